"""Training-data operators: scoring, filtering, deduplication, mixing, search, formatting and packing.

Nothing outside this subpackage imports it.
"""
