"""The registered queries and their SQL."""

from tessera.plans import alignment, analytics, details, exports, graphs, nested, ontology, patterns, quality, records, reviews, search, tools, versions  # noqa: F401
from tessera.plans.registered import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
