"""Indel similarity of short texts, as Arrow-batched functions; what no built-in expression gives."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit a character of `a`."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = row = (1 << len(a)) - 1
    for c in b:
        hit = row & places.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """2 * common / all characters; 1 for two empty texts."""
    return 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial(a: str, b: str) -> float:
    """The best ratio of the shorter text with a stretch of the longer one, no longer than itself; 0 if it is empty."""
    short, long = sorted((a, b), key=len)
    n = len(short)
    if not n:
        return float(not long)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def _by_pairs(f):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return F.pandas_udf(run, "double")


def fuzzy_ratio(a: str | Column, b: str | Column) -> Column:
    """0..1; null where either is."""
    return _by_pairs(ratio)(a, b)


def partial_ratio(a: str | Column, b: str | Column) -> Column:
    return _by_pairs(partial)(a, b)
