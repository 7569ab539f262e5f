"""Text chunking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def chunked(docs: DataFrame, id_col: str, text_col: str, size: int = 750, overlap: int = 0, trim: bool = False) -> DataFrame:
    """(id_col, chunk, content): windows of `size` characters, each `overlap` into the one before. Empty texts give none;
    with `trim`, chunks are trimmed and blank ones go."""
    if size <= overlap:
        raise ValueError("size must exceed overlap")
    step = size - overlap
    long = docs.where(F.length(text_col) > 0)
    starts = F.sequence(F.lit(0), F.length(text_col) - 1, F.lit(step))
    rows = long.select(id_col, text_col, F.posexplode(starts).alias("chunk", "at"))
    content = F.substring(F.col(text_col), F.col("at") + 1, F.lit(size))
    out = rows.select(id_col, "chunk", (F.trim(content) if trim else content).alias("content"))
    return out.where("content <> ''") if trim else out
