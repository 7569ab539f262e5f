"""Vectorised word scanning and hashing of Arrow string columns.

A column's UTF-8 bytes are taken in blocks of whole texts; words are runs of bytes other than space and 0x09-0x0D.
A word's hash is a polynomial over randomly mapped bytes modulo 2**64, read off prefix sums, then mixed.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_VALUES = np.random.default_rng(20240613).integers(1, 2**63, 256, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 2**64)
LONG_WORD = 256
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64; kept for later calls."""
    if not _powers or len(_powers[0]) <= n:
        size = max(1 << 20, 1 << (n + 1).bit_length())
        _powers[:] = []
        for base in (BASE, BASE_INVERSE):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers.append(np.multiply.accumulate(steps))
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Entry i: the polynomial over the first i bytes."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(len(data))[0][: len(data)], out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the byte spans [start, end); equal bytes have equal hashes wherever they stand."""
    return mix((sums[ends] - sums[starts]) * powers(len(sums))[1][starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of words. Polynomials modulo 2**64 give some pairs of strings of a thousand bytes one value, so words of more than
    LONG_WORD bytes are hashed by themselves."""
    h = span_hashes(prefix_sums(data), starts, ends)
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        h[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), 7)
    return h


class Block(NamedTuple):
    """Whole texts in a row: rows [first, last) of a column, their bytes, and each one's offset (one more at the end)."""

    first: int
    last: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and row (from 0 in the block) of each word."""
        n = len(self.data)
        if not n:
            return (np.zeros(0, np.int64),) * 3
        inside = ~SPACE[self.data]
        edge = np.zeros(n + 1, bool)
        edge[self.offsets] = True
        first = inside.copy()
        first[1:] &= ~inside[:-1] | edge[1:n]
        last = inside
        last[:-1] &= ~inside[1:] | edge[1:n]
        starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        return starts, ends, np.searchsorted(self.offsets[1:], starts, "right")


def blocks(column: pa.Array | pa.ChunkedArray, most: int = 1 << 18) -> Iterator[Block]:
    """Cut a string column into blocks of at most `most` bytes, or of one longer text; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield Block(first, last, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])
        first = last


def packed_texts(rows: DataFrame) -> DataFrame:
    """Rows (..., text) with the text as zstandard bytes in `packed`, which halves what a shuffle writes."""
    names = rows.columns[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(1).compress
        for batch in batches:
            packed = pa.array([pack(x.as_buffer()) for x in batch.column(len(names)).cast(pa.binary())], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], packed], [*names, "packed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(run, f"{kinds}, packed binary")


def unpacked(column: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(x.as_buffer()) for x in column)
