"""Vector code compression: product quantisation in whole numbers, by Lloyd's rounds with Hamerly's bounds.

Beside its codes, each vector keeps for every part an upper bound of the distance to its entry and a lower bound of the
distance to the second nearest. After entries have moved, the bounds move with them, and a part whose upper bound is
strictly under its lower bound (or under half the way from its entry to the next one) can't have changed. Other parts get
their exact distance, and if that doesn't settle it, a scan of all entries in whole numbers, where the lower index wins ties.
Bounds are widened in rounding, so codes are those of plain scans.

A round reads the table of vectors, codes and bounds, and writes the next one; sums and counts of entries change by what
the parts that moved add and take away, one row a partition, so only numbers of codebook size reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop, keep, shared_folder, table

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
SALTS = 32  # into which rows of one label are dealt when their sum is joined to them
SMALL = 1 << 26  # below this, squared distances of 64-bit numbers can't overflow; above, Python's integers are taken
BLOCK = 2_048
UP, DOWN = 1 + 2.0**-48, 1 - 2.0**-48
LARGEST = np.finfo(np.float32).max


class Codes(NamedTuple):
    rows: DataFrame  # (id, label, code, error): code holds a byte a part
    codebooks: np.ndarray  # (parts, entries, width) of whole numbers


def whole(column: pa.Array, parts: int, width: int, scale: int) -> np.ndarray:
    """Vectors as floor(scale * x), cut into parts of one width and filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(column), parts * width))
    out[np.arange(parts * width) < lengths[:, None]] = np.floor(flat * scale)
    small = not out.size or np.abs(out).max() < SMALL
    out = out.astype(np.int64) if small else np.array([int(x) for x in out.ravel()], object).reshape(out.shape)
    return out.reshape(len(column), parts, width)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances (..., entries) of points (..., width), exact."""
    gap = x[..., None, :] - entries
    return (gap * gap).sum(-1)


def root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(np.float64))


def half_ways(book: np.ndarray) -> np.ndarray:
    """(parts, entries): at most half the distance from an entry to the nearest other one."""
    apart = root(squares(book, book[:, None]))
    apart[:, np.arange(book.shape[1]), np.arange(book.shape[1])] = np.inf
    return apart.min(-1) / 2 * DOWN


class Moves(NamedTuple):
    """How far entries have moved since the bounds were taken: (parts, entries), and the furthest of the others."""

    own: np.ndarray
    others: np.ndarray

    @staticmethod
    def between(old: np.ndarray, new: np.ndarray) -> Moves:
        gap = new - old
        own = root((gap * gap).sum(-1)) * UP
        first = own.argmax(1)
        rest = own.copy()
        rest[np.arange(len(own)), first] = 0.0
        others = np.repeat(own.max(1)[:, None], own.shape[1], 1)
        others[np.arange(len(own)), first] = rest.max(1)
        return Moves(own, others)


def settled(x: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: np.ndarray, half: np.ndarray) -> int:
    """Bring codes and bounds of vectors (n, parts, width) up to date in place; how many parts were scanned in full."""
    scans = 0
    for p in range(book.shape[0]):
        bar = np.maximum(half[p][code[:, p]], lower[:, p])
        doubtful = np.flatnonzero(~(upper[:, p] < bar))
        if not len(doubtful):
            continue
        gap = x[doubtful, p] - book[p][code[doubtful, p]]
        upper[doubtful, p] = root((gap * gap).sum(-1)) * UP
        doubtful = doubtful[~(upper[doubtful, p] < bar[doubtful])]
        scans += len(doubtful)
        for at in range(0, len(doubtful), BLOCK):
            some = doubtful[at : at + BLOCK]
            far = squares(x[some, p], book[p])
            best = far.argmin(1)  # the first of equal ones
            code[some, p] = best
            upper[some, p] = root(far[np.arange(len(some)), best]) * UP
            rest = root(far) * DOWN
            rest[np.arange(len(some)), best] = np.inf
            lower[some, p] = rest.min(1)
    return scans


def stored(bounds: np.ndarray, up: bool) -> pa.Array:
    """Bounds of four bytes, rounded to the safe side."""
    near = np.minimum(bounds, LARGEST).astype(np.float32)
    near = np.nextafter(near, np.float32(np.inf)) if up else np.maximum(np.nextafter(near, np.float32(-np.inf)), np.float32(0))
    return binaries(near)


def binaries(rows: np.ndarray) -> pa.Array:
    size = rows.shape[1] * rows.itemsize
    offsets = pa.py_buffer(np.arange(0, (len(rows) + 1) * size, size, dtype=np.int32).tobytes() if size else np.zeros(len(rows) + 1, np.int32).tobytes())
    return pa.BinaryArray.from_buffers(pa.binary(), len(rows), [None, offsets, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def numbers(column: pa.Array, kind: type, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), parts).copy()


def kept_vectors(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    v = F.col(vector_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(v.isNotNull() & finite, F.lit(False))).select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("v"))


def compress(
    vectors: DataFrame,
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    scale: int = SCALE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
) -> Codes:
    """Codes of all vectors, and the codebooks.

    Vectors that are null or hold null or non-finite components are left out. Codebooks start from the rows of the smallest
    ids (null ids last, equal ids by their vectors); with fewer rows than entries there are fewer entries. Equal distances go
    to the lower entry, entries without parts stay as they are, repeated rows count each. A vector whose length is not that
    of the longest, or no multiple of the parts, is filled up with zeros. Errors that don't fit 64 bits are null. An empty
    table gives no rows and empty codebooks. Columns other than the three named are not looked at.
    """
    spark = vectors.sparkSession
    shared_folder(spark)
    rows = kept_vectors(vectors, id_col, vector_col, label_col)
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    width = -(-longest // parts)
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).select("v").toArrow()["v"].combine_chunks()
    book = whole(first if isinstance(first, pa.Array) else pa.concat_arrays(first.chunks), parts, width, scale).transpose(1, 0, 2)
    k = book.shape[1]
    kinds = {n: rows.schema[n].dataType.simpleString() for n in ("id", "label", "v")}
    state = f"id {kinds['id']}, label {kinds['label']}, v {kinds['v']}, code binary, upper binary, lower binary, sums array<decimal(38,0)>"
    names = ["id", "label", "v", "code", "upper", "lower", "sums"]
    sums_kind = pa.list_(pa.decimal128(38, 0))

    def updated(batch: pa.RecordBatch, book: np.ndarray, half: np.ndarray, moves: Moves | None) -> tuple[np.ndarray, ...]:
        """(vectors, codes before or None, codes, upper, lower) of a batch."""
        x = whole(batch.column(2), parts, width, scale)
        if moves is None:
            before, code = None, np.zeros((len(x), parts), np.uint8)
            upper, lower = np.full((len(x), parts), np.inf), np.zeros((len(x), parts))
        else:
            before = numbers(batch.column(3), np.uint8, parts)
            code, at = before.copy(), np.arange(parts)
            upper = (numbers(batch.column(4), np.float32, parts) + moves.own[at, code]) * UP
            lower = np.maximum((numbers(batch.column(5), np.float32, parts) - moves.others[at, code]) * DOWN, 0)
        settled(x, code, upper, lower, book, half)
        return x, before, code, upper, lower

    def round_of(book: np.ndarray, moves: Moves | None):
        half = half_ways(book)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            change = np.zeros((parts, k, width + 1), object)  # sums of components, then the count
            for batch in batches:
                if not batch.num_rows:
                    continue
                x, before, code, upper, lower = updated(batch, book, half, moves)
                for p in range(parts):
                    moved = np.arange(len(x)) if before is None else np.flatnonzero(before[:, p] != code[:, p])
                    for e in range(k):
                        for sign, codes in ((1, code), (-1, before)):
                            own = moved[codes[moved, p] == e] if codes is not None else moved[:0]
                            if len(own):
                                change[p, e, :width] += sign * x[own, p].sum(0)
                                change[p, e, width] += sign * len(own)
                none = pa.nulls(batch.num_rows, sums_kind)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], binaries(code), stored(upper, True), stored(lower, False), none], names)
            flat = pa.array([[Decimal(int(c)) for c in change.ravel()]], sums_kind)
            types = [pa.null() if t is None else t for t in own_types]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, t) for t in types], *[pa.nulls(1, pa.binary())] * 3, flat], names)

        return run

    own_types = [f.type for f in rows.limit(0).toArrow().schema]
    if not k:
        return Codes(spark.createDataFrame([], f"id {kinds['id']}, label {kinds['label']}, code binary, error long"), book)
    sums, moves, held = np.zeros((parts, k, width + 1), object), None, None
    for _ in range(rounds):
        source = rows if held is None else held.where("code is not null").drop("sums")
        after = keep(source.mapInArrow(round_of(book, moves), state))
        changes = after.where("sums is not null").select(F.posexplode("sums").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect()  # of codebook size
        for r in changes:
            sums.ravel()[r["at"]] += int(r["x"])
        if held is not None:
            drop(held)
        held = after
        new = np.array([[(s[:width] // s[width]) if s[width] else b for s, b in zip(*pair, strict=True)] for pair in zip(sums, book, strict=True)], object).reshape(book.shape)
        small = not new.size or max(abs(c) for c in new.ravel()) < SMALL
        new = new.astype(np.int64) if small else new
        moves, book = Moves.between(book, new), new

    half = half_ways(book)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, _, code, _, _ = updated(batch, book, half, moves)
            gap = x - book[np.arange(parts), code]
            error = (gap * gap).sum((1, 2))
            error = pa.array(error) if error.dtype == np.int64 else pa.array([e if e < 2**63 else None for e in error], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), binaries(code), error], ["id", "label", "code", "error"])

    source = rows if held is None else held.where("code is not null").drop("sums")
    coded = keep(source.mapInArrow(finish, f"id {kinds['id']}, label {kinds['label']}, code binary, error long"))
    if held is not None:
        drop(held)
    return Codes(coded, book)


def decoded(codes: Codes, scale: int = SCALE) -> DataFrame:
    """(id, v): the vectors that codes stand for."""
    book = codes.codebooks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = numbers(batch.column(1), np.uint8, len(book))
            v = book[np.arange(len(book)), code].reshape(len(code), -1).astype(np.float64) / scale
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(v), pa.list_(pa.float64()))], ["id", "v"])

    rows = codes.rows.select("id", "code")
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>")


def label_errors(rows: DataFrame) -> DataFrame:
    """Rows with the errors of their label added up, nulls being one label. A label's sum goes to its rows in salted parts, so a
    frequent one is not one task."""
    name = F.coalesce(F.concat(F.lit("l"), F.col("label").cast("string")), F.lit("n"))
    named = rows.withColumns({"name": name, "salt": F.pmod(F.xxhash64("id", "code"), F.lit(SALTS))})
    sums = named.groupBy("name", "salt").agg(F.sum("error").alias("error")).groupBy("name").agg(F.sum("error").alias("label_error"))
    spread = sums.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return named.join(spread, ["name", "salt"]).drop("name", "salt")


def codebooks_sha256(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in codebooks.ravel()).encode()).hexdigest()


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = compress(table(spark, sf_dir, "embeddings"))
    rows = label_errors(made.rows)
    return rows.select(F.col("id").alias("vec_id"), F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(codebooks_sha256(made.codebooks)).alias("codebooks_sha256"))


def _sql() -> str:
    """The same codes by plain scans, a round after the other."""
    steps = [
        f"""r AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, embedding FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""x AS MATERIALIZED (SELECT r, i // (len(embedding) // {PARTS}) AS part, i % (len(embedding) // {PARTS}) AS pos,
            CAST(floor({SCALE} * CAST(embedding[i + 1] AS DOUBLE)) AS HUGEINT) AS x FROM (SELECT r, embedding, unnest(range(len(embedding))) AS i FROM r))""",
        f"b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x AS c FROM x WHERE r <= {ENTRIES})",
    ]
    for n in range(ROUNDS + 1):
        steps.append(f"""a{n} AS MATERIALIZED (SELECT r, part, CAST(min(struct_pack(d := d, e := entry)).e AS BIGINT) AS entry, min(d) AS d FROM (
            SELECT r, part, entry, sum((x - c) * (x - c)) AS d FROM x JOIN b{n} USING (part, pos) GROUP BY ALL) GROUP BY r, part)""")
        if n < ROUNDS:
            steps.append(f"""b{n + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - (s % n + n) % n) // n, c) AS c FROM b{n} LEFT JOIN (
                SELECT part, entry, pos, CAST(sum(x) AS HUGEINT) AS s, CAST(count(*) AS HUGEINT) AS n FROM x JOIN a{n} USING (r, part) GROUP BY ALL) USING (part, entry, pos))""")
    last = f"""coded AS (SELECT r, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY r),
        books AS (SELECT sha256(string_agg(CAST(c AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256 FROM b{ROUNDS})
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded JOIN r USING (r), books"""
    return "WITH " + ",\n".join(steps) + ",\n" + last


SQL = _sql()
