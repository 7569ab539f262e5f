"""Approximate nearest neighbours by an inverted multi-index.

Both halves of the vectors are quantised by codebooks of their own; a vector lies in the cell of its pair of centroids. A
query takes pairs in order of their summed inner products, largest first, off a heap, until the cells taken hold the
share of all rows that trials on the sample needed for the wanted recall; what lies in them is ranked by exact inner
products. Cells are stored in blocks by their first centroid, and a query goes to a block with one bit for each second
centroid, so blocks of queries meet blocks of vectors in matrix products.

Equal vectors are one entry with its smallest ids, so copies cost nothing and ties come out by id.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, sampled, table

CENTROIDS = 64  # of each half; one bit each in a query's mask
SAMPLE, TRIALS, RECALL = 20_000, 400, 0.97  # vectors and queries that the index is fitted and tried on
BLOCK, QUERIES = 2_048, 256  # vectors and queries in a block
SALTS = 64


class Index(NamedTuple):
    first: np.ndarray  # (CENTROIDS, half)
    second: np.ndarray
    share: float  # of all rows that a query looks at


def codebook(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    centres = rows[np.random.default_rng(5).permutation(len(rows))[:k]].copy()
    for _ in range(rounds):
        own = nearest(rows, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, rows)
        n = np.bincount(own, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(rows: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(1) - 2 * rows @ centres.T).argmin(1)


def fit(rows: np.ndarray, top: int) -> Index:
    """Codebooks of the sample, and the share of rows within which RECALL of its trial queries' nearest lie."""
    half = rows.shape[1] // 2
    first, second = codebook(rows[:, :half], CENTROIDS), codebook(rows[:, half:], CENTROIDS)
    quantised = np.hstack([first[nearest(rows[:, :half], first)], second[nearest(rows[:, half:], second)]])
    needed = []
    for i in np.linspace(0, len(rows) - 1, min(TRIALS, len(rows))).astype(int):
        exact, rough = rows @ rows[i], quantised @ rows[i]
        exact[i] = -np.inf
        best = np.argsort(-exact, kind="stable")[: min(top, len(rows) - 1)]
        needed.append(len(rows) - np.searchsorted(np.sort(rough), rough[best], "left"))
    needed = np.concatenate(needed) if needed else np.zeros(0)
    return Index(first, second, float(np.quantile(needed, RECALL)) / len(rows) if len(needed) else 1.0)


def traversal(index: Index, sizes: np.ndarray, query: np.ndarray, wanted: float) -> dict[int, int]:
    """Pairs of centroids in order of summed inner product until their cells hold `wanted` rows: for each first centroid
    a bit for each second one."""
    half = index.first.shape[1]
    a, b = index.first @ query[:half], index.second @ query[half:]
    left, right = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
    heap, taken, masks = [(-(a[left[0]] + b[right[0]]), 0, 0)], 0, {}
    while heap and taken < wanted:
        _, i, j = heapq.heappop(heap)
        n = sizes[left[i], right[j]]
        if n:
            taken += n
            masks[int(left[i])] = masks.get(int(left[i]), 0) | 1 << int(right[j])
        if j + 1 < len(right):
            heapq.heappush(heap, (-(a[left[i]] + b[right[j + 1]]), i, j + 1))
        if j == 0 and i + 1 < len(left):
            heapq.heappush(heap, (-(a[left[i + 1]] + b[right[0]]), i + 1, 0))
    return masks


def stacked(column: pa.Array) -> np.ndarray:
    values = np.frombuffer(b"".join(column.to_pylist()), "<f8")
    return values.reshape(len(column), -1)


def search(vectors: DataFrame, is_query, top: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the `top` largest inner products found for each row that the condition selects, among
    all rows with another id; nearest first, ties by smaller id.

    Vectors that are null, zero, or hold null or non-finite components take no part; nor do null ids, or vectors of
    no length. Shorter vectors are compared as if they went on with zeros. Repeated rows count once. Scores are double precision on the given vectors.
    An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    value = F.col(vector_col).cast("array<double>")
    sound = F.col(id_col).isNotNull() & value.isNotNull() & F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(value, lambda x: x != 0)
    rows = vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), value.alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    rows = rows.withColumn("v", F.concat("v", F.array_repeat(F.lit(0.0), F.lit(width) - F.size("v"))))
    picked = sampled(rows.select("id", "v"), SAMPLE).select("v").toArrow()["v"].to_pylist()
    result = "query_id long, rank int, id long, score double"
    if not picked:
        return spark.createDataFrame([], result)
    index = fit(np.array(picked), top)

    copies = Window.partitionBy("v", "salt").orderBy("id")
    same = Window.partitionBy("v").orderBy("id")
    distinct = rows.groupBy("id", "v").agg(F.max("asks").alias("asks"))
    few = (
        distinct.select("id", "v", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt"))
        .withColumn("nth", F.row_number().over(copies))
        .where(F.col("nth") <= top + 1)
        .withColumn("nth", F.row_number().over(same))
        .where(F.col("nth") <= top + 1)
    )
    entries = few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("entry"), "ids", "v")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = index.first.shape[1]
        for batch in batches:
            v = batch.column(2).values.to_numpy(zero_copy_only=False)[batch.column(2).offsets[0].as_py() :].reshape(batch.num_rows, -1) if batch.num_rows else np.zeros((0, width))
            i, j = nearest(v[:, :half], index.first), nearest(v[:, half:], index.second)
            raw = pa.array([x.astype("<f8").tobytes() for x in v], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), raw], ["entry", "ids", "i", "j", "raw"])

    placed = cut(entries.mapInArrow(place, "entry long, ids array<long>, i int, j int, raw binary"))
    sizes = np.zeros((len(index.first), len(index.second)), np.int64)
    for r in placed.groupBy("i", "j").count().collect():  # at most CENTROIDS ** 2 rows
        sizes[r["i"], r["j"]] = r["count"]
    total = int(sizes.sum())
    named = entries.select("entry", "v")
    asking = cut(distinct.where("asks").join(named, "v").select(F.col("id").alias("query_id"), "entry"))
    asked = cut(placed.join(asking.select("entry").distinct(), "entry").select("entry", "raw"))
    wanted = max(index.share * total, 5 * (top + 1))

    def traverse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for entry, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                out += [(entry, raw, i, m - (1 << 64) if m >> 63 else m) for i, m in traversal(index, sizes, np.frombuffer(raw, "<f8"), wanted).items()]
            kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, kinds, strict=True)], ["entry", "raw", "i", "mask"])

    parts = np.maximum(-(-sizes.sum(1) // BLOCK), 1)
    groups = max(1, -(-asked.count() // QUERIES))
    blocks_of = F.element_at(F.array(*[F.lit(int(x)) for x in parts]), F.col("i") + 1)
    lists = placed.withColumn("block", F.pmod(F.xxhash64("entry"), blocks_of)).groupBy("i", "block").agg(F.collect_list(F.struct("entry", "j", "raw")).alias("held"))
    visits = asked.mapInArrow(traverse, "entry long, raw binary, i int, mask long").withColumn("part", F.pmod(F.xxhash64("entry"), F.lit(groups)))
    visits = visits.groupBy("i", "part").agg(F.collect_list(F.struct("entry", "mask", "raw")).alias("asked"))

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for held, asks in zip(batch.column(0), batch.column(1), strict=True):
                held, asks = pa.Table.from_struct_array(held.values), pa.Table.from_struct_array(asks.values)
                v, q = stacked(held["raw"]), stacked(asks["raw"])
                seen = (asks["mask"].to_numpy()[:, None] >> held["j"].to_numpy().astype(np.int64)[None]) & 1 == 1
                rough = np.where(seen, q @ v.T, -np.inf)
                if v.shape[0] > top + 1:
                    least = np.partition(rough, -(top + 1), axis=1)[:, -(top + 1)]
                    slack = 1e-9 * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
                    seen &= rough >= (least - slack)[:, None]
                a, b = np.nonzero(seen)
                exact = np.concatenate([(q[a[k : k + 4096]] * v[b[k : k + 4096]]).sum(1) for k in range(0, len(a), 4096)]) if len(a) else np.zeros(0)
                yield pa.RecordBatch.from_arrays([asks["entry"].combine_chunks().take(pa.array(a)), held["entry"].combine_chunks().take(pa.array(b)), pa.array(exact)], ["asker", "entry", "score"])

    met = visits.join(lists, "i").select("held", "asked").mapInArrow(rerank, "asker long, entry long, score double")
    by_score = Window.partitionBy("asker").orderBy(F.col("score").desc(), "entry")
    near = met.withColumn("nth", F.row_number().over(by_score)).where(F.col("nth") <= top + 1).select("asker", "entry", "score")
    near = near.join(placed.select("entry", "ids"), "entry").select("asker", "score", F.explode("ids").alias("id"))
    by_id = Window.partitionBy("asker").orderBy(F.col("score").desc(), "id")
    near = near.withColumn("nth", F.row_number().over(by_id)).where(F.col("nth") <= top + 1).select("asker", "score", "id")
    found = asking.join(near, asking["entry"] == near["asker"]).where("id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")))
    return ranked.where(F.col("rank") <= top).select("query_id", "rank", "id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")
