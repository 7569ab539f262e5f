"""Retrieval fusion and ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import settle


def numbered(rows: DataFrame, order: list[str | Column], name: str) -> DataFrame:
    """rows with their place from 1 in an order, which should have no ties: ranges are sorted apart, and each adds the
    number of rows in the ranges before it, so no task sees all rows."""
    split = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order)).withColumn("_part", F.spark_partition_id())
    counts = split.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    starts = counts.select("_part", before.alias("_before"))
    inner = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return split.withColumn("_nth", inner).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + F.col("_nth")).drop("_part", "_nth", "_before")


def ranked(rows: DataFrame, source: str, order: list[Column]) -> DataFrame:
    """A result list with its source and rank from 1."""
    return numbered(rows, order, "rank").withColumn("source", F.lit(source))


def reciprocal_rank_fusion(lists: DataFrame, weights: dict[str, float], k: int = 60) -> DataFrame:
    """lists (source, rank, key, id) fused by the sum of weight / (k + rank) over rows that share a key; a source without a
    weight counts 1. The row of the first list, in the order of the weights, stands for its key."""
    weight, place = F.lit(1.0), F.lit(len(weights))
    for n, (name, w) in enumerate(weights.items()):
        weight = F.when(F.col("source") == name, w).otherwise(weight)
        place = F.when(F.col("source") == name, n).otherwise(place)
    rows = lists.withColumns({"_weight": weight, "_place": place})
    score = F.sum(F.col("_weight") / (k + F.col("rank")))
    return rows.groupBy("key").agg(score.alias("score"), F.min(F.struct("_place", "rank", "id"))["id"].alias("id"), F.count("*").alias("lists")).drop("key")


def adaptive_weights(queries: DataFrame, graph: float = 0.4, vector: float = 0.4) -> DataFrame:
    """queries (id, question_type, n_entities, most_properties) with graph and vector weights that add up to 1."""
    g, v = F.lit(graph), F.lit(vector)
    causal = F.col("question_type").isin("causal", "comparative")
    g, v = g + F.when(causal, 0.15).otherwise(0.0), v - F.when(causal, 0.10).otherwise(0.0)
    some = F.col("n_entities") > 0
    g, v = g + F.when(some, 0.05).otherwise(-0.10), v + F.when(some, 0.0).otherwise(0.15)
    g = g + F.when(F.col("most_properties") > 5, 0.05).otherwise(0.0)
    return queries.select("id", (g / (g + v)).alias("graph_weight"), (v / (g + v)).alias("vector_weight"))


def path_scores(relations: DataFrame, expected: list[str]) -> DataFrame:
    """relations (path_id, rel, confidence) to a score a path: 0.4 mean confidence + 0.45 relevance + 0.15 / length, in
    0..1. Relevance is the share of relations that contain an expected name, 0.5 if none is expected."""
    hit = F.lit(False)
    for name in expected:
        hit = hit | F.contains(F.lower("rel"), F.lit(name.lower()))
    relevance = F.avg(hit.cast("int")) if expected else F.lit(0.5)
    score = 0.4 * F.avg("confidence") + 0.45 * relevance + 0.15 / F.count("*")
    return relations.groupBy("path_id").agg(F.count("*").alias("length"), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)).alias("score"))


def round_robin(rows: DataFrame, group: str, order: str, target: int) -> DataFrame:
    """A sample that takes the groups' rows in turn, groups by their first row."""
    own = Window.partitionBy(group).orderBy(order)
    first = F.min(order).over(Window.partitionBy(group))
    return rows.withColumns({"turn": F.row_number().over(own), "first": first}).orderBy("turn", "first", order).limit(target).drop("first")


def evidence(rows: DataFrame, prefix: int = 150, most: int = 25) -> DataFrame:
    """rows (id, seq, text, score): one for each text prefix, the first seen, then the best scores."""
    first = Window.partitionBy(F.substring("text", 1, prefix)).orderBy("seq")
    return rows.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth").orderBy(F.col("score").desc(), "seq").limit(most)


def positional_scores(rows: DataFrame, order: str, start: float, step: float) -> DataFrame:
    """Scores that fall by a step with each row, never below 0."""
    return numbered(rows, [order], "_nth").withColumn("score", F.greatest(start - step * (F.col("_nth") - 1), F.lit(0.0))).drop("_nth")


def path_breakdown(relations: DataFrame, expected: list[str]) -> DataFrame:
    """As `path_scores`, with the parts that a score is made of: (path_id, length, confidence, relevance, brevity, score)."""
    hit = F.lit(False)
    for name in expected:
        hit = hit | F.contains(F.lower("rel"), F.lit(name.lower()))
    relevance = F.avg(F.coalesce(hit, F.lit(False)).cast("int")) if expected else F.lit(0.5)
    rows = relations.groupBy("path_id").agg(F.count("*").alias("length"), (0.4 * F.avg("confidence")).alias("confidence"), (0.45 * relevance).alias("relevance"), (0.15 / F.count("*")).alias("brevity"))
    return rows.withColumn("score", F.least(F.greatest(F.col("confidence") + F.col("relevance") + F.col("brevity"), F.lit(0.0)), F.lit(1.0)))
