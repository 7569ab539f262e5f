"""Overlap of texts' runs of words, counted as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.stemming import grams


def rouge(pairs: DataFrame, n: int = 1) -> DataFrame:
    """pairs (id, candidate, reference: word arrays) with the shared runs of n words (id, hits, candidates, references, f1): runs
    count as often as both texts hold them, and f1 is 0 where nothing is shared. Runs are counted before they are shuffled, so
    long texts and repeated words cost no more than their distinct runs."""
    side = lambda c, a, b: pairs.select("id", F.explode(grams(F.col(c), n)).alias("gram"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    counts = side("candidate", 1, 0).union(side("reference", 0, 1)).groupBy("id", "gram").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    found = counts.groupBy("id").agg(F.sum(F.least("a", "b")).alias("hits"), F.sum("a").alias("candidates"), F.sum("b").alias("references"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    rows = pairs.select("id").join(found, "id", "left").select("id", zero("hits"), zero("candidates"), zero("references"))
    return rows.withColumn("f1", F.when(F.col("hits") == 0, 0.0).otherwise(2 * F.col("hits") / (F.col("candidates") + F.col("references"))))
