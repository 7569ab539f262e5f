"""Long lists of a key's items as rows of bounded length."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import settle


def paged(rows: DataFrame, key: str, order: str, item: str, size: int = 1_000) -> DataFrame:
    """rows as (key, page from 0, items): each key's items by order, `size` in each page but the last. Ranges of (key, order) are
    numbered apart, so a key that holds any share of all rows is spread over tasks and no list is longer than a page; rows of one
    key and order lie in one range and are ordered by item. Null keys and orders come first, null items are kept as items; an empty table gives no pages."""
    place = [F.col("key"), F.col("order"), F.col("item")]
    plain = rows.select(F.col(key).alias("key"), F.col(order).alias("order"), F.struct(F.col(item).alias("value")).alias("item"))
    split = settle(plain.repartitionByRange("key", "order")).withColumn("part", F.spark_partition_id())
    within = F.row_number().over(Window.partitionBy("part").orderBy(*place))
    near = split.withColumn("nth", within)

    # What spans ranges: a row a range, however long the keys' lists are.
    at = F.struct("key", (-F.col("nth")).alias("back"))
    ends = near.groupBy("part").agg(F.count("*").alias("n"), F.min(F.struct("key")).alias("first"), F.max(at).alias("last"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = ends.withColumn("before", before)
    opened = ends.groupBy(F.struct("last.key").alias("open")).agg(F.min(F.col("before") - F.col("last.back")).alias("opens"), F.min("part").alias("by"))
    carried = ends.join(opened, ends["first"].eqNullSafe(opened["open"]) & (F.col("by") < F.col("part")), "left").select("part", "before", F.col("first.key").alias("head"), "opens")

    own = F.min(F.col("before") + F.col("nth")).over(Window.partitionBy("part", "key"))
    start = F.when(F.col("key").eqNullSafe(F.col("head")) & F.col("opens").isNotNull(), F.col("opens")).otherwise(own)
    numbered = near.join(F.broadcast(carried), "part").withColumn("start", start).withColumn("offset", F.col("before") + F.col("nth") - F.col("start"))
    listed = numbered.groupBy("key", F.floor(F.col("offset") / size).alias("page")).agg(F.array_sort(F.collect_list(F.struct("offset", "item"))).alias("found"))
    return listed.select(F.col("key").alias(key), "page", F.transform("found", lambda x: x["item"]["value"]).alias("items"))


def distinct_pages(rows: DataFrame, key: str, item: str, size: int = 1_000) -> DataFrame:
    """Each key's distinct items, sorted, in pages."""
    return paged(rows.select(key, item).distinct().withColumn("_order", F.col(item)), key, "_order", item, size)
