"""Mixing sources to target token counts by entropy balancing, with DataFrame operations only.

Each document has a rate near 1 (relative entropy) under one token constraint a source. The dual's solution tilts rates
exponentially by size, min(2, exp(dual * size / mean size)); one dual variable a source is found by Newton steps kept in
a bracket, each step one aggregation over the (source, size) histogram. Rates are then rounded into 0, 1 or 2 copies by
cumulative rounding along sizes, so a source misses its target by about one document at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, table

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BUCKETS, NEWTON, EXACT = 1024, 12, 1e-7  # after so many Newton steps the bracket is halved


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, docs) with its target: weights cycle over sources by code point, null last; targets are
    capped at `most` times the source's size and the excess is reshared by weight until none is above its cap."""
    everything = Window.partitionBy()
    ranked = sizes.withColumn("nth", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("nth") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumns({"weight": cycle.cast("double"), "cap": most * F.col("source_size").cast("double")})
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "nth")
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    total = share * F.sum(F.col("source_size").cast("double")).over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    levels = ranked.withColumn("level", level).withColumn("free", F.col("level") < F.col("cap") / F.col("weight"))
    water = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("weight"), "nth", "level"))).over(everything)["level"]
    return levels.select(
        "source", "source_size", "docs", F.least("cap", F.coalesce(water * F.col("weight"), F.col("cap"))).alias("target")
    )


def tilts(histogram: DataFrame, targets: DataFrame, most: float = MOST) -> DataFrame:
    """(key, dual) for each source: min(most, exp(dual * size / mean)) summed over its documents' words is its target, to EXACT,
    or as near as doubles allow."""
    mean = F.col("source_size") / F.col("docs")
    live = targets.where("source_size > 0").select(
        "key",
        "source_size",
        "target",
        mean.alias("mean"),
        F.lit(0.0).alias("dual"),
        (-mean * F.greatest(F.log(F.col("source_size") / F.col("target")), F.lit(0.0)) - 1e-9).alias("low"),
        (mean * F.log(F.lit(most)) + 1e-9).alias("high"),
        F.lit(1.0).alias("miss"),
    )
    state = cut(live)
    turn = 0
    while True:
        turn += 1
        x = F.col("size") / F.col("mean")
        rate = F.exp(F.least(F.col("dual") * x, F.log(F.lit(most))))
        words = F.col("n") * F.col("size") * rate
        sums = histogram.join(state, "key").groupBy("key").agg(
            F.sum(words).alias("words"), F.sum(F.when(F.col("dual") * x < F.log(F.lit(most)), words * x).otherwise(0.0)).alias("slope")
        )
        over = F.col("words") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("dual")), F.when(over, F.col("dual")).otherwise(F.col("high"))
        step = F.col("dual") - (F.col("words") - F.col("target")) / F.nullif(F.col("slope"), F.lit(0.0))
        inside = step.isNotNull() & (step > F.col("low")) & (step < F.col("high")) & F.lit(turn <= NEWTON)
        state = cut(
            state.join(sums, "key")
            .withColumns({"miss": F.abs(F.col("words") / F.col("target") - 1), "low": low, "high": high})
            .withColumn("dual", F.when(F.col("miss") <= EXACT, F.col("dual")).when(inside, step).otherwise((F.col("low") + F.col("high")) / 2))
            .select(*live.columns)
        )
        wide = F.col("high") - F.col("low") > 1e-15 * (1 + F.abs("high") + F.abs("low"))
        if state.where((F.col("miss") > EXACT) & wide).isEmpty():
            break
    return state.select("key", "dual", "mean")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, source, size, source_size, target, copies) of every row.

    Null texts have size 0 and null sources are one source. Documents of size 0 are taken once and count nothing. Equal
    sizes in a source have equal rates; which of them gets the extra copy follows a hash of the id, so reruns agree;
    repeated rows are separate documents. An empty table gives an empty result.
    """
    name = F.col(source_col).cast("string")
    rows = cut(
        docs.select(
            F.col(id_col).alias("id"),
            name.alias("source"),
            F.coalesce(F.concat(F.lit("s"), name), F.lit("n")).alias("key"),
            word_count(F.col(text_col)).alias("size"),
            F.pmod(F.xxhash64(F.col(id_col)), F.lit(BUCKETS)).alias("bucket"),
        )
    )
    dealt = rows.groupBy("key", "source", "size", "bucket").agg(F.count("*").alias("n"))
    histogram = cut(dealt.groupBy("key", "source", "size").agg(F.sum("n").alias("n")))
    sizes = histogram.groupBy("key", "source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("docs"))
    targets = cut(source_targets(sizes).withColumn("key", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))))
    rate = F.exp(F.least(F.col("dual") * F.col("size") / F.col("mean"), F.log(F.lit(MOST))))
    rated = histogram.join(tilts(histogram, targets), "key", "left").select(
        "key", "size", "n", F.when(F.col("size") == 0, 1.0).otherwise(F.coalesce(rate, F.lit(0.0))).alias("rate")
    )
    rated = rated.withColumn("whole", F.floor(F.col("rate") + 1e-12)).withColumn("part", F.greatest(F.col("rate") - F.col("whole"), F.lit(0.0)))
    along = Window.partitionBy("key").orderBy(F.col("size").desc())
    reach = F.round(F.sum(F.col("part") * F.col("n")).over(along)).cast("long")
    extra = rated.withColumn("reach", reach).withColumn("extra", F.col("reach") - F.coalesce(F.lag("reach").over(along), F.lit(0)))
    inner = Window.partitionBy("key", "size").orderBy("bucket")
    upto = F.sum("m").over(inner)
    shared = (
        dealt.select("key", "size", "bucket", F.col("n").alias("m"))
        .join(extra.select("key", "size", "n", "whole", "extra"), ["key", "size"])
        .withColumn("upto", upto)
        .select(
            "key",
            "size",
            "bucket",
            "whole",
            (F.expr("extra * upto div n") - F.expr("extra * (upto - m) div n")).alias("more"),
        )
    )
    nth = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("id"))
    return (
        rows.join(shared, ["key", "size", "bucket"])
        .withColumn("copies", F.col("whole") + (nth <= F.col("more")).cast("long"))
        .join(targets.select("key", "source_size", "target"), "key")
        .select("id", "source", "size", "source_size", "target", "copies")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken")
    )
