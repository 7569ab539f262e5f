"""Sharding by proportional stratified interleaving.

Rows are shuffled within their source by a seeded hash and ranked; the k-th of n rows of a source stands at the fraction
(k - 1 + shift) / n of the whole, the shift in (0, 1) being the source's own, so that small sources don't meet in one place.
All rows in order of their fractions are cut into shards of equal numbers of rows, and each shard holds each source's share
of the mixture but for a row or two.

Ranks come from counts of ranges: a source's hashes, and later all fractions, are cut into ranges of equal width, whose
counts add up to where each range starts; only rows of one range are put in order by one task. Rows equal in id, source
and text are one entry with a count until their fractions are known, so no group of copies lands in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop, keep, table

SHARDS, SEED, OVERHEAD = 40, 42, 16
RANGES, ROWS_A_RANGE = 1024, 50_000  # at least so many ranges, and as many as keep them this small
ENTRY = ["stratum", "h", "id", "size", "crc"]


def stratum(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def entry_columns(id_col: str, text_col: str, source_col: str, seed: int) -> dict[str, Column]:
    """What tells entries apart, besides the text itself: 64 bits of hash, 32 of checksum, the size and the id."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return {
        "stratum": stratum(F.col(source_col)),
        "h": F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col), text), 1),
        "id": F.col(id_col),
        "size": (F.octet_length(text) + OVERHEAD).cast("long"),
        "crc": F.crc32(text.cast("binary")),
    }


def starts(counts: DataFrame, key: list[str], place: str) -> DataFrame:
    """(key, place, before): how many rows lie in the ranges of a key before each one."""
    before = Window.partitionBy(*key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*key, place, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))


def assign(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> DataFrame:
    """(stratum, h, id, size, crc, shard, slot), a row for every row; slots are gapless from 0 in each shard.

    Null texts are empty, null sources are one source, null ids are allowed. Repeated rows are rows of their own next to
    each other in their source's shuffle. Numbers of rows are at most one apart; with fewer rows than shards some shards
    are empty, and an empty table gives an empty result. Order depends on the seed, ids, texts and sources alone.
    """
    entries = keep(docs.select(*[c.alias(k) for k, c in entry_columns(id_col, text_col, source_col, seed).items()]).groupBy(*ENTRY).agg(F.count("*").alias("n")))
    total = entries.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    ranges = max(RANGES, total // ROWS_A_RANGE)
    in_range = F.shiftrightunsigned(F.shiftrightunsigned("h", 23) * F.lit(ranges), 40).alias("range")  # 40 bits of 63

    counts = cut(entries.groupBy("stratum", in_range).agg(F.sum("n").alias("n")))
    sizes = counts.groupBy("stratum").agg(F.sum("n").alias("source_rows"))
    places = starts(counts, ["stratum"], "range").join(sizes, "stratum")
    upto = Window.partitionBy("stratum", "range").orderBy("h", F.col("id").asc_nulls_first(), "size", "crc").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = entries.withColumn("range", in_range).withColumn("upto", F.sum("n").over(upto)).join(places, ["stratum", "range"])
    first = F.col("before") + F.col("upto") - F.col("n")
    shift = (F.pmod(F.xxhash64(F.lit(seed), "stratum"), F.lit(1 << 20)) + 0.5) / (1 << 20)
    each = ranked.select(*ENTRY, "source_rows", F.explode(F.sequence(first, first + F.col("n") - 1)).alias("rank"))
    placed = each.withColumn("fraction", (F.col("rank") + shift) / F.col("source_rows"))
    placed = keep(placed.select(*ENTRY, "rank", "fraction", F.floor(F.col("fraction") * ranges).alias("range")))

    counts = cut(placed.groupBy("range").agg(F.count("*").alias("n")))
    within = F.row_number().over(Window.partitionBy("range").orderBy("fraction", "stratum", "rank"))
    position = F.col("before") + within - 1
    whole = F.lit(max(total, 1))
    out = placed.join(starts(counts, [], "range"), "range").withColumn("position", position)
    out = out.withColumn("shard", F.expr(f"cast(position * {shards} div {max(total, 1)} as int)"))
    begin = F.ceil(F.col("shard").cast("decimal(20,0)") * whole / shards).cast("long")  # the first position of the shard
    out = keep(out.select(*ENTRY, "shard", (F.col("position") - begin).alias("slot")))
    drop(entries, placed)
    return out


def write(docs: DataFrame, path: str, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED) -> None:
    """Shards as folders of Parquet under a path, rows (id, text, source, slot) in order of their slots within each file."""
    columns = entry_columns(id_col, text_col, source_col, seed)
    texts = docs.select(*[c.alias(k) for k, c in columns.items()], F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    once = texts.groupBy(*ENTRY).agg(F.min("text").alias("text"), F.min("source").alias("source"))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ENTRY]
    at = assign(docs, shards, id_col, text_col, source_col, seed)
    held = at.alias("a").join(once.alias("b"), same).select(F.col("a.id").alias(id_col), F.col("b.text").alias(text_col), F.col("b.source").alias(source_col), "a.shard", "a.slot")
    held.repartitionByRange(shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    drop(at)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = assign(table(spark, sf_dir, "documents"))
    return at.select(F.col("id").alias("doc_id"), "size", F.col("crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
