"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20  # of a batch that goes to a Python worker, so that many rows of long texts don't fill it or its executor
SPREAD = 1 << 40
FEW = 10_000  # short rows that may be broadcast


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a private one on a single machine, and an error on a cluster."""
    small_batches(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp())
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the cluster's shared folder; for small tables."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """Cut the lineage with a compressed table in the cluster's shared folder; for larger tables."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(*kept: DataFrame) -> None:
    """Delete tables that keep() wrote, once all that is read from them is itself kept or checkpointed."""
    for df in kept:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, k: int) -> Column:
    """crc32 of an id as text, modulo k; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % k


def thinned(rows: DataFrame, most: int, within: list[str] | None = None) -> DataFrame:
    """Distinct rows with a `key`, a hash over all columns, and for each value of `within` the `most` smallest keys among them, and
    some more. Distinct rows are counted first, by their keys alone, so copies don't take others' place."""
    keyed = rows.withColumn("key", F.xxhash64(*rows.columns))
    own = within or []
    each = keyed.select(*own, "key").distinct().groupBy(*own).agg(F.count("*").alias("distinct"))
    bar = F.ceil((2.0 * most + 64) * SPREAD / F.greatest("distinct", F.lit(1))).alias("bar")
    if own:
        bars = cut(each.select(*own, bar))
        keyed = keyed.join(F.broadcast(bars) if bars.count() <= FEW else bars, own)
    else:
        keyed = keyed.withColumn("bar", F.lit(each.select(bar).first()[0]))
    return keyed.where(F.pmod("key", F.lit(SPREAD)) < F.col("bar")).drop("bar").dropDuplicates([*own, "key"])


def sampled(rows: DataFrame, most: int) -> DataFrame:
    """`most` distinct rows, those whose hash over all columns is smallest, or all if there are no more: the same ones in every
    run, also where ids are null or equal or rows repeat. The hash thins the table before rows are put in order."""
    return thinned(rows, most).orderBy(F.pmod("key", F.lit(SPREAD)), "key").limit(most).drop("key")


def sampled_within(rows: DataFrame, most: int, column: str) -> DataFrame:
    """As sampled(), for each value of a column that holds no nulls."""
    order = Window.partitionBy(column).orderBy(F.pmod("key", F.lit(SPREAD)), "key")
    return thinned(rows, most, [column]).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most).drop("nth", "key")
