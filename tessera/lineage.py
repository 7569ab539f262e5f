"""Materialising what a loop carries from round to round."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset a private one on a single machine, and an error on a cluster."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp())
    return context._jsc.sc().getCheckpointDir().get()


def settle(df: DataFrame) -> DataFrame:
    """The rows as a reliable checkpoint in the folder of ``spark.checkpoint.dir``, so that plans don't grow with rounds and
    lost executors cost a read."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def keep(df: DataFrame) -> DataFrame:
    """The rows as a compressed table in the same folder, for what is large; drop() deletes it."""
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.kept_at = path
    return out


def drop(kept: DataFrame) -> None:
    """Delete a table that keep() wrote, once all that is read from it is itself kept or settled."""
    path = kept.sparkSession._jvm.org.apache.hadoop.fs.Path(kept.kept_at)
    path.getFileSystem(kept.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
