"""Review signals as a stream: windowed acceptance with late data dropped beyond a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "signal_id string, element_type string, decision string, timestamp timestamp"


def read_signals(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Signals appended to a folder as JSON lines."""
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def windowed_acceptance(signals: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, end, element_type, signals, accepted, rate) of each window. A signal id that comes again within the allowed
    lateness counts once."""
    once = signals.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["signal_id"])
    accepted = F.count_if(F.col("decision") == "accept")
    counts = once.groupBy(F.window("timestamp", width).alias("span"), "element_type").agg(F.count("*").alias("signals"), accepted.alias("accepted"))
    return counts.select("span.start", "span.end", "element_type", "signals", "accepted", (F.col("accepted") / F.col("signals")).alias("rate"))
