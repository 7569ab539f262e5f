"""Benchmark files: predictions out, results and reference data in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT = "system string, test_case string, level string, scores map<string,double>"
CONCEPT = "label string, definition string, id string"


def write_predictions(rows: DataFrame, path: str, mode: str = "append") -> None:
    """rows (model, strategy, split_id, ...) as JSON lines in a folder for each of the three; slashes and colons of a model's name
    become underscores."""
    safe = rows.withColumn("model", F.translate("model", "/:", "__"))
    safe.write.mode(mode).partitionBy("model", "strategy", "split_id").json(path)


def read_predictions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def read_results(spark: SparkSession, folder: str) -> DataFrame:
    """Results of all `*_result.json` files of a folder, one object a file; files that hold none are passed over."""
    rows = spark.read.schema(RESULT + ", _corrupt_record string").option("multiLine", True).json(f"{folder}/*_result.json")
    return rows.where("_corrupt_record is null and system is not null").drop("_corrupt_record")


def read_concepts(spark: SparkSession, folder: str) -> DataFrame:
    """(reference, label, definition) of JSON files of concept arrays or objects by label; reference is the file's name."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1)
    return spark.read.schema(CONCEPT).option("multiLine", True).json(f"{folder}/*.json").select(name.alias("reference"), F.coalesce("label", "id").alias("label"), F.coalesce("definition", F.lit("")).alias("definition"))


def read_triple_csv(spark: SparkSession, folder: str) -> DataFrame:
    """(reference, s, p, o) of CSV files with a heading."""
    name = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.csv$", 1)
    rows = spark.read.schema("subject string, predicate string, object string").option("header", True).csv(f"{folder}/*.csv")
    return rows.select(name.alias("reference"), F.col("subject").alias("s"), F.col("predicate").alias("p"), F.col("object").alias("o"))


def read_texts(spark: SparkSession, folder: str, most: int = 10_000) -> DataFrame:
    """(name, text) of text files, texts cut at so many characters (the cut is the loader's feature)."""
    rows = spark.read.option("wholetext", True).text(f"{folder}/*.txt")
    return rows.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("name"), F.substring("value", 1, most).alias("text"))


def write_table(table: DataFrame, path: str, kind: str = "csv") -> None:
    """A table as CSV with a heading, or as JSON lines."""
    if kind not in ("csv", "json"):
        raise ValueError("csv or json")
    writer = table.write.mode("overwrite")
    (writer.option("header", True).csv if kind == "csv" else writer.json)(path)


def unfinished(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a run that was broken off has still to do: wanted rows without a stored result."""
    return wanted.join(done.select(*keys), keys, "left_anti")
