"""Extraction checkpoints: nested JSON of entities and their evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = """entities array<struct<id:string, label:string, entity_type:string, description:string, aliases:array<string>,
    confidence:double, evidence:array<struct<source_id:string, text_span:string>>>>"""


def read_entities(spark: SparkSession, path: str) -> DataFrame:
    """One row an entity; its frequency is its number of evidences, whose ids and passages are arrays. What is missing is
    empty or zero."""
    e = F.col("e")
    evidence = F.coalesce(e["evidence"], F.array().cast("array<struct<source_id:string,text_span:string>>"))
    words = lambda name: F.coalesce(e[name], F.lit(""))
    return (
        spark.read.schema(SCHEMA)
        .json(path, multiLine=True)
        .select(F.explode("entities").alias("e"))
        .select(
            words("id").alias("id"),
            words("label").alias("label"),
            words("entity_type").alias("entity_type"),
            words("description").alias("description"),
            F.coalesce(e["aliases"], F.array().cast("array<string>")).alias("aliases"),
            F.coalesce(e["confidence"], F.lit(0.0)).alias("confidence"),
            F.size(evidence).cast("long").alias("frequency"),
            F.transform(evidence, lambda x: F.coalesce(x["source_id"], F.lit(""))).alias("source_ids"),
            F.transform(evidence, lambda x: F.coalesce(x["text_span"], F.lit(""))).alias("evidence_spans"),
        )
    )
