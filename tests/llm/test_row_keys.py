"""Rows of null or equal ids are documents of their own."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tessera.llm import suffixes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("shared", [None, 7])
def test_passages_of_texts_with_one_hash_and_id(spark, shared):
    texts = spark.range(300_000).select(F.sha2(F.col("id").cast("string"), 256).alias("text"))
    a, b = texts.groupBy(F.hash("text")).agg(F.sort_array(F.collect_list("text")).alias("x")).where("size(x) > 1").orderBy("x").first()["x"][:2]
    docs = spark.createDataFrame([(shared, a), (shared, b), (5, a)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, bytes(r["kept"]).decode()) for r in suffixes.cut_repeats(docs, length=40).collect())
    assert got == sorted([(shared or 0, ""), (shared or 0, b), (5, "")])


@pytest.mark.parametrize("shared", [None, 7])
def test_mixing_counts_each_row(spark, shared):
    docs = spark.createDataFrame([(shared, "word " * n, "en", "web", 5 * n) for n in range(1, 61)], SCHEMA)
    taken = sum(r["n_chars"] // 5 for r in corpus_pipeline.mix_sources(spark, docs, "").collect())
    assert abs(taken - 1.5 * sum(range(1, 61))) <= 60
