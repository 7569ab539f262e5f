"""Tables of copies, bounded samples, and words that polynomials would confuse."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, copies, langid, neighbours, scoring, sketches


@pytest.mark.parametrize("n", [1, 2, 5, 1001])
def test_samples_of_copies(spark, n):
    rows = spark.range(30_000).select((F.col("id") % n).alias("x"))
    got = [r["x"] for r in common.sampled(rows, 1000).collect()]
    assert len(got) == len(set(got)) == min(n, 1000)
    assert sorted(got) == sorted(r["x"] for r in common.sampled(rows.repartition(5), 1000).collect())


def test_samples_of_few_and_no_rows(spark):
    assert common.sampled(spark.range(1), 1).count() == 1
    assert common.sampled(spark.range(0), 5).count() == 0
    assert common.sampled(spark.range(4_000), 3).count() == 3


def test_samples_within_groups(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).cast("string").alias("g"), F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("x"))
    got = {r["g"]: (r["n"], r["d"]) for r in common.sampled_within(rows, 100, "g").groupBy("g").agg(F.count("*").alias("n"), F.count_distinct("x").alias("d")).collect()}
    assert got == {"0": (1, 1), "1": (100, 100), "2": (100, 100)}


def test_neighbours_among_copies(spark):
    v = {0: [1.0, 0.0, 0.0, 1.0], 1: [0.5, 0.5, 0.0, 0.0], 2: [0.0, 1.0, 1.0, 0.0]}
    rows = spark.range(60_000).select((F.col("id") % 3).alias("vec_id"), F.col("id").alias("row"))
    array = F.element_at(F.create_map(*[F.lit(x) for k, a in v.items() for x in (k, a)]), F.col("vec_id").cast("int"))
    got = neighbours.search(rows.withColumn("embedding", array), F.col("vec_id") == 0).collect()
    assert [(r["query_id"], r["rank"], r["id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 0.5), (0, 2, 2, 0.0)]


def test_neighbours_of_unequal_lengths(spark):
    rng = np.random.default_rng(2)
    v = {i: [float(x) for x in rng.normal(size=3 + i % 5)] for i in range(60)}
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in neighbours.search(spark.createDataFrame(list(v.items()), "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0, top=5).collect()}
    for q in (0, 20, 40):
        best = sorted(((-sum(a * b for a, b in zip(v[q], v[i])), i) for i in v if i != q))[:5]  # noqa: B905
        assert [got[q, k + 1][0] for k in range(5)] == [i for _, i in best]


def test_a_language_of_copies(spark):
    rows = [(i, "das ist immer derselbe satz", "de") for i in range(3000)] + [(5000 + i, f"some other words number {i} here", "en") for i in range(50)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    tests = spark.createDataFrame([(1, "das ist derselbe satz"), (2, "other words here")], "doc_id long, text string")
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(tests, model, reject=False).collect()} == {1: "de", 2: "en"}


def test_scores_of_one_text_many_times(spark):
    docs = spark.createDataFrame([(i, "the same few words again") for i in range(2500)], "doc_id long, text string")
    got = scoring.score(docs, F.lit(True)).select("base_score", "score", "n_known").distinct().collect()
    assert len(got) == 1 and got[0]["n_known"] == 6 and np.isfinite(got[0]["score"])


def thue_morse(a: str, b: str, n: int) -> str:
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


@pytest.mark.parametrize("n", [512, 1024, 4096])
def test_words_of_alternating_letters_are_told_apart(spark, n):
    x, y = thue_morse("a", "b", n), thue_morse("b", "a", n)
    counts = scoring.word_counts(spark.createDataFrame([(f"{x} {y}",)], "text string")).collect()
    assert sorted((r["word"], r["n"]) for r in counts) == sorted([(x, 1), (y, 1)])
    one, two = sketches.sketches([x.encode(), y.encode()])
    assert one.tolist() != two.tolist()
    grouped = copies.groups(spark.createDataFrame([(1, x), (2, y)], "row long, text string")).collect()
    assert sorted((r["row"], r["root"]) for r in grouped) == [(1, 1), (2, 2)]


def test_a_crowded_bucket_of_several_groups(spark):
    """Near copies of one text, some of them of two further texts that are under the threshold to it: no link is lost, and few rows are made."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(200)]
    other = base[:176] + [f"o{i}" for i in range(24)]
    third = base[:170] + [f"t{i}" for i in range(30)]
    texts = []
    for k in range(1500):
        words = list((base, other, third)[k % 3])
        words[int(rng.integers(200))] = f"e{k}"
        texts.append((k, " ".join(words)))
    got = {r["row"]: r["root"] for r in copies.groups(spark.createDataFrame(texts, "row long, text string")).collect()}
    sets = {k: {tuple(t.split()[i : i + 5]) for i in range(196)} for k, t in texts[:60]}
    assert len(sets[0] & sets[1]) / len(sets[0] | sets[1]) > 0.6
    for a in range(0, 60, 7):
        for b in range(60):
            if len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8:
                assert got[a] == got[b]
    linked = any(len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8 for a in sets for b in sets if a % 3 != b % 3)
    assert len(set(got.values())) == (1 if linked else 3)
