"""Similarity, fuzzy and substring joins against brute force, and how much they leave out."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.functions.fuzzy import ratio
from tessera.operators import matching, stats, vectors
from tests.spent import most_rows

SCHEMA = "id long, embedding array<double>"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], SCHEMA)


def cosines(a, b):
    unit = lambda m: np.divide(m, np.linalg.norm(m, axis=1, keepdims=True), out=np.zeros_like(m), where=np.linalg.norm(m, axis=1, keepdims=True) > 0)
    return unit(a) @ unit(b).T


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(60, 24))
    right = centres[rng.integers(60, size=50_000)] + 0.12 * rng.normal(size=(50_000, 24))
    left = centres[rng.integers(60, size=1_500)] + 0.12 * rng.normal(size=(1_500, 24))
    made = lambda m, first: spark.createDataFrame(pa.table({"id": np.arange(first, first + len(m)), "embedding": pa.array(list(m), pa.list_(pa.float64()))}))
    return left, right, made(left, 1_000_000), made(right, 0)


def test_clusters_meet_few_blocks(spark, clustered):
    left, right, a, b = clustered
    placed_a, placed_b, cells, width = vectors.prepared(a, b)
    meet = vectors.meetings(placed_a.withColumn("bar", F.lit(0.95)), cells, width, vectors.near_enough)
    assert meet.count() < 0.1 * len(left) * len(cells.cell)
    assert cells.size.sum() == len(right) and cells.size.max() <= vectors.BLOCK


def test_pairs_above_a_threshold(spark, clustered):
    left, right, a, b = clustered
    near = cosines(left, right) >= 0.97
    got = vectors.above(a, b, 0.97).groupBy("left_id").agg(F.count("*").alias("n"), F.sum("right_id").alias("s")).collect()
    want = {1_000_000 + i: (int(x.sum()), int(np.flatnonzero(x).sum())) for i, x in enumerate(near) if x.any()}
    assert {r["left_id"]: (r["n"], r["s"]) for r in got} == want


def test_nearest_of_clusters(spark, clustered):
    left, right, a, b = clustered
    near = cosines(left, right)
    got = {(r["left_id"] - 1_000_000, r["rank"]): r["right_id"] for r in vectors.nearest(a, b, 3).collect()}
    best = np.argsort(-near, axis=1, kind="stable")[:, :3]
    assert got == {(i, k + 1): int(best[i, k]) for i in range(len(left)) for k in range(3)}


def test_vectors_of_every_kind(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    monkeypatch.setattr(vectors, "ROWS_A_PIVOT", 20)
    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 6))
    m[:40] = m[0] * rng.uniform(0.5, 2, size=(40, 1))
    m[40:60] = 0
    rows = list(enumerate(m)) + [(300, None), (None, m[1]), (301, m[2][:3]), (302, [])]
    full = np.vstack([m, np.concatenate([m[2][:3], np.zeros(3)]), np.zeros(6)])
    ids = [*range(300), 301, 302]
    near = cosines(full, full)
    np.fill_diagonal(near, -np.inf)
    df = frame(spark, rows)
    for bar in (-0.5, 0.0, 0.4, 1 - 1e-7):
        got = {(r["left_id"], r["right_id"]) for r in vectors.above(df, df, bar).collect()}
        sure, maybe = ({(ids[i], ids[j]) for i, j in zip(*np.nonzero(near >= bar + e), strict=True)} for e in (1e-12, -1e-12))
        assert sure <= got <= maybe
    order = lambda i: sorted(range(len(ids)), key=lambda j: (-round(near[i, j], 9), ids[j]))
    got = {(r["left_id"], r["rank"]): r["right_id"] for r in vectors.nearest(df, df, 4).collect()}
    assert got == {(ids[i], k + 1): ids[order(i)[k]] for i in range(len(ids)) for k in range(4)}
    some = {(r["left_id"], r["rank"]): r["right_id"] for r in vectors.nearest(df, df, 4, threshold=0.3, where="id % 3 = 0").collect()}
    want = {}
    for i in range(len(ids)):
        good = [j for j in order(i) if ids[j] % 3 == 0 and near[i, j] >= 0.3][:4]
        want |= {(ids[i], k + 1): ids[j] for k, j in enumerate(good)}
    assert some == want


def test_no_vectors(spark):
    some, none = frame(spark, [(1, [1.0, 0.0])]), frame(spark, [])
    assert vectors.above(some, none, 0.5).count() == vectors.above(none, some, 0.5).count() == vectors.nearest(some, none, 2).count() == 0


@pytest.fixture(scope="module")
def labels():
    rng = random.Random(4)
    parts = ["regul", "permit", "facil", "waste", "water", "ity", "tion", "ment", "er", "or"]
    base = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 5))) for _ in range(350)]

    def edit(x):
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(x) + 1)
            x = x[:at] + rng.choice("abxyz") + x[at + rng.randrange(2) :]
        return x

    return base + ["", "a", "ab", "Aa", None], [edit(rng.choice(base)) for _ in range(350)] + ["", "A", "abc", "aa", None]


@pytest.mark.parametrize("least", [0.75, 0.85, 1.0])
def test_fuzzy_matches_equal_brute_force(spark, labels, monkeypatch, least):
    monkeypatch.setattr(matching, "GRAM_ROWS", 20)
    a, b = labels
    left, right = (spark.createDataFrame([(x,) for x in side], "label string") for side in (a, b))
    low = [{x.lower() for x in side if x is not None} for side in (a, b)]
    want = {(x, y) for x in low[0] for y in low[1] if ratio(x, y) >= least}
    assert {(r["left"], r["right"]) for r in matching.fuzzy_matches(left, right, least).collect()} == want
    if least == 0.85:
        assert matching.fuzzy_candidates(left, right, least).count() < 0.12 * len(low[0]) * len(low[1])


def test_many_terms_in_a_long_text(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(4, 9))) for _ in range(60_000)]
    terms = sorted(set(words[:50_000]))
    long = " ".join(rng.choice(words) for _ in range(700_000))
    texts = spark.createDataFrame([(1, long, "x"), (2, None, "x"), (3, "", "x"), (4, terms[0] + terms[1], "x")], "id long, text string, label2 string")
    got = matching.holding(texts, spark.createDataFrame([(t,) for t in [*terms, "", None]], "label string")).select("id", "label")
    found = {i: set() for i in (1, 2, 3, 4)}
    for r in got.collect():
        assert r["label"] not in found[r["id"]]
        found[r["id"]].add(r["label"])
    assert found[2] == found[3] == set() and {terms[0], terms[1]} <= found[4]
    assert all((t in long) == (t in found[1]) for t in terms[::25])


def test_terms_in_parts(spark):
    rng = random.Random(3)
    terms = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 6))) for _ in range(300)]
    texts = ["".join(rng.choice("abcd ") for _ in range(rng.randrange(60))) for _ in range(200)] + ["aaaa"] * 20 + [None]
    want = sorted((i, t) for i, x in enumerate(texts) if x is not None for t in set(terms) if t in x)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    names = spark.createDataFrame([(t,) for t in terms], "label string")
    for options in ({"few": 1000}, {}, {"term_bytes": 100}):
        assert sorted((r["id"], r["label"]) for r in matching.holding(df, names, **options).collect()) == want


def test_the_bootstrap_is_as_wide_as_resampling(spark):
    rng = np.random.default_rng(8)
    a, b = rng.normal(0.6, 0.2, 400), rng.normal(0.5, 0.2, 400)
    rows = [("m", int(i), float(x), float(y)) for i, (x, y) in enumerate(zip(a, b, strict=True))] + [("m", None, 1.0, 1.0), ("m", 900, None, 1.0), ("one", 1, 0.75, 0.5)]
    got = {r["metric"]: r for r in stats.bootstrap(spark.createDataFrame(rows, "metric string, pair long, a double, b double"), 4000).collect()}
    d = a - b
    means = rng.choice(d, (4000, len(d))).mean(1)
    width = np.quantile(means, 0.975) - np.quantile(means, 0.025)
    assert got["m"]["high"] - got["m"]["low"] == pytest.approx(width, rel=0.06)
    assert got["m"]["low"] < d.mean() < got["m"]["high"] and got["one"]["low"] == got["one"]["high"] == 0.25


def unclustered(n, width=16):
    rng = np.random.default_rng(11)
    return [*rng.normal(size=(n - n // 4, width)), *np.repeat(rng.normal(size=(n // 40, width)), 10, axis=0)]


def test_rows_are_sent_once_a_shelf(spark, monkeypatch):
    """Vectors that don't cluster meet nearly all blocks, but a row is sent only as often as the other side has shares."""
    monkeypatch.setattr(vectors, "BLOCK", 64)
    df = frame(spark, list(enumerate(unclustered(4_000))))
    a, b, cells, width = vectors.prepared(df, df)
    a = a.withColumn("bar", F.lit(0.1))
    assert vectors.meetings(a, cells, width, vectors.near_enough).count() > 40 * 4_000
    slots = vectors.in_slots(a, cells, width)
    sent = vectors.meetings(a, cells, width, vectors.near_enough, vectors.shelved(cells, width), slots).count()
    assert sent <= (vectors.SHARES + 1) * 4_000 and slots.many <= 2 * vectors.SHARES


def test_first_and_any_beyond_a_threshold(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "ROWS_A_PIVOT", 40)
    rows = list(enumerate(unclustered(600, 6)))
    near = cosines(np.array([v for _, v in rows]), np.array([v for _, v in rows]))
    np.fill_diagonal(near, -np.inf)
    df = frame(spark, rows)
    want = {(i, n + 1): int(j) for i, x in enumerate(near) for n, j in enumerate(np.flatnonzero(x > 0.6)[:3])}
    assert {(r["left_id"], r["nth"]): r["right_id"] for r in vectors.first_beyond(df, df, 0.6, 3).collect()} == want
    assert sorted(r["left_id"] for r in vectors.linked(df, df, 0.95).collect()) == np.flatnonzero((near >= 0.95).any(1)).tolist()
    best = {(r["left_id"], r["rank"]): r["right_id"] for r in vectors.nearest(df, df, 4).collect()}
    assert best == {(i, n + 1): int(j) for i, x in enumerate(near) for n, j in enumerate(np.lexsort((np.arange(600), -np.round(x, 9)))[:4])}


def test_floats_are_sent_as_floats_and_shelves_where_they_are_met(spark, monkeypatch):
    """Vectors of floats take four bytes a component, a million rows make no more shares than a hundred thousand, and a shelf goes
    only to slots that meet it: with 30 clusters a nearest row costs each right row far fewer copies than there are slots."""
    monkeypatch.setattr(vectors, "BLOCK", 32)
    monkeypatch.setattr(vectors, "ROWS_A_PIVOT", 64)
    assert 1_000_000 <= vectors.SHARES * vectors.share(1_000_000, 64)
    rng = np.random.default_rng(3)
    m = (rng.normal(size=(30, 12))[rng.integers(30, size=1_920)] + 0.05 * rng.normal(size=(1_920, 12))).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<float>")
    assert {len(r["unit"]) for r in vectors.unit_rows(df, 12).collect()} == {48}
    a, b, cells, width = vectors.prepared(df, df)
    got = vectors.compared(a.withColumn("bar", F.lit(0.9)), b, cells, width, vectors.near_enough, 0.0, 1)
    assert most_rows(got) < 4 * len(m) < vectors.in_slots(a, cells, width).many * len(m)
    near = cosines(m.astype(float), m.astype(float))
    np.fill_diagonal(near, -np.inf)
    best = {r["left_id"]: (r["right_id"], round(r["similarity"], 9)) for r in vectors.nearest(df, df, 1).collect()}
    assert best == {i: (int(np.lexsort((np.arange(len(m)), -np.round(x, 9)))[0]), round(float(x.max()), 9)) for i, x in enumerate(near)}
