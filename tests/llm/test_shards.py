"""Shards against ranks counted in Python."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm import registry, shards
from tests.oracle import SMALL

SCHEMA = "shard string, doc_id long, text string, source string, slot int"


def expected(df, n_shards):
    """Rows (id, size, crc, shard, slot) from one sorted list of fractions."""
    columns = shards.entry_columns("doc_id", "text", "source", shards.SEED)
    seeds = F.pmod(F.xxhash64(F.lit(shards.SEED), F.col("stratum")), F.lit(1 << 20)).alias("seed")
    rows = df.select(*[c.alias(k) for k, c in columns.items()]).withColumn("seed", seeds).collect()
    by_source = defaultdict(list)
    for r in rows:
        by_source[r["stratum"]].append(r)
    placed = []
    for name, own in by_source.items():
        own.sort(key=lambda r: (r["h"], r["id"] is not None, r["id"] or 0, r["size"], r["crc"]))
        placed += [((i + (r["seed"] + 0.5) / (1 << 20)) / len(own), name, i, r) for i, r in enumerate(own)]
    placed.sort(key=lambda x: x[:3])
    out = []
    for at, (_, _, _, r) in enumerate(placed):
        shard = at * n_shards // len(placed)
        out.append((r["id"], r["size"], r["crc"], shard, at - -(-shard * len(placed) // n_shards)))
    return sorted(out, key=str)


def test_the_query(spark):
    df = registry.QUERIES["op12_shards"](spark, SMALL)
    assert dict(df.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    got = df.collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    assert all((r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(texts[r["doc_id"]]) + 16, zlib.crc32(texts[r["doc_id"]]), "rows", None) for r in got)
    assert sorted(((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in got), key=str) == expected(docs, 40)


def test_every_shard_has_the_mixture(spark):
    sizes = {"big": 4000, "mid": 1000, "small": 37, None: 400} | {f"one{i}": 1 for i in range(300)}
    rows = [(None, i, f"text {i}", s, None) for i, s in enumerate(s for s, n in sizes.items() for _ in range(n))]
    got = shards.assign(spark.createDataFrame(rows, SCHEMA), 16).collect()
    counts = Counter(r["shard"] for r in got)
    assert set(counts) == set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    per = Counter((r["shard"], r["stratum"]) for r in got)
    for s in (*"big mid small".split(), None):
        for k in range(16):
            assert abs(per[k, "n" if s is None else f"s{s}"] - sizes[s] / 16) <= 3 + 0.03 * sizes[s] / 16
    ones = Counter()
    for (k, s), n in per.items():
        ones[k] += n if s.startswith("sone") else 0
    assert max(ones.values()) <= 40


@pytest.mark.parametrize("n_shards", [3, 40])
def test_rows_of_every_kind(spark, n_shards):
    rows = [("x", None, None, None, 1), ("x", None, "", None, 2), ("x", 1, "a", "s", 1), ("x", 2, "a", "s", 1), ("x", 2, "b", "n", 1), ("x", 3, "w " * 200_000, "", 0)]
    rows += [("x", 7, "same", "hot", 1)] * 30
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(((r["id"], r["size"], r["crc"], r["shard"], r["slot"]) for r in shards.assign(df, n_shards).collect()), key=str)
    assert got == expected(df, n_shards)


def test_an_empty_table(spark):
    assert shards.assign(spark.createDataFrame([], SCHEMA)).count() == 0


def test_order_depends_on_the_rows_alone(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    key = lambda df: sorted(tuple(r) for r in df.select("id", "shard", "slot").collect())
    assert key(shards.assign(docs)) == key(shards.assign(docs.repartition(7, "text"))) != key(shards.assign(docs, seed=1))


def test_written_shards(spark, tmp_path):
    rows = [(None, i, f"text {i}" if i % 5 else None, f"s{i % 3}", None) for i in range(50)] + [(None, 3, "text 3", "s0", None)] * 4
    df = spark.createDataFrame(rows, SCHEMA)
    shards.write(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out")).collect()
    at = Counter((r["doc_id"], r["text"], r["source"]) for r in back)
    assert at == Counter((r[1], r[2], r[3]) for r in rows)
    want = sorted((r["id"], r["shard"], r["slot"]) for r in shards.assign(df, 4).collect())
    assert sorted((r["doc_id"], r["shard"], r["slot"]) for r in back) == want
