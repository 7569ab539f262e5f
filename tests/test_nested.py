"""Nested replies, pages of long lists and stems, against values and plain loops."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import replies, stemming
from tessera.operators import overlap, pages, tool_replies

# Words and stems as the algorithm's published steps give them.
KNOWN = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing
conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky
relational relat conditional condit rational ration valenci valenc hesitanci hesit digitizer digit radicalli radic differentli differ vileli vile
analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal decisiveness decis hopefulness hope callousness callous
formaliti formal sensitiviti sensit sensibiliti sensibl triplicate triplic formative form formalize formal electriciti electr electrical electr
hopeful hope goodness good revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust defensible defens
irritant irrit replacement replac adjustment adjust dependent depend adoption adopt homologou homolog communism commun activate activ angulariti angular
homologous homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll generalizations gener
oscillators oscil yes ye boy boi enjoyed enjoi yielding yield""".split()


def test_known_stems(spark):
    words = KNOWN[::2]
    got = spark.createDataFrame([(words,)], "w array<string>").select(stemming.stems(F.col("w"), least=3)).first()[0]
    assert dict(zip(words, got, strict=True)) == dict(zip(words, KNOWN[1::2], strict=True))


def test_stems_of_short_words_nulls_and_nothing(spark):
    df = spark.createDataFrame([(["as", "was", "cats", None, "", "42s", "a1ing"],), ([],), (None,)], "w array<string>")
    got = [r[0] for r in df.select(stemming.stems(F.col("w"))).collect()]
    assert got[0][:6] == ["as", "was", "cat", None, "", "42s"] and got[1:] == [[], None]


def test_rouge_of_stems(spark):
    df = spark.createDataFrame([("The cats were running", "a cat runs"), (None, "x"), ("", "")], "a string, b string")
    plain = df.select(replies.generation_scores("a", "b").alias("s")).collect()
    stemmed = df.select(replies.generation_scores(F.col("a"), F.col("b"), stemmed=True).alias("s")).collect()
    assert plain[0]["s"]["rouge_1"] == 0 and stemmed[0]["s"]["rouge_1"] == pytest.approx(4 / 7)
    assert [r["s"]["rouge_l"] for r in stemmed[1:]] == [0, 0]


def test_overlap_equals_counters(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice("abcd") for _ in range(rng.randrange(6))], [rng.choice("abcd") for _ in range(rng.randrange(6))]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, candidate array<string>, reference array<string>")
    got = {r["id"]: (r["hits"], r["candidates"], r["references"], r["f1"]) for r in overlap.rouge(df, 2).collect()}
    for i, a, b in rows:
        x, y = (Counter(zip(w, w[1:], strict=False)) for w in (a, b))
        hits, n, m = sum((x & y).values()), max(0, len(a) - 1), max(0, len(b) - 1)
        assert got[i] == (hits, n, m, pytest.approx(2 * hits / (n + m) if hits else 0))


@pytest.mark.parametrize("size", [1, 7, 1000])
def test_pages_equal_sorted_lists(spark, size):
    rng = random.Random(size)
    rows = [(rng.choice(["hot"] * 6 + ["a", "z", None]), rng.randrange(900), rng.choice(["x", "y", None])) for _ in range(3_000)]
    df = spark.createDataFrame(rows, "k string, o int, v string").repartition(5).withColumn("key", F.lit(1))
    got = pages.paged(df, "k", "o", "v", size).collect()
    assert all(0 < len(r["items"]) <= size for r in got)
    for key in {k for k, _, _ in rows}:
        own = sorted((r for r in got if r["k"] == key), key=lambda r: r["page"])
        assert [r["page"] for r in own] == list(range(len(own))) and all(len(r["items"]) == size for r in own[:-1])
        want = [v for _, v in sorted(((o, v) for k, o, v in rows if k == key), key=lambda x: (x[0], x[1] is not None, x[1] or ""))]
        assert [v for r in own for v in r["items"]] == want


def test_distinct_pages_and_empty_tables(spark):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "y"), ("b", None)], "k string, v string")
    assert sorted((r["k"], r["page"], r["items"]) for r in pages.distinct_pages(df, "k", "v", 1).collect()) == [("a", 0, ["x"]), ("a", 1, ["y"]), ("b", 0, [None])]
    assert pages.paged(df.where("false"), "k", "v", "v").count() == 0


PATH = {"nodes": ["a", "b"], "node_labels": {"a": "Alpha"}, "edges": [{"src": "a", "tgt": "b", "type": "HAS"}, "no object", {"src": "a"}], "chain": "a > b"}


def test_fact_chains(spark):
    sound = json.dumps({"source": "a", "target": "b", "paths": [PATH, {"nodes": []}, 7]})
    df = spark.createDataFrame([(1, sound), (2, '{"error": "down"}'), (3, "no json"), (4, '{"paths": "none"}'), (5, None), (6, "[1]")], "query int, reply string")
    chains = tool_replies.fact_chains(df)
    got = sorted(chains.collect(), key=lambda r: r["nth"])
    assert [(r["query"], r["nth"], round(r["score"], 2)) for r in got] == [(1, 0, 0.95), (1, 1, 0.93)]
    assert got[0]["text"] == "FACT CHAIN (a -> b, path 1):\n  a > b\n  Nodes: a (Alpha), b (b)\n  TRIPLE: [a] -[HAS]-> [b]\n  TRIPLE: [a] -[None]-> [None]\n"
    assert [tuple(r) for r in tool_replies.chain_relations(chains).collect()] == [(1, "a", "HAS", "b")]
    text = tool_replies.chain_summaries(chains).first()["text"].split("\n")
    assert text[1:5] == ["", "  Chain 1: a -> b", "    Path: a > b", "    GROUNDED TRIPLE: [a] -[HAS]-> [b]"] and "    Labels: a=Alpha" in text


def test_neighbourhoods(spark):
    sound = json.dumps({"hops": 2, "entities": [{"id": "x", "label": "X", "type": "T"}, {"label": "no id"}, 3], "relations": [{"src": "x", "tgt": "y", "type": "R"}, {"src": "x"}]})
    df = spark.createDataFrame([(1, "e", sound), (2, "e", "plain words"), (3, "e", "An Error"), (4, "e", '{"error": 1}'), (5, "e", "{}"), (6, "e", None)], "query int, entity string, reply string")
    got = {r["query"]: r for r in tool_replies.neighbourhoods(df).collect()}
    assert sorted(got) == [1, 2, 5] and (got[1]["n_entities"], got[1]["n_relations"], got[2]["score"], got[2]["text"]) == (1, 1, 0.6, "plain words")
    assert got[1]["text"] == "Neighborhood of 'e' (2-hop):\nEntities (1):\n  [T] x: X\nRelations (1):\n  x -[R]-> y"


def test_reports(spark):
    full = {"summary": {"classes_added_total": 4, "cq_coverage": {"final": 0.5}, "entity_coverage": 3, "acceptance_rate_avg": 1}}
    df = spark.createDataFrame([(1, json.dumps(full), None), (2, "broken", '{"new_classes_count": 2}'), (3, "[]", "{}")], "id int, convergence string, iteration string")
    got = {r[0]: tuple(r)[1:] for r in tool_replies.report_metrics(df).collect()}
    assert got == {1: (4, 0.5, 0.0, 1.0, None, None, None), 2: (None, None, None, None, 2, 0.0, 0.0), 3: (None, None, None, None, 0, 0.0, 0.0)}


def test_ontology_contexts(spark):
    df = spark.createDataFrame([(1, "Class: Waste"), (2, "No ontology class"), (3, None)], "query int, reply string")
    assert [tuple(r) for r in tool_replies.ontology_contexts(df).collect()] == [(1, "Class: Waste", 0.3)]
