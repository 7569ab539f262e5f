"""Matches with references, versions and tables against plain loops and known values."""

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import alignment, metrics, records, stats, versions


def shared(a, b):
    a, b = set(a.lower().split()), set(b.lower().split())
    return len(a & b) / len(a | b) if a | b else 0.0


def cosine(a, b):
    n = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
    return sum(x * y for x, y in zip(a, b, strict=True)) / n if n else 0.0


def phrases(rng, n):
    """Texts of a few words, one of which is in nearly all of them."""
    return [" ".join([*(["The"] if rng.random() < 0.8 else []), *rng.choices([f"w{k}" for k in range(40)], k=rng.randrange(5))]) for _ in range(n)]


@pytest.mark.parametrize("least", [0.3, 0.55, 1.0])
def test_alike_texts_equal_all_pairs(spark, monkeypatch, least):
    monkeypatch.setattr(metrics, "WORD_ROWS", 20)  # the frequent word is dealt into parts
    rng = random.Random(5)
    a, b = phrases(rng, 150), phrases(rng, 150)
    frame = lambda rows: spark.createDataFrame([(x,) for x in [*rows, *rows[:5], None, "", "  "]], "text string")
    got = {(r["left"], r["right"]): r["overlap"] for r in metrics.alike(frame(a), frame(b), least).collect()}
    want = {(x.lower(), y.lower()): shared(x, y) for x in a for y in b if shared(x, y) >= least}
    assert got == pytest.approx(want) and got
    with pytest.raises(ValueError):
        metrics.alike(frame(a), frame(b), 0)


def test_best_overlaps_equal_all_pairs(spark):
    rng = random.Random(6)
    a, b = phrases(rng, 80), phrases(rng, 15)
    labels = spark.createDataFrame(list(enumerate(a)), "id int, label string")
    got = {r["id"]: r["overlap"] for r in metrics.best_overlaps(labels, spark.createDataFrame([(x,) for x in b], "reference string")).collect()}
    assert got == pytest.approx({i: max(shared(x, y) for y in b) for i, x in enumerate(a)})


def concepts(rng, n, some=0.7):
    vector = lambda: [rng.gauss(0, 1) for _ in range(4)] if rng.random() < some else None
    return {x: vector() for x in phrases(rng, n)}


def frame(spark, rows):
    return spark.createDataFrame(list(rows.items()), "label string, embedding array<double>")


def test_concepts_in_turn_equal_a_plain_loop(spark):
    rng = random.Random(7)
    generated, first, second = concepts(rng, 60), concepts(rng, 25), concepts(rng, 25, some=1)
    found = alignment.in_turn(frame(spark, generated), {"a": frame(spark, first), "b": frame(spark, second)}, lambda g, r: alignment.concept_links(g, r, 0.8))
    got = {r["label"]: (r["reference"], r["match"], round(r["score"], 9), r["tier"]) for r in found.collect()}
    want = {}
    for name, reference in (("a", first), ("b", second)):
        for label in [x for x in generated if x not in want]:
            options = []
            for other, vector in reference.items():
                both = generated[label] and vector
                score = cosine(generated[label], vector) if both else shared(label, other)
                if score >= 0.8:
                    options.append((-round(score, 9), other, "vector" if both else "words"))
            if options:
                score, other, tier = min(options)
                want[label] = (name, other, -score, tier)
    assert got == want and {v[0] for v in want.values()} == {"a", "b"} and {v[3] for v in want.values()} == {"vector", "words"}
    rows = alignment.percents(found, frame(spark, generated), ["a", "b"]).collect()
    assert {r["reference"]: r["percent"] for r in rows}["b"] == pytest.approx(100 * len(want) / len(generated))


def test_matches_of_nothing(spark):
    none, one = frame(spark, {"x": None}).where("false"), spark.createDataFrame([("Pump", [1.0, 0.0]), (None, [1.0, 0.0]), ("", None)], "label string, embedding array<double>")
    for links in (alignment.concept_links, alignment.statement_links):
        found = alignment.in_turn(none, {"a": one}, links)
        assert found.count() == 0 and [tuple(r) for r in alignment.percents(found, none, ["a"]).collect()] == [("a", 0, 0.0)]
        assert alignment.in_turn(one, {"a": none}, links).count() == 0
        assert {r["label"] for r in alignment.in_turn(one, {"a": one}, links).collect()} >= {"Pump"}
    with pytest.raises(ValueError):
        alignment.in_turn(one, {}, alignment.concept_links)


def test_statements_by_tiers(spark):
    generated = {" Pump isA Device": None, "pump has part": [1.0, 0.0], "valve near tank": [1.0, 0.0], "lone one": [0.0, 1.0]}
    reference = {"pump ISA device ": None, "pump has parts": [0.0, 1.0], "gauge on wall": [0.9, 0.1]}
    got = {r["label"]: (r["match"], r["tier"]) for r in alignment.statement_links(frame(spark, generated), frame(spark, reference)).collect()}
    assert got == {" Pump isA Device": ("pump ISA device ", "exact"), "pump has part": ("pump has parts", "words"), "valve near tank": ("gauge on wall", "vector"), "lone one": ("pump has parts", "vector")}


def test_types_by_tiers(spark):
    types = spark.createDataFrame([(" Heat_Pump", None), ("big heat pump x", None), ("PUM", None), ("z", [1.0, 0.0]), ("q", [0.0, -1.0]), ("", None), (None, None)], "entity_type string, embedding array<double>")
    classes = frame(spark, {"heat pump": [0.0, 1.0], "Pump": [0.0, 1.0], "Apump": None, "Tank": [1.0, 0.1]})
    got = {r["entity_type"]: (r["match"], round(r["similarity"], 2), r["tier"]) for r in alignment.type_matches(types, classes).collect()}
    assert got == {" Heat_Pump": ("heat pump", 1.0, "exact"), "big heat pump x": ("Pump", 0.9, "substring"), "PUM": ("Apump", 0.9, "substring"), "z": ("Tank", 1.0, "vector"), "q": (None, 0.0, "none"), "": (None, 0.0, "none")}


def triples(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def tree(*edges, more=()):
    names = {x for e in edges for x in e}
    return [(x, "rdf:type", "owl:Class") for x in names] + [(a, "rdfs:subClassOf", b) for a, b in edges] + list(more)


def test_six_scores_and_failures(spark):
    gold = triples(spark, tree(("u#B", "u#A"), ("u#C", "u#B"), ("u#D", "u#C")))
    made = triples(spark, tree(("u#B", "u#A"), ("u#x", "u#B"), ("u#d", "u#B")))
    seed = triples(spark, tree(("u#B", "u#A")))
    removed, vectors = frame(spark, {"C": [1.0, 0.0], "D": None}), frame(spark, {"cc": [1.0, 0.1], "d": None})
    asked = spark.createDataFrame([(1, ["u#B", "u#x"]), (2, ["u#C"]), (3, [])], "id int, targets array<string>")
    got = alignment.six_scores(made, gold, seed, "u#", removed, vectors, asked).first().asDict()
    assert got == pytest.approx({"semantic": 1.0, "hallucination": 0.5, "cq": 2 / 3, "hierarchy": 0.75, "domain": 0.75, "expert": 0.5})
    failed = alignment.six_scores(made, gold, seed, "u#", None, None, None).first()
    assert (failed["semantic"], failed["cq"]) == (0, 0)


def test_unit_tests_of_ontologies(spark):
    gold = triples(spark, tree(("C", "A"), ("B", "A"), ("A", "C"), ("Z", "A")))
    disjoint = ("B", "owl:disjointWith", "C")
    made = triples(spark, tree(("C", "B"), ("B", "A"), more=[disjoint, ("i", "rdf:type", "B")]))
    got = {r["test"]: r["passed"] for r in alignment.inference_tests(made, gold).collect()}
    assert got == {"consistency": True, "subclass C A": True, "subclass B A": True, "subclass A C": False}
    both = made.union(triples(spark, [("i", "rdf:type", "C")]))
    assert not {r["test"]: r["passed"] for r in alignment.inference_tests(both, gold).collect()}["consistency"]
    assert [tuple(r) for r in alignment.provocation_tests(made).collect()] == [("disjoint B C", True)]
    assert [tuple(r) for r in alignment.provocation_tests(gold).collect()] == [("disjoint", False)]


def graphs(spark, rows):
    return spark.createDataFrame(rows, "graph string, s string, p string, o string")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_versions_are_copied_and_promoted(spark):
    main, staging = versions.MAIN, versions.STAGING + "7"
    t = graphs(spark, [(main, "a", "p", "b"), (staging, "c", "p", "d"), ("other", "e", "p", "f"), (None, "g", "p", "h"), ("urn:graph:pre-promote-7", "old", "p", "x")])
    kept = [(None, "g", "p", "h"), ("other", "e", "p", "f")]
    key = lambda r: tuple(x or "" for x in r)
    got = sorted((tuple(r) for r in versions.promoted(t, "7").collect()), key=key)
    assert got == sorted([*kept, (main, "c", "p", "d"), (staging, "c", "p", "d"), ("urn:graph:pre-promote-7", "a", "p", "b")], key=key)
    assert versions.created(t, "7").where(F.col("graph") == staging).collect() == [(staging, "a", "p", "b")]
    assert versions.copied(t, main, main).count() == 5 and versions.copied(t, "missing", "other").where("graph = 'other'").count() == 0
    assert versions.snapshot(t, "now").where("graph = 'now'").collect() == [("now", "a", "p", "b")]


def test_edits_replace_add_and_leave(spark):
    t = graphs(spark, [("m", "a", "rdfs:label", "old"), ("m", "a", "rdfs:label", "older"), ("m", "a", "rdfs:subClassOf", "p"), ("m", "a", "rdfs:subClassOf", "_:r"), ("m", "p", "rdf:type", "owl:Class"), ("m", "b", "rdfs:label", "b"), ("n", "a", "rdfs:label", "old")])
    edits = spark.createDataFrame([("a", "new", "said", "q"), ("a", "mew", None, None), ("b", None, None, None), (None, "x", None, None)], "s string, label string, comment string, parent string")
    assert rows(versions.edited(t, edits, "m")) == sorted([
        ("m", "a", "rdfs:label", "new"), ("m", "a", "rdfs:comment", "said"), ("m", "a", "rdfs:subClassOf", "_:r"), ("m", "a", "rdfs:subClassOf", "q"),
        ("m", "p", "rdf:type", "owl:Class"), ("m", "b", "rdfs:label", "b"), ("n", "a", "rdfs:label", "old"),
    ])
    assert rows(versions.edited(t, edits.where("false"), "m")) == rows(t)


def test_comparison_of_versions(spark):
    before = triples(spark, [("C", "rdf:type", "owl:Class"), ("C", "rdfs:label", "Cat"), ("i", "rdf:type", "C"), ("q", "rdf:type", "owl:ObjectProperty")])
    after = triples(spark, [("D", "rdf:type", "rdfs:Class"), ("D", "rdf:type", "rdfs:Class"), ("q", "rdf:type", "owl:ObjectProperty")])
    assert rows(versions.things_changed(before, after).select("kind", "uri", "change", F.coalesce("label", F.lit("-")))) == [
        ("class", "C", "removed", "Cat"), ("class", "D", "added", "-"), ("individual", "D", "added", "-"), ("individual", "i", "removed", "-"),
    ]
    got = versions.comparison(before, after).first()
    assert (got["triples_before"], got["triples_after"], got["triples_more"], got["removed_classes"], got["added_individuals"], got["added_properties"]) == (4, 2, -2, 1, 1, 0)


def test_nested_metrics_and_tables(spark):
    reports = [("a", "L1", {"semantic_correctness": 0.5, "hallucination_rate": 0.9, "composite_score": "text", "semantic_match_concept": {"match_percentage": 40}, "owlunit_suite": None}), ("a", "L2", {"semantic_correctness": 1.5, "hallucination_rate": -1}), ("b", "L1", {})]
    df = spark.createDataFrame([(s, x, json.dumps(m)) for s, x, m in reports], "system string, level string, m string").select("system", "level", F.parse_json("m").alias("metrics"))
    table = stats.benchmark_table(df)
    a = table.where("system = 'a' and level is null").first()
    assert (a["n"], a["semantic_correctness"], a["composite_score"], a["semantic_match_concept"], a["owlunit_pass_rate"]) == (2, 1.0, 0, pytest.approx(0.2), 0)
    values = {(r["system"], r["level"], r["metric"]): r["value"] for r in stats.chart_values(table).collect()}
    assert (values["a", "L2", "semantic_correctness"], values["a", "L2", "hallucination_rate"], values["b", "L1", "hallucination_rate"]) == (1, 1, 1)
    lines = {r["system"]: r["line"] for r in stats.latex_rows(table.where("level is null")).collect()}
    assert lines["a"] == r"a & \textbf{1.00} & \textbf{-0.05} & \textbf{0.00} & \textbf{0.00} & \textbf{0.00} & \textbf{0.00} & \textbf{0.00} \\"
    above, below = stats.latex_frame("Systems")
    assert r"\begin{tabular}{l|cccccc|c}" in above and below.endswith(r"\end{table}")


def test_themes_and_hints(spark):
    df = spark.createDataFrame([("What PLANT hazards?",), ("cost of waste",), ("who?",), (None,)], "q string")
    assert [r[0] for r in df.select(text.question_theme(F.col("q"))).collect()] == ["Planning & Scheduling", "Resource Management", "Other", "Other"]
    asked = spark.createDataFrame([(1, "list", ["A", "B", "C", "D"]), (2, "factoid", None), (3, None, ["A"]), (4, "odd", [])], "query int, question_type string, entity_types array<string>")
    assert {r["query"]: r["hint"] for r in records.answer_hints(asked).collect()} == {1: "List all instances of A, B, C that match the question.", 2: "Provide a concise factual answer about relevant entities.", 3: "", 4: ""}
