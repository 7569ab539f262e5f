"""Benchmark files, fuzzy matches and reply parsing against small fixtures."""

import itertools
import json
import math

import pytest
from pyspark.sql import functions as F

from tessera.functions import fuzzy, replies
from tessera.operators import exports, graph, matching, quality, retrieval, rules, search
from tessera.sources import results


def test_predictions_and_results(spark, tmp_path):
    rows = spark.createDataFrame([("a/b:c", "zero", "U1", 1, "x"), ("a/b:c", "few", "U2", 2, "y")], "model string, strategy string, split_id string, id int, answer string")
    results.write_predictions(rows, f"{tmp_path}/p")
    got = results.read_predictions(spark, f"{tmp_path}/p", "id int, answer string, model string, strategy string, split_id string")
    assert sorted(tuple(r) for r in got.select("model", "strategy", "split_id", "id").collect()) == [("a_b_c", "few", "U2", 2), ("a_b_c", "zero", "U1", 1)]
    folder = tmp_path / "r"
    folder.mkdir()
    (folder / "one_result.json").write_text(json.dumps({"system": "s", "test_case": "t", "level": "L1", "scores": {"f1": 0.5}}, indent=1))
    (folder / "bad_result.json").write_text("{ not json")
    (folder / "other.json").write_text("{}")
    found = results.read_results(spark, str(folder))
    assert [(r["system"], r["scores"]) for r in found.collect()] == [("s", {"f1": 0.5})]
    wanted = spark.createDataFrame([("s", "t"), ("s", "u")], "system string, test_case string")
    assert [r["test_case"] for r in results.unfinished(wanted, found, ["system", "test_case"]).collect()] == ["u"]


def test_reference_files(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([{"label": "A", "definition": "first"}, {"id": "B"}]))
    (tmp_path / "t.csv").write_text("subject,predicate,object\na,p,b\n")
    (tmp_path / "n.txt").write_text("é" * 12_000)
    assert sorted(tuple(r) for r in results.read_concepts(spark, str(tmp_path)).collect()) == [("c", "A", "first"), ("c", "B", "")]
    assert [tuple(r) for r in results.read_triple_csv(spark, str(tmp_path)).collect()] == [("t", "a", "p", "b")]
    assert [(r["name"], len(r["text"])) for r in results.read_texts(spark, str(tmp_path)).collect()] == [("n", 10_000)]


def slow_common(a, b):
    return max((len(s) for n in range(len(a) + 1) for s in map("".join, itertools.combinations(a, n)) if subsequence(s, b)), default=0)


def subsequence(s, t):
    it = iter(t)
    return all(c in it for c in s)


@pytest.mark.parametrize("a, b", [("", ""), ("a", ""), ("kitten", "sitting"), ("abcde", "badce"), ("waste", "wastes"), ("ééx", "xéé")])
def test_indel_ratio(a, b):
    assert fuzzy.common(a, b) == slow_common(a, b)
    assert fuzzy.ratio(a, b) == (2 * slow_common(a, b) / (len(a) + len(b)) if a or b else 1.0)


def test_partial_ratio():
    assert fuzzy.partial("plan", "the plant plan") == 1.0 and fuzzy.partial("abc", "xxbcxx") == pytest.approx(2 / 3)
    assert fuzzy.partial("", "x") == 0.0 and fuzzy.partial("", "") == 1.0


def test_fuzzy_matches_equal_brute_force(spark):
    left = ["Facility", "facilities", "wastes", "plan", "ab", "a", "Decommissioning plan", None]
    right = ["facility", "waste", "plans", "planning", "ab", "b", "decomissioning plan"]
    df = lambda x: spark.createDataFrame([(w,) for w in x], "label string")
    got = {(r["left"], r["right"]) for r in matching.fuzzy_matches(df(left), df(right), 0.85).collect()}
    assert got == {(a.lower(), b.lower()) for a in left if a for b in right if fuzzy.ratio(a.lower(), b.lower()) >= 0.85}


def test_three_tiers(spark):
    v = [1.0, 0.0]
    entities = spark.createDataFrame([(1, "x", "Waste", v), (2, "WASTE", "t", v), (3, "x", "wastes", None), (4, "x", "zzz", v), (5, "x", "zzz", [0.0, 1.0]), (6, "y", None, None)], "id long, label string, entity_type string, embedding array<double>")
    classes = spark.createDataFrame([("waste", None), ("other", [0.9, 0.1])], "label string, embedding array<double>")
    got = {r["id"]: r["tier"] for r in matching.three_tiers(entities, classes).collect()}
    assert got == {1: "exact", 2: "exact", 3: "fuzzy", 4: "vector", 5: "none", 6: "none"}


@pytest.mark.parametrize("few", [1_000, 0])
def test_substrings_with_few_and_many_terms(spark, few):
    texts = spark.createDataFrame([(1, "a fact"), (2, ""), (3, None), (4, "act act")], "id int, text string")
    terms = spark.createDataFrame([("act",), ("fact",), ("",), ("none",), ("a fact and more",)], "label string")
    assert sorted((r["id"], r["label"]) for r in matching.holding(texts, terms, few=few).collect()) == [(1, "act"), (1, "fact"), (4, "act")]


def test_linking(spark):
    terms = spark.createDataFrame([(1, "plan"), (1, "E2")], "query int, term string")
    entities = spark.createDataFrame([("e1", "Master plan", None), ("e2", "zzz", "qq"), ("e3", "planet orbit systems", "x"), ("e4", "none", None)], "id string, label string, description string")
    got = [(r["id"], round(r["score"], 3), r["rank"]) for r in search.linked_entities(terms, entities).orderBy("rank").collect()]
    assert got == [("e2", 120.0, 1), ("e1", 100.0, 2), ("e3", 100.0, 3)]


def test_linking_answers_equal_queries_once(spark):
    terms = spark.createDataFrame([(q, w) for q in range(20) for w in (["plan", "E2"] if q % 2 else ["E2", "PLAN", "plan", "orbit"])], "query int, term string")
    asked = search.alike_queries(terms)
    assert sorted((r["query"], r["one"]) for r in asked.collect()) == [(q, q % 2) for q in range(20)]
    entities = spark.createDataFrame([("e1", "Master plan", None), ("e1", "Orbit", "x"), ("e2", None, "qq"), ("e3", "planet orbit systems", "x"), ("e4", "none", None)], "id string, label string, description string")
    got = {}
    for r in search.linked_entities(terms, entities).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append((r["id"], round(r["score"], 3)))
    assert got == {q: [("e2", 120.0), ("e1", 100.0), ("e3", 100.0)] for q in range(20)}


@pytest.mark.parametrize("text, want", [("no", None), ('a {"x": {"y": "}"}, } b', {"x": {"y": "}"}}), ("{bad} {\"k\": [1,2,]}", {"k": [1, 2]}), ('{"open": 1', None), ('{"q": "\\"}"}', {"q": '"}'})])
def test_json_blocks(text, want):
    got = replies.block(text)
    assert (json.loads(got) if got else None) == want


def test_text_scores():
    same = replies.text_scores("The cat sat on the mat", "the cat sat on the mat")
    assert same == pytest.approx((1, 1, 1, 1))
    r1, r2, rl, bleu = replies.text_scores("a b c d e", "a b x d e f")
    assert (r1, r2, rl) == pytest.approx((8 / 11, 4 / 9, 8 / 11)) and bleu == 0
    assert replies.text_scores("a b c d", "a b c d e f")[3] == pytest.approx(math.exp(1 - 6 / 4))


@pytest.mark.parametrize("t, df, p", [(2.0, 10, 0.07338803), (0.0, 5, 1.0), (-12.0, 30, 5.5e-13), (1.96, 1e6, 0.04999579)])
def test_two_sided_p(t, df, p):
    assert quality.two_sided(t, df) == pytest.approx(p, rel=2e-2 if p < 1e-9 else 1e-5)


def test_long_chains_and_cycles(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)]
    ring = [(f"r{i}", f"r{(i + 1) % 10}") for i in range(10)] + [("below", "r4")]
    tree = spark.createDataFrame(chain + ring, "child string, parent string")
    up = {(r["node"], r["ancestor"]): r["depth"] for r in graph.closure(tree).collect()}
    assert up["n00", "n12"] == 12 and up["r3", "r2"] == 9 and up["r3", "r3"] == 10 and up["below", "r3"] == 10
    assert graph.chain_depth(spark.createDataFrame(chain, tree.schema)).first()[0] == 13
    classes = tree.withColumnsRenamed({"child": "uri"})
    assert [r["affected"] for r in rules.cycles(classes).collect()] == ["r0"]
    assert graph.descendants(tree, "n12").count() == 13


def test_paths_equal_brute_force(spark):
    edges = [("a", "b", "r"), ("b", "c", "r"), ("a", "c", "s"), ("c", "d", "r"), ("b", "d", "s"), ("d", "e", "r")]
    steps = {(a, b) for a, b, _ in edges} | {(b, a) for a, b, _ in edges}
    want = {p for n in range(2, 6) for p in itertools.permutations("abcde", n) if p[0] == "a" and p[-1] == "d" and len(p) - 1 <= 3 and all(x in steps for x in itertools.pairwise(p))}
    got = {tuple(r["path"]) for r in graph.simple_paths(spark.createDataFrame(edges, "src string, dst string, rel string"), "a", "d", 3).collect()}
    assert got == want


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("x")).repartition(7)
    assert [r["n"] for r in retrieval.numbered(rows, ["x"], "n").orderBy("x").collect()] == list(range(1, 1001))


def test_missing_layer_is_an_error(spark):
    triples = spark.createDataFrame([("g", "s", "p", "o")], "graph string, s string, p string, o string")
    assert exports.layer(triples, "g").count() == 1
    with pytest.raises(KeyError):
        exports.layer(triples, "h")


def test_bulk_stops_at_the_first_error(spark):
    rows = spark.createDataFrame([(1, 1, True), (1, 2, False), (1, 3, True), (1, 4, False), (2, 1, True)], "batch int, seq int, ok boolean")
    assert [tuple(r) for r in exports.bulk(rows).orderBy("batch", "seq").collect()] == [(1, 1, "applied"), (1, 2, "failed"), (1, 3, "skipped"), (1, 4, "skipped"), (2, 1, "applied")]
