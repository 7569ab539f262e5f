"""Operators on small hand-made inputs."""

import pytest
from pyspark.sql import Row

from tessera.functions import text
from tessera.operators import debate, feedback, graph, matching, metrics, rules, stats
from tessera.sources.chunks import chunked


def values(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_two_of_three_votes_agree(spark):
    votes = spark.createDataFrame([("a", "llm", "x", 0.9), ("a", "embedding", "x", 0.8), ("a", "cooccurrence", "y", 0.5)], "label string, strategy string, parent string, confidence double")
    row = matching.weighted_votes(votes, {"llm": 0.5, "embedding": 0.3, "cooccurrence": 0.2}).first()
    assert row["parent"] == "x" and row["agreement"] == pytest.approx(2 / 3) and row["confidence"] == pytest.approx(0.69)


def test_weights_decide(spark):
    votes = spark.createDataFrame([("a", "llm", "x", 0.9), ("a", "embedding", "y", 0.9), ("a", "cooccurrence", None, 0.5)], "label string, strategy string, parent string, confidence double")
    row = matching.weighted_votes(votes, {"llm": 0.1, "embedding": 0.8, "cooccurrence": 0.1}).first()
    assert row["parent"] == "y" and row["agreement"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("a, b, want", [([1.0, 0.0], [1.0, 0.0], 1.0), ([1.0, 0.0], [0.0, 1.0], 0.0), ([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 0.0], 0.0)])
def test_cosine(spark, a, b, want):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    assert df.select(text.cosine(df["a"], df["b"])).first()[0] == pytest.approx(want)


def test_rouge_l(spark):
    df = spark.createDataFrame([("the cat sat", "the cat on the mat sat"), ("a b", "c d"), ("", "x")], "a string, b string")
    got = [r[0] for r in df.select(text.rouge_l(df["a"], df["b"])).collect()]
    assert got == pytest.approx([2 * 3 / 9, 0.0, 0.0])


def test_answers(spark):
    df = spark.createDataFrame([("<think>b</think> (c) it is",), ("True, since",), ("none",), ("x\nFinal answer: 42",)], "t string")
    t = df["t"]
    rows = df.select(text.choice_letter(t), text.truth(t), text.final_answer(t)).collect()
    assert rows[0][0] == "C" and rows[1][1] == "true" and rows[2][0] is None and rows[3][2] == "42"


def test_tuples(spark):
    df = spark.createDataFrame([("('a', \"b\") (c) (d, e, f)",)], "t string")
    assert df.select(text.tuples(df["t"])).first()[0] == [["a", "b"], ["d", "e", "f"]]


def test_local_names(spark):
    df = spark.createDataFrame([("http://x.org/a#LegalPerson",), ("http://x.org/Act",)], "u string")
    assert [tuple(r) for r in df.select(text.local_name(df["u"]), text.spaced_label(df["u"])).collect()] == [("LegalPerson", "legal person"), ("Act", "act")]


CLASSES = "uri string, label string, parent string, is_new boolean, disjoint boolean"


def test_cycle_is_found_once(spark):
    df = spark.createDataFrame([("a", "A", "b", True, False), ("b", "B", "a", True, False), ("c", "C", None, True, False)], CLASSES)
    assert values(rules.cycles(df), "rule", "affected") == [("cycle", "a")]


def test_many_children_and_single_child(spark):
    df = spark.createDataFrame([(f"k{i}", f"K{i}", "root", True, False) for i in range(13)] + [("leaf", "Leaf", "k1", True, False)], CLASSES)
    found = {(r["rule"], r["affected"]) for r in rules.all_rules(df, spark.createDataFrame([("p", "leaf"), ("p", "k1")], "name string, uri string")).collect()}
    assert {("too_many_children", "root"), ("single_child", "k1"), ("redundant_property", "p@leaf")} <= found


MESSAGES = "debate long, seq long, role string, message_type string, approves boolean, reasoning string"


def test_consensus_needs_known_approvals_after_the_last_change(spark):
    rows = [(1, 0, "a", "proposal", None, "p"), (1, 1, "b", "review", False, "n"), (1, 2, "a", "revision", None, "q"), (1, 3, "b", "review", True, "y")]
    rows += [(2, 0, "a", "proposal", None, "p"), (2, 1, "b", "review", True, "y"), (2, 2, "c", "review", None, "?")]
    rows += [(3, 0, "a", "proposal", None, "p")]
    assert values(debate.consensus(spark.createDataFrame(rows, MESSAGES)), "debate", "consensus") == [(1, True), (2, False), (3, False)]


def test_convergence(spark):
    df = spark.createDataFrame([(1, 0.3), (2, 0.5), (3, 0.7), (4, 0.71)], "iteration int, value double")
    row = feedback.convergence(df).first()
    assert row["converged_at"] == 4 and row["delta"] == pytest.approx(0.41)


def test_trend_with_few_signals_is_one_rate(spark):
    df = spark.createDataFrame([("e", i, "accepted" if i % 2 else "rejected") for i in range(3)], "element string, seq long, decision string")
    assert [r["rate"] for r in feedback.acceptance_trend(df, "element").collect()] == pytest.approx([1 / 3])


def test_shortest_path_and_hops(spark):
    edges = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("a", "d", "r", 1.0), ("d", "c", "r", 1.0)], "src string, dst string, rel string, confidence double")
    assert ("c", 2, "a>b>c") in values(graph.shortest_paths(edges, "a"), "id", "length", "path")
    assert values(graph.hops(edges, spark.createDataFrame([("a",)], "id string"), 1), "id", "hop") == [("a", 0), ("b", 1), ("d", 1)]


def test_pagerank_sums_to_one(spark):
    edges = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 1.0)], "src string, dst string, rel string, confidence double")
    ranks = {r["id"]: r["rank"] for r in graph.pagerank(edges, spark.createDataFrame([("a",)], "id string")).collect()}
    assert sum(ranks.values()) == pytest.approx(1.0) and ranks["b"] > ranks["c"]


def test_triple_f1_is_positional(spark):
    df = spark.createDataFrame([Row(predicted=["x", "y"], expected=["y", "x", "z"])])
    assert metrics.triple_f1(df).first()["matched"] == 0 and metrics.tuple_f1(df).first()["matched"] == 2


def test_effect_size(spark):
    df = spark.createDataFrame([("m", 1.0, 0.0), ("m", 2.0, 1.5), ("m", 3.0, 2.0)], "metric string, a double, b double")
    row = stats.paired_statistics(df).first()
    assert row["n"] == 3 and row["mean_difference"] == pytest.approx(2.5 / 3) and row["effect"] == "large"


def test_chunks_overlap(spark):
    df = spark.createDataFrame([(1, "abcdefgh"), (2, ""), (3, None)], "id long, text string")
    assert [r["content"] for r in chunked(df, "id", "text", 4, 1).orderBy("chunk").collect()] == ["abcd", "defg", "gh"]
    with pytest.raises(ValueError):
        chunked(df, "id", "text", 4, 4)
