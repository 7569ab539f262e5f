"""Hierarchy statistics, cases, inherited shapes, contexts and strict pairs on small known inputs."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import gaps, graph, layers, quality, retrieval, stats
from tests.spent import most_rows


def triples(spark, rows):
    return spark.createDataFrame(rows, "s string, p string, o string")


def test_hierarchy_metrics(spark):
    tree = spark.createDataFrame([("A", "Top"), ("B", "A"), ("C", "A"), ("C", "A"), ("D", "C"), ("D", "Top"), ("X", "Y"), ("Y", "X"), (None, "A")], "child string, parent string")
    classes = spark.createDataFrame([(x,) for x in ["Top", "A", "B", "C", "D", "X", "alone", "A", None]], "uri string")
    got = graph.hierarchy_metrics(classes, tree, "Top").first().asDict()
    assert (got["classes"], got["orphans"], got["depth_min"], got["depth_max"], got["depth_mean"], got["depth_median"]) == (7, 1, 0, 2, pytest.approx(1.2), 1)
    assert got["branching_mean"] == pytest.approx((2 + 2 + 1 + 1) / 4) and got["branching_max"] == 2 and got["leaf_ratio"] == pytest.approx(3 / 7)
    none = graph.hierarchy_metrics(classes.where("false"), tree.where("false"), "Top").first()
    assert (none["classes"], none["depth_max"], none["depth_stdev"], none["leaf_ratio"], none["orphans"]) == (0, 0, 0, 0, 0)


def test_shuffled_periphery_is_the_same_in_every_run(spark):
    classes = spark.createDataFrame([(f"c{i}",) for i in range(20)], "uri string")
    dependents = spark.createDataFrame([("c3",), ("c3",), ("c4",), ("zz",)], "uri string")
    pick = lambda seed, share=0.5: [r["uri"] for r in layers.shuffled_periphery(classes.repartition(3), dependents, share, seed).orderBy("nth").collect()]
    assert pick(1) == pick(1) != pick(2) and len(pick(1)) == 10 and not {"c3", "c4"} & set(pick(1))
    assert pick(1, 1.0)[-2:] == ["c4", "c3"] and len(pick(1, 0.0)) == 1


def test_inherited_shapes(spark):
    onto = triples(spark, [
        ("B", "rdfs:subClassOf", "A"), ("C", "rdfs:subClassOf", "B"), ("A", "rdfs:subClassOf", "C"),
        ("age", "rdf:type", "owl:DatatypeProperty"), ("age", "rdfs:domain", "A"), ("age", "rdfs:range", "xsd:integer"), ("age", "owl:cardinality", "1"),
        ("near", "rdf:type", "owl:ObjectProperty"), ("near", "rdfs:domain", "A"), ("near", "rdfs:range", "D"), ("E", "rdfs:subClassOf", "D"),
    ])
    rows = [("x", "C", "age", "7"), ("x", "C", "age", "7"), ("x", "C", "near", "e"), ("e", "E", "age", "no rule"), ("y", "B", "age", "7"), ("y", "B", "age", "old"), ("y", "B", "near", "x"), ("z", "A", "age", None), (None, None, "age", "1")]
    instances = spark.createDataFrame(rows, "id string, class string, attribute string, value string")
    got = sorted(tuple(r) for r in quality.inherited_violations(onto, instances).collect())
    assert got == [("y", "age", "datatype"), ("y", "age", "maxCount"), ("y", "near", "class"), ("z", "age", "minCount")]
    assert quality.inherited_violations(onto, instances.where("false")).count() == 0


def test_structural_scores_and_contexts(spark):
    entities = spark.createDataFrame([("T", i, f"e{i}") for i in range(7)] + [("U", 1, "x"), (None, 1, "e1")], "entity_type string, seq int, id string")
    degrees = spark.createDataFrame([("e0", 5), ("e1", 20), ("e6", 9)], "id string, degree int")
    assert {r["entity_type"]: (r["entities"], r["score"]) for r in gaps.structural_scores(entities, degrees).collect()} == {"T": (5, 5.0), "U": (1, 0.0)}
    kind = "entity_type string, frequency long, closest_class string, distance double, examples array<string>, evidence string"
    found = spark.createDataFrame([("Pump", 3, "Device", 0.256, ["a", "b", "c", "d"], "a -[x]-> b"), ("Tank", None, "", None, None, "")], kind)
    got = {r["entity_type"]: r["context"].split("\n") for r in gaps.gap_contexts(found).collect()}
    assert got["Pump"] == ["Gap Candidate: Pump", "  Frequency: 3", "  Closest seed class: Device", "  Semantic distance: 0.26", "  Examples: a, b, c", "", "a -[x]-> b"]
    assert got["Tank"][2:4] == ["  Closest seed class: none", "  Semantic distance: 1.00"] and got["Tank"][-1].startswith("(No graph")


def test_breakdown_adds_up_to_the_score(spark):
    paths = spark.createDataFrame([(1, "hasPart", 0.5), (1, None, 1.0), (2, "x", -9.0)], "path_id int, rel string, confidence double")
    got = {r["path_id"]: r for r in retrieval.path_breakdown(paths, ["PART"]).collect()}
    assert (got[1]["confidence"], got[1]["relevance"], got[1]["brevity"]) == pytest.approx((0.3, 0.225, 0.075)) and got[1]["score"] == pytest.approx(0.6)
    assert got[2]["score"] == 0 and retrieval.path_breakdown(paths, []).where("path_id = 2").first()["relevance"] == pytest.approx(0.225)


def test_strict_pairs(spark):
    rows = [("a", 1, "L", 0.5), ("b", 1, "L", 0.25), ("c", 2, "L", 1.0)]
    results = spark.createDataFrame(rows, "system string, test_case int, level string, semantic double")
    assert stats.paired_strictly(results, "a", "b", ("semantic",)).select((F.col("a") - F.col("b")).alias("d")).first()["d"] == 0.25
    with pytest.raises(ValueError):
        stats.paired_strictly(results, "a", "c", ("semantic",))
    with pytest.raises(ValueError):
        stats.paired_strictly(results.union(results.where("system = 'a'")), "a", "b", ("semantic",))


def test_inherited_shapes_meet_classes_and_not_instances(spark):
    """500 instances of one class whose ancestor has 20 properties of 30 ranges each: ranges that a value isn't of don't become rows."""
    rules = [("low", "rdfs:subClassOf", "mid"), ("mid", "rdfs:subClassOf", "top"), ("inner", "rdfs:subClassOf", "r0")]
    rules += [x for i in range(20) for x in [(f"p{i}", "rdf:type", "owl:ObjectProperty"), (f"p{i}", "rdfs:domain", "top"), *[(f"p{i}", "rdfs:range", f"r{k}") for k in range(30 if i else 1)]]]
    rows = [(f"x{n}", "low", f"p{i}", f"v{i % 2}") for n in range(500) for i in range(20)] + [("v0", "inner", None, None), ("v1", "r1", None, None)]
    instances = spark.createDataFrame(rows, "id string, class string, attribute string, value string")
    onto = triples(spark, rules)
    got = quality.inherited_violations(onto, instances)
    assert {(r["attribute"], r["violation"]) for r in got.collect()} == {(f"p{i}", "class") for i in range(1, 20)} and got.count() == 500 * 19
    assert most_rows(got) <= 20_000


def test_two_classes_of_an_instance_ask_for_all_their_ranges(spark):
    onto = triples(spark, [("near", "rdf:type", "owl:ObjectProperty"), ("near", "rdfs:domain", "A"), ("near", "rdfs:domain", "B"), ("near", "rdfs:range", "C"), ("near", "rdfs:range", "D")])
    rows = [("x", "A", "near", "y"), ("x", "B", "near", "y"), ("z", "B", "near", "w"), ("y", "C", None, None), ("w", "C", None, None), ("w", "D", None, None)]
    got = quality.inherited_violations(onto, spark.createDataFrame(rows, "id string, class string, attribute string, value string"))
    assert [tuple(r) for r in got.collect()] == [("x", "near", "class")]
