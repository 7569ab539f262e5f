"""Queries' types and what is known of them, answered once for each set of types."""

from pyspark.sql import functions as F

from tessera.operators import search


def test_expanded_queries_meet_terms_once_a_set_of_types(spark):
    queries = spark.createDataFrame([(i, t) for i in range(50) for t in ("Pump", "Tank")] + [(90, "Pump"), (90, "Pump"), (91, None), (91, "Tank"), (92, "None such")], "query int, type string")
    known = lambda *rows: spark.createDataFrame(rows, "type string, term string")
    sub, syn, rel = known(("Pump", "Big Pump"), ("Tank", "pump")), known(("Pump", "BIG PUMP"), ("Tank", "vat")), known(("Tank", "Vat"), ("Tank", "Hose"), ("Pump", "hose"))
    got = search.expanded(queries, sub, syn, rel)
    rows = {}
    for r in got.collect():
        rows.setdefault(r["query"], []).append((r["place"], r["term"]))
    both = [(0, "Pump"), (0, "Tank"), (1, "Big Pump"), (2, "vat"), (3, "Hose")]
    assert all(sorted(rows[i]) == both for i in range(50))
    assert sorted(rows[90]) == [(0, "Pump"), (1, "Big Pump"), (3, "hose")] and rows[92] == [(0, "None such")]
    assert sorted(rows[91], key=str) == sorted([(0, None), (0, "Tank"), (1, "pump"), (2, "vat"), (3, "Hose")], key=str)
    assert "Aggregate" not in got._jdf.queryExecution().optimizedPlan().toString()  # no grouping of queries by terms
    assert search.expanded(queries.where(F.lit(False)), sub, syn, rel).count() == 0
