"""Versions of the bound ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import versions
from tessera.plans.binding import view
from tessera.plans.quality import SIDES, sides
from tessera.plans.registered import query

GRAPHS = """WITH t AS (SELECT CASE graph WHEN 'urn:graph:seed' THEN 'urn:graph:main' WHEN 'urn:graph:ext-v1' THEN 'urn:graph:staging-1' ELSE graph END AS graph, s, p, o FROM {triples}) """


def graphs(spark, sf_dir):
    names = F.when(F.col("graph") == "urn:graph:seed", versions.MAIN).when(F.col("graph") == "urn:graph:ext-v1", versions.STAGING + "1").otherwise(F.col("graph"))
    return view(spark, sf_dir, "triples").withColumn("graph", names)


@query(GRAPHS + "SELECT * FROM t UNION ALL SELECT 'urn:graph:staging-2', s, p, o FROM t WHERE graph = 'urn:graph:main'")
def version_created(spark, sf_dir):
    """A version's staging graph from the main one."""
    return versions.created(graphs(spark, sf_dir), "2")


@query(GRAPHS + """SELECT * FROM t WHERE graph <> 'urn:graph:main' UNION ALL SELECT 'urn:graph:main', s, p, o FROM t WHERE graph = 'urn:graph:staging-1' UNION ALL SELECT 'urn:graph:pre-promote-1', s, p, o FROM t WHERE graph = 'urn:graph:main'""")
def version_promoted(spark, sf_dir):
    """Staging in place of main, with a snapshot of main before."""
    return versions.promoted(graphs(spark, sf_dir), "1")


@query(GRAPHS + """, e AS (SELECT DISTINCT concat('urn:class#', child) AS s, CASE WHEN length(child) % 2 = 0 THEN concat('New ', child) END AS label, CASE WHEN length(child) % 3 = 0 THEN concat('About ', child) END AS comment, CASE WHEN length(child) % 5 = 0 THEN 'urn:class#Thing' END AS parent FROM {class_tree}),
    n AS (SELECT s, 'rdfs:label' AS p, label AS o FROM e WHERE label IS NOT NULL UNION ALL SELECT s, 'rdfs:comment', comment FROM e WHERE comment IS NOT NULL UNION ALL SELECT s, 'rdfs:subClassOf', parent FROM e WHERE parent IS NOT NULL), m AS (SELECT DISTINCT s, p, o FROM t WHERE graph = 'urn:graph:main'),
    c AS (SELECT s FROM m WHERE p = 'rdf:type' AND o = 'owl:Class')
    SELECT * FROM t WHERE graph <> 'urn:graph:main' UNION ALL SELECT 'urn:graph:main', s, p, o FROM (SELECT s, p, o FROM m WHERE NOT (concat(s, '|', p) IN (SELECT concat(s, '|', p) FROM n) AND (p <> 'rdfs:subClassOf' OR o IN (SELECT s FROM c))) UNION SELECT s, p, o FROM n) AS x""")
def class_edits(spark, sf_dir):
    """Labels, comments and parents replaced."""
    child, n = F.col("child"), F.length("child")
    edits = view(spark, sf_dir, "class_tree").select(
        F.concat(F.lit("urn:class#"), child).alias("s"), F.when(n % 2 == 0, F.concat(F.lit("New "), child)).alias("label"), F.when(n % 3 == 0, F.concat(F.lit("About "), child)).alias("comment"), F.when(n % 5 == 0, "urn:class#Thing").alias("parent")
    )
    return versions.edited(graphs(spark, sf_dir), edits.distinct(), versions.MAIN)


KINDS = SIDES + ", " + ", ".join(
    f"""{t}y AS (SELECT s AS uri, bool_or(o IN ('owl:Class', 'rdfs:Class')) AS c, bool_or(o IN ('owl:ObjectProperty', 'owl:DatatypeProperty', 'rdf:Property')) AS q, NOT bool_or(o IN ('owl:Class', 'owl:ObjectProperty', 'owl:DatatypeProperty')) AS i FROM {t} WHERE p = 'rdf:type' GROUP BY s),
    {t}k AS (SELECT uri, 'class' AS kind FROM {t}y WHERE c UNION ALL SELECT uri, 'property' FROM {t}y WHERE q UNION ALL SELECT uri, 'individual' FROM {t}y WHERE i)"""
    for t in "gk"
) + """, d AS (SELECT kind, uri, 'added' AS change, (SELECT min(o) FROM k WHERE s = uri AND p = 'rdfs:label') AS label FROM (SELECT * FROM kk EXCEPT SELECT * FROM gk) AS x UNION ALL SELECT kind, uri, 'removed', (SELECT min(o) FROM g WHERE s = uri AND p = 'rdfs:label') FROM (SELECT * FROM gk EXCEPT SELECT * FROM kk) AS y)"""


@query(KINDS + " SELECT kind, uri, change, label FROM d")
def things_changed(spark, sf_dir):
    """Classes, properties and individuals that one version has and the other hasn't."""
    return versions.things_changed(*sides(spark, sf_dir))


@query(KINDS + " SELECT (SELECT count(*) FROM g) AS triples_before, (SELECT count(*) FROM k) AS triples_after, (SELECT count(*) FROM k) - (SELECT count(*) FROM g) AS triples_more, " + ", ".join(f"(SELECT count(*) FROM d WHERE kind = '{k}' AND change = '{c}') AS {c}_{n}" for k, n in (("class", "classes"), ("property", "properties"), ("individual", "individuals")) for c in ("added", "removed")))
def version_comparison(spark, sf_dir):
    """How two versions differ, in numbers."""
    return versions.comparison(*sides(spark, sf_dir))
