"""Versions of ontologies: graphs copied, promoted and snapshotted, classes edited, two versions compared by kinds of things."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAIN, STAGING = "urn:graph:main", "urn:graph:staging-"
CLASS, PROPERTY = ("owl:Class", "rdfs:Class"), ("owl:ObjectProperty", "owl:DatatypeProperty", "rdf:Property")
NO_INDIVIDUAL = ("owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty")  # fixed values: what an individual isn't


def placed(triples: DataFrame, where: dict[str, list[str]], gone: list[str]) -> DataFrame:
    """Triples of some graphs under the names given for them; those of graphs that are `gone` are dropped, all others stay. One pass
    without a shuffle."""
    out = F.when(F.col("graph").isin(*gone), F.array().cast("array<string>")).otherwise(F.array("graph"))
    for graph, targets in where.items():
        out = F.when(F.col("graph") == graph, F.array(*map(F.lit, targets))).otherwise(out)
    return triples.select(F.explode(out).alias("graph"), "s", "p", "o")


def copied(triples: DataFrame, source: str, target: str) -> DataFrame:
    """A graph copied over another one, which is emptied if there is no such source; a graph over itself stays."""
    return placed(triples, {source: list(dict.fromkeys([source, target]))}, [target])


def created(triples: DataFrame, version: str) -> DataFrame:
    """A version's staging graph as a copy of the main one."""
    return copied(triples, MAIN, STAGING + version)


def snapshot(triples: DataFrame, label: str) -> DataFrame:
    """The main graph as it is now under a name of its own."""
    return copied(triples, MAIN, label)


def promoted(triples: DataFrame, version: str) -> DataFrame:
    """A version's staging graph in place of the main one, which is kept as urn:graph:pre-promote- and the version."""
    before, staging = f"urn:graph:pre-promote-{version}", STAGING + version
    return placed(triples, {MAIN: [before], staging: [staging, MAIN]}, [before])


def edited(triples: DataFrame, edits: DataFrame, graph: str) -> DataFrame:
    """One graph's classes with new labels, comments and parents by edits (s, label, comment, parent); null leaves what there is.

    A new value takes the place of all old ones, or is added where there was none. Of old parents only those go that are classes of
    the graph themselves. Of several edits of a subject the largest value counts. The graph stays a set; other graphs stay as they are.
    """
    new = edits.where("s is not null").select("s", F.explode(F.create_map(F.lit("rdfs:label"), "label", F.lit("rdfs:comment"), "comment", F.lit("rdfs:subClassOf"), "parent")).alias("p", "new"))
    new = new.where("new is not null").groupBy("s", "p").agg(F.max("new").alias("new"))
    own = triples.where(F.col("graph") == graph).select("s", "p", "o")
    classes = own.where("p = 'rdf:type' and o = 'owl:Class'").select(F.col("s").alias("o")).distinct().withColumn("is_class", F.lit(True))
    touched = own.join(new, ["s", "p"]).join(classes, "o", "left")
    stay = touched.where((F.col("p") == "rdfs:subClassOf") & F.col("is_class").isNull()).select("s", "p", "o")
    rest = own.join(new.select("s", "p"), ["s", "p"], "left_anti")
    after = rest.unionByName(stay).unionByName(new.select("s", "p", F.col("new").alias("o"))).distinct()
    return triples.where(~F.col("graph").eqNullSafe(graph)).select("graph", "s", "p", "o").unionByName(after.select(F.lit(graph).alias("graph"), "s", "p", "o"))


def things(triples: DataFrame) -> DataFrame:
    """(uri, kind): typed subjects as class, property or individual. One that is typed only by rdfs:Class or rdf:Property is an
    individual as well, as readers of plain types take it."""
    has = lambda kinds: F.bool_or(F.col("o").isin(*kinds))
    rows = triples.where("p = 'rdf:type'").groupBy(F.col("s").alias("uri")).agg(has(CLASS).alias("c"), has(PROPERTY).alias("q"), (~has(NO_INDIVIDUAL)).alias("i"))
    kinds = F.filter(F.array(F.when(F.col("c"), "class"), F.when(F.col("q"), "property"), F.when(F.col("i"), "individual")), lambda x: x.isNotNull())
    return rows.select("uri", F.explode(kinds).alias("kind"))


def things_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(kind, uri, change, label): classes, properties and individuals added or removed, with the first of their labels in the version
    that has them."""
    sides = things(before).withColumns({"b": F.lit(1), "a": F.lit(0)}).unionByName(things(after).withColumns({"b": F.lit(0), "a": F.lit(1)}))
    rows = sides.groupBy("uri", "kind").agg(F.max("b").alias("b"), F.max("a").alias("a")).where("a <> b")
    rows = rows.select("kind", "uri", F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"))
    name = lambda t, change: t.where("p = 'rdfs:label'").groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("label")).withColumn("change", F.lit(change))
    return rows.join(name(after, "added").unionByName(name(before, "removed")), ["uri", "change"], "left").select("kind", "uri", "change", "label")


def comparison(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: distinct triples of both versions, their difference, and how many classes, properties and individuals are new or gone."""
    n = lambda kind, change: F.count_if((F.col("kind") == kind) & (F.col("change") == change))
    plural: dict[str, str] = {"class": "classes", "property": "properties", "individual": "individuals"}
    counts: list[Column] = [n(k, c).alias(f"{c}_{name}") for k, name in plural.items() for c in ("added", "removed")]
    size = lambda t, name: t.select("s", "p", "o").distinct().agg(F.count("*").alias(name))
    rows = size(before, "triples_before").join(F.broadcast(size(after, "triples_after"))).join(F.broadcast(things_changed(before, after).agg(*counts)))  # one row each
    return rows.withColumn("triples_more", F.col("triples_after") - F.col("triples_before"))
