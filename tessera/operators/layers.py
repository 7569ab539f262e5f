"""Named graphs of triples (graph, s, p, o): merging, comparing, changing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import numbered

SEED = "urn:graph:seed"


def merged(triples: DataFrame, up_to: int | None = None) -> DataFrame:
    """Seed and extension layers, up to a version, as one set of triples."""
    version = F.regexp_extract("graph", r"ext-v(\d+)$", 1)
    wanted = F.col("graph") == SEED
    later = version != ""
    if up_to is not None:
        later = later & (version.cast("int") <= up_to)
    return triples.where(wanted | later).select("s", "p", "o").distinct()


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Triples added and removed between two sets, in one pass over both."""
    sides = before.distinct().withColumns({"b": F.lit(1), "a": F.lit(0)}).union(after.distinct().withColumns({"b": F.lit(0), "a": F.lit(1)}))
    by = sides.groupBy("s", "p", "o").agg(F.max("b").alias("b"), F.max("a").alias("a")).where("a <> b")
    return by.select("s", "p", "o", F.when(F.col("a") == 1, "added").otherwise("removed").alias("change"))


def classes(triples: DataFrame) -> DataFrame:
    """Classes with their label, or local name without one."""
    from tessera.functions.text import local_name

    named = triples.where("p = 'rdfs:label'").groupBy("s").agg(F.min("o").alias("label"))
    uris = triples.where("p = 'rdf:type' and o in ('owl:Class', 'rdfs:Class')").select("s").distinct()
    return uris.join(named, "s", "left").select(F.col("s").alias("uri"), F.coalesce("label", local_name(F.col("s"))).alias("label"))


def summary(triples: DataFrame) -> DataFrame:
    """Triples, subjects and classes of each graph."""
    return triples.groupBy("graph").agg(F.count("*").alias("triples"), F.countDistinct("s").alias("subjects"), F.count_if((F.col("p") == "rdf:type") & (F.col("o") == "owl:Class")).alias("classes"))


def removed(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """Triples in which none of the removed uris (uri) is subject, predicate or object."""
    g = gone.select("uri").distinct()
    for c in ("s", "p", "o"):
        triples = triples.join(g, triples[c] == g["uri"], "left_anti")
    return triples


def by_dependents(classes: DataFrame, dependents: DataFrame) -> DataFrame:
    """classes (uri) with how many dependents (uri, one row each) they have and their place in that order, ties by uri."""
    counted = classes.join(dependents.groupBy("uri").agg(F.count("*").alias("dependents")), "uri", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    return numbered(counted, ["dependents", "uri"], "nth")


def periphery(classes: DataFrame, dependents: DataFrame, share: float) -> DataFrame:
    """The share of classes (uri) with the fewest dependents, at least one class; ties by uri."""
    most = max(1, int(classes.count() * share))
    return by_dependents(classes, dependents).where(F.col("nth") <= most).select("uri", "dependents")


def graded(classes: DataFrame, dependents: DataFrame, levels: list[float]) -> DataFrame:
    """(level, removed, dependents): what the periphery of each level holds."""
    n = classes.count()
    cuts = F.array(*[F.struct(F.lit(x).alias("level"), F.lit(max(1, int(n * x))).alias("most")) for x in levels])
    rows = by_dependents(classes, dependents).withColumn("l", F.explode(cuts)).where("nth <= l.most")
    return rows.groupBy(F.col("l.level").alias("level")).agg(F.count("*").alias("removed"), F.sum("dependents").alias("dependents"))


def relabelled(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """The old labels of the given subjects (s, label) replaced by the new ones."""
    old = triples.where("p = 'rdfs:label'").join(labels.select("s"), "s", "left_semi")
    kept = triples.join(old, ["graph", "s", "p", "o"], "left_anti")
    new = old.select("graph", "s", "p").distinct().join(labels, "s").select("graph", "s", "p", F.col("label").alias("o"))
    return kept.select("graph", "s", "p", "o").union(new)


def promoted(triples: DataFrame, source: str, target: str) -> DataFrame:
    """A graph copied over another one."""
    return triples.where(F.col("graph") != target).union(triples.where(F.col("graph") == source).withColumn("graph", F.lit(target)))


def ntriples(triples: DataFrame) -> DataFrame:
    """One line a triple; objects with a scheme are IRIs, others literals."""
    iri = lambda c: F.concat(F.lit("<"), F.col(c), F.lit(">"))
    literal = F.concat(F.lit('"'), F.replace(F.replace("o", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return triples.select(F.concat_ws(" ", iri("s"), iri("p"), F.when(F.col("o").rlike("^[a-z]+:"), iri("o")).otherwise(literal), F.lit(".")).alias("value"))


def dependent_properties(triples: DataFrame) -> DataFrame:
    """(uri, property): properties that have a class as domain or range, each once."""
    from tessera.operators.patterns import DATA, OBJECTS, typed

    ends = triples.where("p in ('rdfs:domain', 'rdfs:range')").select(F.col("o").alias("uri"), F.col("s").alias("property")).distinct()
    return ends.join(typed(triples, (*OBJECTS, *DATA), "property"), "property", "left_semi").select("uri", "property")


def shuffled_periphery(classes: DataFrame, dependents: DataFrame, share: float, seed: int) -> DataFrame:
    """As `periphery`, classes of as many dependents being in an order that a seed shuffles, the same in every run."""
    keys = classes.select("uri").where("uri is not null").distinct().withColumn("mixed", F.md5(F.concat(F.lit(f"{seed}:"), "uri")))
    counted = keys.join(dependents.groupBy("uri").agg(F.count("*").alias("dependents")), "uri", "left").withColumn("dependents", F.coalesce("dependents", F.lit(0)))
    most = max(1, int(keys.count() * share))
    return numbered(counted, ["dependents", "mixed", "uri"], "nth").where(F.col("nth") <= most).select("uri", "dependents", "nth")
