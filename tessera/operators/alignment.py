"""Generated ontologies against reference ontologies, by words and vectors: concepts, statements, entity types, six scores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.lineage import settle
from tessera.operators import graph, matching, metrics, patterns, quality, vectors

CONCEPTS, STATEMENTS, TYPES = 0.55, 0.50, 0.80  # fixed values: least likeness of concepts, of statements and of entity types


def by_words(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(label, match, score, tier) of labels that share enough words, ignoring case."""
    text = lambda df: df.select(F.col("label").alias("text"))
    spelled = right.groupBy(F.lower("label").alias("right")).agg(F.min("label").alias("match"))
    pairs = metrics.alike(text(left), text(right), least).join(spelled, "right")
    return left.select("label", F.lower("label").alias("left")).join(pairs, "left").select("label", "match", F.col("overlap").alias("score"), F.lit("words").alias("tier"))


def by_vectors(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(label, match, score, tier) of each label's nearest one, which may have the same label, if it is near enough."""
    name = lambda df, side: df.where("embedding is not null").select(F.concat(F.lit(side), "label").alias("id"), "embedding")
    near = vectors.nearest(name(left, "l"), name(right, "r"), 1, threshold=least)  # equal ids don't meet
    bare = lambda c: F.substring(c, F.lit(2), F.length(c) - 1)
    return near.select(bare(F.col("left_id")).alias("label"), bare(F.col("right_id")).alias("match"), F.col("similarity").alias("score"), F.lit("vector").alias("tier"))


def best(found: DataFrame) -> DataFrame:
    """The best match of each label, ties by the match."""
    order = F.struct((-F.round("score", 9)).alias("s"), F.col("match").alias("m"))
    return found.groupBy("label").agg(F.min_by(F.struct("match", "score", "tier"), order).alias("b")).select("label", "b.*")


def once(rows: DataFrame) -> DataFrame:
    """A row a label; of several vectors of a label the largest counts."""
    return rows.where("label is not null").groupBy("label").agg(F.max("embedding").alias("embedding"))


def concept_links(generated: DataFrame, reference: DataFrame, least: float = CONCEPTS) -> DataFrame:
    """Concepts (label, embedding), the vector being that of `concept_text`, with their best match: by cosine where both have a
    vector, by the words of their labels where one hasn't."""
    g, r = once(generated), once(reference)
    none = F.col("embedding").isNull()
    return best(by_vectors(g, r, least).unionByName(by_words(g.where(none), r, least)).unionByName(by_words(g.where(~none), r.where(none), least)))


def concept_text(label: Column, definition: Column) -> Column:
    """What stands for a concept when it is embedded."""
    return F.concat_ws(" -- ", label, F.coalesce(definition, F.lit("")))


def statement_links(generated: DataFrame, reference: DataFrame, least: float = STATEMENTS) -> DataFrame:
    """Statements (label, a sentence, and its embedding) with their match: an equal one, ignoring case and outer spaces; else that
    of the most shared words, if these suffice; else the nearest by cosine."""
    g, r = once(generated), once(reference)
    bare = F.lower(F.trim("label"))
    exact = g.withColumn("k", bare).join(r.groupBy(bare.alias("k")).agg(F.min("label").alias("match")), "k").select("label", "match", F.lit(1.0).alias("score"), F.lit("exact").alias("tier"))
    rest = g.join(exact, "label", "left_anti")
    words = settle(best(by_words(rest, r, least)))
    return exact.unionByName(words).unionByName(by_vectors(rest.join(words, "label", "left_anti"), r, least))


def in_turn(generated: DataFrame, references: dict[str, DataFrame], links: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(label, match, score, tier, reference): what matched one reference isn't tried on the next. The loop is over references,
    a handful of ontologies."""
    left, found = settle(once(generated)), None
    for name, reference in references.items():
        hits = settle(links(left, settle(once(reference)))).withColumn("reference", F.lit(name))
        found = hits if found is None else found.unionByName(hits)
        left = settle(left.join(hits, "label", "left_anti"))
    if found is None:
        raise ValueError("no reference to match with")
    return found


def percents(found: DataFrame, generated: DataFrame, references: list[str]) -> DataFrame:
    """(reference, matched, percent) of what `in_turn` found, percentages of all generated labels and cumulative; 0 without any."""
    names = found.sparkSession.createDataFrame(list(enumerate(references)), "nth int, reference string")
    total = once(generated).agg(F.count("*").alias("total"))
    rows = names.join(found.groupBy("reference").agg(F.count("*").alias("n")), "reference", "left").select("nth", "reference", F.coalesce("n", F.lit(0)).alias("matched"))
    so_far = F.sum("matched").over(Window.partitionBy(F.lit(0)).orderBy("nth"))  # a row a reference
    return rows.join(F.broadcast(total)).select("reference", "matched", F.coalesce(100.0 * so_far / F.nullif("total", F.lit(0)), F.lit(0.0)).alias("percent"))


def type_matches(types: DataFrame, classes: DataFrame, least: float = TYPES) -> DataFrame:
    """types (entity_type, embedding) with the class (label, embedding) that covers each: an equal label, ignoring case, outer
    spaces and underscores (1.0); one that holds the type or is held by it (0.9); the nearest by cosine. Of several of a tier the
    first label counts. A type without a class has a null match and similarity 0; empty types and labels only match equal ones."""
    t = types.where("entity_type is not null").groupBy("entity_type").agg(F.max("embedding").alias("embedding"))
    t = settle(t.withColumn("k", F.replace(F.trim(F.lower("entity_type")), F.lit("_"), F.lit(" "))))
    c = once(classes).withColumns({"k": F.lower(F.trim("label")), "low": F.lower("label")})
    exact = t.join(c.groupBy("k").agg(F.min("label").alias("match")), "k").select("entity_type", "match", F.lit(1.0).alias("similarity"), F.lit("exact").alias("tier"))
    rest = t.join(exact, "entity_type", "left_anti")
    terms = lambda df, col: df.select(F.col(col).alias("label")).distinct()
    inside = matching.holding(rest.select("entity_type", F.col("k").alias("text")), terms(c, "low")).withColumnRenamed("label", "low").join(c.select("label", "low"), "low")
    around = matching.holding(c.select(F.col("label").alias("class"), F.col("low").alias("text")), terms(rest, "k")).withColumnRenamed("label", "k").join(rest.select("entity_type", "k"), "k")
    part = inside.select("entity_type", "label").unionByName(around.select("entity_type", F.col("class").alias("label"))).groupBy("entity_type").agg(F.min("label").alias("match"))
    part = settle(part.select("entity_type", "match", F.lit(0.9).alias("similarity"), F.lit("substring").alias("tier")))
    left = rest.join(part, "entity_type", "left_anti").select(F.col("entity_type").alias("label"), "embedding")
    near = by_vectors(left, once(classes), least).select(F.col("label").alias("entity_type"), "match", F.col("score").alias("similarity"), "tier")
    covered = exact.unionByName(part).unionByName(near)
    return t.select("entity_type").join(covered, "entity_type", "left").select("entity_type", "match", F.coalesce("similarity", F.lit(0.0)).alias("similarity"), F.coalesce("tier", F.lit("none")).alias("tier"))


def subclass_edges(triples: DataFrame) -> DataFrame:
    edges = patterns.pairs(triples, "rdfs:subClassOf", "child", "parent")
    return edges.where(~patterns.blank("child") & ~patterns.blank("parent"))


def hierarchy_quality(generated: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: the nodes of the longest chains of two class trees (child, parent) and the generated one's share of gold's, at most 1.
    A tree without edges has chains of one node."""
    depth = lambda df, name: graph.chain_depth(df).select(F.coalesce("max_depth", F.lit(1)).alias(name))
    rows = depth(generated, "depth").join(F.broadcast(depth(gold, "gold_depth")))  # one row each
    return rows.select("depth", "gold_depth", (F.least("depth", "gold_depth") / F.col("gold_depth")).alias("hierarchy"))


FAILED = {"semantic": 0.0, "hallucination": 1.0, "cq": 0.0, "hierarchy": 0.0, "domain": 0.0, "expert": 0.0}


def six_scores(generated: DataFrame, gold: DataFrame, seed: DataFrame, prefix: str, removed: DataFrame | None, vectors_of: DataFrame | None, questions: DataFrame | None) -> DataFrame:
    """One row of six scores of a generated ontology (s, p, o) against a gold one and the seed: removed labels (label, embedding)
    found again among the generated ones' vectors (label, embedding), labels that gold doesn't know, questions (id, targets)
    covered, depth, namespace and labels of new classes, and acceptance of new spellings. A score without its input is the one that a
    failed score has."""
    names = lambda t: patterns.classes_with_parent(t).select("uri", "label").distinct()
    new = names(generated).join(names(seed).select("uri"), "uri", "left_anti")
    present = generated.select(F.explode(F.array("s", "p", "o")).alias("name"))
    scores = {
        "semantic": quality.recovered(removed, vectors_of).select("recovered") if removed is not None and vectors_of is not None else None,
        "hallucination": metrics.hallucination(names(generated), names(seed), names(gold)).select("hallucination_rate"),
        "cq": metrics.cq_coverage(questions, present).select("coverage") if questions is not None else None,
        "hierarchy": hierarchy_quality(subclass_edges(generated), subclass_edges(gold)).select("hierarchy"),
        "domain": metrics.domain_compliance(new, prefix, names(gold)).select("compliance"),
        "expert": quality.expert_acceptance(names(generated), names(gold)).select("acceptance"),
    }
    out = None
    for name, row in scores.items():
        if row is not None:
            row = row.toDF(name)
            out = row if out is None else out.join(F.broadcast(row))  # one row each
    return out.select(*[F.coalesce(name, F.lit(value)).alias(name) if scores[name] is not None else F.lit(value).alias(name) for name, value in FAILED.items()])


def inference_tests(generated: DataFrame, gold: DataFrame) -> DataFrame:
    """(test, passed): no individual of generated triples is of two disjoint classes, and each subclass pair of gold whose ends both
    occur as subjects follows in the generated hierarchy. All pairs are tested."""
    disjoint = patterns.pairs(generated, "owl:disjointWith", "a", "b")
    types = generated.where("p = 'rdf:type'").select("s", "o").distinct()
    clear = metrics.disjointness_violations(types, disjoint).agg((F.count("*") == 0).alias("passed")).select(F.lit("consistency").alias("test"), "passed")
    known = lambda end: generated.select(F.col("s").alias(end)).distinct()
    asked = subclass_edges(gold).join(known("child"), "child", "left_semi").join(known("parent"), "parent", "left_semi")
    follows = graph.closure(subclass_edges(generated)).select(F.col("node").alias("child"), F.col("ancestor").alias("parent")).distinct().withColumn("hit", F.lit(True))
    pairs = asked.distinct().join(follows, ["child", "parent"], "left")
    return clear.unionByName(pairs.select(F.concat_ws(" ", F.lit("subclass"), "child", "parent").alias("test"), (F.col("hit").isNotNull() | (F.col("child") == F.col("parent"))).alias("passed")))


def provocation_tests(generated: DataFrame) -> DataFrame:
    """(test, passed): for each pair of disjoint classes an individual of both is put in, and must be found; without such a pair one
    test that didn't pass."""
    disjoint = patterns.pairs(generated, "owl:disjointWith", "a", "b").distinct()
    name = F.concat(F.lit("urn:provoked#"), F.hex(F.xxhash64("a", "b")))
    put = disjoint.select(name.alias("s"), "a", "b")
    types = generated.where("p = 'rdf:type'").select("s", "o").unionByName(put.select("s", F.explode(F.array("a", "b")).alias("o"))).distinct()
    found = metrics.disjointness_violations(types, disjoint).withColumn("hit", F.lit(True))
    each = put.join(found, ["s", "a", "b"], "left").select(F.concat_ws(" ", F.lit("disjoint"), "a", "b").alias("test"), F.col("hit").isNotNull().alias("passed"))
    none = disjoint.agg(F.count("*").alias("n")).where("n = 0").select(F.lit("disjoint").alias("test"), F.lit(False).alias("passed"))
    return each.unionByName(none)
