"""Nested JSON replies of tools and reports, read as VARIANT: fields that are missing or of another kind get their default, and
list elements that are no objects are dropped where objects are asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def field(value: Column, path: str, kind: str = "string", default: object = None) -> Column:
    """What lies at a path of a variant, as a kind; the default where nothing or something else does."""
    found = F.try_variant_get(value, path, kind)
    return found if default is None else F.coalesce(found, F.lit(default))


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def objects(value: Column, path: str) -> Column:
    """The objects of a list at a path, in order, as variants; none where there is no list."""
    items = F.coalesce(F.try_variant_get(value, path, "array<variant>"), F.array().cast("array<variant>"))
    return F.filter(items, is_object)


def parsed(replies: DataFrame) -> DataFrame:
    """replies with their reply as a variant `v`: null where it is no JSON object or reports an error."""
    v = F.col("v")
    failed = F.try_variant_get(v, "$.error", "variant").isNotNull()
    return replies.withColumn("v", F.try_parse_json("reply")).withColumn("v", F.when(is_object(v) & ~failed, v))


def complete(relation: Column) -> Column:
    """Whether a relation names both ends and its type."""
    return F.forall(F.array(*[field(relation, f"$.{c}", default="") for c in ("src", "tgt", "type")]), lambda x: x != "")


def arrow(relation: Column, left: str = "", right: str = "") -> Column:
    """A relation as one line of text, its ends between marks."""
    part = lambda c: field(relation, f"$.{c}", default="None")
    return F.concat(F.lit(left), part("src"), F.lit(right + " -["), part("type"), F.lit("]-> " + left), part("tgt"), F.lit(right))


def neighbourhoods(replies: DataFrame) -> DataFrame:
    """replies (query, entity, reply) of a tool that explores an entity as contexts (query, text, score, n_entities, n_relations):
    counts of entities with an id and of whole relations, the first fifteen and twenty as lines. Replies that are no JSON object
    and don't speak of an error give their first 500 characters with a lower score (these excerpts are the rule); those that report an error give nothing."""
    rows = parsed(replies)
    v = F.col("v")
    entities = F.filter(objects(v, "$.entities"), lambda e: field(e, "$.id", default="") != "")
    relations = F.filter(objects(v, "$.relations"), complete)
    listed = rows.withColumns({"entities": entities, "relations": relations, "hops": field(v, "$.hops", "int", 1)})
    line = lambda e: F.concat(F.lit("  ["), field(e, "$.type", default=""), F.lit("] "), field(e, "$.id"), F.lit(": "), field(e, "$.label", default=""))
    head = F.format_string("Neighborhood of '%s' (%d-hop):", "entity", "hops")
    shown = F.concat(
        F.array(head, F.format_string("Entities (%d):", F.size("entities"))), F.transform(F.slice("entities", 1, 15), line),
        F.array(F.format_string("Relations (%d):", F.size("relations"))), F.transform(F.slice("relations", 1, 20), lambda r: F.concat(F.lit("  "), arrow(r))),
    )
    loose = F.try_parse_json("reply").isNull() & ~F.contains(F.lower("reply"), F.lit("error"))
    text = F.when(v.isNotNull(), F.array_join(shown, "\n")).when(loose, F.substring("reply", 1, 500))
    out = listed.select("query", text.alias("text"), F.when(v.isNotNull(), 0.85).otherwise(0.6).alias("score"), F.size("entities").alias("n_entities"), F.size("relations").alias("n_relations"))
    return out.where("text is not null")


def fact_chains(replies: DataFrame) -> DataFrame:
    """replies (query, reply) of a tool that finds paths as contexts (query, nth from 0, source, target, nodes, labels map, edges,
    chain, text, score): one a path, its nodes with their labels and its edges as triples; scores fall by 0.02 a path."""
    rows = parsed(replies).select("query", field(F.col("v"), "$.source", default="").alias("source"), field(F.col("v"), "$.target", default="").alias("target"), F.posexplode(objects(F.col("v"), "$.paths")).alias("nth", "path"))
    p = F.col("path")
    read = rows.select(
        "query", "nth", "source", "target", F.coalesce(F.try_variant_get(p, "$.nodes", "array<string>"), F.array().cast("array<string>")).alias("nodes"),
        F.coalesce(F.try_variant_get(p, "$.node_labels", "map<string,string>"), F.create_map().cast("map<string,string>")).alias("labels"),
        objects(p, "$.edges").alias("edges"), field(p, "$.chain", default="").alias("chain"),
    )
    named = lambda n: F.concat(n, F.lit(" ("), F.coalesce(F.element_at("labels", n), n), F.lit(")"))
    lines = F.concat(
        F.array(F.format_string("FACT CHAIN (%s -> %s, path %d):", "source", "target", F.col("nth") + 1), F.concat(F.lit("  "), "chain"), F.concat(F.lit("  Nodes: "), F.array_join(F.transform("nodes", named), ", "))),
        F.transform("edges", lambda e: F.concat(F.lit("  TRIPLE: "), arrow(e, "[", "]"))), F.array(F.lit("")),
    )
    return read.withColumns({"text": F.array_join(lines, "\n"), "score": 0.95 - 0.02 * F.col("nth")})


def chain_relations(chains: DataFrame) -> DataFrame:
    """The whole relations of fact chains, each once a query."""
    edge = F.col("edge")
    rows = chains.select("query", F.explode("edges").alias("edge")).where(complete(edge))
    return rows.select("query", *[field(edge, f"$.{c}").alias(c) for c in ("src", "type", "tgt")]).distinct()


def chain_summaries(chains: DataFrame) -> DataFrame:
    """One context a query over all its fact chains (query, n_chains, text, score): each with its path and its triples. An agent's
    reply holds few paths, so a query's chains fit one row."""
    labels = F.array_sort(F.map_entries("labels"))
    lines = F.concat(
        F.array(F.format_string("  Chain %d: %s -> %s", F.col("nth") + 1, "source", "target"), F.concat(F.lit("    Path: "), "chain")),
        F.transform("edges", lambda e: F.concat(F.lit("    GROUNDED TRIPLE: "), arrow(e, "[", "]"))),
        F.when(F.size("labels") > 0, F.array(F.concat(F.lit("    Labels: "), F.array_join(F.transform(labels, lambda x: F.concat_ws("=", x["key"], x["value"])), ", ")))).otherwise(F.array().cast("array<string>")),
    )
    one = chains.select("query", F.struct("nth", F.concat(F.lit("\n"), F.array_join(lines, "\n")).alias("text")).alias("part"))
    texts = F.transform(F.array_sort(F.collect_list("part")), lambda x: x["text"])
    text = F.concat(F.lit("GRAPH REASONING — Verified fact chains from knowledge graph:\n"), F.array_join(texts, "\n"))
    return one.groupBy("query").agg(F.count("*").alias("n_chains"), text.alias("text")).withColumn("score", F.lit(0.98))


def ontology_contexts(replies: DataFrame) -> DataFrame:
    """replies (query, reply) of an ontology tool as contexts, unless they say that there is none."""
    return replies.where(~F.startswith("reply", F.lit("No ontology"))).select("query", F.col("reply").alias("text"), F.lit(0.3).alias("score"))


def report_metrics(reports: DataFrame) -> DataFrame:
    """reports (id, convergence, iteration: JSON texts or null) as one row of metrics each: null for a report that is missing or no
    JSON object, and 0 for what a sound report lacks."""
    v, w = F.try_parse_json("convergence"), F.try_parse_json("iteration")
    rows = reports.select("id", F.when(is_object(v), v).alias("v"), F.when(is_object(w), w).alias("w"))
    # Metrics, their report, where they lie in it, and their kind.
    wanted = (
        ("classes_added_total", "v", "$.summary.classes_added_total", "long"), ("cq_coverage_final", "v", "$.summary.cq_coverage.final", "double"),
        ("entity_coverage_final", "v", "$.summary.entity_coverage.final", "double"), ("acceptance_rate_avg", "v", "$.summary.acceptance_rate_avg", "double"),
        ("new_classes", "w", "$.new_classes_count", "long"), ("cq_coverage_pct", "w", "$.cq_coverage_pct", "double"), ("entity_coverage_pct", "w", "$.entity_coverage_pct", "double"),
    )
    return rows.select("id", *[F.when(F.col(c).isNotNull(), field(F.col(c), path, kind, 0)).alias(name) for name, c, path, kind in wanted])
