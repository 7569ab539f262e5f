"""Small records of runs: votes put together, modes chosen, templates filled, results as one row each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import spaced_label
from tessera.lineage import settle


def tree_lines(tree: DataFrame) -> DataFrame:
    """tree (child, parent) as lines (path, line), two spaces a level, in pre-order by path; a child's smallest parent counts, and
    classes on a cycle, which no root reaches, don't show."""
    up = settle(tree.groupBy("child").agg(F.min("parent").alias("parent")))
    roots = up.select(F.col("parent").alias("node")).distinct().join(up, F.col("node") == F.col("child"), "left_anti")
    level = found = roots.select("node", F.col("node").alias("path"), F.lit(0).alias("depth"))
    while True:
        level = settle(level.join(up, F.col("node") == F.col("parent")).select(F.col("child").alias("node"), F.concat_ws(" / ", "path", "child").alias("path"), (F.col("depth") + 1).alias("depth")))
        if level.isEmpty():
            return found.select("path", F.concat(F.repeat(F.lit("  "), F.col("depth")), F.lit("- "), "node").alias("line"))
        found = found.union(level)


def all_votes(llm: DataFrame, embedding: DataFrame, cooccurrence: DataFrame) -> DataFrame:
    """(label, strategy, parent, confidence) of three strategies' tables (label, parent, confidence); a label without a parent votes
    too, with confidence 0."""
    parts = {"llm": llm, "embedding": embedding, "cooccurrence": cooccurrence}
    out = None
    for name, df in parts.items():
        row = df.select("label", F.lit(name).alias("strategy"), "parent", F.when(F.col("parent").isNull(), 0.0).otherwise(F.col("confidence")).alias("confidence"))
        out = row if out is None else out.unionByName(row)
    return out


def retrieval_mode(queries: DataFrame) -> DataFrame:
    """queries (query, terms, ids, mode) with the mode that is run: automatically SUBGRAPH for up to three terms and PPR for more;
    PATH without two ids is SUBGRAPH, and nothing runs without ids."""
    auto = F.when(F.col("terms") <= 3, "SUBGRAPH").otherwise("PPR")
    return queries.select("query", F.when(F.col("ids") == 0, "NONE").when(F.col("mode") == "AUTO", auto).when((F.col("mode") == "PATH") & (F.col("ids") < 2), "SUBGRAPH").otherwise(F.col("mode")).alias("mode"))


# How an answer is laid out by question type.
TEMPLATES = {"causal": "Cause, then effect", "comparative": "Side by side", "list": "Items", "boolean": "Yes or no, with a reason"}


def answer_template(queries: DataFrame) -> DataFrame:
    out = F.lit("Short answer")
    for kind, text in TEMPLATES.items():
        out = F.when(F.col("question_type") == kind, text).otherwise(out)
    return queries.select("query", out.alias("template"))


# What an answer should look like by question type, %s standing for the entity types, and what stands for none.
HINTS = {
    "factoid": "Provide a concise factual answer about %s.",
    "list": "List all instances of %s that match the question.",
    "boolean": "Answer with Yes or No, then provide justification.",
    "comparative": "Compare the mentioned %s, highlighting differences.",
    "causal": "Explain the causal chain, citing specific entities and relations.",
    "aggregation": "Provide the count or aggregation over %s.",
}
NO_TYPES, MOST_TYPES = "relevant entities", 3


def answer_hints(queries: DataFrame) -> DataFrame:
    """queries (query, question_type, entity_types array) with a hint that names the first three entity types; empty without a
    question type or for one that isn't known."""
    few = F.slice(F.coalesce("entity_types", F.array().cast("array<string>")), 1, MOST_TYPES)
    types = F.when(F.size(few) > 0, F.array_join(few, ", ")).otherwise(NO_TYPES)
    out = F.lit("")
    for kind, text in HINTS.items():
        out = F.when(F.col("question_type") == kind, F.replace(F.lit(text), F.lit("%s"), types)).otherwise(out)
    return queries.select("query", out.alias("hint"))


DIMENSIONS = ("semantic", "hallucination", "cq", "hierarchy", "domain", "expert")


def six_dimensions(scores: DataFrame) -> DataFrame:
    """scores (system, metric, value) as a row a system; what is missing or failed counts 0, hallucination 1."""
    value = lambda m: F.coalesce(F.avg(F.when(F.col("metric") == m, F.col("value"))), F.lit(1.0 if m == "hallucination" else 0.0)).alias(m)
    return scores.groupBy("system").agg(*[value(m) for m in DIMENSIONS])


def graph_context(found: DataFrame, most: int = 10) -> DataFrame:
    """found (query, id, text), a graph search's nodes, as one context a query of score 0.9 with the first ids (the cap is the
    feature) and how many there are."""
    from tessera.operators.gaps import keep_first

    few = keep_first(found, "query", "id", most).groupBy("query").agg(F.array_join(F.array_sort(F.collect_list("id")), "|").alias("ids"))
    return found.groupBy("query").agg(F.count("*").alias("nodes")).join(few, "query").withColumn("score", F.lit(0.9))


def external_candidates(labels: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """labels (label) with the first candidates (label, uri, rank) that an external search gave for them."""
    return labels.distinct().join(known.where(F.col("rank") <= most), "label").select("label", "uri", "rank")


def fallback_corpus(removed: DataFrame) -> DataFrame:
    """removed (level, uri) as one sentence each, standing for documents where there are none."""
    return removed.select("level", "uri", F.concat(F.lit("This text is about "), spaced_label(F.col("uri")), F.lit(".")).alias("text"))


def outcome_record(debates: DataFrame, most: int = 500) -> DataFrame:
    """debates (debate, outcome, proposal, verdict) as records, the proposal cut at so many characters (the cut is the feature)."""
    return debates.select("debate", F.lower("outcome").alias("outcome"), F.substring("proposal", 1, most).alias("excerpt"), F.length("proposal").alias("length"), "verdict")


def with_default_properties(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """(label, name, kind, required) of classes (label); those without properties (label, name, kind, required) get a label, required,
    and a description."""
    bare = classes.select("label").distinct().join(properties.select("label"), "label", "left_anti")
    given = F.array(F.struct(F.lit("label").alias("name"), F.lit("string").alias("kind"), F.lit(True).alias("required")), F.struct(F.lit("description").alias("name"), F.lit("string").alias("kind"), F.lit(False).alias("required")))
    return properties.select("label", "name", "kind", "required").unionByName(bare.select("label", F.explode(given).alias("p")).select("label", "p.*"))
