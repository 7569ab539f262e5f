"""Gap analysis: which entity types an ontology lacks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.pages import paged


def uncovered(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """Entities whose type is no class label, ignoring case."""
    labels = classes.select(F.lower("label").alias("known")).distinct()
    return entities.join(labels, F.lower("entity_type") == F.col("known"), "left_anti")


def keyed(entities: DataFrame) -> DataFrame:
    """entities with the label as type where they have none."""
    return entities.withColumn("entity_type", F.coalesce(F.nullif("entity_type", F.lit("")), "label"))


def gap_candidates(entities: DataFrame, classes: DataFrame, least: int = 3) -> DataFrame:
    """Uncovered types with at least so many entities: first label, first five labels by seq, count and mean confidence."""
    firsts = F.slice(F.array_sort(F.collect_list(F.struct("seq", "label"))), 1, 5)
    ranked = uncovered(entities, classes)
    few = keep_first(ranked, "entity_type", "seq", 5).groupBy("entity_type").agg(F.array_join(F.transform(firsts, lambda x: x["label"]), "|").alias("examples"))
    stats = ranked.groupBy("entity_type").agg(
        F.min_by("label", "seq").alias("representative_label"), F.count("*").alias("frequency"), F.avg("confidence").alias("avg_confidence")
    )
    return stats.where(F.col("frequency") >= least).join(few, "entity_type").orderBy(F.col("frequency").desc(), "entity_type")


def keep_first(rows: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The first n rows of each key."""
    from pyspark.sql import Window

    return rows.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_nth") <= n).drop("_nth")


def coverage(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """Covered share of all entities; 0 if there are none."""
    labels = classes.select(F.lower("label").alias("known")).distinct()
    marked = entities.join(labels, F.lower("entity_type") == F.col("known"), "left")
    return marked.agg(F.count("*").alias("total"), F.count("known").alias("covered"), F.coalesce(F.avg(F.col("known").isNotNull().cast("int")), F.lit(0.0)).alias("coverage"))


def schema_coverage(entities: DataFrame, classes: DataFrame) -> DataFrame:
    """Percentage of distinct types that are classes, and the sorted list of those that aren't."""
    types = entities.select("entity_type").distinct()
    labels = classes.select(F.lower("label").alias("known")).distinct()
    marked = types.join(labels, F.lower("entity_type") == F.col("known"), "left")
    gaps = F.array_join(F.array_sort(F.collect_list(F.when(F.col("known").isNull(), F.col("entity_type")))), "|")
    return marked.agg(F.count("*").alias("total_types"), F.count("known").alias("covered_types"), (100.0 * F.count("known") / F.count("*")).alias("coverage_pct"), gaps.alias("gaps"))


def aggregated_entities(mentions: DataFrame) -> DataFrame:
    """mentions (seq, label, entity_type, confidence, document, passage) by type: an id from the first label and the type, mean
    confidence, the first five passages, and how many other mentions and documents there are; these are counted and not listed,
    since a type can hold any share of all mentions."""
    by = mentions.groupBy("entity_type").agg(
        F.min_by("label", "seq").alias("label"), F.count("*").alias("frequency"), F.avg("confidence").alias("confidence"), F.countDistinct("document").alias("documents")
    )
    few = keep_first(mentions, "entity_type", "seq", 5).groupBy("entity_type").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "passage"))), lambda x: x["passage"]), "|").alias("snippets")
    )
    digest = F.substring(F.sha2(F.concat_ws("::", "label", "entity_type"), 256), 1, 12)
    rows = by.join(few, "entity_type")
    return rows.select("entity_type", F.concat(F.lit("ent_"), digest).alias("id"), "label", (F.col("frequency") - 1).alias("aliases"), "frequency", "confidence", "documents", "snippets")


def aliases(mentions: DataFrame, size: int = 1_000) -> DataFrame:
    """All labels of each type but its first, by seq, as (entity_type, page, aliases): at most `size` mentions a page, the first of
    which is the one that stands for the type."""
    rows = paged(mentions, "entity_type", "seq", "label", size)
    return rows.select("entity_type", "page", F.when(F.col("page") == 0, F.slice("items", 2, size)).otherwise(F.col("items")).alias("aliases"))


def structural_scores(entities: DataFrame, degrees: DataFrame, first: int = 5) -> DataFrame:
    """entities (entity_type, seq, id) by type: the mean number of neighbours (id, degree), which is counted up to a cap, of the first
    entities, which stand for the type. An entity without neighbours counts 0."""
    few = keep_first(entities.where("entity_type is not null"), "entity_type", "seq", first)
    return few.join(degrees, "id", "left").groupBy("entity_type").agg(F.count("*").alias("entities"), F.avg(F.coalesce("degree", F.lit(0))).alias("score"))


def gap_contexts(found: DataFrame) -> DataFrame:
    """(entity_type, context) for gaps (entity_type, frequency, closest_class, distance, examples array, evidence): what is known of a gap as
    lines of text; the first three examples are shown, and gaps without a near class or evidence say so."""
    line = lambda name, c: F.concat(F.lit(f"  {name}: "), c)
    few = F.array_join(F.slice(F.coalesce("examples", F.array().cast("array<string>")), 1, 3), ", ")
    none = F.lit("(No graph evidence found for this gap candidate.)")
    text = F.concat_ws(
        "\n",
        F.concat(F.lit("Gap Candidate: "), "entity_type"),
        line("Frequency", F.coalesce("frequency", F.lit(0)).cast("string")),
        line("Closest seed class", F.coalesce(F.nullif("closest_class", F.lit("")), F.lit("none"))),
        line("Semantic distance", F.format_string("%.2f", F.coalesce(F.col("distance").cast("double"), F.lit(1.0)))),
        line("Examples", few),
        F.lit(""),
        F.coalesce(F.nullif("evidence", F.lit("")), none),
    )
    return found.select("entity_type", text.alias("context"))
