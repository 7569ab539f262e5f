"""Matching: tiers of equality, substring and vector similarity, best matches and votes."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tessera.functions.fuzzy import fuzzy_ratio
from tessera.lineage import settle
from tessera.operators import vectors

GRAM_ROWS = 5_000  # labels of a gram that meet the other side's at a time


def coverage_tiers(types: DataFrame, classes: DataFrame) -> DataFrame:
    """types (entity_type) by classes (label): exact (1.0), then substring either way (0.9), both case-insensitive; of
    several substring matches the first label counts. Unmatched types have a null label and similarity 0."""
    t = types.select("entity_type").distinct()
    c = classes.select("label").distinct()
    exact = t.join(c, F.lower("entity_type") == F.lower("label"), "left_semi").withColumns({"match": F.col("entity_type"), "similarity": F.lit(1.0), "tier": F.lit("exact")})
    rest = t.join(exact.select("entity_type"), "entity_type", "left_anti")
    low = c.select("label", F.lower("label").alias("text"))
    inside = holding(rest.select("entity_type", F.lower("entity_type").alias("text")), low.select(F.col("text").alias("label")).distinct())
    inside = inside.select("entity_type", F.col("label").alias("text")).join(low, "text").select("entity_type", "label")
    around = holding(low.withColumnRenamed("label", "class"), rest.select(F.lower("entity_type").alias("label")).distinct())
    around = around.join(rest, F.lower("entity_type") == F.col("label")).select("entity_type", F.col("class").alias("label"))
    part = inside.union(around).groupBy("entity_type").agg(F.min("label").alias("match")).withColumns({"similarity": F.lit(0.9), "tier": F.lit("substring")})
    none = rest.join(part.select("entity_type"), "entity_type", "left_anti")
    none = none.withColumns({"match": F.lit(None).cast("string"), "similarity": F.lit(0.0), "tier": F.lit("none")})
    return exact.unionByName(part).unionByName(none)


def entity_links(left: DataFrame, right: DataFrame, threshold: float = 0.75, same: float = 0.92) -> DataFrame:
    """Pairs at or above the threshold, called sameAs above `same` and seeAlso otherwise."""
    return vectors.above(left, right, threshold).withColumn("link", F.when(F.col("similarity") > same, "sameAs").otherwise("seeAlso"))


def structural_confidence(left: DataFrame, right: DataFrame) -> DataFrame:
    """Best match of each left row and how far it is ahead of the second; the whole similarity where it is alone."""
    best = vectors.nearest(left, right, 2).groupBy("left_id").agg(
        F.max(F.when(F.col("rank") == 1, F.col("right_id"))).alias("parent"),
        F.max(F.when(F.col("rank") == 1, F.col("similarity"))).alias("similarity"),
        F.max(F.when(F.col("rank") == 2, F.col("similarity"))).alias("second"),
    )
    return best.select("left_id", "parent", "similarity", (F.col("similarity") - F.coalesce("second", F.lit(0.0))).alias("confidence"))


def siblings(proposed: DataFrame, seeds: DataFrame, threshold: float = 0.6, most: int = 5) -> DataFrame:
    """For each seed, the first proposals whose cosine to it is above the threshold, in order of id."""
    return vectors.first_beyond(seeds, proposed, threshold, most).select(F.col("left_id").alias("seed"), F.col("right_id").alias("sibling"), "nth")


def best_matches(entities: DataFrame, classes: DataFrame, threshold: float = 0.65) -> DataFrame:
    """entities (label, embedding) by classes (label, embedding): an equal label, ignoring case, with similarity 1, else the
    class of the largest cosine, covered at the threshold; similarity is null where neither has a vector. Of rows with one label
    the smallest vector counts, or that of the smallest id where there is one."""
    vector = (F.min_by("embedding", F.when(F.col("embedding").isNotNull(), F.col("id"))) if "id" in entities.columns and "id" in classes.columns else F.min("embedding")).alias("embedding")
    e = entities.groupBy("label").agg(vector)
    c = classes.groupBy("label").agg(vector)
    known = c.groupBy(F.lower("label").alias("low")).agg(F.min("label").alias("match"))
    exact = e.join(known, F.lower("label") == F.col("low")).select("label", "match", F.lit(1.0).alias("similarity"))
    rest = e.join(exact.select("label"), "label", "left_anti").select(F.col("label").alias("id"), "embedding")
    near = vectors.nearest(rest, c.select(F.col("label").alias("id"), "embedding"), 1).select(F.col("left_id").alias("label"), F.col("right_id").alias("match"), "similarity")
    found = rest.select(F.col("id").alias("label")).join(near, "label", "left").unionByName(exact)
    return found.withColumn("covered", F.coalesce(F.col("similarity") >= threshold, F.lit(False)))


def label_grams(labels: DataFrame) -> DataFrame:
    """(label, at, gram): pairs of neighbouring characters, ends marked, each repetition in a label being a gram of its own."""
    marked = F.concat(F.lit("\u0002"), "label", F.lit("\u0003"))
    pairs = F.transform(F.sequence(F.lit(1), F.length("label") + 1), lambda i: F.substring(marked, i, F.lit(2)))
    each = labels.select("label", F.posexplode(pairs).alias("at", "two"))
    nth = F.row_number().over(Window.partitionBy("label", "two").orderBy("at"))
    return each.select("label", "at", F.concat("two", nth.cast("string")).alias("gram"))


def fuzzy_candidates(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right): labels, in lower case, that can have an indel ratio of `least`.

    Grams are ordered by how rare they are in both sides. Of n + 1 grams of a label of n characters an alike label lacks at
    most n (2 - 1.5 r) + n r / (2 - r) (1 - 1.5 r), deleting a character costing two grams and inserting one costing one, so
    two alike labels share a gram among so many and one of their rarest, in places no further apart than edits allow. Rows of
    a gram that is frequent all the same are dealt into parts, each of which meets the other side.
    """
    sides = [df.select(F.lower("label").alias("label")).where("label is not null").distinct() for df in (left, right)]
    grams = [settle(label_grams(df)) for df in sides]
    counts = grams[0].select("gram").unionAll(grams[1].select("gram")).groupBy("gram").agg(F.count("*").alias("n"))
    parts = F.greatest(F.ceil(F.col("n") / GRAM_ROWS), F.lit(1))
    n = F.length("label")
    lost = F.floor(n * (2 - 1.5 * least) + n * (least / (2 - least) * (1 - 1.5 * least)) + 1e-9)
    rare = Window.partitionBy("label").orderBy("n", "gram")
    prefix = lambda df: df.join(counts, "gram").withColumn("nth", F.row_number().over(rare)).where(F.col("nth") <= lost + 1).withColumn("parts", parts)
    a = prefix(grams[0]).select("gram", F.pmod(F.xxhash64("label"), "parts").alias("part"), F.col("label").alias("left"), F.col("at").alias("i"))
    b = prefix(grams[1]).select("gram", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("label").alias("right"), F.col("at").alias("j"))
    both = F.length("left") + F.length("right")
    gap = F.abs(F.length("left") - F.length("right"))
    sized = 2 * F.least(F.length("left"), F.length("right")) >= least * both - 1e-9
    placed = 2 * F.abs(F.col("i") - F.col("j")) <= (1 - least) * both + gap + 1e-9
    return a.join(b, ["gram", "part"]).where(sized & placed).select("left", "right").distinct()


def fuzzy_matches(left: DataFrame, right: DataFrame, least: float = 0.85) -> DataFrame:
    """(left, right, ratio) of labels at least so alike by indel ratio, ignoring case."""
    if least < 0.75:
        raise ValueError("labels less alike may share no pair of characters")
    return fuzzy_candidates(left, right, least).withColumn("ratio", fuzzy_ratio("left", "right")).where(F.col("ratio") >= least)


def three_tiers(entities: DataFrame, classes: DataFrame, fuzzy: float = 0.85, threshold: float = 0.65) -> DataFrame:
    """entities (id, label, entity_type, embedding) with the tier at which classes (label, embedding) cover them: exact by type or
    label, fuzzy by type, vector by cosine, or none."""
    known = classes.select(F.lower("label").alias("k")).distinct()
    rows = entities.withColumns({"t": F.lower("entity_type"), "l": F.lower("label")})
    for c in ("t", "l"):
        rows = rows.join(known.select(F.col("k").alias(f"k_{c}")), F.col(c) == F.col(f"k_{c}"), "left")
    types = rows.select(F.col("t").alias("label")).distinct()
    alike = fuzzy_matches(types, classes, fuzzy).select(F.col("left").alias("t")).distinct().withColumn("fuzzy", F.lit(True))
    rest = rows.where("k_t is null and k_l is null").join(alike, "t", "left_anti").select("id", "embedding")
    near = vectors.nearest(rest, classes.select(F.col("label").alias("id"), "embedding"), 1).where(F.col("similarity") >= threshold).select(F.col("left_id").alias("id"), F.lit(True).alias("vector"))
    out = rows.join(alike, "t", "left").join(near, "id", "left")
    return out.select("id", F.when(F.col("k_t").isNotNull() | F.col("k_l").isNotNull(), "exact").when(F.col("fuzzy"), "fuzzy").when(F.col("vector"), "vector").otherwise("none").alias("tier"))


FEW_TERMS = 64  # up to so many terms are looked for one by one
TERM_BYTES, TEXT_BYTES = 4 << 20, 4 << 20  # of terms in one automaton, and of texts that meet it at a time


def holding(texts: DataFrame, terms: DataFrame, text_col: str = "text", few: int = FEW_TERMS, term_bytes: int = TERM_BYTES) -> DataFrame:
    """The other columns of texts with each term (label) that the text holds as a plain substring; empty terms are held by none.

    Up to `few` terms, which is counted, are broadcast. More make an automaton that finds all of them in one pass over a text; up to
    `term_bytes` of them are sent to every task. Beyond that they are dealt into parts, and blocks of texts meet each part.
    """
    words = settle(terms.select("label").where("label <> ''").distinct())
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("label")), F.lit(0)).alias("bytes")).first()
    if size["n"] <= few:
        return texts.join(F.broadcast(words), F.contains(F.col(text_col), F.col("label"))).drop(text_col)
    texts = texts.select(*[c for c in texts.columns if c != text_col], text_col)
    schema = StructType([*texts.schema.fields[:-1], StructField("label", StringType())])

    def held(automaton: ahocorasick.Automaton, rows: pa.RecordBatch) -> pa.RecordBatch:
        took, labels = [], []
        for i, text in enumerate(rows.column(rows.num_columns - 1).to_pylist()):
            hits = {label for _, label in automaton.iter(text)} if text else ()
            took += [i] * len(hits)
            labels += hits
        others = [c.take(pa.array(took, pa.int64())) for c in rows.columns[:-1]]
        return pa.RecordBatch.from_arrays([*others, pa.array(labels, pa.string())], schema.names)

    if size["bytes"] <= term_bytes:
        every = [r["label"] for r in words.toLocalIterator()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = built(every)
            for batch in batches:
                yield from (held(automaton, batch.slice(k, 64)) for k in range(0, batch.num_rows, 64))

        return texts.mapInArrow(run, schema)

    parts = -(-size["bytes"] // term_bytes)
    listed = words.groupBy(F.pmod(F.xxhash64("label"), F.lit(parts)).alias("part")).agg(F.collect_list("label").alias("labels"))
    rows = settle(texts.withColumn("nth", F.monotonically_increasing_id()))  # written out, so that a row keeps its number
    blocks = -(-(rows.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // TEXT_BYTES) + 1
    block = F.pmod(F.xxhash64("nth"), F.lit(blocks)).alias("block")
    gathered = rows.groupBy(block).agg(F.collect_list(F.struct(*texts.columns)).alias("rows"))
    met = gathered.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).join(listed, "part").select("rows", "labels")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, labels in zip(batch.column(0), batch.column(1), strict=True):
                yield held(built(labels.as_py()), pa.RecordBatch.from_struct_array(some.values))

    return met.mapInArrow(meet, schema)


def built(terms: list[str]) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for term in terms:
        automaton.add_word(term, term)
    automaton.make_automaton()
    return automaton


def cooccurrence_votes(chunks: DataFrame, proposed: DataFrame, seeds: DataFrame) -> DataFrame:
    """For each proposed label the seed label that most chunks hold together with it (plain substrings, ignoring case),
    with its share of all such votes; ties by label. Labels that differ in case alone are one, the first in order."""
    text = chunks.select("chunk_id", F.lower("text").alias("text"))

    def held(terms: DataFrame, name: str) -> DataFrame:
        low = terms.groupBy(F.lower("label").alias("low")).agg(F.min("label").alias(name))
        return holding(text, low.select(F.col("low").alias("label"))).select("chunk_id", F.col("label").alias("low")).join(low, "low").drop("low")

    votes = held(proposed, "label").join(held(seeds, "seed"), "chunk_id").where(F.col("label") != F.col("seed")).groupBy("label", "seed").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("label").orderBy(F.col("votes").desc(), "seed")
    total = F.sum("votes").over(Window.partitionBy("label"))
    ranked = votes.withColumns({"nth": F.row_number().over(order), "share": F.col("votes") / total})
    return ranked.where("nth = 1").select("label", F.col("seed").alias("parent"), "votes", "share")


def weighted_votes(votes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """votes (label, strategy, parent, confidence) to one parent a label: the largest weighted confidence, divided by the
    sum of all weights; agreement is the share of all votes, empty ones included, for the winner. Ties by parent."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("strategy") == name, w).otherwise(weight)
    totals = votes.groupBy("label").agg(F.count("*").alias("all_votes"))
    by_parent = votes.where("parent is not null").groupBy("label", "parent").agg(F.sum(weight * F.col("confidence")).alias("score"), F.count("*").alias("n"))
    order = Window.partitionBy("label").orderBy(F.round("score", 8).desc(), "parent")  # sums in another order are the same score
    best = by_parent.withColumn("nth", F.row_number().over(order)).where("nth = 1")
    return best.join(totals, "label").select("label", "parent", (F.col("score") / sum(weights.values())).alias("confidence"), (F.col("n") / F.col("all_votes")).alias("agreement"))


def ensemble_report(decisions: DataFrame) -> DataFrame:
    """Means of agreement and confidence, and how many decisions were unanimous or split."""
    return decisions.agg(
        F.avg("agreement").alias("mean_agreement"),
        F.avg("confidence").alias("mean_confidence"),
        F.count_if(F.col("agreement") >= 1.0).alias("unanimous"),
        F.count_if(F.col("agreement") < 0.5).alias("split"),
    )
