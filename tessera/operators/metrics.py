"""Quality metrics of generated ontologies against gold ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import jaccard, tokens
from tessera.lineage import settle

WORD_ROWS = 5_000  # texts of a word that meet the other side's at a time


def scores(hits: DataFrame) -> DataFrame:
    """hits (matched, predicted, expected) to precision, recall and F1, 0 where undefined."""
    p = F.coalesce(F.col("matched") / F.nullif("predicted", F.lit(0)), F.lit(0.0))
    r = F.coalesce(F.col("matched") / F.nullif("expected", F.lit(0)), F.lit(0.0))
    return hits.select("matched", "predicted", "expected", p.alias("precision"), r.alias("recall"), F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1"))


def edge_f1(generated: DataFrame, gold: DataFrame) -> DataFrame:
    """Precision, recall and F1 of one set of rows against another with the same columns, in one pass over both."""
    both = generated.distinct().withColumns({"g": F.lit(1), "e": F.lit(0)}).union(gold.distinct().withColumns({"g": F.lit(0), "e": F.lit(1)}))
    rows = both.groupBy(*generated.columns).agg(F.max("g").alias("g"), F.max("e").alias("e"))
    return scores(rows.agg(F.sum(F.col("g") * F.col("e")).alias("matched"), F.sum("g").alias("predicted"), F.sum("e").alias("expected")))


def tuple_f1(rows: DataFrame) -> DataFrame:
    """rows (predicted, expected), arrays of tuples in any order; micro-averaged."""
    n = lambda c: F.sum(F.size(F.array_distinct(c)))
    hits = rows.agg(F.sum(F.size(F.array_intersect("predicted", "expected"))).alias("matched"), n("predicted").alias("p"), n("expected").alias("e"))
    return scores(hits.withColumnsRenamed({"p": "predicted", "e": "expected"}))


def triple_f1(rows: DataFrame) -> DataFrame:
    """rows (predicted, expected), arrays of tuples that match only at the same position; micro-averaged."""
    same = F.size(F.filter(F.arrays_zip("predicted", "expected"), lambda x: x["predicted"].eqNullSafe(x["expected"]) & x["predicted"].isNotNull()))
    hits = rows.agg(F.sum(same).alias("matched"), F.sum(F.size("predicted")).alias("p"), F.sum(F.size("expected")).alias("e"))
    return scores(hits.withColumnsRenamed({"p": "predicted", "e": "expected"}))


def alike(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(left, right, overlap): texts (text), in lower case, that share at least so much of all their words (Jaccard).

    Of n words an alike text shares at least `least` * n, so two of them share one of the n - least * n + 1 words that are rarest in
    both sides; only these words are joined. A word that is frequent all the same is dealt into parts. Null texts and texts
    without words are like none.
    """
    if not 0 < least <= 1:
        raise ValueError("texts that share nothing can't be joined by words")
    sides = [df.select(F.lower("text").alias("text")).distinct().select("text", F.array_distinct(tokens(F.col("text"))).alias("words")) for df in (left, right)]
    rows = [settle(df.select("text", F.size("words").alias("n"), F.explode("words").alias("word"))) for df in sides]
    counts = rows[0].select("word").unionAll(rows[1].select("word")).groupBy("word").agg(F.count("*").alias("texts"))
    rare = Window.partitionBy("text").orderBy("texts", "word")
    most = F.col("n") - F.ceil(least * F.col("n") - 1e-9) + 1
    a, b = (df.join(counts, "word").withColumn("nth", F.row_number().over(rare)).where(F.col("nth") <= most).withColumn("parts", F.ceil(F.col("texts") / WORD_ROWS)) for df in rows)
    a = a.select("word", F.pmod(F.xxhash64("text"), "parts").alias("part"), F.col("text").alias("left"), F.col("n").alias("x"))
    b = b.select("word", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), F.col("text").alias("right"), F.col("n").alias("y"))
    met = a.join(b, ["word", "part"]).where(F.least("x", "y") >= least * F.greatest("x", "y") - 1e-9).select("left", "right").distinct()
    return met.withColumn("overlap", jaccard(tokens(F.col("left")), tokens(F.col("right")))).where(F.col("overlap") >= least)


def best_overlaps(labels: DataFrame, references: DataFrame, stages: tuple[float, ...] = (0.4, 1e-9)) -> DataFrame:
    """labels (id, label) with the best word overlap (Jaccard) with any reference (reference), 0 without a shared word; equal labels
    and references are one. Labels that are alike enough are found by their rarest words; only the others go on to the next stage, the
    last of which asks for any shared word."""
    left, right = labels.select(F.col("label").alias("text")).distinct(), references.select(F.col("reference").alias("text"))
    found = None
    for least in stages:
        best = settle(alike(left, right, least).groupBy("left").agg(F.max("overlap").alias("overlap")))
        found = best if found is None else found.union(best)
        left = left.join(best, F.lower("text") == F.col("left"), "left_anti")
    return labels.join(found, F.lower("label") == F.col("left"), "left").select("id", "label", F.coalesce("overlap", F.lit(0.0)).alias("overlap"))


def simulated_review(labels: DataFrame, references: DataFrame) -> DataFrame:
    """labels (id, label) to 1, 0.5 or 0 by the best word overlap with a reference (reference)."""
    best = best_overlaps(labels, references).groupBy("id").agg(F.max("overlap").alias("overlap"))
    return best.withColumn("review", F.when(F.col("overlap") >= 0.8, 1.0).when(F.col("overlap") >= 0.4, 0.5).otherwise(0.0))


def hallucination(generated: DataFrame, seed: DataFrame, gold: DataFrame) -> DataFrame:
    """Share of labels new against the seed that gold doesn't have, ignoring case; 0 if none is new."""
    low = lambda d: d.select(F.lower("label").alias("label")).distinct()
    new = low(generated).join(low(seed), "label", "left_anti")
    known = new.join(low(gold).withColumn("known", F.lit(1)), "label", "left")
    return known.agg(F.count("*").alias("new_classes"), F.coalesce(F.avg(F.col("known").isNull().cast("int")), F.lit(0.0)).alias("hallucination_rate"))


def domain_compliance(new: DataFrame, prefix: str, gold: DataFrame) -> DataFrame:
    """Mean of the share of new classes (uri, label) in the namespace and the share whose label gold knows; 1 if none."""
    labels = gold.select(F.lower("label").alias("known")).distinct()
    marked = new.join(labels, F.lower("label") == F.col("known"), "left")
    both = (F.avg(F.startswith("uri", F.lit(prefix)).cast("int")) + F.avg(F.col("known").isNotNull().cast("int"))) / 2
    return marked.agg(F.count("*").alias("classes"), F.coalesce(both, F.lit(1.0)).alias("compliance"))


def cq_coverage(questions: DataFrame, present: DataFrame) -> DataFrame:
    """questions (id, targets array) of which every target is among present (name): covered share; no targets count as
    covered, no questions give 0."""
    one = questions.select("id", F.explode_outer("targets").alias("name"))
    known = present.select("name").distinct().withColumn("known", F.lit(1))
    by = one.join(known, "name", "left").groupBy("id").agg(F.bool_and(F.col("name").isNull() | F.col("known").isNotNull()).alias("covered"))
    return by.agg(F.count("*").alias("questions"), F.coalesce(F.avg(F.col("covered").cast("int")), F.lit(0.0)).alias("coverage"))


def construct_counts(triples: DataFrame) -> DataFrame:
    """How often each type occurs as an object of rdf:type."""
    return triples.where("p = 'rdf:type'").groupBy(F.col("o").alias("construct")).agg(F.count("*").alias("n"))


def consistency(triples: DataFrame) -> DataFrame:
    """1 - (classes without a label + properties without a domain or a range) / (classes + properties); 1 if there are none."""
    kinds = F.col("o").isin("owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty")
    things = triples.where((F.col("p") == "rdf:type") & kinds).groupBy("s").agg(F.bool_or(F.col("o") == "owl:Class").alias("is_class"), F.bool_or(F.col("o") != "owl:Class").alias("is_property"))
    has = lambda p: F.coalesce(F.bool_or(F.col("p") == p), F.lit(False))
    facts = triples.where("p in ('rdfs:label', 'rdfs:domain', 'rdfs:range')").groupBy("s").agg(has("rdfs:label").alias("label"), (has("rdfs:domain") & has("rdfs:range")).alias("ends"))
    rows = things.join(facts, "s", "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    total = F.count_if("is_class") + F.count_if("is_property")
    bad = F.count_if(F.col("is_class") & no(F.col("label"))) + F.count_if(F.col("is_property") & no(F.col("ends")))
    return rows.agg(F.count_if("is_class").alias("classes"), F.count_if("is_property").alias("properties"), F.coalesce(1 - bad / F.nullif(total, F.lit(0)), F.lit(1.0)).alias("consistency"))


def disjointness_violations(types: DataFrame, disjoint: DataFrame) -> DataFrame:
    """Individuals (s, o) typed by both of a pair (a, b) of disjoint classes."""
    left, right = types.select("s", F.col("o").alias("a")), types.select("s", F.col("o").alias("b"))
    return left.join(disjoint, "a").join(right, ["s", "b"]).select("s", "a", "b").distinct()


def spo(triples: DataFrame) -> DataFrame:
    """Statements worth comparing: no labels or comments, local names, each once."""
    from tessera.functions.text import local_name

    rows = triples.where(~F.col("p").isin("rdfs:label", "rdfs:comment"))
    return rows.select(local_name(F.col("s")).alias("s"), F.element_at(F.split("p", ":"), -1).alias("p"), local_name(F.col("o")).alias("o")).distinct()


def composite(semantic, hallucination, cq, hierarchy, domain, expert):
    """The weighted benchmark score of six metrics; less hallucination is better."""
    return 0.25 * semantic + 0.20 * (1 - hallucination) + 0.20 * cq + 0.10 * hierarchy + 0.15 * domain + 0.10 * expert
