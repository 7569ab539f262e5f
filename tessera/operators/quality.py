"""Benchmark and quality metrics of generated ontologies, scores and comparison tables."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.lineage import settle
from tessera.operators import metrics, patterns, vectors
from tessera.operators.graph import closure


def low(df: DataFrame, c: str = "label") -> DataFrame:
    return df.select(F.lower(c).alias("label")).where("label is not null").distinct()


def rate(hit: Column, empty: float) -> Column:
    return F.coalesce(F.avg(hit.cast("int")), F.lit(empty))


def recovered(removed: DataFrame, generated: DataFrame, threshold: float = 0.85) -> DataFrame:
    """Share of removed labels (label, embedding) that generated ones match, ignoring case, or by cosine; 1 if none was."""
    exact = removed.withColumn("k", F.lower("label")).join(low(generated).withColumnRenamed("label", "k"), "k", "left_semi")
    rest = removed.join(exact.select("label"), "label", "left_anti")
    name = lambda df: df.select(F.col("label").alias("id"), "embedding")
    near = vectors.linked(name(rest), name(generated), threshold).select(F.col("left_id").alias("label"))
    hits = exact.select("label").union(near).distinct().withColumn("hit", F.lit(True))
    return removed.select("label").distinct().join(hits, "label", "left").agg(F.count("*").alias("removed"), rate(F.col("hit").isNotNull(), 1.0).alias("recovered"))


def expert_acceptance(new: DataFrame, gold: DataFrame) -> DataFrame:
    """Without a session: share of classes (label) not in gold by case-sensitive spelling that gold has in any case."""
    fresh = new.select("label").distinct().join(gold.select("label").distinct(), "label", "left_anti")
    marked = fresh.withColumn("k", F.lower("label")).join(low(gold).withColumnRenamed("label", "k").withColumn("hit", F.lit(True)), "k", "left")
    return marked.agg(F.count("*").alias("classes"), rate(F.col("hit").isNotNull(), 1.0).alias("acceptance"))


def concepts(triples: DataFrame) -> DataFrame:
    """(label, definition) of classes; of several of one label the largest definition counts."""
    rows = patterns.export_rows(triples)
    return rows.groupBy("label").agg(F.max("comment").alias("definition"))


def matched_in_turn(generated: DataFrame, references: list[tuple[str, DataFrame]], threshold: float) -> DataFrame:
    """generated (label) against reference lists (label) one after another by word overlap, what matched one isn't tried on the
    next: (reference, matched, percent), percentages cumulative."""
    left = generated.select("label").distinct()
    total = left.count()
    out, done = None, 0
    for name, ref in references:
        alike = metrics.alike(left.select(F.col("label").alias("text")), ref.select(F.col("label").alias("text")), threshold)
        hit = left.join(alike, F.lower("label") == F.col("left"), "left_semi")
        n = hit.count()
        done += n
        row = generated.sparkSession.createDataFrame([(name, n, 100.0 * done / total if total else 0.0)], "reference string, matched long, percent double")
        out = row if out is None else out.union(row)
        left = left.join(hit, "label", "left_anti")
    return out


def understanding(generated: DataFrame, gold: DataFrame) -> DataFrame:
    """(task, questions, accuracy): gold class labels, subclass pairs and property ends that generated triples have too."""
    names = lambda t: low(patterns.classes_with_parent(t))
    edges = lambda t: patterns.pairs(t, "rdfs:subClassOf", "child", "parent").where(~patterns.blank("child") & ~patterns.blank("parent"))

    def ends(t: DataFrame) -> DataFrame:
        end = lambda p: t.where(F.col("p") == p).groupBy(F.col("s").alias("uri")).agg(F.min("o").alias(p[5:]))
        rows = patterns.typed(t, patterns.OBJECTS).join(end("rdfs:domain"), "uri", "left").join(end("rdfs:range"), "uri", "left")
        return rows.select("uri", F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("range", F.lit("")).alias("range"))

    out = None
    for task, f in (("U1", names), ("U2", edges), ("U3", ends)):
        want = f(gold)
        row = want.join(f(generated).withColumn("hit", F.lit(True)), want.columns, "left").agg(F.count("*").alias("questions"), rate(F.col("hit").isNotNull(), 0.0).alias("accuracy"))
        row = row.select(F.lit(task).alias("task"), "questions", "accuracy")
        out = row if out is None else out.union(row)
    return out


def reasoning(generated: DataFrame, gold: DataFrame) -> DataFrame:
    """(task, score): R1, gold subclass pairs that follow in the generated hierarchy; R2, disjoint statements, five or more
    counting as 1; R5, gold properties that are there."""
    edges = lambda t: patterns.pairs(t, "rdfs:subClassOf", "child", "parent").where(~patterns.blank("child") & ~patterns.blank("parent"))
    follows = closure(edges(generated)).select(F.col("node").alias("child"), F.col("ancestor").alias("parent"), F.lit(True).alias("hit"))
    r1 = edges(gold).join(follows, ["child", "parent"], "left").agg(rate(F.col("hit").isNotNull(), 0.0).alias("score"))
    r2 = generated.agg(F.least(F.lit(1.0), F.count_if(F.col("p") == "owl:disjointWith") / 5.0).alias("score"))
    props = lambda t: patterns.typed(t, patterns.OBJECTS + patterns.DATA)
    r5 = props(gold).join(props(generated).withColumn("hit", F.lit(True)), "uri", "left").agg(rate(F.col("hit").isNotNull(), 0.0).alias("score"))
    named = lambda t, df: df.select(F.lit(t).alias("task"), "score")
    return named("R1", r1).union(named("R2", r2)).union(named("R5", r5))


def profile(scores: DataFrame) -> DataFrame:
    """scores (task, score) by capability, the task's first letter, and the mean of the capabilities (capability null)."""
    by = scores.groupBy(F.substring("task", 1, 1).alias("capability")).agg(F.avg("score").alias("score"))
    return by.union(by.agg(F.lit(None).cast("string").alias("capability"), F.avg("score").alias("score")))


def suite(tests: DataFrame) -> DataFrame:
    """tests (kind, passed): pass rate by kind and in all (kind null)."""
    return tests.rollup("kind").agg(F.count("*").alias("tests"), rate(F.col("passed"), 0.0).alias("pass_rate"))


def overall_quality(rows: DataFrame) -> DataFrame:
    """Columns consistency, coherence, modularity, expressiveness, structural and semantic coverage as one score."""
    cover = (F.col("structural") + F.col("semantic")) / 2
    return rows.withColumn("coverage", cover).withColumn(
        "quality", 0.25 * F.col("consistency") + 0.20 * F.col("coherence") + 0.15 * F.col("modularity") + 0.15 * F.col("expressiveness") + 0.25 * F.col("coverage")
    )


# Constructs that expressiveness counts, as types or as predicates, and by how many it divides.
CONSTRUCTS = {
    "classes": "owl:Class", "object_properties": "owl:ObjectProperty", "datatype_properties": "owl:DatatypeProperty", "restrictions": "owl:Restriction",
    "unions": "owl:unionOf", "intersections": "owl:intersectionOf", "enumerations": "owl:oneOf", "functional_properties": "owl:FunctionalProperty",
    "inverse_functional_properties": "owl:InverseFunctionalProperty", "transitive_properties": "owl:TransitiveProperty", "symmetric_properties": "owl:SymmetricProperty",
    "asymmetric_properties": "owl:AsymmetricProperty", "reflexive_properties": "owl:ReflexiveProperty", "irreflexive_properties": "owl:IrreflexiveProperty",
}
VARIETY = 12


def expressiveness(triples: DataFrame) -> DataFrame:
    """A column a construct with how often it occurs, as type or predicate, their sum, and the share of those that occur."""
    counts = triples.agg(*[F.count_if((F.col("p") == c) | ((F.col("p") == "rdf:type") & (F.col("o") == c))).alias(k) for k, c in CONSTRUCTS.items()])
    return counts.withColumns({"total": sum(F.col(k) for k in CONSTRUCTS), "variety": sum((F.col(k) > 0).cast("int") for k in CONSTRUCTS) / float(VARIETY)})


def growth(seed: DataFrame, generated: DataFrame) -> DataFrame:
    """Classes and properties of both ontologies and how many are new in the generated one."""
    out = None
    for kind, kinds in (("classes", patterns.CLASSES), ("properties", patterns.OBJECTS + patterns.DATA)):
        old, new = patterns.typed(seed, kinds).withColumn("old", F.lit(1)), patterns.typed(generated, kinds).withColumn("new", F.lit(1))
        row = old.join(new, "uri", "full").agg(F.count("old").alias("seed"), F.count("new").alias("generated"), F.count_if(F.col("old").isNull()).alias("added"))
        row = row.select(F.lit(kind).alias("kind"), "seed", "generated", "added")
        out = row if out is None else out.union(row)
    return out


def group_summary(results: DataFrame) -> DataFrame:
    """results (size, strategy, score, ok) by model size: mean, least, largest, share that succeeded, best strategy (ties by name)."""
    by = results.groupBy("size", "strategy").agg(F.round(F.avg("score"), 9).alias("mean"))
    best = by.groupBy("size").agg(F.min_by("strategy", F.struct(-F.col("mean"), F.col("strategy"))).alias("best"))
    stats = results.groupBy("size").agg(F.count("*").alias("runs"), F.avg("score").alias("mean"), F.min("score").alias("least"), F.max("score").alias("most"), F.avg(F.col("ok").cast("int")).alias("success"))
    return stats.join(best, "size")


def comparison(ours: DataFrame, published: DataFrame) -> DataFrame:
    """(task, a column a model): our scores (model, task, score) times 100 with one decimal beside published ones."""
    both = ours.select("model", "task", F.round(F.col("score") * 100, 1).alias("score")).union(published.select("model", "task", "score"))
    models = sorted(r[0] for r in both.select("model").distinct().collect())  # a column each
    return both.groupBy("task").pivot("model", models).agg(F.max("score"))


def shape_violations(triples: DataFrame, instances: DataFrame) -> DataFrame:
    """instances (id, class, attribute, value), a row a value, against the ontology's attributes: a missing or repeated value where
    the cardinality is 1, and values that aren't of the datatype: (id, attribute, violation)."""
    rules = patterns.class_attributes(triples)
    wanted = instances.select("id", "class").distinct().join(rules.where("required"), "class").select("id", "attribute")
    counts = instances.where("value is not null").groupBy("id", "attribute").agg(F.count("*").alias("n"))
    found = wanted.join(counts, ["id", "attribute"], "left").where("n is null or n > 1")
    card = found.select("id", "attribute", F.when(F.col("n").isNull(), "minCount").otherwise("maxCount").alias("violation"))
    typed = instances.join(rules.select("class", "attribute", "kind"), ["class", "attribute"]).where("value is not null")
    return card.union(typed.where(~fits("kind", "value")).select("id", "attribute", F.lit("datatype")).distinct())


def inherited_violations(triples: DataFrame, instances: DataFrame) -> DataFrame:
    """As `shape_violations`, a class's instances being held to what all its ancestors ask for as well, and values of object properties
    being instances of the property's range, or of a class below it, else a violation "class". Equal statements are one."""
    triples = settle(triples.where(F.col("p").isin("rdfs:subClassOf", "rdf:type", "rdfs:domain", "rdfs:range", "owl:cardinality")))
    up = triples.where("p = 'rdfs:subClassOf'").select(F.col("s").alias("child"), F.col("o").alias("parent"))
    own = instances.select("id", "class").where("class is not null").distinct()
    above = closure(up).select(F.col("node").alias("class"), "ancestor").distinct()
    values = instances.where("value is not null").select("id", "attribute", "value").distinct()

    def inherited(rules: DataFrame) -> DataFrame:
        """What classes ask for, and what all below them ask for with it: rules meet classes, not instances."""
        below = above.withColumnsRenamed({"class": "low", "ancestor": "class"}).where("low <> class")
        return settle(rules.unionByName(below.join(rules, "class").drop("class").withColumnRenamed("low", "class")).distinct())

    due = inherited(patterns.class_attributes(triples).select("class", "attribute", "required", "kind"))
    counts = values.groupBy("id", "attribute").agg(F.count("*").alias("n"))
    wanted = own.join(due.where("required").select("class", "attribute").distinct(), "class").select("id", "attribute").distinct()
    card = wanted.join(counts, ["id", "attribute"], "left").where("n is null or n > 1")
    card = card.select("id", "attribute", F.when(F.col("n").isNull(), "minCount").otherwise("maxCount").alias("violation"))
    held = values.join(own, "id")
    typed = held.join(due, ["class", "attribute"]).groupBy("id", "attribute", "value").agg(F.min("kind").alias("kind"))
    typed = typed.where(~fits("kind", "value")).select("id", "attribute", F.lit("datatype").alias("violation")).distinct()
    ends = patterns.typed(triples, patterns.OBJECTS, "attribute")
    for end, name in (("rdfs:domain", "class"), ("rdfs:range", "range")):
        ends = ends.join(patterns.pairs(triples, end, "attribute", name), "attribute")
    ends = inherited(ends.select("class", "attribute", "range"))
    # A value must be of every range that a class of the instance asks for: those that it is of are counted, and others never become rows.
    ranges = ends.select("range").distinct()
    reach = ranges.select(F.col("range").alias("class"), "range").unionByName(above.withColumnRenamed("ancestor", "range").join(ranges, "range").select("class", "range")).distinct()
    right = own.join(reach, "class").select(F.col("id").alias("value"), "range").distinct()
    asked = held.join(ends.groupBy("class", "attribute").agg(F.count("*").alias("all")), ["class", "attribute"])
    met = asked.join(right, "value").join(ends, ["class", "attribute", "range"]).groupBy("id", "attribute", "value", "class").agg(F.count("*").alias("met"))
    wrong = asked.join(met, ["id", "attribute", "value", "class"], "left").where(F.coalesce("met", F.lit(0)) < F.col("all"))
    return card.unionByName(typed).unionByName(wrong.select("id", "attribute", F.lit("class").alias("violation")).distinct())


def fits(kind: str, value: str) -> Column:
    """Whether a value is written as its kind asks for."""
    v = F.col(value)
    number = v.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$")
    return F.when(F.col(kind) == "integer", v.rlike(r"^[+-]?\d+$")).when(F.col(kind) == "float", number).when(F.col(kind) == "date", v.rlike(r"^\d{4}-\d\d-\d\d$")).otherwise(True)


def two_sided(t: float, df: float) -> float:
    """p of Student's t by the continued fraction of the incomplete beta function."""
    import math

    a, b, x = df / 2, 0.5, df / (df + t * t)
    if x >= 1:
        return 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - front * fraction(b, a, 1 - x) / b
    return front * fraction(a, b, x) / a


def fraction(a: float, b: float, x: float) -> float:
    tiny = 1e-300
    c, d = 1.0, 1 / ((1 - (a + b) * x / (a + 1)) or tiny)
    out = d
    for m in range(1, 500):
        for k in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + k * d) or tiny)
            c = (1 + k / c) or tiny
            out *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return out


def with_p(stats: DataFrame) -> DataFrame:
    """stats (metric, n, t, ...) with the two-sided p; 1 with fewer than two pairs or without a t."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["p"] = [two_sided(t, n - 1) if n > 1 and t == t and t is not None else 1.0 for t, n in zip(frame["t"], frame["n"], strict=True)]
            yield frame

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in stats.schema.fields)
    return stats.mapInPandas(run, f"{kinds}, p double")


def markdown(table: DataFrame, name: str, columns: list[str], less_is_better: tuple[str, ...] = ()) -> DataFrame:
    """A line of Markdown for each row of a table, the best value of each column in bold."""
    best = table.agg(*[(F.min(c) if c in less_is_better else F.max(c)).alias(f"best_{c}") for c in columns])
    rows = table.join(F.broadcast(best))  # one row
    cell = lambda c: F.when(F.col(c) == F.col(f"best_{c}"), F.format_string("**%.3f**", c)).otherwise(F.format_string("%.3f", c))
    return rows.select(name, F.concat(F.lit("| "), F.concat_ws(" | ", name, *[cell(c) for c in columns]), F.lit(" |")).alias("line"))
