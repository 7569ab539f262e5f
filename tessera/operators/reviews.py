"""Grounding, drift, strategies and competency questions: what moderators and evaluators derive from records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import local_name
from tessera.operators.matching import holding


def share(hits, total):
    """hits / total, 1 where there is nothing."""
    return F.coalesce(hits / F.nullif(total, F.lit(0)), F.lit(1.0))


def grounding(elements: DataFrame, seeds: DataFrame) -> DataFrame:
    """elements (proposal, name, parent, cited, serves) by proposal: how many there are, and the shares of them that cite
    documents, serve a question, and are connected, their parent holding a seed's label (plain substring); 1 where there is
    no element, and all are connected where there is no seed. ungrounded and unconnected list up to five names. Healthy with
    0.85, 0.8 and 0.9 at least."""
    anchored = holding(elements.select("parent", F.col("parent").alias("text")).where("parent <> ''").distinct(), seeds).select("parent").distinct().withColumn("hit", F.lit(True))
    any_seed = not seeds.isEmpty()
    rows = elements.join(anchored, "parent", "left").withColumn("connected", F.coalesce("hit", F.lit(not any_seed)))
    n = F.count("*")
    first = lambda hit: F.array_join(F.slice(F.array_sort(F.collect_set(F.when(hit, F.col("name")))), 1, 5), "|")
    by = rows.groupBy("proposal").agg(
        n.alias("elements"),
        share(F.count_if("cited"), n).alias("grounding"),
        share(F.count_if("serves"), n).alias("serving"),
        share(F.count_if("connected"), n).alias("connectivity"),
        first(~F.col("cited")).alias("ungrounded"),
        first(~F.col("connected")).alias("orphans"),
    )
    return by.withColumn("healthy", (F.col("grounding") >= 0.85) & (F.col("serving") >= 0.8) & (F.col("connectivity") >= 0.9))


def drift(messages: DataFrame, grounded: DataFrame, rounds: int = 2) -> DataFrame:
    """Flags of each debate: little grounding (under 0.85), revisions that never shrink, little connection to the seed (under
    0.6), so many approving rounds on end, and few elements that serve a question (under 0.8); `grounded` has debate and the
    three shares. drifting says whether any is set."""
    from tessera.operators.debate import echo_chambers, growing_revisions

    rows = growing_revisions(messages).withColumnRenamed("growing", "complexity_ratchet")
    rows = rows.join(echo_chambers(messages), "debate", "left").join(grounded, "debate", "left")
    under = lambda c, least: F.coalesce(F.col(c) < least, F.lit(False))
    flags = {
        "hallucination_spiral": under("grounding", 0.85),
        "complexity_ratchet": F.col("complexity_ratchet"),
        "conceptual_drift": under("connectivity", 0.6),
        "echo_chamber": F.coalesce(F.col("longest") >= rounds, F.lit(False)),
        "scope_creep": under("serving", 0.8),
    }
    out = rows.select("debate", *[c.alias(k) for k, c in flags.items()])
    anything = F.lit(False)
    for k in flags:
        anything = anything | F.col(k)
    return out.withColumn("drifting", anything)


ADVICE = (
    ("hallucination_spiral", "Cite a source passage for every element or withdraw it."),
    ("complexity_ratchet", "Remove or merge elements in the next revision."),
    ("conceptual_drift", "Attach every element to a class of the seed."),
    ("echo_chamber", "Name at least one weakness in the next review."),
    ("scope_creep", "Drop elements that answer no question."),
)


def corrections(flags: DataFrame) -> DataFrame:
    """One text of advice for each debate with a flag set."""
    said = F.concat_ws(" ", *[F.when(F.col(k), F.lit(text)) for k, text in ADVICE])
    return flags.where("drifting").select("debate", said.alias("advice"))


# Strategies in the order in which they stand in for a phase's own one.
FALLBACKS = ("consensus_building", "dialectical", "socratic", "abductive", "delphi")


def chosen_strategy(phases: DataFrame) -> DataFrame:
    """phases (id, strategy, failures): the strategy itself without failures, else the others in order, the last one staying."""
    others = F.filter(F.array(*map(F.lit, FALLBACKS)), lambda x: x != F.col("strategy"))
    at = F.least(F.col("failures"), F.size(others)).cast("int")
    return phases.select("id", F.when(F.col("failures") == 0, F.col("strategy")).otherwise(F.get(others, at - 1)).alias("strategy"))


def anonymous_feedback(messages: DataFrame, issues: DataFrame, most: int = 3) -> DataFrame:
    """By debate: approvals of known ones as n/m, and the first issues (debate, seq, issue) raised, in order."""
    votes = messages.where("message_type = 'review'").groupBy("debate").agg(F.concat(F.count_if("approves").cast("string"), F.lit("/"), F.count("approves").cast("string")).alias("approval"))
    order = Window.partitionBy("debate").orderBy("seq", "issue")
    few = issues.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= most)
    said = few.groupBy("debate").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "issue"))), lambda x: x["issue"]), "|").alias("issues"))
    return votes.join(said, "debate", "left").select("debate", "approval", F.coalesce("issues", F.lit("")).alias("issues"))


def before_after(metrics: DataFrame) -> DataFrame:
    """metrics (system, phase 'before' or 'after', metric, value): change and whether it is improved, degraded or unchanged."""
    by = metrics.groupBy("system", "metric").agg(F.avg(F.when(F.col("phase") == "before", F.col("value"))).alias("before"), F.avg(F.when(F.col("phase") == "after", F.col("value"))).alias("after"))
    change = F.round(F.col("after") - F.col("before"), 6)
    return by.where("before is not null and after is not null").select("system", "metric", "before", "after", F.when(change > 0, "improved").when(change < 0, "degraded").otherwise("unchanged").alias("verdict"))


def evidence_records(replies: DataFrame) -> DataFrame:
    """replies (id, reply), JSON with arrays of classes, properties, relations and instances that hold evidence, as one row
    a passage: (id, kind, element, document, passage, confidence). Replies that aren't JSON give none."""
    item = "array<struct<name:string,evidence:array<struct<document:string,passage:string,confidence:double>>>>"
    kinds = ("classes", "properties", "relations", "instances")
    parsed = replies.select("id", F.from_json("reply", ", ".join(f"{k} {item}" for k in kinds)).alias("r"))
    each = parsed.select("id", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col("r")[k].alias("items")) for k in kinds])).alias("k"))
    items = each.select("id", "k.kind", F.explode("k.items").alias("e"))
    return items.select("id", "kind", F.col("e.name").alias("element"), F.explode("e.evidence").alias("v")).select("id", "kind", "element", "v.document", "v.passage", F.coalesce("v.confidence", F.lit(0.0)).alias("confidence"))


def proposals_from_hierarchy(classes: DataFrame, seeds: DataFrame) -> DataFrame:
    """Classes (uri, label, parent) that the seed (uri) doesn't have as accepted proposals with numbered ids."""
    rows = classes.join(seeds.select("uri"), "uri", "left_anti")
    return rows.select(F.concat(F.lit("prop_"), F.substring(F.sha2("uri", 256), 1, 12)).alias("id"), "label", "parent", F.lit("accept").alias("decision"))


def valid_relations(proposed: DataFrame, existing: DataFrame, classes: DataFrame) -> DataFrame:
    """Proposed relations (name, domain, range) that are complete, aren't there already by name, and whose ends are classes
    (label), ignoring case."""
    whole = proposed.where("name <> '' and domain <> '' and range <> ''")
    fresh = whole.join(existing.select(F.lower("name").alias("k")), F.lower("name") == F.col("k"), "left_anti")
    for end in ("domain", "range"):
        known = classes.select(F.lower("label").alias(f"{end}_k")).distinct()
        fresh = fresh.join(known, F.lower(end) == F.col(f"{end}_k"), "left_semi")
    return fresh.select("name", "domain", "range")


def review_issues(reviews: DataFrame) -> DataFrame:
    """reviews (id, review), JSON with arrays of violations (rule, element) and missing (names), as flat issue texts."""
    parsed = reviews.select("id", F.from_json("review", "violations array<struct<rule:string,element:string>>, missing array<string>").alias("r"))
    broken = F.transform(F.col("r.violations"), lambda x: F.format_string("%s: %s", x["rule"], x["element"]))
    absent = F.transform(F.col("r.missing"), lambda x: F.concat(F.lit("missing: "), x))
    empty = F.array().cast("array<string>")
    return parsed.select("id", F.explode(F.concat(F.coalesce(broken, empty), F.coalesce(absent, empty))).alias("issue"))


def iteration_metrics(phases: DataFrame) -> DataFrame:
    """phases (iteration, kind 'term', 'question' or 'instance', category, passed) by iteration: share of terms that became
    classes, of questions answered and of instances that passed; 0 without any."""
    part = lambda kind, hit: F.coalesce(F.avg(F.when(F.col("kind") == kind, hit.cast("int"))), F.lit(0.0))
    return phases.groupBy("iteration").agg(
        part("term", F.col("category") == "class").alias("entity_coverage"), part("question", F.col("passed")).alias("question_coverage"), part("instance", F.col("passed")).alias("instance_pass_rate")
    )


def term_split(terms: DataFrame) -> DataFrame:
    """terms (id, category) counted by class, property, relation and anything else."""
    kinds = ("class", "property", "relation")
    return terms.groupBy("id").agg(*[F.count_if(F.col("category") == k).alias(k) for k in kinds], F.count_if(~F.coalesce(F.col("category").isin(*kinds), F.lit(False))).alias("unknown"))


def merged_questions(existing: DataFrame, generated: DataFrame) -> DataFrame:
    """existing (num, question) kept, and generated (seq, question) added that are not empty and new ignoring case, once
    each, in order, numbered on from the largest number; ids are CQ_ and three digits."""
    from tessera.operators.retrieval import numbered

    key = F.lower("question")
    fresh = generated.where("question <> ''").groupBy(key.alias("key")).agg(F.min(F.struct("seq", "question")).alias("f")).join(existing.select(key.alias("key")), "key", "left_anti")
    start = existing.agg(F.coalesce(F.max("num"), F.lit(0)).alias("start"))
    added = numbered(fresh.select("f.*"), ["seq"], "nth").join(F.broadcast(start))  # one row
    rows = existing.select("num", "question").unionByName(added.select((F.col("start") + F.col("nth")).alias("num"), "question"))
    return rows.select(F.format_string("CQ_%03d", "num").alias("id"), "question")


def removal_questions(removed: DataFrame) -> DataFrame:
    """removed (uri, kind, level) as template questions; a class's is easy to hard by level, a property's medium or hard."""
    label = F.replace(local_name(F.col("uri")), F.lit("_"), F.lit(" "))
    is_class = F.col("kind") == "class"
    ask = F.when(is_class, F.concat(F.lit("What is a "), label, F.lit(" and how does it relate to the ontology?"))).otherwise(F.concat(F.lit("What relationship does '"), label, F.lit("' describe between entities?")))
    hard = F.when(F.col("level") >= 0.9, "hard").when(is_class & (F.col("level") < 0.75), "easy").otherwise("medium")
    return removed.select("uri", "kind", "level", ask.alias("question"), hard.alias("difficulty"))


def moderator_questions(classes: DataFrame, relations: DataFrame, existing: DataFrame) -> DataFrame:
    """Questions on accepted classes (label, parent): their properties, their place, and their first two relations (label,
    nth, name, range); those whose id is there already are left out."""
    base = F.concat(F.lit("cq_"), F.replace(F.lower("label"), F.lit(" "), F.lit("_")))
    named = classes.where("label <> ''")
    two = F.array(
        F.struct(F.concat(base, F.lit("_properties")).alias("id"), F.concat(F.lit("What properties does a "), "label", F.lit(" have?")).alias("question")),
        F.struct(F.concat(base, F.lit("_hierarchy")).alias("id"), F.concat(F.lit("Which "), F.coalesce("parent", F.lit("entity")), F.lit(" instances are also "), "label", F.lit("?")).alias("question")),
    )
    own = relations.where("nth <= 2 and name <> '' and range <> ''").join(named.select("label"), "label", "left_semi")
    more = own.select(F.concat(base, F.lit("_rel_"), "name").alias("id"), F.concat(F.lit("What "), "range", F.lit(" does "), "label", F.lit(" "), "name", F.lit("?")).alias("question"))
    return named.select(F.explode(two).alias("q")).select("q.*").unionByName(more).distinct().join(existing.select("id"), "id", "left_anti")


def structural_checks(questions: DataFrame, classes: DataFrame) -> DataFrame:
    """questions (id, expected array) with whether all expected classes are among labels, ignoring case; null without any."""
    known = classes.select(F.lower("label").alias("name")).distinct().withColumn("known", F.lit(1))
    one = questions.select("id", F.explode_outer("expected").alias("e")).withColumn("name", F.lower("e")).join(known, "name", "left")
    return one.groupBy("id").agg(F.bool_and(F.when(F.col("e").isNotNull(), F.col("known").isNotNull())).alias("passed"))


def question_percent(checks: DataFrame) -> DataFrame:
    """checks (id, passed) as counts and a percentage; a check that is null doesn't pass."""
    ok = F.count_if(F.coalesce("passed", F.lit(False)))
    return checks.agg(F.count("*").alias("total"), ok.alias("covered"), F.coalesce(100.0 * ok / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("coverage_pct"))
