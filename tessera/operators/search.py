"""Chunk scans, retrieval results and their combination: contexts are rows (query, source, key, text, score, rank)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.fuzzy import fuzzy_ratio, partial_ratio
from tessera.lineage import settle
from tessera.operators.matching import holding

# Words that mark legal documents, and phrases that mark precedents.
LEGAL = ("law", "regulation", "regulatory", "statute", "act", "code", "directive", "guidance", "permit", "license", "compliance", "standard", "requirement", "policy", "legislation")
PRECEDENT = (
    "precedent", "case law", "court decision", "judicial", "ruling", "judgment", "appellate", "supreme court", "district court", "legal opinion", "stare decisis",
)


def any_of(text: Column, words: tuple[str, ...]) -> Column:
    return F.coalesce(F.rlike(F.lower(text), F.lit("|".join(words))), F.lit(False))


def is_legal(document: Column, document_type: Column, text: Column) -> Column:
    """Whether name, type or the first 200 characters hold a legal word (that prefix is the rule)."""
    return any_of(document, LEGAL) | any_of(document_type, LEGAL) | any_of(F.substring(text, 1, 200), LEGAL)


def is_precedent(text: Column) -> Column:
    return any_of(text, PRECEDENT)


def chunks(points: DataFrame) -> DataFrame:
    """points (id, payload map) as (id, text, document, metadata): text or content, document or source, and what is left."""
    p = F.col("payload")
    first = lambda *names: F.coalesce(*[F.nullif(F.element_at(p, n), F.lit("")) for n in names])
    known = ("id", "text", "content", "document", "source")
    return points.select(
        F.coalesce(F.element_at(p, "id"), F.col("id").cast("string")).alias("id"), F.coalesce(first("text", "content"), F.lit("")).alias("text"), F.coalesce(first("document", "source"), F.lit("unknown")).alias("document"),
        F.map_filter("payload", lambda k, v: ~k.isin(*known)).alias("metadata"), F.col("id").alias("seq"),
    )


def scanned(found: DataFrame, most: int = 500, legal_first: bool = False) -> DataFrame:
    """The first chunks by arrival (seq), at most so many (the limit is the feature); legal ones before the others, the last
    to arrive first, if asked for. place is the order."""
    some = found.orderBy("seq").limit(most)
    if not legal_first:
        return some.withColumn("place", F.row_number().over(Window.orderBy("seq")))  # at most `most` rows
    legal = is_legal(F.col("document"), F.element_at("metadata", "document_type"), F.col("text"))
    order = Window.orderBy(F.col("legal").desc(), F.when(F.col("legal"), -F.col("seq")).otherwise(F.col("seq")))
    return some.withColumn("legal", legal).withColumn("place", F.row_number().over(order)).drop("legal")


def filtered(found: DataFrame, conditions: dict[str, str]) -> DataFrame:
    """Chunks whose metadata has all these values."""
    for key, value in conditions.items():
        found = found.where(F.element_at("metadata", key) == value)
    return found


def by_jurisdiction(found: DataFrame, jurisdiction: str | None = None, document_type: str | None = None) -> DataFrame:
    """Chunks by what is asked for; all of them where nothing is."""
    asked = {"jurisdiction": jurisdiction, "document_type": document_type}
    return filtered(found, {k: v for k, v in asked.items() if v})


def by_source(found: DataFrame, name: str) -> DataFrame:
    """Chunks whose source or collection is the name, or whose document holds it, ignoring case; all of them if there is none."""
    low = name.lower()
    hit = (F.lower(F.coalesce(F.element_at("metadata", "source"), F.lit(""))) == low) | (F.lower(F.coalesce(F.element_at("metadata", "collection"), F.lit(""))) == low) | F.contains(F.lower("document"), F.lit(low))
    some = found.where(hit)
    return found if some.isEmpty() else some


def upserted(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """stored and batch (id, vector, payload) as one table, the batch's row in place of a stored one of the same id."""
    both = stored.withColumn("turn", F.lit(0)).unionByName(batch.withColumn("turn", F.lit(1)))
    return both.groupBy("id").agg(F.max_by(F.struct("vector", "payload"), "turn").alias("r")).select("id", "r.*")


def normalised(nodes: DataFrame) -> DataFrame:
    """nodes (id, label, node_type, labels array, properties JSON text) with properties merged, the node's own fields winning, the
    type falling back on the first label, and extras being what else isn't null."""
    inner = F.coalesce(F.from_json("properties", "map<string,string>"), F.create_map().cast("map<string,string>"))
    pick = lambda name: F.coalesce(F.nullif(F.col(name), F.lit("")), F.element_at(inner, name))
    extras = F.map_filter(inner, lambda k, v: ~k.isin("id", "label", "node_type") & v.isNotNull())
    kind = F.coalesce(F.nullif(F.col("node_type"), F.lit("")), F.element_at(inner, "node_type"), F.get("labels", F.lit(0)), F.lit(""))
    return nodes.select("id", F.coalesce(pick("label"), F.col("id").cast("string")).alias("label"), kind.alias("entity_type"), extras.alias("extras"))


def compliance(activities: DataFrame, permits: DataFrame, regulations: DataFrame, jurisdictions: DataFrame, wanted: str | None = None) -> DataFrame:
    """activities (id) with the sorted lists of their permits (id, permit), regulations (id, regulation) and the jurisdictions
    (regulation, jurisdiction) of these; a wanted jurisdiction thins the last list only."""
    j = jurisdictions if wanted is None else jurisdictions.where(F.col("jurisdiction") == wanted)
    listed = lambda df, c: df.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(c)), "|").alias(f"{c}s"))
    rows = activities.select("id").distinct()
    for part in (listed(permits, "permit"), listed(regulations, "regulation"), listed(regulations.join(j, "regulation"), "jurisdiction")):
        rows = rows.join(part, "id", "left")
    return rows.select("id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("permits", "regulations", "jurisdictions")])


def concept_cases(mentions: DataFrame, cases: DataFrame, kind: str | None = None) -> DataFrame:
    """Concepts with the cases that mention them (concept, case) and these cases' kinds (case, kind), of one kind if asked for."""
    rows = mentions.distinct().join(cases if kind is None else cases.where(F.col("kind") == kind), "case")
    return rows.groupBy("concept").agg(F.countDistinct("case").alias("cases"), F.array_join(F.array_sort(F.collect_set("kind")), "|").alias("kinds"))


# First score and step by tool.
TOOLS = {"vector": (0.9, 0.05), "cypher": (1.0, 0.02), "explore": (0.85, 0.0), "path": (0.95, 0.02), "ontology": (0.3, 0.0)}


def tool_contexts(results: DataFrame) -> DataFrame:
    """results (query, tool, nth from 0, text) with scores by tool that fall with each result; other tools give none."""
    score = F.lit(None).cast("double")
    for name, (start, step) in TOOLS.items():
        score = F.when(F.col("tool") == name, start - step * F.col("nth")).otherwise(score)
    return results.withColumn("score", score).where("score is not null")


def vector_results(replies: DataFrame) -> DataFrame:
    """replies (query, reply): texts between lines of three dashes, those that report nothing or an error left out."""
    parts = replies.select("query", F.posexplode(F.split("reply", "\n---\n")).alias("nth", "text"))
    return parts.where(~F.startswith("text", F.lit("No vector")) & ~F.startswith("text", F.lit("Vector search error"))).withColumn("score", 0.9 - 0.05 * F.col("nth"))


def row_results(replies: DataFrame) -> DataFrame:
    """replies (query, reply), a heading with `rows:` and then a JSON object a line, as (query, nth, id, text, score); lines that are
    no JSON score 0.5 with their first 300 characters."""
    lines = replies.where(F.contains("reply", F.lit("rows:"))).select("query", F.posexplode(F.split("reply", "\n")).alias("at", "line")).where("at > 0")
    row = lines.select("query", (F.col("at") - 1).alias("nth"), "line", F.from_json("line", "map<string,string>").alias("r"))
    get = lambda *names: F.coalesce(*[F.element_at("r", n) for n in names], F.lit(""))
    sound = F.col("r").isNotNull() & (F.size("r") > 0)
    label, kind = get("label", "n.label", "e.label"), get("type", "n.node_type", "node_type")
    text = F.when(~sound, F.substring("line", 1, 300)).when(label != "", F.concat(label, F.lit(" ["), kind, F.lit("]"))).otherwise(F.substring("line", 1, 200))
    return row.select("query", "nth", F.when(sound, F.nullif(get("id", "n.id", "e.id"), F.lit(""))).alias("id"), text.alias("text"), F.when(sound, 1.0 - 0.02 * F.col("nth")).otherwise(0.5).alias("score"))


def reranked(contexts: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """contexts (query, key, text) with a model's scores (query, key, score) in place of their own: the best k of each query, ties by
    key."""
    rows = contexts.drop("score").join(scores, ["query", "key"])
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "key"))).where(F.col("rank") <= k)


def fallback(graph: DataFrame, vector: DataFrame, most: int = 25) -> DataFrame:
    """Graph results of each query before vector results, at most so many in all (the limit is the feature)."""
    both = graph.withColumn("place", F.lit(0)).unionByName(vector.withColumn("place", F.lit(1)))
    order = Window.partitionBy("query").orderBy("place", F.col("score").desc(), "key")
    return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).select("query", "rank", "key", "score")


def hybrid(vector: DataFrame, graph: DataFrame, weights: DataFrame, scores: DataFrame, k: int = 5) -> DataFrame:
    """vector and graph results (query, key, score) of each query fused by its weights (query, vector_weight, graph_weight) with
    reciprocal ranks, then the best k by a model's scores (query, key, score)."""
    def placed(df: DataFrame, weight: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "key"))
        return df.withColumn("rank", rank).join(weights, "query").select("query", "key", (F.col(weight) / (60 + F.col("rank"))).alias("part"))

    fused = placed(vector, "vector_weight").unionByName(placed(graph, "graph_weight")).groupBy("query", "key").agg(F.sum("part").alias("fused"))
    return reranked(fused, scores, k)


FEW_TERMS_KNOWN = 100_000  # rows of terms that are broadcast to the queries


def expanded(queries: DataFrame, subclasses: DataFrame, synonyms: DataFrame, relations: DataFrame) -> DataFrame:
    """queries (query, type) with terms: the types, then what each table (type, term) knows of them, each new term once.

    Queries of the same types are answered once."""
    asked = queries.groupBy("query").agg(F.struct(F.array_sort(F.collect_set("type")).alias("types"), F.bool_or(F.col("type").isNull()).alias("none")).alias("asked"))
    asked = settle(asked)
    sets = settle(asked.select("asked").distinct())
    types = sets.select("asked", F.explode("asked.types").alias("type")).unionByName(sets.where("asked.none").select("asked", F.lit(None).cast("string").alias("type")))
    own = types.select("asked", F.col("type").alias("term"), F.lit(0).alias("place"))
    for n, table in enumerate((subclasses, synonyms, relations), 1):
        own = own.unionByName(types.join(table.select("type", "term"), "type").select("asked", "term", F.lit(n).alias("place")))
    terms = settle(own.groupBy("asked", F.lower("term").alias("key")).agg(F.min(F.struct("place", "term")).alias("first")).select("asked", "first.place", "first.term"))
    return asked.join(F.broadcast(terms) if terms.count() <= FEW_TERMS_KNOWN else terms, "asked").select("query", "place", "term")


def alike_queries(terms: DataFrame) -> DataFrame:
    """(query, terms, one) for rows (query, term): the query's terms in lower case and order, and the smallest query that has the same."""
    t = terms.select("query", F.lower("term").alias("term")).where("query is not null and term <> ''")
    asked = settle(t.groupBy("query").agg(F.array_sort(F.collect_set("term")).alias("terms")))
    return settle(asked.join(asked.groupBy("terms").agg(F.min("query").alias("one")), "terms").select("query", "terms", "one"))


def linked_entities(terms: DataFrame, entities: DataFrame, least: float = 50.0, most: int = 15) -> DataFrame:
    """terms (query, term) linked to entities (id, label, description): candidates have a term as id or hold one in label, ignoring
    case; scored by the best of the label's ratio and partial ratio, 1.2 times the id's ratio and 0.8 times the description's partial
    ratio, in 0..120; kept from `least` on or with an equal id; the best `most` of each query (the cap is the feature).

    Queries of the same terms are answered once, and a term is scored once against each label, description and id."""
    low = entities.select("id", F.lower("id").alias("lid"), F.lower(F.coalesce("label", F.lit(""))).alias("label"), F.lower("description").alias("description"))
    asked = alike_queries(terms)
    t = asked.where("query = one").select("query", F.explode("terms").alias("term"))
    words = t.select(F.col("term").alias("label")).distinct()
    by_label = holding(low.select("id", F.col("label").alias("text")), words).select("id", F.col("label").alias("term"))
    by_id = low.join(words, low["lid"] == words["label"]).select("id", words["label"].alias("term"))
    candidates = by_label.union(by_id).distinct().join(t, "term").select("query", "id").distinct()
    met = settle(candidates.join(t, "query").select("id", "term").distinct().join(low, "id"))
    label = met.select("term", "label").distinct().withColumn("of_label", F.greatest(100 * fuzzy_ratio("term", "label"), 100 * partial_ratio("term", "label")))
    told = met.where("description is not null").select("term", "description").distinct().withColumn("of_description", 80 * partial_ratio("term", "description"))
    scored = met.join(label, ["term", "label"]).join(told, ["term", "description"], "left")
    best = F.greatest("of_label", 120 * fuzzy_ratio("term", "lid"), F.coalesce("of_description", F.lit(0.0)))
    scored = scored.groupBy("id", "term").agg(F.max(best).alias("best"), F.max(F.col("lid") == F.col("term")).alias("same"))
    by = candidates.join(t, "query").join(scored, ["id", "term"]).groupBy("query", "id").agg(F.max("best").alias("score"), F.max("same").alias("same")).where((F.col("score") >= least) | F.col("same"))
    order = Window.partitionBy("query").orderBy(F.round("score", 6).desc(), "id")
    ranked = by.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).withColumnRenamed("query", "one")
    return asked.select("query", "one").join(ranked, "one").select("query", "id", "score", "rank")


def capped_proposals(gaps: DataFrame, most: int = 30) -> DataFrame:
    """The first gaps by frequency as numbered proposals (the cap is the feature), and the parent that a label resolves to."""
    few = gaps.orderBy(F.col("frequency").desc(), "entity_type").limit(most)
    nth = F.row_number().over(Window.orderBy(F.col("frequency").desc(), "entity_type"))  # at most `most` rows
    return few.select(F.format_string("prop_%03d", nth).alias("id"), "entity_type", "frequency")


def resolved_parents(proposals: DataFrame, classes: DataFrame, top: str = "owl:Thing") -> DataFrame:
    """proposals (id, parent) with the uri of the first class (uri, label) of that label, ignoring case, else the top."""
    first = classes.groupBy(F.lower("label").alias("k")).agg(F.min("uri").alias("parent_uri"))
    return proposals.join(first, F.lower("parent") == F.col("k"), "left").select("id", "parent", F.coalesce("parent_uri", F.lit(top)).alias("parent_uri"))


def last_rows(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Each file's summary, which is its last row, and how many rows come before it."""
    last = F.max_by(F.struct(*[c for c in rows.columns if c not in (by, order)]), order)
    return rows.groupBy(by).agg(last.alias("last"), (F.count("*") - 1).alias("matches")).select(by, "last.*", "matches")


