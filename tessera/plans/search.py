"""Scans, retrieval and answers over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import replies, text
from tessera.operators import gaps, matching, metrics, search
from tessera.plans.binding import view
from tessera.plans.registered import query, rounded

POINTS = """WITH c AS (SELECT doc_id AS seq, doc_id::VARCHAR AS id, CASE WHEN doc_id % 3 = 0 THEN concat('Permit ', doc_id) ELSE text END AS text, CASE WHEN doc_id % 5 = 0 THEN 'unknown' ELSE source END AS document, lang AS jurisdiction, CASE WHEN doc_id % 7 = 0 THEN 'Statute' ELSE 'memo' END AS document_type FROM documents),
    w AS (SELECT *, regexp_matches(lower(concat(document, ' ', document_type, ' ', substr(text, 1, 200))), 'law|regulation|regulatory|statute|act|code|directive|guidance|permit|license|compliance|standard|requirement|policy|legislation') AS legal FROM c)"""


def found(spark, sf_dir):
    d = view(spark, sf_dir, "documents")
    k = F.col("doc_id")
    entry = lambda name, value: F.struct(F.lit(name).alias("key"), value.alias("value"))
    pairs = F.array(
        entry("text", F.when(k % 3 == 0, "").otherwise(F.col("text"))), entry("content", F.when(k % 3 == 0, F.concat(F.lit("Permit "), k.cast("string")))), entry("source", F.when(k % 5 == 0, "").otherwise(F.col("source"))),
        entry("jurisdiction", F.col("lang")), entry("document_type", F.when(k % 7 == 0, "Statute").otherwise("memo")),
    )
    return search.chunks(d.select(k.alias("id"), F.map_from_entries(pairs).alias("payload")))


@query(POINTS + """, f AS (SELECT * FROM w ORDER BY seq LIMIT 500) SELECT id, document, md5(text) AS digest, row_number() OVER (ORDER BY legal DESC, CASE WHEN legal THEN -seq ELSE seq END) AS place FROM f""")
def chunk_scan(spark, sf_dir):
    """The first five hundred chunks (the limit is the feature), legal ones first."""
    return search.scanned(found(spark, sf_dir), 500, legal_first=True).select("id", "document", F.md5("text").alias("digest"), "place")


@query(POINTS + "SELECT id, document FROM c WHERE jurisdiction = 'en' AND document_type = 'Statute'")
def chunks_by_jurisdiction(spark, sf_dir):
    """Chunks by their metadata."""
    return search.by_jurisdiction(found(spark, sf_dir), "en", "Statute").select("id", "document")


@query(POINTS + "SELECT id, document FROM c WHERE CASE WHEN (SELECT count(*) FROM c WHERE contains(lower(document), 'web')) > 0 THEN contains(lower(document), 'web') ELSE true END")
def chunks_by_source(spark, sf_dir):
    """Chunks of one source, all if there is none."""
    return search.by_source(found(spark, sf_dir), "Web").select("id", "document")


@query(POINTS + "SELECT count_if(legal) AS legal, count_if(regexp_matches(lower(text), 'precedent|case law|court decision|judicial|ruling|judgment|appellate|supreme court|district court|legal opinion|stare decisis')) AS precedents, count(*) AS chunks FROM w")
def legal_counts(spark, sf_dir):
    """Legal chunks and precedents."""
    rows = found(spark, sf_dir)
    legal = search.is_legal(F.col("document"), F.element_at("metadata", "document_type"), F.col("text"))
    return rows.agg(F.count_if(legal).alias("legal"), F.count_if(search.is_precedent(F.col("text"))).alias("precedents"), F.count("*").alias("chunks"))


@query("""SELECT doc_id, CAST(n AS INTEGER) AS chunk, md5(trim(substr(text, CAST(n * 650 + 1 AS INTEGER), 750), ' ')) AS digest FROM documents, (SELECT unnest(range(0, (SELECT max(length(text)) FROM documents) // 650 + 1)) AS n) AS r
    WHERE n * 650 < length(text) AND trim(substr(text, CAST(n * 650 + 1 AS INTEGER), 750), ' ') <> ''""")
def overlapping_chunks(spark, sf_dir):
    """A10: trimmed chunks that overlap."""
    from tessera.sources.chunks import chunked

    return chunked(view(spark, sf_dir, "documents"), "doc_id", "text", 750, 100, trim=True).select("doc_id", "chunk", F.md5("content").alias("digest"))


@query("""SELECT vec_id AS id, CASE WHEN vec_id % 3 = 0 THEN 'new' ELSE 'old' END AS payload FROM embeddings UNION ALL SELECT vec_id + 1000000, 'new' FROM embeddings WHERE label = 1""")
def upserted_points(spark, sf_dir):
    """A batch over what is stored."""
    e = view(spark, sf_dir, "embeddings")
    row = lambda df, name: df.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), F.lit(name).alias("payload"))
    more = e.where("label = 1").withColumn("vec_id", F.col("vec_id") + 1_000_000)
    return search.upserted(row(e, "old"), row(e.where("vec_id % 3 = 0"), "new").union(row(more, "new"))).select("id", "payload")


@query("""SELECT event_id AS id, CASE WHEN event_id % 4 = 0 THEN event_type ELSE concat('inner ', event_id) END AS label, CASE WHEN event_id % 3 = 0 THEN 'own' WHEN event_id % 2 = 0 THEN 'nested' ELSE 'First' END AS entity_type, concat('k=', regexp_extract(props, '[0-9]+')) AS extras FROM events""")
def normalised_nodes(spark, sf_dir):
    """Nodes with their JSON properties merged."""
    e = view(spark, sf_dir, "events")
    k = F.col("event_id")
    inner = F.to_json(F.struct(F.when(k % 2 == 0, "nested").alias("node_type"), F.concat(F.lit("inner "), k.cast("string")).alias("label"), F.regexp_extract("props", "[0-9]+", 0).alias("k")))
    nodes = e.select(k.alias("id"), F.when(k % 4 == 0, F.col("event_type")).alias("label"), F.when(k % 3 == 0, "own").alias("node_type"), F.array(F.lit("First")).alias("labels"), inner.alias("properties"))
    shown = F.array_join(F.transform(F.map_entries("extras"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",")
    return search.normalised(nodes).select("id", "label", "entity_type", shown.alias("extras"))


@query("""WITH p AS (SELECT o_custkey AS id, o_orderpriority AS permit FROM orders), r AS (SELECT DISTINCT o_custkey AS id, l_returnflag AS regulation FROM orders JOIN lineitem ON l_orderkey = o_orderkey), j AS (SELECT unnest(['A', 'N', 'R']) AS regulation, unnest(['EU', 'US', 'EU']) AS jurisdiction)
    SELECT c_custkey AS id, coalesce((SELECT string_agg(DISTINCT permit, '|' ORDER BY permit) FROM p WHERE p.id = c_custkey), '') AS permits, coalesce((SELECT string_agg(DISTINCT regulation, '|' ORDER BY regulation) FROM r WHERE r.id = c_custkey), '') AS regulations,
    coalesce((SELECT string_agg(DISTINCT jurisdiction, '|' ORDER BY jurisdiction) FROM r JOIN j USING (regulation) WHERE r.id = c_custkey AND jurisdiction = 'EU'), '') AS jurisdictions FROM customer""")
def compliance_star(spark, sf_dir):
    """Permits, regulations and jurisdictions of activities."""
    o, l = view(spark, sf_dir, "orders"), view(spark, sf_dir, "lineitem")
    regulations = o.join(l, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("id"), F.col("l_returnflag").alias("regulation")).distinct()
    issued = spark.createDataFrame([("A", "EU"), ("N", "US"), ("R", "EU")], "regulation string, jurisdiction string")
    return search.compliance(view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), o.select(F.col("o_custkey").alias("id"), F.col("o_orderpriority").alias("permit")), regulations, issued, "EU")


@query("""SELECT l_partkey AS concept, count(DISTINCT l_orderkey) AS cases, string_agg(DISTINCT o_orderpriority, '|' ORDER BY o_orderpriority) AS kinds FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderpriority IS NOT NULL GROUP BY 1""")
def concept_cases(spark, sf_dir):
    """C17: cases of each concept and their kinds."""
    mentions = view(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("concept"), F.col("l_orderkey").alias("case"))
    return search.concept_cases(mentions, view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case"), F.col("o_orderpriority").alias("kind")))


@query("""WITH r AS (SELECT event_id % 50 AS query, CASE event_id % 6 WHEN 0 THEN 'vector' WHEN 1 THEN 'cypher' WHEN 2 THEN 'explore' WHEN 3 THEN 'path' WHEN 4 THEN 'ontology' ELSE 'other' END AS tool, event_id // 300 AS nth FROM events)
    SELECT query, tool, nth, round(CASE tool WHEN 'vector' THEN 0.9e0 - 0.05e0 * nth WHEN 'cypher' THEN 1.0e0 - 0.02e0 * nth WHEN 'explore' THEN 0.85e0 WHEN 'path' THEN 0.95e0 - 0.02e0 * nth ELSE 0.3e0 END, 4) AS score FROM r WHERE tool <> 'other'""")
def tool_contexts(spark, sf_dir):
    """Results of an agent's tools with their scores."""
    tools = F.array(*[F.lit(x) for x in ("vector", "cypher", "explore", "path", "ontology", "other")])
    rows = view(spark, sf_dir, "events").select((F.col("event_id") % 50).alias("query"), F.element_at(tools, (F.col("event_id") % 6 + 1).cast("int")).alias("tool"), F.expr("event_id div 300").alias("nth"))
    return search.tool_contexts(rows).select("query", "tool", "nth", rounded("score"))


@query("""WITH e AS (SELECT user_id AS query, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS nth FROM events WHERE event_type <> 'error') SELECT query, nth, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id::VARCHAR END AS id,
    CASE WHEN event_id % 6 = 0 THEN concat('broken ', event_id) ELSE concat(event_type, ' [', event_id % 4, ']') END AS text, round(CASE WHEN event_id % 6 = 0 THEN 0.5e0 ELSE 1.0e0 - 0.02e0 * nth END, 4) AS score FROM e""")
def row_results(spark, sf_dir):
    """Rows of a tool's reply as contexts."""
    e = view(spark, sf_dir, "events").where("event_type <> 'error'")
    line = F.when(F.col("event_id") % 6 == 0, F.concat(F.lit("broken "), F.col("event_id").cast("string"))).otherwise(F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("label"), (F.col("event_id") % 4).alias("type"))))
    reply = F.concat(F.lit("Found rows:\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n"))
    return search.row_results(e.groupBy(F.col("user_id").alias("query")).agg(reply.alias("reply"))).select("query", "nth", "id", "text", rounded("score"))


@query("""WITH d AS (SELECT source AS query, doc_id, substr(text, 1, 20) AS t, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS nth FROM documents WHERE NOT contains(text, '---')) SELECT query, nth, CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE md5(concat(doc_id, t)) END AS digest, round(0.9e0 - 0.05e0 * nth, 4) AS score FROM d WHERE doc_id % 9 <> 0 AND NOT contains(t, chr(10))""".replace("CASE WHEN doc_id % 9 = 0 THEN 'x' ELSE md5(concat(doc_id, t)) END", "md5(concat(doc_id, t))").replace("WHERE NOT contains(text, '---')", "WHERE NOT contains(substr(text, 1, 20), '---') AND NOT contains(substr(text, 1, 20), chr(10))"))
def vector_results(spark, sf_dir):
    """Chunks of a vector tool's reply; excerpts as short as these are the reply's."""
    d = view(spark, sf_dir, "documents").select("source", "doc_id", F.substring("text", 1, 20).alias("t")).where(~F.contains("t", F.lit("---")) & ~F.contains("t", F.lit("\n")))
    part = F.when(F.col("doc_id") % 9 == 0, "No vector results").otherwise(F.concat(F.col("doc_id").cast("string"), "t"))
    reply = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", part.alias("p")))), lambda x: x["p"]), "\n---\n")
    return search.vector_results(d.groupBy(F.col("source").alias("query")).agg(reply.alias("reply"))).select("query", "nth", F.md5("text").alias("digest"), rounded("score"))


CONTEXTS = """WITH v AS (SELECT o_custkey AS query, o_orderkey AS key, o_totalprice / 500000 AS score FROM orders), g AS (SELECT o_custkey AS query, l_orderkey AS key, max(l_discount) AS score FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL),
    m AS (SELECT o_custkey AS query, o_orderkey AS key, (o_orderkey * 7919 % 1009) / 1009.0e0 AS score FROM orders)"""


def contexts(spark, sf_dir):
    o, l = view(spark, sf_dir, "orders"), view(spark, sf_dir, "lineitem")
    own = lambda score: o.select(F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("key"), score.alias("score"))
    graph = l.join(o, F.col("o_orderkey") == F.col("l_orderkey")).groupBy(F.col("o_custkey").alias("query"), F.col("l_orderkey").alias("key")).agg(F.max("l_discount").alias("score"))
    return own(F.col("o_totalprice") / 500000), graph, own(F.col("o_orderkey") * 7919 % 1009 / 1009.0)


@query(CONTEXTS + ", r AS (SELECT m.*, row_number() OVER (PARTITION BY query ORDER BY m.score DESC, key) AS rank FROM v JOIN m USING (query, key)) SELECT query, key, round(score, 4) AS score, rank FROM r WHERE rank <= 5".replace("SELECT m.*,", "SELECT query, key, m.score,"))
def reranked_contexts(spark, sf_dir):
    """contexts by a model's scores; the best five are the feature."""
    v, _, m = contexts(spark, sf_dir)
    return search.reranked(v, m, 5).select("query", "key", rounded("score"), "rank")


@query(CONTEXTS + ", u AS (SELECT *, 0 AS place FROM g UNION ALL SELECT *, 1 FROM v), r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY place, score DESC, key) AS rank, key, score FROM u) SELECT query, rank, key, round(score, 4) AS score FROM r WHERE rank <= 25")
def fallback_contexts(spark, sf_dir):
    """Graph results, then vector results, twenty-five at most (the limit is the feature)."""
    v, g, _ = contexts(spark, sf_dir)
    return search.fallback(g, v).select("query", "rank", "key", rounded("score"))


@query(CONTEXTS + """, w AS (SELECT c_custkey AS query, 0.3e0 + c_custkey % 4 / 10.0e0 AS vw FROM customer), a AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS n FROM v), b AS (SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS n FROM g),
    f AS (SELECT query, key, sum(p) AS fused FROM (SELECT query, key, vw / (60 + n) AS p FROM a JOIN w USING (query) UNION ALL SELECT query, key, (1 - vw) / (60 + n) FROM b JOIN w USING (query)) AS x GROUP BY ALL),
    r AS (SELECT query, key, fused, m.score, row_number() OVER (PARTITION BY query ORDER BY m.score DESC, key) AS rank FROM f JOIN m USING (query, key)) SELECT query, key, round(fused, 6) AS fused, round(score, 4) AS score, rank FROM r WHERE rank <= 5""")
def hybrid_retrieval(spark, sf_dir):
    """Two lists fused by each query's weights, then reranked (five are the feature)."""
    v, g, m = contexts(spark, sf_dir)
    w = view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("query"), (0.3 + F.col("c_custkey") % 4 / 10.0).alias("vector_weight")).withColumn("graph_weight", 1 - F.col("vector_weight"))
    return search.hybrid(v, g, w, m).select("query", "key", rounded("fused", 6), rounded("score"), "rank")


@query("""WITH q AS (SELECT o_orderkey AS query, p_type AS type FROM orders JOIN (SELECT DISTINCT p_type, ascii(p_type) % 5 AS k FROM part) AS t ON k = o_orderkey % 5), s AS (SELECT parent AS type, child AS term FROM {class_tree}), y AS (SELECT DISTINCT p_type AS type, concat(lower(p_type), ' goods') AS term FROM part), r AS (SELECT DISTINCT p_type AS type, p_brand AS term FROM part WHERE p_size > 47 UNION SELECT DISTINCT p_type, lower(p_type) FROM part),
    u AS (SELECT query, type AS term, 0 AS place FROM q UNION ALL SELECT query, term, 1 FROM q JOIN s USING (type) UNION ALL SELECT query, term, 2 FROM q JOIN y USING (type) UNION ALL SELECT query, term, 3 FROM q JOIN r USING (type))
    SELECT query, min(place) AS place, arg_min(term, concat(place, term)) AS term FROM u GROUP BY query, lower(term)""")
def expanded_queries(spark, sf_dir):
    """Types with subclasses, synonyms and relations, each new one once."""
    part = view(spark, sf_dir, "part")
    types = part.select("p_type", (F.ascii("p_type") % 5).alias("k")).distinct()
    q = view(spark, sf_dir, "orders").join(types, F.col("k") == F.col("o_orderkey") % 5).select(F.col("o_orderkey").alias("query"), F.col("p_type").alias("type"))
    s = view(spark, sf_dir, "class_tree").select(F.col("parent").alias("type"), F.col("child").alias("term"))
    y = part.select(F.col("p_type").alias("type"), F.concat(F.lower("p_type"), F.lit(" goods")).alias("term")).distinct()
    r = part.where("p_size > 47").select(F.col("p_type").alias("type"), F.col("p_brand").alias("term")).union(part.select("p_type", F.lower("p_type"))).distinct()
    return search.expanded(q, s, y, r)


@query(None)
def linked_entities(spark, sf_dir):
    """Query terms linked to entities by fuzzy scores (fifteen a query are the feature)."""
    terms = view(spark, sf_dir, "part").select(F.col("p_size").cast("long").alias("query"), F.split_part("p_name", F.lit(" "), F.lit(2)).alias("term")).distinct()
    nodes = view(spark, sf_dir, "kg_nodes").select("id", "label", F.col("entity_type").alias("description"))
    return search.linked_entities(terms, nodes).select("query", "id", rounded("score"), "rank")


@query(None)
def three_tier_matches(spark, sf_dir):
    """Entities covered exactly, by fuzzy type, or by vector."""
    e = view(spark, sf_dir, "vectors")
    kind = F.when(F.col("id") % 5 == 0, "Facility").when(F.col("id") % 5 == 1, "Facilitys").when(F.col("id") % 5 == 2, "waste").otherwise("else")
    rows = e.select("id", F.concat(F.lit("e"), F.col("id").cast("string")).alias("label"), kind.alias("entity_type"), "embedding")
    classes = e.where("label = 3").select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("label"), "embedding").union(spark.createDataFrame([("facility", None), ("Waste", None)], "label string, embedding array<float>"))
    return matching.three_tiers(rows, classes)


@query("""WITH e AS (SELECT coalesce(nullif(CASE WHEN p_size % 10 = 0 THEN '' ELSE p_type END, ''), p_name) AS key, p_partkey AS seq, p_name AS label, p_size / 50.0e0 AS confidence FROM part)
    SELECT key AS entity_type, min_by(label, seq) AS representative_label, count(*) AS frequency, round(avg(confidence), 4) AS avg_confidence FROM e WHERE lower(key) NOT IN ('promo') GROUP BY key HAVING count(*) >= 3""")
def live_gaps(spark, sf_dir):
    """Gaps by type, or by label without one."""
    part = view(spark, sf_dir, "part")
    rows = part.select(F.col("p_partkey").alias("seq"), F.col("p_name").alias("label"), F.when(F.col("p_size") % 10 == 0, "").otherwise(F.col("p_type")).alias("entity_type"), (F.col("p_size") / 50.0).alias("confidence"))
    found = gaps.gap_candidates(gaps.keyed(rows), spark.createDataFrame([("Promo",)], "label string"))
    return found.select("entity_type", "representative_label", "frequency", rounded("avg_confidence"))


@query("""WITH g AS (SELECT p_brand AS entity_type, count(*) AS frequency FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, entity_type) AS n FROM g) SELECT printf('prop_%03d', n) AS id, entity_type, frequency FROM r WHERE n <= 30""")
def capped_proposals(spark, sf_dir):
    """thirty proposals at most (the cap is the feature)."""
    return search.capped_proposals(view(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("entity_type")).agg(F.count("*").alias("frequency")))


@query("""SELECT c_custkey AS id, c_mktsegment AS parent, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN concat('urn:class#', lower(c_mktsegment)) ELSE 'owl:Thing' END AS parent_uri FROM customer""")
def resolved_parents(spark, sf_dir):
    """A parent's label as the uri of its class."""
    classes = spark.createDataFrame([("urn:class#building", "Building"), ("urn:class#machinery", "machinery"), ("urn:z#building", "BUILDING")], "uri string, label string")
    return search.resolved_parents(view(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("parent")), classes)


@query("""SELECT o_custkey AS file, max_by(o_totalprice, o_orderkey) AS summary, count(*) - 1 AS matches FROM orders GROUP BY 1""")
def summary_rows(spark, sf_dir):
    """The last row of each file is its summary."""
    return search.last_rows(view(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), "o_orderkey", F.col("o_totalprice").alias("summary")), "file", "o_orderkey")


@query("""SELECT event_id AS id, event_id AS found, event_type AS kind FROM events""")
def json_replies(spark, sf_dir):
    """JSON blocks out of replies, with commas too many."""
    e = view(spark, sf_dir, "events")
    reply = F.concat(F.lit('Sure {not json} here: {"id": '), F.col("event_id").cast("string"), F.lit(', "kind": "'), "event_type", F.lit('", "more": {"a": "}",},} and then } some'))
    parsed = e.select(F.col("event_id").alias("id"), F.from_json(replies.json_block(reply), "id long, kind string").alias("r"))
    return parsed.select("id", F.col("r.id").alias("found"), F.col("r.kind").alias("kind"))


@query("""SELECT event_id AS id, CASE event_id % 4 WHEN 0 THEN upper(substr('abcd', CAST(event_id % 3 AS INTEGER) + 1, 1)) WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END ELSE concat('free ', event_type) END AS answer FROM events""")
def predictions(spark, sf_dir):
    """Answers by a task's type."""
    e = view(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("The answer: "), F.upper(F.substring(F.lit("abcd"), (F.col("event_id") % 3 + 1).cast("int"), F.lit(1))))).when(k == 1, F.when(F.col("user_id") % 2 == 0, "It is True.").otherwise("FALSE, not true")).otherwise(F.concat(F.lit("free "), "event_type"))
    task = F.when(k == 0, "choice").when(k == 1, "truth").otherwise("open")
    return e.select(F.col("event_id").alias("id"), replies.prediction(F.concat(F.lit("<think>maybe B</think> "), said), task).alias("answer"))


@query("""SELECT event_type AS kind, count(*) AS questions, round(avg(CASE WHEN event_id % 4 = user_id % 4 THEN 1 ELSE 0 END), 4) AS accuracy FROM events GROUP BY 1""")
def choice_accuracy(spark, sf_dir):
    """Right letters among answers."""
    letter = lambda c: F.substring(F.lit("ABCD"), (c % 4 + 1).cast("int"), F.lit(1))
    said = replies.prediction(F.concat(F.lit("Option "), letter(F.col("event_id")), F.lit(" it is")), F.lit("choice"))
    rows = view(spark, sf_dir, "events").select("event_type", (said == letter(F.col("user_id"))).alias("hit"))
    return rows.groupBy(F.col("event_type").alias("kind")).agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce("hit", F.lit(False)).cast("int")), 4).alias("accuracy"))


@query("""SELECT event_id AS id, CASE WHEN event_id % 2 = 0 THEN concat('value ', user_id) ELSE concat('last ', event_type) END AS answer FROM events""")
def final_answers(spark, sf_dir):
    """After the mark, else the last line."""
    e = view(spark, sf_dir, "events")
    said = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("some\nFinal answer: value "), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("first\nlast "), "event_type"))
    return e.select(F.col("event_id").alias("id"), text.final_answer(said).alias("answer"))


@query("""SELECT event_id AS id, CASE event_id % 3 WHEN 0 THEN concat('ASK { ?x a ', user_id, ' }') WHEN 1 THEN concat('PREFIX e: <x> ASK { e:', user_id, ' ?p ?o }') END AS ask FROM events""")
def ask_queries(spark, sf_dir):
    """ASK queries out of model texts."""
    e = view(spark, sf_dir, "events")
    k, u = F.col("event_id") % 3, F.col("user_id").cast("string")
    said = F.when(k == 0, F.concat(F.lit("Use this: ASK { ?x a "), u, F.lit(" } thanks"))).when(k == 1, F.concat(F.lit(" PREFIX e: <x> ASK { e:"), u, F.lit(" ?p ?o }"))).otherwise("no query")
    return e.select(F.col("event_id").alias("id"), replies.ask_query(said).alias("ask"))


@query("""SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 'xsd:integer' WHEN p_size % 3 = 1 THEN p_type END AS range, CASE WHEN p_size % 2 = 0 THEN 'object' ELSE 'datatype' END AS kind FROM part""")
def picked_ranges(spark, sf_dir):
    """One range of a list, one type of piped ones."""
    part = view(spark, sf_dir, "part")
    k = F.col("p_size") % 3
    ranges = F.when(k == 0, F.array("p_type", F.lit("xsd:integer"))).when(k == 1, F.array("p_type", F.lit("Other"))).otherwise(F.array().cast("array<string>"))
    return part.select(F.col("p_partkey").alias("id"), replies.picked_range(ranges).alias("range"), replies.picked_type(F.when(F.col("p_size") % 2 == 0, "Datatype | Object").otherwise("Datatype|literal")).alias("kind"))


@query("""WITH t AS (SELECT o_orderkey AS id, list(concat(l_linenumber, ',', l_partkey % 3) ORDER BY l_linenumber, l_partkey) AS p, list(concat(l_linenumber, ',', l_suppkey % 3) ORDER BY l_linenumber, l_partkey) AS e FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1),
    m AS (SELECT CAST(sum(list_sum(list_transform(list_zip(p, e), lambda x: CASE WHEN x[1] = x[2] THEN 1 ELSE 0 END))) AS BIGINT) AS matched, CAST(sum(len(p)) AS BIGINT) AS predicted, CAST(sum(len(e)) AS BIGINT) AS expected FROM t) SELECT matched, predicted, expected, round(matched / predicted, 4) AS precision, round(matched / expected, 4) AS recall, round(2.0 * matched / (predicted + expected), 4) AS f1 FROM m""")
def triple_f1(spark, sf_dir):
    """Tuples read out of texts, matched by position."""
    def said(c):
        item = F.struct("l_linenumber", "l_partkey", F.concat(F.lit("('"), F.col("l_linenumber").cast("string"), F.lit("', "), (F.col(c) % 3).cast("string"), F.lit(")")).alias("t"))
        return F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["t"]), " ; ")

    rows = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("l_orderkey").agg(said("l_partkey").alias("p"), said("l_suppkey").alias("e"))
    found = metrics.triple_f1(rows.select(text.tuples(F.col("p")).alias("predicted"), text.tuples(F.col("e")).alias("expected")))
    return found.select("matched", "predicted", "expected", rounded("precision"), rounded("recall"), rounded("f1"))


@query(None)
def generation_scores(spark, sf_dir):
    """ROUGE and BLEU of each turn against the next."""
    from pyspark.sql import Window

    rows = view(spark, sf_dir, "conversations").withColumn("next", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))).where("next is not null")
    scores = rows.select("conv_id", replies.generation_scores(F.col("text"), F.col("next")).alias("s"))
    return scores.groupBy("conv_id").agg(*[F.round(F.avg(F.col("s")[c]), 4).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l", "bleu")])


@query("""SELECT source AS split, lang, count(*) AS examples, min(doc_id) AS first FROM documents WHERE contains(source, '1') GROUP BY ALL""")
def split_sizes(spark, sf_dir):
    """Sizes of splits by part of their name."""
    return view(spark, sf_dir, "documents").where(F.contains("source", F.lit("1"))).groupBy(F.col("source").alias("split"), "lang").agg(F.count("*").alias("examples"), F.min("doc_id").alias("first"))


@query("""SELECT l_linenumber AS iteration, CASE WHEN l_linenumber <= 2 THEN 15 ELSE 10 END AS proposals FROM lineitem GROUP BY 1""")
def iteration_plan(spark, sf_dir):
    """Proposals of an iteration."""
    i = F.col("iteration")
    return view(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("iteration")).distinct().select("iteration", F.when(i <= 2, 15).otherwise(10).alias("proposals"))
