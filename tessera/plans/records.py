"""Records of runs over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import debate, graph, matching, records, stats
from tessera.plans.binding import view
from tessera.plans.graphs import HOPS, seeds
from tessera.plans.registered import query, rounded


@query("""WITH RECURSIVE u AS (SELECT child, min(parent) AS parent FROM {class_tree} GROUP BY child), r(node, path, depth) AS (SELECT DISTINCT parent, parent, 0 FROM u WHERE parent NOT IN (SELECT child FROM u)
    UNION ALL SELECT child, concat(path, ' / ', child), depth + 1 FROM r JOIN u ON u.parent = r.node) SELECT path, concat(repeat('  ', depth), '- ', node) AS line FROM r""")
def tbox_tree(spark, sf_dir):
    """The class tree as indented lines."""
    return records.tree_lines(view(spark, sf_dir, "class_tree"))


VOTES = """WITH v AS (SELECT c_custkey AS label, 'llm' AS strategy, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_mktsegment END AS parent, CASE WHEN c_custkey % 9 = 0 THEN 0.0e0 ELSE 0.8e0 END AS confidence FROM customer UNION ALL
    SELECT c_custkey, 'embedding', CASE WHEN c_nationkey % 2 = 0 THEN 'BUILDING' ELSE c_mktsegment END, c_nationkey / 25.0e0 FROM customer UNION ALL SELECT c_custkey, 'cooccurrence', 'MACHINERY', 0.5e0 FROM customer WHERE c_custkey % 2 = 0)"""


def put_together(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    key = F.col("c_custkey")
    vote = lambda df, parent, confidence: df.select(key.alias("label"), parent.alias("parent"), confidence.alias("confidence"))
    return records.all_votes(
        vote(c, F.when(key % 9 != 0, F.col("c_mktsegment")), F.lit(0.8)), vote(c, F.when(F.col("c_nationkey") % 2 == 0, "BUILDING").otherwise(F.col("c_mktsegment")), F.col("c_nationkey") / 25.0), vote(c.where("c_custkey % 2 = 0"), F.lit("MACHINERY"), F.lit(0.5))
    )


@query(VOTES + "SELECT label, strategy, parent, round(confidence, 4) AS confidence FROM v")
def vote_union(spark, sf_dir):
    """Three strategies' votes as one table."""
    return put_together(spark, sf_dir).select("label", "strategy", "parent", rounded("confidence"))


@query(VOTES + """, s AS (SELECT label, parent, sum(CASE strategy WHEN 'llm' THEN 0.5e0 WHEN 'embedding' THEN 0.3e0 ELSE 0.2e0 END * confidence) AS score, count(*) AS n FROM v WHERE parent IS NOT NULL GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 8) DESC, parent) AS k FROM s) SELECT r.label, parent, round(score, 4) AS confidence, round(n / (SELECT count(*) FROM v WHERE v.label = r.label), 4) AS agreement FROM r WHERE k = 1""")
def vote_outcome(spark, sf_dir):
    """The parent that these votes choose."""
    return matching.weighted_votes(put_together(spark, sf_dir), {"llm": 0.5, "embedding": 0.3, "cooccurrence": 0.2}).select("label", "parent", rounded("confidence"), rounded("agreement"))


@query("""SELECT o_orderkey AS query, CASE WHEN o_custkey % 4 = 0 THEN 'NONE' WHEN o_orderkey % 4 = 0 THEN CASE WHEN o_custkey % 6 <= 3 THEN 'SUBGRAPH' ELSE 'PPR' END WHEN o_orderkey % 4 = 1 THEN CASE WHEN o_custkey % 4 < 2 THEN 'SUBGRAPH' ELSE 'PATH' END WHEN o_orderkey % 4 = 2 THEN 'PPR' ELSE 'SUBGRAPH' END AS mode FROM orders""")
def retrieval_modes(spark, sf_dir):
    """How a query searches the graph."""
    modes = F.array(*map(F.lit, ("AUTO", "PATH", "PPR", "SUBGRAPH")))
    rows = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), (F.col("o_custkey") % 6).alias("terms"), (F.col("o_custkey") % 4).alias("ids"), F.element_at(modes, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("mode"))
    return records.retrieval_mode(rows)


@query("""SELECT o_orderkey AS query, CASE o_orderkey % 5 WHEN 0 THEN 'Cause, then effect' WHEN 1 THEN 'Side by side' WHEN 2 THEN 'Items' WHEN 3 THEN 'Yes or no, with a reason' ELSE 'Short answer' END AS template FROM orders""")
def answer_templates(spark, sf_dir):
    """An answer's layout by question type."""
    kinds = F.array(*map(F.lit, ("causal", "comparative", "list", "boolean", "factoid")))
    return records.answer_template(view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("question_type")))


@query("""WITH u AS (SELECT system, 'semantic' AS metric, semantic AS value FROM {results} UNION ALL SELECT system, 'hallucination', CASE WHEN system <> 'NO' THEN hallucination END FROM {results} UNION ALL SELECT system, 'cq', coverage FROM {results})
    SELECT system, round(coalesce(avg(CASE metric WHEN 'semantic' THEN value END), 0), 4) AS semantic, round(coalesce(avg(CASE metric WHEN 'hallucination' THEN value END), 1), 4) AS hallucination, round(coalesce(avg(CASE metric WHEN 'cq' THEN value END), 0), 4) AS cq,
    0.0e0 AS hierarchy, 0.0e0 AS domain, 0.0e0 AS expert FROM u GROUP BY system""")
def six_dimensions(spark, sf_dir):
    """Six metrics of each system, with defaults where one failed."""
    r = view(spark, sf_dir, "results").withColumn("hallucination", F.when(F.col("system") != "NO", F.col("hallucination")))
    rows = stats.unpivoted(r.select("system", "semantic", "hallucination", F.col("coverage").alias("cq")), ("semantic", "hallucination", "cq"))
    return records.six_dimensions(rows).select("system", *[rounded(m) for m in records.DIMENSIONS])


@query(HOPS + ", r AS (SELECT hop AS query, id, row_number() OVER (PARTITION BY hop ORDER BY id) AS n FROM f) SELECT query, count(*) AS nodes, string_agg(CASE WHEN n <= 10 THEN id END, '|' ORDER BY id) AS ids, 0.9e0 AS score FROM r GROUP BY query")
def graph_contexts(spark, sf_dir):
    """What a graph search found as one context (ten ids are the feature)."""
    found = graph.hops(view(spark, sf_dir, "kg_edges"), seeds(spark), 3).select(F.col("hop").alias("query"), "id", F.col("id").alias("text"))
    return records.graph_context(found)


@query("""WITH k AS (SELECT p_type AS label, concat('urn:x#', p_brand) AS uri, row_number() OVER (PARTITION BY p_type ORDER BY p_brand) AS rank FROM (SELECT DISTINCT p_type, p_brand FROM part) AS x) SELECT label, uri, rank FROM k WHERE rank <= 3 AND label <> 'PROMO'""")
def external_candidates(spark, sf_dir):
    """The first three candidates of a search (the limit is the feature)."""
    from pyspark.sql import Window

    part = view(spark, sf_dir, "part")
    known = part.select("p_type", "p_brand").distinct().select(F.col("p_type").alias("label"), F.concat(F.lit("urn:x#"), "p_brand").alias("uri"), F.row_number().over(Window.partitionBy("p_type").orderBy("p_brand")).alias("rank"))
    return records.external_candidates(part.where("p_type <> 'PROMO'").select(F.col("p_type").alias("label")), known)


@query("""SELECT DISTINCT p_size % 4 AS level, concat('urn:x#', replace(p_brand, '#', ''), 'Part') AS uri, concat('This text is about ', lower(regexp_replace(concat(replace(p_brand, '#', ''), 'Part'), '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '.') AS text FROM part""")
def fallback_corpus(spark, sf_dir):
    """Sentences from removed names."""
    uri = F.concat(F.lit("urn:x#"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit("Part"))
    return records.fallback_corpus(view(spark, sf_dir, "part").select((F.col("p_size") % 4).alias("level"), uri.alias("uri")).distinct())


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY debate ORDER BY seq DESC) AS b FROM {messages}), o AS (SELECT debate, CASE WHEN coalesce(bool_and(approves) FILTER (b <= 3 AND message_type = 'review' AND approves IS NOT NULL), false) THEN 'consensus' WHEN count_if(message_type = 'proposal') > 1 THEN 'revised' ELSE 'escalated' END AS outcome FROM l GROUP BY debate),
    p AS (SELECT debate, max_by(reasoning, seq) AS proposal FROM l WHERE message_type = 'proposal' GROUP BY debate) SELECT o.debate, outcome, md5(substr(proposal, 1, 500)) AS excerpt, length(proposal) AS length FROM o JOIN p USING (debate)""")
def outcome_records(spark, sf_dir):
    """Outcomes with excerpts of 500 characters (the feature)."""
    m = view(spark, sf_dir, "messages")
    rows = debate.outcomes(m).join(debate.latest_proposals(m), "debate").withColumn("verdict", F.lit(None).cast("string"))
    return records.outcome_record(rows).select("debate", "outcome", F.md5("excerpt").alias("excerpt"), "length")


@query("""WITH p AS (SELECT DISTINCT p_type AS label, p_brand AS name, 'string' AS kind, p_size > 48 AS required FROM part WHERE p_size > 45 AND p_type <> 'LARGE') SELECT * FROM p UNION ALL SELECT label, name, 'string', required FROM (SELECT DISTINCT p_type AS label FROM part) AS c,
    (SELECT unnest(['label', 'description']) AS name, unnest([true, false]) AS required) AS d WHERE label NOT IN (SELECT label FROM p)""")
def default_properties(spark, sf_dir):
    """Properties of classes that were given none."""
    part = view(spark, sf_dir, "part")
    own = part.where("p_size > 45 and p_type <> 'LARGE'").select(F.col("p_type").alias("label"), F.col("p_brand").alias("name"), F.lit("string").alias("kind"), (F.col("p_size") > 48).alias("required")).distinct()
    return records.with_default_properties(part.select(F.col("p_type").alias("label")), own)
