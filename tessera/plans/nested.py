"""Nested replies, long lists in pages and overlap of texts over the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions import replies, stemming
from tessera.operators import gaps, overlap, pages, tool_replies
from tessera.plans.binding import view
from tessera.plans.registered import query, rounded


def text_of(prefix: str, column: str):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def listed(*columns):
    """A group's structs in order."""
    return F.array_sort(F.collect_list(F.struct(*columns)))


def path_replies(spark, sf_dir):
    o, p, s = text_of("o:", "l_orderkey"), text_of("p:", "l_partkey"), text_of("s:", "l_suppkey")
    edge = lambda a, b, kind: F.struct(a.alias("src"), b.alias("tgt"), kind.alias("type"))
    path = F.struct(
        F.array(o, p, s).alias("nodes"), F.create_map(p, text_of("part ", "l_partkey")).alias("node_labels"),
        F.array(edge(o, p, F.col("l_returnflag")), edge(p, s, F.lit("SUPPLIED_BY"))).alias("edges"), F.concat_ws(" > ", o, p, s).alias("chain"),
    )
    rows = view(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_json(path).alias("path"))
    held = F.array_join(F.transform(listed("l_linenumber", "l_partkey", "l_suppkey", "path"), lambda x: x["path"]), ",")
    reply = F.concat(F.lit('{"source": "o:'), F.col("l_orderkey").cast("string"), F.lit('", "target": "all", "paths": ['), held, F.lit(', "no object"]}'))
    return rows.groupBy("l_orderkey").agg(reply.alias("reply")).withColumnRenamed("l_orderkey", "query")


PATHS = """WITH n AS (SELECT l_orderkey AS query, concat('o:', l_orderkey) AS o, concat('p:', l_partkey) AS p, concat('s:', l_suppkey) AS s, l_partkey, l_returnflag AS kind,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS nth FROM lineitem)"""


@query(PATHS + """ SELECT query, nth, md5(concat('FACT CHAIN (', o, ' -> all, path ', nth + 1, '):', chr(10), '  ', o, ' > ', p, ' > ', s, chr(10), '  Nodes: ', o, ' (', o, '), ', p, ' (part ', l_partkey, '), ', s, ' (', s, ')', chr(10),
    '  TRIPLE: [', o, '] -[', kind, ']-> [', p, ']', chr(10), '  TRIPLE: [', p, '] -[SUPPLIED_BY]-> [', s, ']', chr(10))) AS digest, round(0.95e0 - 0.02e0 * nth, 4) AS score FROM n""")
def fact_chains(spark, sf_dir):
    """Paths of a tool's reply as fact chains; what is no object is dropped."""
    return tool_replies.fact_chains(path_replies(spark, sf_dir)).select("query", "nth", F.md5("text").alias("digest"), rounded("score"))


@query(PATHS + """ SELECT query, count(*) AS n_chains, md5(concat('GRAPH REASONING — Verified fact chains from knowledge graph:', chr(10), string_agg(concat(chr(10), '  Chain ', nth + 1, ': ', o, ' -> all', chr(10), '    Path: ', o, ' > ', p, ' > ', s, chr(10),
    '    GROUNDED TRIPLE: [', o, '] -[', kind, ']-> [', p, ']', chr(10), '    GROUNDED TRIPLE: [', p, '] -[SUPPLIED_BY]-> [', s, ']', chr(10), '    Labels: ', p, '=part ', l_partkey), chr(10) ORDER BY nth))) AS digest, 0.98e0 AS score FROM n GROUP BY query""")
def chain_summaries(spark, sf_dir):
    """One summary of a query's fact chains."""
    return tool_replies.chain_summaries(tool_replies.fact_chains(path_replies(spark, sf_dir))).select("query", "n_chains", F.md5("text").alias("digest"), "score")


@query(PATHS + """ SELECT DISTINCT query, src, type, tgt FROM (SELECT query, o AS src, kind AS type, p AS tgt FROM n UNION ALL SELECT query, p, 'SUPPLIED_BY', s FROM n) AS r""")
def chain_relations(spark, sf_dir):
    """Relations that fact chains are made of."""
    return tool_replies.chain_relations(tool_replies.fact_chains(path_replies(spark, sf_dir)))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders),
    g AS (SELECT o_custkey, count(*) AS n, string_agg(CASE WHEN nth <= 15 THEN concat(chr(10), '  [', o_orderstatus, '] o:', o_orderkey, ': ', o_orderpriority) END, '' ORDER BY nth) AS e,
      string_agg(CASE WHEN nth <= 20 THEN concat(chr(10), '  c:', o_custkey, ' -[PLACED]-> o:', o_orderkey) END, '' ORDER BY nth) AS r FROM o GROUP BY o_custkey)
    SELECT o_custkey AS query, CASE WHEN o_custkey % 7 = 0 THEN 0.6e0 ELSE 0.85e0 END AS score, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE n END AS n_entities, CASE WHEN o_custkey % 7 = 0 THEN 0 ELSE n END AS n_relations,
      md5(CASE WHEN o_custkey % 7 = 0 THEN concat('about ', o_custkey) ELSE concat('Neighborhood of ''c:', o_custkey, ''' (1-hop):', chr(10), 'Entities (', n, '):', e, chr(10), 'Relations (', n, '):', r) END) AS digest FROM g""")
def neighbourhood_contexts(spark, sf_dir):
    """An explored entity's neighbourhood as a context; its first lines are the feature."""
    c, o = text_of("c:", "o_custkey"), text_of("o:", "o_orderkey")
    rows = view(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", F.struct(o.alias("id"), F.col("o_orderpriority").alias("label"), F.col("o_orderstatus").alias("type")).alias("entity"),
        F.struct(c.alias("src"), o.alias("tgt"), F.lit("PLACED").alias("type")).alias("relation"),
    )
    grouped = rows.groupBy("o_custkey").agg(listed("o_orderkey", "entity", "relation").alias("all"))
    part = lambda name: F.transform("all", lambda x: x[name]).alias(f"{name[:-1]}ies" if name == "entity" else "relations")
    sound = F.to_json(F.struct(part("entity"), part("relation")))
    reply = F.when(F.col("o_custkey") % 7 == 0, text_of("about ", "o_custkey")).otherwise(sound)
    found = tool_replies.neighbourhoods(grouped.select(F.col("o_custkey").alias("query"), c.alias("entity"), reply.alias("reply")))
    return found.select("query", "score", "n_entities", "n_relations", F.md5("text").alias("digest"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey END AS classes_added_total, CASE WHEN o_orderkey % 5 > 0 THEN round(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END, 4) END AS cq_coverage_final,
    CASE WHEN o_orderkey % 5 > 0 THEN 0.0e0 END AS entity_coverage_final, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey END AS new_classes, CASE WHEN o_orderkey % 2 = 0 THEN 0.0e0 END AS cq_coverage_pct FROM orders""")
def report_metrics(spark, sf_dir):
    """Metrics out of nested reports; what a report lacks, or holds as another kind, counts 0."""
    k = F.col("o_orderkey")
    final = F.struct(F.col("o_totalprice").cast("double").alias("final"))
    summary = F.struct(F.col("o_custkey").alias("classes_added_total"), F.when(k % 3 > 0, final).alias("cq_coverage"), F.lit("no object").alias("entity_coverage"))
    report = F.when(k % 5 > 0, F.to_json(F.struct(summary.alias("summary")))).otherwise("{broken")
    rows = view(spark, sf_dir, "orders").select(k.alias("id"), report.alias("convergence"), F.when(k % 2 == 0, F.to_json(F.struct(F.col("o_custkey").alias("new_classes_count")))).alias("iteration"))
    return tool_replies.report_metrics(rows).select("id", "classes_added_total", rounded("cq_coverage_final"), "entity_coverage_final", "new_classes", "cq_coverage_pct")


@query("""WITH m AS (SELECT entity_type, seq, label, row_number() OVER (PARTITION BY entity_type ORDER BY seq) AS nth FROM {entities})
    SELECT entity_type, (nth - 1) // 100 AS page, count(CASE WHEN nth > 1 THEN 1 END) AS aliases, md5(coalesce(string_agg(CASE WHEN nth > 1 THEN label END, '|' ORDER BY nth), '')) AS digest FROM m GROUP BY ALL""")
def alias_pages(spark, sf_dir):
    """All aliases of each type, in pages."""
    found = gaps.aliases(view(spark, sf_dir, "entities"), 100)
    return found.select("entity_type", "page", F.size("aliases").alias("aliases"), F.md5(F.array_join("aliases", "|")).alias("digest"))


@query("""WITH d AS (SELECT DISTINCT o_orderpriority AS kind, o_custkey AS item FROM orders), n AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY item) AS nth FROM d)
    SELECT kind, (nth - 1) // 100 AS page, count(*) AS n, min(item) AS first, max(item) AS last, sum(item)::BIGINT AS total FROM n GROUP BY ALL""")
def document_pages(spark, sf_dir):
    """Distinct documents of each type, sorted, in pages."""
    found = pages.distinct_pages(view(spark, sf_dir, "orders").withColumnsRenamed({"o_orderpriority": "kind", "o_custkey": "item"}), "kind", "item", 100)
    total = F.aggregate("items", F.lit(0).cast("long"), lambda t, x: t + x)
    return found.select("kind", "page", F.size("items").alias("n"), F.array_min("items").alias("first"), F.array_max("items").alias("last"), total.alias("total"))


def turns(spark, sf_dir):
    """Each turn with the next one of its conversation."""
    after = F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn"))
    return view(spark, sf_dir, "conversations").withColumn("next", after).where("next is not null")


@query("""WITH t AS (SELECT concat(conv_id, ':', turn) AS id, text AS a, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations),
    w AS (SELECT id, regexp_extract_all(lower(a), '[a-z0-9]+') AS a, regexp_extract_all(lower(b), '[a-z0-9]+') AS b FROM t WHERE b IS NOT NULL),
    g AS (SELECT 1 AS n, id, unnest(a) AS gram, 1 AS x, 0 AS y FROM w UNION ALL SELECT 1, id, unnest(b), 0, 1 FROM w
      UNION ALL SELECT 2, id, concat(z[1], ' ', z[2]), 1, 0 FROM (SELECT id, unnest(list_zip(a[1:len(a) - 1], a[2:])) AS z FROM w WHERE len(a) > 1) AS p
      UNION ALL SELECT 2, id, concat(z[1], ' ', z[2]), 0, 1 FROM (SELECT id, unnest(list_zip(b[1:len(b) - 1], b[2:])) AS z FROM w WHERE len(b) > 1) AS q),
    c AS (SELECT n, id, gram, sum(x) AS x, sum(y) AS y FROM g GROUP BY ALL), s AS (SELECT n, id, sum(least(x, y)) AS hits, sum(x) AS xs, sum(y) AS ys FROM c GROUP BY ALL)
    SELECT k.n, w.id, coalesce(hits, 0)::BIGINT AS hits, coalesce(xs, 0)::BIGINT AS candidates, coalesce(ys, 0)::BIGINT AS refs, CASE WHEN coalesce(hits, 0) = 0 THEN 0.0e0 ELSE round(2.0e0 * hits / (xs + ys), 4) END AS f1
    FROM w CROSS JOIN (SELECT unnest([1, 2]) AS n) AS k LEFT JOIN s ON s.id = w.id AND s.n = k.n""")
def rouge_overlap(spark, sf_dir):
    """ROUGE-1 and ROUGE-2 of each turn against the next, counted as rows."""
    rows = turns(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("id"), stemming.word_list(F.col("text")).alias("candidate"), stemming.word_list(F.col("next")).alias("reference"))
    one = lambda n: overlap.rouge(rows, n).withColumn("n", F.lit(n))
    return one(1).union(one(2)).select("n", "id", "hits", "candidates", F.col("references").alias("refs"), rounded("f1"))


@query(None)
def stemmed_scores(spark, sf_dir):
    """ROUGE over stems, and BLEU, of each turn against the next."""
    scores = turns(spark, sf_dir).select("conv_id", replies.generation_scores(F.col("text"), F.col("next"), stemmed=True).alias("s"))
    return scores.groupBy("conv_id").agg(*[F.round(F.avg(F.col("s")[c]), 4).alias(c) for c in ("rouge_1", "rouge_2", "rouge_l", "bleu")])
