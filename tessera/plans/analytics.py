"""Debates, feedback, retrieval and statistics over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import debate, feedback, retrieval, stats
from tessera.plans.binding import view
from tessera.plans.registered import query, rounded


@query("""WITH d AS (SELECT proposal, max_by(decision, seq) AS decision, max(seq) AS seq FROM {decisions} GROUP BY proposal)
    SELECT p.id, p.label, p.parent, round(p.weight, 4) AS weight, d.seq FROM (SELECT * FROM {proposals}) AS p JOIN d ON p.id = d.proposal WHERE decision IN ('accept', 'accepted')""")
def accepted_latest(spark, sf_dir):
    """Proposals whose last decision accepts them."""
    found = feedback.accepted(view(spark, sf_dir, "proposals"), view(spark, sf_dir, "decisions"))
    return found.select("id", "label", "parent", rounded("weight"), "seq")


@query("SELECT id, label FROM {proposals} WHERE id NOT IN (SELECT proposal FROM {decisions})")
def pending_proposals(spark, sf_dir):
    """Not decided yet."""
    return feedback.pending(view(spark, sf_dir, "proposals"), view(spark, sf_dir, "decisions")).select("id", "label")


@query("""WITH b AS (SELECT proposal, count(*) AS n, count(DISTINCT decision) AS k FROM {decisions} GROUP BY proposal HAVING count(*) >= 2)
    SELECT count(*) AS proposals, round(avg(CASE WHEN k = 1 THEN 1 ELSE 0 END), 4) AS agreement FROM b""")
def reviewer_agreement(spark, sf_dir):
    """D11."""
    return feedback.reviewer_agreement(view(spark, sf_dir, "decisions")).select("proposals", rounded("agreement"))


@query("SELECT count(*) AS total, count_if(decision = 'accept') AS accept, count_if(decision = 'reject') AS reject, count_if(decision = 'revise') AS revise FROM {decisions}")
def review_status(spark, sf_dir):
    """D12."""
    return feedback.status(view(spark, sf_dir, "decisions"))


@query("SELECT element_type, count(*) AS n, round(avg(CASE WHEN decision = 'accepted' THEN 1 ELSE 0 END), 4) AS rate FROM {signals} GROUP BY element_type")
def acceptance_rate(spark, sf_dir):
    """D13, D27."""
    return feedback.acceptance(view(spark, sf_dir, "signals"), ["element_type"]).select("element_type", "n", rounded("rate"))


@query("""WITH r AS (SELECT element, seq, avg(CASE WHEN decision = 'accepted' THEN 1 ELSE 0 END) OVER (PARTITION BY element ORDER BY seq ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS rate,
    row_number() OVER (PARTITION BY element ORDER BY seq) AS n, count(*) OVER (PARTITION BY element) AS a FROM {signals})
    SELECT element, seq, round(rate, 4) AS rate FROM r WHERE n >= 5 OR (a < 5 AND n = a)""")
def acceptance_trend(spark, sf_dir):
    """Rolling acceptance of each element."""
    return feedback.acceptance_trend(view(spark, sf_dir, "signals"), "element").select("element", "seq", rounded("rate"))


@query("""WITH s AS (SELECT *, coalesce(nullif(substr(rationale, 1, 100), ''), 'unspecified') AS reason FROM {signals} WHERE decision = 'rejected'),
    r AS (SELECT *, row_number() OVER (PARTITION BY reason ORDER BY seq DESC) AS b FROM s)
    SELECT reason, count(*) AS n, string_agg(CASE WHEN b <= 3 THEN element END, '|' ORDER BY seq) AS examples FROM r GROUP BY reason""")
def rejection_reasons(spark, sf_dir):
    """D14."""
    return feedback.rejection_reasons(view(spark, sf_dir, "signals"))


@query("""WITH r AS (SELECT phase, seq, element, row_number() OVER (PARTITION BY phase ORDER BY seq DESC) AS nth FROM {signals} WHERE decision = 'accepted')
    SELECT phase, nth, seq, element FROM r WHERE nth <= 3""")
def recent_examples(spark, sf_dir):
    """The last accepted elements of each phase."""
    return feedback.recent_examples(view(spark, sf_dir, "signals"))


ITERATIONS = "WITH s AS (SELECT l_linenumber AS iteration, round(avg(l_quantity) / 100 + l_linenumber / 50.0e0, 6) AS value FROM lineitem GROUP BY l_linenumber)"


def iterations(spark, sf_dir):
    by = view(spark, sf_dir, "lineitem").groupBy(F.col("l_linenumber").alias("iteration")).agg(F.avg("l_quantity").alias("mean"))
    return by.select("iteration", F.round(F.col("mean") / 100 + F.col("iteration") / 50.0, 6).alias("value"))


@query(ITERATIONS + "SELECT iteration, round(value, 4) AS value, round(value - coalesce(lag(value) OVER (ORDER BY iteration), 0), 4) AS improvement FROM s")
def iteration_delta(spark, sf_dir):
    """E02."""
    return feedback.improvements(iterations(spark, sf_dir)).select("iteration", rounded("value"), rounded("improvement"))


@query(ITERATIONS + """, d AS (SELECT *, value - coalesce(lag(value) OVER (ORDER BY iteration), 0) AS i FROM s)
    SELECT count(*) AS iterations, round(min_by(value, iteration), 4) AS first_value, round(max_by(value, iteration), 4) AS last_value,
    round(max_by(value, iteration) - min_by(value, iteration), 4) AS delta, min(CASE WHEN i < 0.02 AND iteration > 1 THEN iteration END) AS converged_at, round(avg(i), 4) AS mean_improvement FROM d""")
def convergence_summary(spark, sf_dir):
    """D25, T40."""
    found = feedback.convergence(iterations(spark, sf_dir))
    return found.select("iterations", rounded("first_value"), rounded("last_value"), rounded("delta"), "converged_at", rounded("mean_improvement"))


@query("""WITH m AS (SELECT *, max(CASE WHEN message_type = 'proposal' THEN seq END) OVER (PARTITION BY debate) AS last FROM {messages}),
    a AS (SELECT *, message_type = 'review' AND seq > coalesce(last, -1) AS after_it FROM m)
    SELECT debate, count_if(after_it) AS reviews, coalesce(bool_and(coalesce(approves, false)) FILTER (after_it), false) AS consensus FROM a GROUP BY debate""")
def debate_consensus(spark, sf_dir):
    """E08, T31."""
    return debate.consensus(view(spark, sf_dir, "messages"))


@query("SELECT debate, max_by(reasoning, seq) AS proposal, max(seq) AS seq FROM {messages} WHERE message_type = 'proposal' GROUP BY debate")
def latest_proposals(spark, sf_dir):
    """E09."""
    return debate.latest_proposals(view(spark, sf_dir, "messages"))


@query("""WITH r AS (SELECT debate, seq, bool_and(coalesce(approves, false) AND issues = 0) OVER (PARTITION BY debate ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ok FROM {messages} WHERE message_type = 'review'),
    i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY debate ORDER BY seq) AS g FROM r), n AS (SELECT debate, g, count_if(ok) AS n FROM i GROUP BY debate, g)
    SELECT debate, max(n) AS longest FROM n GROUP BY debate""")
def echo_chambers(spark, sf_dir):
    """Most rounds on end of three reviews that approve and raise nothing."""
    return debate.echo_chambers(view(spark, sf_dir, "messages"))


@query("""WITH s AS (SELECT debate, seq, length(reasoning) AS n FROM {messages} WHERE message_type = 'proposal'),
    l AS (SELECT *, lag(n, 1) OVER (PARTITION BY debate ORDER BY seq) AS a, lag(n, 2) OVER (PARTITION BY debate ORDER BY seq) AS b FROM s)
    SELECT debate, coalesce(bool_or(n >= a AND a >= b), false) AS growing FROM l GROUP BY debate""")
def complexity_ratchet(spark, sf_dir):
    """Proposals that never get shorter."""
    return debate.growing_revisions(view(spark, sf_dir, "messages"))


@query("""WITH k AS (SELECT debate, count(approves) AS known, avg(CAST(approves AS INT)) AS m FROM {messages} GROUP BY debate)
    SELECT debate, known, round(m, 4) AS mean, coalesce(known >= 2 AND m >= 0.8, false) AS converged FROM k""")
def delphi_convergence(spark, sf_dir):
    """M07."""
    return debate.delphi(view(spark, sf_dir, "messages")).select("debate", "known", rounded("mean"), "converged")


@query("""WITH l AS (SELECT *, row_number() OVER (PARTITION BY debate ORDER BY seq DESC) AS b FROM {messages})
    SELECT debate, CASE WHEN coalesce(bool_and(approves) FILTER (b <= 3 AND message_type = 'review' AND approves IS NOT NULL), false) THEN 'CONSENSUS'
    WHEN count_if(message_type = 'proposal') > 1 THEN 'REVISED' ELSE 'ESCALATED' END AS outcome FROM l GROUP BY debate""")
def debate_outcomes(spark, sf_dir):
    """M06, T32."""
    return debate.outcomes(view(spark, sf_dir, "messages"))


ISSUES = """WITH i AS (SELECT DISTINCT conv_id AS debate, lower(w) AS issue FROM (SELECT conv_id, unnest(string_split(text, ' ')) AS w FROM conversations WHERE role = 'user') AS x WHERE length(w) > 3),
    s AS (SELECT conv_id AS debate, lower(text) AS said FROM conversations WHERE role = 'assistant'),
    u AS (SELECT debate, issue FROM i WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.debate = i.debate AND contains(said, issue)))"""


def issues(spark, sf_dir):
    rows = view(spark, sf_dir, "conversations")
    words = rows.where("role = 'user'").select(F.col("conv_id").alias("debate"), F.explode(F.split("text", " ")).alias("w"))
    raised = words.where("length(w) > 3").select("debate", F.lower("w").alias("issue")).distinct()
    return raised, rows.where("role = 'assistant'").select(F.col("conv_id").alias("debate"), F.col("text").alias("reasoning"))


@query(ISSUES + "SELECT * FROM u")
def unresolved_issues(spark, sf_dir):
    """Issues that no revision mentions."""
    return debate.unresolved(*issues(spark, sf_dir))


@query(ISSUES + """, r AS (SELECT debate, count(*) AS raised FROM i GROUP BY debate), o AS (SELECT debate, count(*) AS n FROM u GROUP BY debate)
    SELECT debate, raised, coalesce(n, 0) AS open, raised - coalesce(n, 0) AS resolved, CASE WHEN n IS NULL THEN 'REVISED' WHEN n < 3 THEN 'PARTIAL' ELSE 'ESCALATED' END AS verdict FROM r LEFT JOIN o USING (debate)""")
def debate_verdicts(spark, sf_dir):
    """M05."""
    return debate.verdicts(*issues(spark, sf_dir))


@query("""SELECT debate, count(*) AS messages, count_if(message_type = 'review') AS reviews, count_if(coalesce(approves, false)) AS approvals,
    round(coalesce(count_if(coalesce(approves, false)) / nullif(count_if(message_type = 'review'), 0), 0), 4) AS approval_rate FROM {messages} GROUP BY debate""")
def debate_health(spark, sf_dir):
    """D24, D28."""
    return debate.health(view(spark, sf_dir, "messages")).select("debate", "messages", "reviews", "approvals", rounded("approval_rate"))


@query("SELECT debate, string_agg(concat(role, ': ', substr(reasoning, 1, 500)), chr(10) ORDER BY seq) AS transcript FROM {messages} GROUP BY debate")
def debate_transcripts(spark, sf_dir):
    """X14."""
    return debate.transcripts(view(spark, sf_dir, "messages"))


@query("""WITH d AS (SELECT doc_id AS id, substr(text, 1, 200) AS k, n_chars, lang FROM documents), a AS (SELECT 'vector' AS source, row_number() OVER (ORDER BY n_chars DESC, id) AS rank, id, k FROM d WHERE lang = 'en'),
    b AS (SELECT 'graph' AS source, row_number() OVER (ORDER BY n_chars, id) AS rank, id, k FROM d),
    u AS (SELECT *, CASE source WHEN 'vector' THEN 0.4e0 ELSE 1.0e0 END AS w FROM (SELECT * FROM a UNION ALL SELECT * FROM b) AS x)
    SELECT round(sum(w / (60 + rank)), 8) AS score, arg_min(id, CASE source WHEN 'vector' THEN 0 ELSE 1000000000000 END + rank) AS id, count(*) AS lists FROM u GROUP BY k""")
def rrf_fusion(spark, sf_dir):
    """Two rankings of all documents fused by the first 200 characters, one list without a weight of its own."""
    docs = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.substring("text", 1, 200).alias("key"), "n_chars", "lang")
    a = retrieval.ranked(docs.where("lang = 'en'"), "vector", [F.col("n_chars").desc(), F.col("id")])
    b = retrieval.ranked(docs, "graph", [F.col("n_chars"), F.col("id")])
    return retrieval.reciprocal_rank_fusion(a.unionByName(b), {"vector": 0.4}).select(rounded("score", 8), "id", "lists")


@query("""WITH q AS (SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'causal' WHEN 1 THEN 'comparative' ELSE 'factoid' END AS t, o_orderkey % 2 AS n, o_orderkey % 9 AS m FROM orders),
    w AS (SELECT id, 0.4 + CASE WHEN t <> 'factoid' THEN 0.15 ELSE 0 END + CASE WHEN n > 0 THEN 0.05 ELSE -0.1 END + CASE WHEN m > 5 THEN 0.05 ELSE 0 END AS g,
    0.4 - CASE WHEN t <> 'factoid' THEN 0.1 ELSE 0 END + CASE WHEN n > 0 THEN 0 ELSE 0.15 END AS v FROM q)
    SELECT id, round(g / (g + v), 4) AS graph_weight, round(v / (g + v), 4) AS vector_weight FROM w""")
def adaptive_weights(spark, sf_dir):
    """J02."""
    kind = F.when(F.col("o_orderkey") % 3 == 0, "causal").when(F.col("o_orderkey") % 3 == 1, "comparative").otherwise("factoid")
    rows = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), kind.alias("question_type"), (F.col("o_orderkey") % 2).alias("n_entities"), (F.col("o_orderkey") % 9).alias("most_properties"))
    return retrieval.adaptive_weights(rows).select("id", rounded("graph_weight"), rounded("vector_weight"))


@query("""SELECT l_orderkey AS path_id, count(*) AS length, round(least(greatest(0.4 * avg(1 - l_discount) + 0.45 * avg(CASE WHEN contains(lower(p_type), 'large') OR contains(lower(p_type), 'promo') THEN 1 ELSE 0 END)
    + 0.15 / count(*), 0), 1), 4) AS score FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey""")
def path_scores(spark, sf_dir):
    """J04, J05, T48."""
    rows = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    relations = rows.select(F.col("l_orderkey").alias("path_id"), F.col("p_type").alias("rel"), (1 - F.col("l_discount")).alias("confidence"))
    return retrieval.path_scores(relations, ["LARGE", "PROMO"]).select("path_id", "length", rounded("score"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS turn, min(doc_id) OVER (PARTITION BY source) AS f FROM documents)
    SELECT source, doc_id, turn FROM r ORDER BY turn, f, doc_id LIMIT 100""")
def diverse_sample(spark, sf_dir):
    """A hundred documents, sources in turn (the limit is the feature)."""
    return retrieval.round_robin(view(spark, sf_dir, "documents").select("source", "doc_id"), "source", "doc_id", 100)


@query("""WITH r AS (SELECT doc_id AS id, text, n_chars AS score, row_number() OVER (PARTITION BY substr(text, 1, 150) ORDER BY doc_id) AS n FROM documents)
    SELECT id, score FROM r WHERE n = 1 ORDER BY score DESC, id LIMIT 25""")
def evidence_final(spark, sf_dir):
    """One text a prefix, the best twenty-five (the limit is the feature)."""
    rows = view(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "text", F.col("n_chars").alias("score"))
    return retrieval.evidence(rows).select("id", "score")


@query("""SELECT system, level, count(*) AS n, round(avg(semantic), 4) AS semantic, round(avg(hallucination), 4) AS hallucination, round(avg(coverage), 4) AS coverage
    FROM {results} GROUP BY GROUPING SETS ((system), (system, level))""")
def master_table(spark, sf_dir):
    """Means by system and by level in one pass."""
    return stats.master_table(view(spark, sf_dir, "results")).select("system", "level", "n", rounded("semantic"), rounded("hallucination"), rounded("coverage"))


MEANS = """WITH u AS (SELECT system, 'semantic' AS metric, semantic AS value FROM {results} UNION ALL SELECT system, 'hallucination', hallucination FROM {results} UNION ALL SELECT system, 'coverage', coverage FROM {results}),
    m AS (SELECT metric, system, avg(value) AS mean FROM u GROUP BY metric, system)"""


@query(MEANS + """, r AS (SELECT metric, system, round(mean, 6) AS mean, row_number() OVER (PARTITION BY metric ORDER BY CASE metric WHEN 'hallucination' THEN -round(mean, 6) ELSE round(mean, 6) END DESC, system) AS n FROM m)
    SELECT metric, system, mean FROM r WHERE n = 1""")
def ranking_table(spark, sf_dir):
    """The best system by metric."""
    return stats.ranking(view(spark, sf_dir, "results"))


@query(MEANS + """SELECT m.metric, m.system, round((m.mean - b.mean) * CASE m.metric WHEN 'hallucination' THEN -1 ELSE 1 END, 4) AS delta
    FROM m JOIN m AS b ON m.metric = b.metric AND b.system = 'NO' WHERE m.system <> 'NO'""")
def delta_table(spark, sf_dir):
    """Differences to one system."""
    return stats.deltas(view(spark, sf_dir, "results"), "NO").select("metric", "system", rounded("delta"))


PAIRS = """WITH u AS (SELECT system, test_case, level, 'semantic' AS metric, semantic AS value FROM {results} UNION ALL SELECT system, test_case, level, 'hallucination', hallucination FROM {results}
    UNION ALL SELECT system, test_case, level, 'coverage', coverage FROM {results}), q AS (SELECT a.metric, a.value AS a, b.value AS b FROM u AS a JOIN u AS b USING (metric, test_case, level) WHERE a.system = 'RF' AND b.system = 'NO')"""


@query(PAIRS + """SELECT metric, count(*) AS n, round(avg(a - b), 4) AS mean_difference, round(avg(a - b) / (stddev_samp(a - b) / sqrt(count(*))), 4) AS t,
    round(avg(a - b) / sqrt((var_samp(a) + var_samp(b)) / 2), 4) AS cohens_d FROM q GROUP BY metric""")
def paired_statistics(spark, sf_dir):
    """Paired t and effect size."""
    found = stats.paired_statistics(stats.paired(view(spark, sf_dir, "results"), "RF", "NO"))
    return found.select("metric", "n", rounded("mean_difference"), rounded("t"), rounded("cohens_d"))


@query(PAIRS.replace("a.value AS a, b.value AS b", "test_case * 10 + CAST(substr(level, 2, 1) AS BIGINT) AS pair, a.value AS a, b.value AS b") + """, x AS (SELECT metric, resample, a - b AS d, (pair * 48271 + resample * 69621 + 42) % 2147483647 AS x FROM q, (SELECT unnest(range(1, 10001)) AS resample) AS r),
    y AS (SELECT metric, resample, d, (x * x + 12345) % 2147483647 AS y FROM x), z AS (SELECT metric, resample, d, ((y * y + resample) % 2147483647) / 2147483647.0e0 AS u FROM y),
    w AS (SELECT metric, resample, d, CAST(u >= 0.3678794412e0 AS INT) + CAST(u >= 0.7357588823e0 AS INT) + CAST(u >= 0.9196986029e0 AS INT) + CAST(u >= 0.9810118431e0 AS INT) + CAST(u >= 0.9963401532e0 AS INT) + CAST(u >= 0.9994058152e0 AS INT) AS w FROM z),
    m AS (SELECT metric, sum(w * d) / sum(w) AS mean FROM w GROUP BY metric, resample) SELECT metric, round(quantile_cont(mean, 0.025), 4) AS low, round(quantile_cont(mean, 0.975), 4) AS high FROM m GROUP BY metric""")
def bootstrap_interval(spark, sf_dir):
    """Poisson bootstrap of the mean difference, 10,000 resamples."""
    pair = F.col("test_case") * 10 + F.substring("level", 2, 1).cast("long")
    return stats.bootstrap(stats.paired(view(spark, sf_dir, "results"), "RF", "NO").withColumn("pair", pair)).select("metric", rounded("low"), rounded("high"))


@query("""SELECT system, round(avg(CASE WHEN level = 'L0' THEN semantic END), 4) AS "L0", round(avg(CASE WHEN level = 'L1' THEN semantic END), 4) AS "L1",
    round(avg(CASE WHEN level = 'L2' THEN semantic END), 4) AS "L2", round(avg(CASE WHEN level = 'L3' THEN semantic END), 4) AS "L3" FROM {results} GROUP BY system""")
def difficulty_curve(spark, sf_dir):
    """N06, N07."""
    return stats.difficulty_curve(view(spark, sf_dir, "results"), "semantic", ["L0", "L1", "L2", "L3"]).select("system", *[rounded(x) for x in ("L0", "L1", "L2", "L3")])
