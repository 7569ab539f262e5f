"""Grounding, drift, questions and evidence over the bound tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import reviews
from tessera.plans.binding import view
from tessera.plans.registered import query, rounded

ELEMENTS = """WITH x AS (SELECT p_partkey % 100 AS proposal, p_name AS name, p_brand AS parent, p_size > 6 AS cited, p_size < 42 AS serves FROM part),
    s AS (SELECT DISTINCT p_brand AS label FROM part WHERE p_brand LIKE 'Brand#1%'),
    y AS (SELECT *, EXISTS (SELECT 1 FROM s WHERE contains(parent, label)) AS connected FROM x),
    g AS (SELECT proposal, count(*) AS elements, count_if(cited) / count(*) AS grounding, count_if(serves) / count(*) AS serving, count_if(connected) / count(*) AS connectivity FROM y GROUP BY proposal)"""


def grounded(spark, sf_dir):
    part = view(spark, sf_dir, "part")
    rows = part.select((F.col("p_partkey") % 100).alias("proposal"), F.col("p_name").alias("name"), F.col("p_brand").alias("parent"), (F.col("p_size") > 6).alias("cited"), (F.col("p_size") < 42).alias("serves"))
    return reviews.grounding(rows, part.where("p_brand like 'Brand#1%'").select(F.col("p_brand").alias("label")).distinct())


@query(ELEMENTS + """, u AS (SELECT DISTINCT proposal, name FROM y WHERE NOT cited), v AS (SELECT proposal, string_agg(name, '|' ORDER BY name) AS ungrounded FROM (SELECT *, row_number() OVER (PARTITION BY proposal ORDER BY name) AS n FROM u) AS a WHERE n <= 5 GROUP BY proposal),
    o AS (SELECT DISTINCT proposal, name FROM y WHERE NOT connected), w AS (SELECT proposal, string_agg(name, '|' ORDER BY name) AS orphans FROM (SELECT *, row_number() OVER (PARTITION BY proposal ORDER BY name) AS n FROM o) AS a WHERE n <= 5 GROUP BY proposal)
    SELECT proposal, elements, round(grounding, 4) AS grounding, round(serving, 4) AS serving, round(connectivity, 4) AS connectivity, coalesce(ungrounded, '') AS ungrounded, coalesce(orphans, '') AS orphans,
    grounding >= 0.85 AND serving >= 0.8 AND connectivity >= 0.9 AS healthy FROM g LEFT JOIN v USING (proposal) LEFT JOIN w USING (proposal)""")
def grounding_report(spark, sf_dir):
    """Cited, serving and connected shares of each proposal (five names are the feature)."""
    return grounded(spark, sf_dir).select("proposal", "elements", rounded("grounding"), rounded("serving"), rounded("connectivity"), "ungrounded", "orphans", "healthy")


DRIFT = ELEMENTS + """, m AS (SELECT * FROM {messages}), r AS (SELECT debate, seq, bool_and(coalesce(approves, false) AND issues = 0) OVER (PARTITION BY debate ORDER BY seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS ok FROM m WHERE message_type = 'review'),
    i AS (SELECT *, sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY debate ORDER BY seq) AS island FROM r), e AS (SELECT debate, max(n) AS longest FROM (SELECT debate, island, count_if(ok) AS n FROM i GROUP BY debate, island) AS q GROUP BY debate),
    z AS (SELECT debate, seq, length(reasoning) AS n FROM m WHERE message_type = 'proposal'), l AS (SELECT *, lag(n, 1) OVER (PARTITION BY debate ORDER BY seq) AS a, lag(n, 2) OVER (PARTITION BY debate ORDER BY seq) AS b FROM z),
    k AS (SELECT debate, coalesce(bool_or(n >= a AND a >= b), false) AS ratchet FROM l GROUP BY debate),
    f AS (SELECT k.debate, coalesce(grounding < 0.85, false) AS hallucination_spiral, ratchet AS complexity_ratchet, coalesce(connectivity < 0.6, false) AS conceptual_drift, coalesce(longest >= 2, false) AS echo_chamber,
          coalesce(serving < 0.8, false) AS scope_creep FROM k LEFT JOIN e ON e.debate = k.debate LEFT JOIN g ON proposal = k.debate)"""


def flags(spark, sf_dir):
    return reviews.drift(view(spark, sf_dir, "messages"), grounded(spark, sf_dir).select(F.col("proposal").alias("debate"), "grounding", "serving", "connectivity"))


@query(DRIFT + "SELECT *, hallucination_spiral OR complexity_ratchet OR conceptual_drift OR echo_chamber OR scope_creep AS drifting FROM f")
def drift_flags(spark, sf_dir):
    """M02."""
    return flags(spark, sf_dir)


@query(DRIFT + """, t AS (SELECT debate, concat_ws(' ', CASE WHEN hallucination_spiral THEN 'Cite a source passage for every element or withdraw it.' END, CASE WHEN complexity_ratchet THEN 'Remove or merge elements in the next revision.' END,
    CASE WHEN conceptual_drift THEN 'Attach every element to a class of the seed.' END, CASE WHEN echo_chamber THEN 'Name at least one weakness in the next review.' END, CASE WHEN scope_creep THEN 'Drop elements that answer no question.' END) AS advice FROM f)
    SELECT debate, advice FROM t WHERE advice <> ''""")
def corrective_texts(spark, sf_dir):
    """R07."""
    return reviews.corrections(flags(spark, sf_dir))


@query("""WITH p AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'consensus_building' WHEN 1 THEN 'dialectical' WHEN 2 THEN 'socratic' WHEN 3 THEN 'abductive' ELSE 'delphi' END AS strategy, o_custkey % 7 AS failures FROM orders)
    SELECT id, CASE WHEN failures = 0 THEN strategy ELSE list_filter(['consensus_building', 'dialectical', 'socratic', 'abductive', 'delphi'], lambda x: x <> strategy)[least(failures, 4)] END AS strategy FROM p""")
def strategy_selection(spark, sf_dir):
    """A strategy by failures so far."""
    named = F.element_at(F.array(*map(F.lit, reviews.FALLBACKS)), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return reviews.chosen_strategy(view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), named.alias("strategy"), (F.col("o_custkey") % 7).alias("failures")))


@query("""WITH v AS (SELECT debate, concat(count_if(coalesce(approves, false)), '/', count(approves)) AS approval FROM {messages} WHERE message_type = 'review' GROUP BY debate),
    i AS (SELECT conv_id AS debate, split_part(text, ' ', 1) AS issue, row_number() OVER (PARTITION BY conv_id ORDER BY turn, split_part(text, ' ', 1)) AS n FROM conversations WHERE role = 'user'),
    s AS (SELECT debate, string_agg(issue, '|' ORDER BY n) AS issues FROM i WHERE n <= 3 GROUP BY debate) SELECT debate, approval, coalesce(issues, '') AS issues FROM v LEFT JOIN s USING (debate)""")
def anonymous_feedback(spark, sf_dir):
    """Votes and the first three issues (the feature) without names."""
    issues = view(spark, sf_dir, "conversations").where("role = 'user'").select(F.col("conv_id").alias("debate"), F.col("turn").alias("seq"), F.split_part("text", F.lit(" "), F.lit(1)).alias("issue"))
    return reviews.anonymous_feedback(view(spark, sf_dir, "messages"), issues)


@query("""WITH u AS (SELECT l_returnflag AS system, CASE l_linestatus WHEN 'F' THEN 'before' ELSE 'after' END AS phase, unnest(['quantity', 'discount', 'tax']) AS metric, unnest([l_quantity, l_discount, l_tax]) AS value FROM lineitem),
    b AS (SELECT system, metric, avg(CASE phase WHEN 'before' THEN value END) AS before, avg(CASE phase WHEN 'after' THEN value END) AS after FROM u GROUP BY ALL HAVING before IS NOT NULL AND after IS NOT NULL)
    SELECT system, metric, round(before, 4) AS before, round(after, 4) AS after, CASE WHEN round(after - before, 6) > 0 THEN 'improved' WHEN round(after - before, 6) < 0 THEN 'degraded' ELSE 'unchanged' END AS verdict FROM b""")
def before_after(spark, sf_dir):
    """Metrics before and after."""
    rows = view(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("system"), F.when(F.col("l_linestatus") == "F", "before").otherwise("after").alias("phase"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"))
    return reviews.before_after(rows.unpivot(["system", "phase"], ["quantity", "discount", "tax"], "metric", "value")).select("system", "metric", rounded("before"), rounded("after"), "verdict")


@query("""SELECT event_id AS id, k AS kind, concat('e', user_id) AS element, concat('doc', event_id % 9) AS document, event_type AS passage, CASE k WHEN 'classes' THEN round(value / 1000, 6) ELSE 0.0e0 END AS confidence
    FROM events, (SELECT unnest(['classes', 'relations']) AS k) AS x WHERE k = 'classes' OR event_id % 4 = 0""")
def evidence_records(spark, sf_dir):
    """Evidence out of nested replies."""
    e = view(spark, sf_dir, "events")
    element = F.concat(F.lit("e"), F.col("user_id").cast("string"))
    proof = lambda c: F.array(F.struct(F.concat(F.lit("doc"), (F.col("event_id") % 9).cast("string")).alias("document"), F.col("event_type").alias("passage"), c.alias("confidence")))
    item = lambda c: F.array(F.struct(element.alias("name"), proof(c).alias("evidence")))
    reply = F.to_json(F.struct(item(F.round(F.col("value") / 1000, 6)).alias("classes"), F.when(F.col("event_id") % 4 == 0, item(F.lit(None).cast("double"))).alias("relations")))
    return reviews.evidence_records(e.select(F.col("event_id").alias("id"), reply.alias("reply")))


@query("""SELECT event_id, props AS passage FROM events WHERE user_id = 7""")
def evidence_lookup(spark, sf_dir):
    """The records of one element."""
    return view(spark, sf_dir, "events").where("user_id = 7").select("event_id", F.col("props").alias("passage"))


@query("SELECT round(count(DISTINCT element) / (SELECT count(DISTINCT user_id) FROM events), 4) AS coverage, count(DISTINCT element) AS elements FROM {signals} WHERE rationale IS NOT NULL")
def provenance_coverage(spark, sf_dir):
    """Elements with a record among all elements."""
    s = view(spark, sf_dir, "signals")
    return s.agg(F.countDistinct(F.when(F.col("rationale").isNotNull(), F.col("element"))).alias("elements"), F.countDistinct("element").alias("n")).select(F.round(F.col("elements") / F.col("n"), 4).alias("coverage"), "elements")


@query("""SELECT concat('prop_', substr(sha256(child), 1, 12)) AS id, child AS label, parent, 'accept' AS decision FROM {class_tree} WHERE child NOT IN (SELECT p_type FROM part)""")
def hierarchy_proposals(spark, sf_dir):
    """Classes that the seed lacks as accepted proposals."""
    tree = view(spark, sf_dir, "class_tree").select(F.col("child").alias("uri"), F.col("child").alias("label"), "parent")
    return reviews.proposals_from_hierarchy(tree, view(spark, sf_dir, "part").select(F.col("p_type").alias("uri")).distinct())


@query("""WITH p AS (SELECT p_name AS name, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_type END AS domain, n_name AS range FROM part LEFT JOIN nation ON n_nationkey = p_partkey % 40), k AS (SELECT lower(p_name) AS name FROM part WHERE p_size = 1)
    SELECT name, domain, range FROM p WHERE name <> '' AND domain <> '' AND range <> '' AND lower(name) NOT IN (SELECT name FROM k) AND lower(domain) IN (SELECT lower(child) FROM {class_tree}) AND lower(range) IN (SELECT lower(child) FROM {class_tree})""")
def valid_relations(spark, sf_dir):
    """Complete, new, both ends known."""
    part = view(spark, sf_dir, "part")
    rows = part.join(view(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("p_partkey") % 40, "left")
    proposed = rows.select(F.col("p_name").alias("name"), F.when(F.col("p_size") % 5 == 0, "").otherwise(F.col("p_type")).alias("domain"), F.col("n_name").alias("range"))
    return reviews.valid_relations(proposed, part.where("p_size = 1").select(F.col("p_name").alias("name")), view(spark, sf_dir, "class_tree").select(F.col("child").alias("label")))


@query("""SELECT o_orderkey AS id, concat(l_returnflag, ': part', l_partkey) AS issue FROM orders JOIN lineitem ON l_orderkey = o_orderkey UNION ALL SELECT o_orderkey, concat('missing: ', o_orderpriority) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def review_issues(spark, sf_dir):
    """Nested reviews as flat issues."""
    rows = view(spark, sf_dir, "orders").join(view(spark, sf_dir, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"))
    item = F.struct(F.col("l_returnflag").alias("rule"), F.concat(F.lit("part"), F.col("l_partkey").cast("string")).alias("element"))
    by = rows.groupBy("o_orderkey", "o_orderstatus", "o_orderpriority").agg(F.collect_list(item).alias("violations"))
    review = F.to_json(F.struct("violations", F.when(F.col("o_orderstatus") == "F", F.array("o_orderpriority")).alias("missing")))
    return reviews.review_issues(by.select(F.col("o_orderkey").alias("id"), review.alias("review")))


@query("""SELECT user_id % 7 AS iteration, round(coalesce(avg(CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_type = 'click' THEN 1 ELSE 0 END END), 0), 4) AS entity_coverage,
    round(coalesce(avg(CASE WHEN event_id % 3 = 1 THEN CASE WHEN value > 50 THEN 1 ELSE 0 END END), 0), 4) AS question_coverage, round(coalesce(avg(CASE WHEN event_id % 3 = 2 THEN CASE WHEN value > 50 THEN 1 ELSE 0 END END), 0), 4) AS instance_pass_rate FROM events GROUP BY 1""")
def iteration_metrics(spark, sf_dir):
    """M13, X37, T39."""
    kind = F.element_at(F.array(F.lit("term"), F.lit("question"), F.lit("instance")), (F.col("event_id") % 3 + 1).cast("int"))
    rows = view(spark, sf_dir, "events").select((F.col("user_id") % 7).alias("iteration"), kind.alias("kind"), F.when(F.col("event_type") == "click", "class").otherwise("other").alias("category"), (F.col("value") > 50).alias("passed"))
    return reviews.iteration_metrics(rows).select("iteration", rounded("entity_coverage"), rounded("question_coverage"), rounded("instance_pass_rate"))


@query("""SELECT l_orderkey AS id, count_if(l_returnflag = 'A') AS class, count_if(l_returnflag = 'N') AS property, 0 AS relation, count_if(l_returnflag NOT IN ('A', 'N')) AS unknown FROM lineitem GROUP BY 1""")
def term_split(spark, sf_dir):
    """Terms by category."""
    kind = F.when(F.col("l_returnflag") == "A", "class").when(F.col("l_returnflag") == "N", "property").otherwise("odd")
    return reviews.term_split(view(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), kind.alias("category")))


@query("""WITH e AS (SELECT min(p_partkey) + 5 AS num, p_name AS question FROM part WHERE p_size < 9 GROUP BY p_name), g AS (SELECT event_id AS seq, CASE WHEN event_id % 5 = 0 THEN '' WHEN event_id % 2 = 0 THEN upper((SELECT min(p_name) FROM part WHERE p_partkey = user_id)) ELSE concat('Q ', user_id, event_type) END AS question FROM events),
    f AS (SELECT min(seq) AS seq, arg_min(question, seq) AS question FROM g WHERE question <> '' AND lower(question) NOT IN (SELECT lower(question) FROM e) GROUP BY lower(question))
    SELECT printf('CQ_%03d', num) AS id, question FROM e UNION ALL SELECT printf('CQ_%03d', (SELECT max(num) FROM e) + row_number() OVER (ORDER BY seq)), question FROM f""")
def merged_questions(spark, sf_dir):
    """Generated questions after the existing ones."""
    part = view(spark, sf_dir, "part")
    existing = part.where("p_size < 9").groupBy(F.col("p_name").alias("question")).agg((F.min("p_partkey") + 5).alias("num"))
    rows = view(spark, sf_dir, "events").join(part.select(F.col("p_partkey").alias("user_id"), F.upper("p_name").alias("named")), "user_id", "left")
    asked = F.when(F.col("event_id") % 5 == 0, "").when(F.col("event_id") % 2 == 0, F.col("named")).otherwise(F.concat(F.lit("Q "), F.col("user_id").cast("string"), "event_type"))
    return reviews.merged_questions(existing, rows.select(F.col("event_id").alias("seq"), asked.alias("question")))


@query("""WITH r AS (SELECT DISTINCT concat('urn:class#', p_brand) AS uri, 'class' AS kind, 0.5e0 AS level FROM part UNION ALL SELECT DISTINCT concat('urn:prop#', replace(p_name, ' ', '_')), 'property', CASE WHEN length(p_name) > 10 THEN 0.95e0 ELSE 0.75e0 END FROM part)
    SELECT uri, kind, level, CASE kind WHEN 'class' THEN concat('What is a ', split_part(uri, '#', -1), ' and how does it relate to the ontology?') ELSE concat('What relationship does ''', replace(split_part(uri, '#', -1), '_', ' '), ''' describe between entities?') END AS question,
    CASE WHEN level >= 0.9 THEN 'hard' WHEN kind = 'class' THEN 'easy' ELSE 'medium' END AS difficulty FROM r""")
def removal_questions(spark, sf_dir):
    """I24."""
    part = view(spark, sf_dir, "part")
    gone = part.select(F.concat(F.lit("urn:class#"), "p_brand").alias("uri"), F.lit("class").alias("kind"), F.lit(0.5).alias("level"))
    props = part.select(F.concat(F.lit("urn:prop#"), F.replace("p_name", F.lit(" "), F.lit("_"))).alias("uri"), F.lit("property").alias("kind"), F.when(F.length("p_name") > 10, 0.95).otherwise(0.75).alias("level"))
    return reviews.removal_questions(gone.union(props).distinct())


@query("""WITH c AS (SELECT DISTINCT p_name AS label, CASE WHEN length(p_name) % 2 = 0 THEN 'Tool' END AS parent FROM part), r AS (SELECT DISTINCT p_name AS label, 1 AS nth, 'fits' AS name, p_type AS range FROM part WHERE p_size > 48),
    q AS (SELECT concat('cq_', replace(lower(label), ' ', '_'), '_properties') AS id, concat('What properties does a ', label, ' have?') AS question FROM c UNION ALL
    SELECT concat('cq_', replace(lower(label), ' ', '_'), '_hierarchy'), concat('Which ', coalesce(parent, 'entity'), ' instances are also ', label, '?') FROM c UNION ALL SELECT concat('cq_', replace(lower(label), ' ', '_'), '_rel_', name), concat('What ', range, ' does ', label, ' ', name, '?') FROM r)
    SELECT DISTINCT id, question FROM q WHERE id <> 'cq_red_gear_properties'""")
def moderator_questions(spark, sf_dir):
    """Questions on accepted classes."""
    part = view(spark, sf_dir, "part")
    classes = part.select(F.col("p_name").alias("label"), F.when(F.length("p_name") % 2 == 0, "Tool").alias("parent")).distinct()
    relations = part.where("p_size > 48").select(F.col("p_name").alias("label"), F.lit(1).alias("nth"), F.lit("fits").alias("name"), F.col("p_type").alias("range")).distinct()
    return reviews.moderator_questions(classes, relations, spark.createDataFrame([("cq_red_gear_properties",)], "id string"))


CHECKS = """WITH q AS (SELECT o_orderkey AS id, unnest(CASE WHEN o_orderkey % 5 = 0 THEN [NULL] ELSE [upper(o_orderpriority), 'large'] END) AS e FROM orders), k AS (SELECT lower(p_type) AS n FROM part UNION SELECT '1-urgent' UNION SELECT '3-medium'),
    x AS (SELECT id, bool_and(lower(e) IN (SELECT n FROM k)) FILTER (e IS NOT NULL) AS passed FROM q GROUP BY id) """


def checks(spark, sf_dir):
    asked = F.when(F.col("o_orderkey") % 5 != 0, F.array(F.upper("o_orderpriority"), F.lit("large")))
    known = view(spark, sf_dir, "part").select(F.col("p_type").alias("label")).union(spark.createDataFrame([("1-URGENT",), ("3-Medium",)], "label string"))
    return reviews.structural_checks(view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), asked.alias("expected")), known)


@query(CHECKS + "SELECT id, passed FROM x")
def structural_checks(spark, sf_dir):
    """Whether a question's classes exist, null without any."""
    return checks(spark, sf_dir)


@query(CHECKS + "SELECT count(*) AS total, count_if(coalesce(passed, false)) AS covered, round(100.0 * count_if(coalesce(passed, false)) / count(*), 4) AS coverage_pct FROM x")
def question_percent(spark, sf_dir):
    """D06, T06."""
    return reviews.question_percent(checks(spark, sf_dir)).select("total", "covered", rounded("coverage_pct"))
