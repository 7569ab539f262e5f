"""Matches with reference ontologies, unit tests, benchmark tables and their figures."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import text
from tessera.operators import alignment, metrics, records, stats
from tessera.plans.binding import view
from tessera.plans.patterns import onto
from tessera.plans.quality import SIDES, sides
from tessera.plans.registered import query, rounded

SHARED = "len(list_intersect({a}, {b})) / len(list_distinct(list_concat({a}, {b})))"


def words(c: str) -> str:
    return f"string_split(lower({c}), ' ')"


LIKENESS = f"CASE WHEN x.e IS NOT NULL AND y.e IS NOT NULL THEN list_cosine_similarity(x.e, y.e) ELSE {SHARED.format(a=words('x.label'), b=words('y.label'))} END"
CONCEPT_TURN = """{n} AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(score, 9) DESC, match) AS nth FROM (SELECT x.label, y.label AS match, """ + LIKENESS + """ AS score,
    CASE WHEN x.e IS NOT NULL AND y.e IS NOT NULL THEN 'vector' ELSE 'words' END AS tier FROM g AS x, {r} AS y WHERE {rest}) AS p WHERE score >= 0.45)"""
CONCEPTS = """WITH v AS (SELECT id, concat(id % 50, ' of ', id % 7, ' ', label) AS label, CAST(embedding AS DOUBLE[]) AS e FROM {vectors}), g AS (SELECT label, max(CASE WHEN id % 4 > 0 THEN e END) AS e FROM v WHERE id % 3 = 0 GROUP BY label),
    r1 AS (SELECT label, max(CASE WHEN id % 5 > 0 THEN e END) AS e FROM v WHERE id % 3 = 1 GROUP BY label), r2 AS (SELECT label, max(e) AS e FROM v WHERE id % 3 = 2 GROUP BY label),
    """ + CONCEPT_TURN.replace("{n}", "m1").replace("{r}", "r1").replace("{rest}", "true") + ", " + CONCEPT_TURN.replace("{n}", "m2").replace("{r}", "r2").replace("{rest}", "x.label NOT IN (SELECT label FROM m1)") + """,
    f AS (SELECT label, match, score, tier, 'first' AS reference FROM m1 WHERE nth = 1 UNION ALL SELECT label, match, score, tier, 'second' FROM m2 WHERE nth = 1)"""
PERCENTS = """ SELECT 'first' AS reference, (SELECT count(*) FROM f WHERE reference = 'first') AS matched, round(100.0 * (SELECT count(*) FROM f WHERE reference = 'first') / (SELECT count(*) FROM g), 4) AS percent
    UNION ALL SELECT 'second', (SELECT count(*) FROM f WHERE reference = 'second'), round(100.0 * (SELECT count(*) FROM f) / (SELECT count(*) FROM g), 4)"""


def concept_turns(spark, sf_dir):
    v = view(spark, sf_dir, "vectors").withColumn("name", F.concat((F.col("id") % 50).cast("string"), F.lit(" of "), (F.col("id") % 7).cast("string"), F.lit(" "), F.col("label").cast("string")))
    side = lambda k, some: v.where(F.col("id") % 3 == k).select(F.col("name").alias("label"), F.when(some, F.col("embedding")).alias("embedding"))
    generated = side(0, F.col("id") % 4 > 0)
    return generated, alignment.in_turn(generated, {"first": side(1, F.col("id") % 5 > 0), "second": side(2, F.lit(True))}, lambda g, r: alignment.concept_links(g, r, 0.45))


@query(CONCEPTS + " SELECT label, match, round(score, 4) AS score, tier, reference FROM f")
def concept_links(spark, sf_dir):
    """Concepts against references in turn, by vectors of label and definition, by words without one."""
    return concept_turns(spark, sf_dir)[1].select("label", "match", rounded("score"), "tier", "reference")


@query(CONCEPTS + PERCENTS)
def concept_percents(spark, sf_dir):
    """What matched each reference, cumulative."""
    generated, found = concept_turns(spark, sf_dir)
    return alignment.percents(found, generated, ["first", "second"]).select("reference", "matched", rounded("percent"))


LOCAL = "split_part(split_part({c}, '#', -1), '/', -1)"
SENTENCE = f"concat_ws(' ', {LOCAL.format(c='s')}, split_part(p, ':', -1), {LOCAL.format(c='o')})"
STATEMENT_TURN = """{n} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY kind, round(score, 9) DESC, match) AS nth FROM (
    SELECT x.label, y.label AS match, 1.0e0 AS score, 'exact' AS tier, 0 AS kind FROM g AS x JOIN {r} AS y ON lower(x.label) = lower(y.label) WHERE {rest}
    UNION ALL SELECT x.label, y.label, {shared}, 'words', 1 FROM g AS x, {r} AS y WHERE {shared} >= 0.5 AND {rest}
    UNION ALL SELECT x.label, y.label, list_cosine_similarity(x.e, y.e), 'vector', 2 FROM g AS x, {r} AS y WHERE list_cosine_similarity(x.e, y.e) >= 0.5 AND {rest}) AS p) AS q WHERE nth = 1)""".replace("{shared}", SHARED.format(a=words("x.label"), b=words("y.label")))
STATEMENTS = SIDES.replace("g AS (", "gt AS (") + f""", v AS (SELECT id, CAST(embedding AS DOUBLE[]) AS e FROM {{vectors}}), gs AS (SELECT DISTINCT {SENTENCE} AS label FROM gt WHERE p NOT IN ('rdfs:label', 'rdfs:comment')), ks AS (SELECT DISTINCT {SENTENCE} AS label FROM k WHERE p NOT IN ('rdfs:label', 'rdfs:comment')),
    g AS (SELECT label, CASE WHEN length(label) % 4 > 0 THEN e END AS e FROM gs LEFT JOIN v ON id = length(label) * 37 % 500), r AS (SELECT label, e FROM ks LEFT JOIN v ON id = length(label) * 41 % 500), r1 AS (SELECT * FROM r WHERE length(label) % 2 = 0), r2 AS (SELECT * FROM r WHERE length(label) % 2 = 1),
    """ + STATEMENT_TURN.replace("{n}", "m1").replace("{r}", "r1").replace("{rest}", "true") + ", " + STATEMENT_TURN.replace("{n}", "m2").replace("{r}", "r2").replace("{rest}", "x.label NOT IN (SELECT label FROM m1)") + """,
    f AS (SELECT label, match, score, tier, 'first' AS reference FROM m1 UNION ALL SELECT label, match, score, tier, 'second' FROM m2)"""


def statement_turns(spark, sf_dir):
    v = view(spark, sf_dir, "vectors").select("id", "embedding")

    def side(triples, factor):
        rows = metrics.spo(triples).select(F.concat_ws(" ", "s", "p", "o").alias("label")).distinct()
        return rows.join(v, F.length("label") * factor % 500 == F.col("id"), "left").drop("id")

    g, k = sides(spark, sf_dir)
    n = F.length("label")
    generated, gold = side(g, 37).withColumn("embedding", F.when(n % 4 > 0, F.col("embedding"))), side(k, 41)
    return generated, alignment.in_turn(generated, {"first": gold.where(n % 2 == 0), "second": gold.where(n % 2 == 1)}, alignment.statement_links)


@query(STATEMENTS + " SELECT label, match, round(score, 4) AS score, tier, reference FROM f")
def statement_links(spark, sf_dir):
    """Statements against references in turn, exact, then by words, then by vectors."""
    return statement_turns(spark, sf_dir)[1].select("label", "match", rounded("score"), "tier", "reference")


@query(STATEMENTS + PERCENTS)
def statement_percents(spark, sf_dir):
    """What matched each reference, cumulative."""
    generated, found = statement_turns(spark, sf_dir)
    return alignment.percents(found, generated, ["first", "second"]).select("reference", "matched", rounded("percent"))


@query("""WITH c AS (SELECT concat('Kind ', id) AS label, CAST(embedding AS DOUBLE[]) AS e FROM {vectors} WHERE id % 3 = 0), t AS (SELECT CASE id % 4 WHEN 0 THEN concat('kind_', id, ' ') WHEN 1 THEN concat('Big ', 'KIND_', id) WHEN 2 THEN concat('ind_', id) ELSE concat('z', id) END AS entity_type, CAST(embedding AS DOUBLE[]) AS e FROM {vectors}),
    n AS (SELECT *, replace(trim(lower(entity_type)), '_', ' ') AS k FROM t), p AS (SELECT entity_type, label AS match, CASE WHEN k = lower(label) THEN 1.0e0 WHEN contains(k, lower(label)) OR contains(lower(label), k) THEN 0.9e0 ELSE list_cosine_similarity(n.e, c.e) END AS similarity,
        CASE WHEN k = lower(label) THEN 'exact' WHEN contains(k, lower(label)) OR contains(lower(label), k) THEN 'substring' ELSE 'vector' END AS tier FROM n, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY tier, CASE tier WHEN 'vector' THEN -round(similarity, 9) ELSE 0 END, match) AS nth FROM p WHERE tier <> 'vector' OR similarity >= 0.4)
    SELECT entity_type, match, round(coalesce(similarity, 0), 4) AS similarity, coalesce(tier, 'none') AS tier FROM t LEFT JOIN (SELECT * FROM r WHERE nth = 1) AS b USING (entity_type)""")
def type_matches(spark, sf_dir):
    """Entity types covered by equal, holding or held, or near classes."""
    v, n = view(spark, sf_dir, "vectors"), F.col("id").cast("string")
    spelled = F.when(F.col("id") % 4 == 0, F.concat(F.lit("kind_"), n, F.lit(" "))).when(F.col("id") % 4 == 1, F.concat(F.lit("Big KIND_"), n)).when(F.col("id") % 4 == 2, F.concat(F.lit("ind_"), n)).otherwise(F.concat(F.lit("z"), n))
    classes = v.where("id % 3 = 0").select(F.concat(F.lit("Kind "), n).alias("label"), "embedding")
    return alignment.type_matches(v.select(spelled.alias("entity_type"), "embedding"), classes, 0.4).select("entity_type", "match", rounded("similarity"), "tier")


CHAIN = "{t}e AS (SELECT s, o FROM {t} WHERE p = 'rdfs:subClassOf' AND NOT starts_with(s, '_:') AND NOT starts_with(o, '_:') AND s <> o), {t}u(n, d) AS (SELECT s, 1 FROM {t}e UNION SELECT {t}e.s, d + 1 FROM {t}u JOIN {t}e ON n = {t}e.o)"
NAMED = "{t}n AS (SELECT DISTINCT s AS uri, coalesce((SELECT min(o) FROM {t} AS z WHERE z.s = x.s AND z.p = 'rdfs:label'), " + LOCAL.format(c="s") + ") AS label FROM {t} AS x WHERE p = 'rdf:type' AND o IN ('owl:Class', 'rdfs:Class') AND NOT starts_with(s, '_:'))"
SIX = SIDES.replace("WITH o", "WITH RECURSIVE o") + ", a AS (SELECT * FROM o WHERE (length(s) + length(o)) % 2 = 0), " + ", ".join((CHAIN + ", " + NAMED).replace("{t}", t) for t in "gk") + ", " + NAMED.replace("{t}", "a")


@query(SIX + """, q AS (SELECT p_brand AS id, concat('urn:prop#', p_brand) AS x, concat('urn:class#', min(p_type)) AS y FROM part GROUP BY p_brand), w AS (SELECT s AS x FROM g UNION SELECT p FROM g UNION SELECT o FROM g), fresh AS (SELECT * FROM gn WHERE uri NOT IN (SELECT uri FROM an)),
    lows AS (SELECT DISTINCT lower(label) AS l FROM gn WHERE lower(label) NOT IN (SELECT lower(label) FROM an)), odd AS (SELECT DISTINCT label FROM gn WHERE label NOT IN (SELECT label FROM kn))
    SELECT 0.0e0 AS semantic, round((SELECT coalesce(avg(CASE WHEN l IN (SELECT lower(label) FROM kn) THEN 0 ELSE 1 END), 0) FROM lows), 4) AS hallucination, round((SELECT avg(CASE WHEN x IN (SELECT x FROM w) AND y IN (SELECT x FROM w) THEN 1 ELSE 0 END) FROM q), 4) AS cq,
    round(least((SELECT max(d) + 1 FROM gu), (SELECT max(d) + 1 FROM ku)) / (SELECT max(d) + 1 FROM ku), 4) AS hierarchy,
    round((SELECT coalesce((avg(CASE WHEN starts_with(uri, 'urn:class#L') THEN 1 ELSE 0 END) + avg(CASE WHEN lower(label) IN (SELECT lower(label) FROM kn) THEN 1 ELSE 0 END)) / 2, 1) FROM fresh), 4) AS domain,
    round((SELECT coalesce(avg(CASE WHEN lower(label) IN (SELECT lower(label) FROM kn) THEN 1 ELSE 0 END), 1) FROM odd), 4) AS expert""")
def six_scores(spark, sf_dir):
    """The six scores of a generated ontology; without vectors the first is that of a failure."""
    generated, gold = sides(spark, sf_dir)
    seed = onto(spark, sf_dir).distinct().where((F.length("s") + F.length("o")) % 2 == 0)
    asked = view(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("id")).agg(F.min("p_type").alias("t"))
    questions = asked.select("id", F.array(F.concat(F.lit("urn:prop#"), "id"), F.concat(F.lit("urn:class#"), "t")).alias("targets"))
    return alignment.six_scores(generated, gold, seed, "urn:class#L", None, None, questions).select(*[rounded(m) for m in alignment.FAILED])


TYPED = "t AS (SELECT DISTINCT s, o FROM g WHERE p = 'rdf:type' UNION SELECT concat('urn:ind#', l_suppkey), concat('urn:class#', p_type) FROM lineitem JOIN part ON p_partkey = l_partkey)"


def with_individuals(spark, sf_dir):
    generated, gold = sides(spark, sf_dir)
    rows = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    found = rows.select(F.concat(F.lit("urn:ind#"), F.col("l_suppkey").cast("string")).alias("s"), F.lit("rdf:type").alias("p"), F.concat(F.lit("urn:class#"), "p_type").alias("o")).distinct()
    return generated.unionByName(found), gold


@query(SIDES.replace("WITH o", "WITH RECURSIVE o") + ", " + TYPED + """, j AS (SELECT s AS a, o AS b FROM g WHERE p = 'owl:disjointWith'), ge AS (SELECT s, o FROM g WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:')), u(n, a) AS (SELECT s, o FROM ge UNION SELECT n, ge.o FROM u JOIN ge ON a = ge.s)
    SELECT 'consistency' AS test, NOT EXISTS (SELECT 1 FROM j JOIN t AS x ON x.o = j.a JOIN t AS y ON y.o = j.b AND x.s = y.s) AS passed
    UNION ALL SELECT concat('subclass ', s, ' ', o), concat(s, '|', o) IN (SELECT concat(n, '|', a) FROM u) FROM k WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:') AND s IN (SELECT s FROM g) AND o IN (SELECT s FROM g)""")
def inference_tests(spark, sf_dir):
    """Consistency, and gold's subclass pairs in the generated hierarchy."""
    return alignment.inference_tests(*with_individuals(spark, sf_dir))


@query("""WITH o AS (SELECT DISTINCT * FROM {onto}) SELECT DISTINCT concat('disjoint ', s, ' ', o) AS test, true AS passed FROM o WHERE p = 'owl:disjointWith'""")
def provocation_tests(spark, sf_dir):
    """An individual of both of two disjoint classes is put in and found."""
    return alignment.provocation_tests(onto(spark, sf_dir))


THEMED = " ".join(f"WHEN {' OR '.join(f'contains(q, {w!r})' for w in ws)} THEN '{name}'" for name, ws in text.THEMES.items())


@query(f"""WITH x AS (SELECT doc_id, lower(concat(CASE doc_id % 9 WHEN 0 THEN 'Which PLANs ' WHEN 1 THEN 'Which permit and budget ' WHEN 2 THEN 'What hazard ' WHEN 3 THEN 'Is the site safe and what waste ' WHEN 4 THEN 'Who may License ' WHEN 5 THEN 'Which disposal ' WHEN 6 THEN 'How to measure ' ELSE '' END, coalesce(text, ''))) AS q FROM documents)
    SELECT doc_id, CASE {THEMED} ELSE 'Other' END AS theme FROM x""")
def question_themes(spark, sf_dir):
    """Themes of questions, the first of seven groups whose keyword occurs."""
    asked = ("Which PLANs ", "Which permit and budget ", "What hazard ", "Is the site safe and what waste ", "Who may License ", "Which disposal ", "How to measure ", "", "")
    head = F.element_at(F.array(*map(F.lit, asked)), (F.col("doc_id") % 9 + 1).cast("int"))
    return view(spark, sf_dir, "documents").select("doc_id", text.question_theme(F.concat(head, F.coalesce("text", F.lit("")))).alias("theme"))


@query("""WITH x AS (SELECT o_orderkey AS query, o_orderkey % 8 AS k, CASE WHEN o_custkey % 5 = 0 THEN 'relevant entities' WHEN o_custkey % 5 = 1 THEN 'Order' ELSE concat('Order, Part, ', o_orderpriority) END AS t FROM orders)
    SELECT query, CASE k WHEN 0 THEN concat('Provide a concise factual answer about ', t, '.') WHEN 1 THEN concat('List all instances of ', t, ' that match the question.') WHEN 2 THEN 'Answer with Yes or No, then provide justification.'
    WHEN 3 THEN concat('Compare the mentioned ', t, ', highlighting differences.') WHEN 4 THEN 'Explain the causal chain, citing specific entities and relations.' WHEN 5 THEN concat('Provide the count or aggregation over ', t, '.') ELSE '' END AS hint FROM x""")
def answer_hints(spark, sf_dir):
    """What an answer should look like, by question type and entity types."""
    kinds = F.array(*map(F.lit, ("factoid", "list", "boolean", "comparative", "causal", "aggregation", "other")), F.lit(None))
    types = F.when(F.col("o_custkey") % 5 == 1, F.array(F.lit("Order"))).when(F.col("o_custkey") % 5 > 1, F.array(F.lit("Order"), F.lit("Part"), F.col("o_orderpriority"), F.lit("Nation")))
    rows = view(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("query"), F.element_at(kinds, (F.col("o_orderkey") % 8 + 1).cast("int")).alias("question_type"), types.alias("entity_types"))
    return records.answer_hints(rows)


FLAT = """WITH m AS (SELECT system, level, semantic AS semantic_correctness, hallucination AS hallucination_rate, coalesce(CASE WHEN test_case % 7 > 0 THEN coverage END, 0) AS cq_coverage, semantic * coverage AS hierarchy_quality, 1 - semantic AS domain_compliance, 1.4142e0 * semantic AS expert_acceptance, (semantic + coverage) / 2 AS composite_score,
    CASE WHEN test_case % 3 = 0 THEN semantic ELSE 0 END AS semantic_match_concept, CASE WHEN test_case % 2 = 0 THEN coverage ELSE 0 END AS semantic_match_triple, CASE WHEN test_case % 5 = 0 THEN hallucination ELSE 0 END AS owlunit_pass_rate, CASE WHEN test_case % 4 = 0 THEN semantic / 2 ELSE 0 END AS ontourl_overall FROM {results})"""
ELEVEN = (*stats.DIMENSIONS, *stats.NESTED)


def flat_results(spark, sf_dir):
    some = lambda k, c, name: F.when(F.col("test_case") % k == 0, F.struct(c.alias(name)))
    s, h, c = F.col("semantic"), F.col("hallucination"), F.col("coverage")
    report = F.struct(
        s.alias("semantic_correctness"), h.alias("hallucination_rate"), F.when(F.col("test_case") % 7 > 0, c).alias("cq_coverage"), (s * c).alias("hierarchy_quality"), (1 - s).alias("domain_compliance"), (1.4142 * s).alias("expert_acceptance"), ((s + c) / 2).alias("composite_score"),
        some(3, s * 100, "match_percentage").alias("semantic_match_concept"), some(2, c * 100, "match_percentage").alias("semantic_match_triple"), some(5, h, "pass_rate").alias("owlunit_suite"), some(4, s / 2, "overall_avg").alias("ontourl_profile"),
    )
    return view(spark, sf_dir, "results").select("system", "level", F.parse_json(F.to_json(report)).alias("metrics"))


@query(FLAT + "SELECT system, level, count(*) AS n, " + ", ".join(f"round(avg({m}), 4) AS {m}" for m in ELEVEN) + " FROM m GROUP BY GROUPING SETS ((system), (system, level))")
def benchmark_table(spark, sf_dir):
    """Eleven metrics of nested reports by system and by level."""
    return stats.benchmark_table(flat_results(spark, sf_dir)).select("system", "level", "n", *map(rounded, ELEVEN))


@query(FLAT + ", x AS (SELECT system, level, " + ", ".join(f"avg({m}) AS {m}" for m in stats.SHOWN) + " FROM m GROUP BY GROUPING SETS ((system), (system, level))), u AS (" + " UNION ALL ".join(f"SELECT system, level, '{m}' AS metric, {'1 - ' if m == 'hallucination_rate' else ''}{m} AS value FROM x" for m in stats.SHOWN) + ") SELECT system, level, metric, round(least(1, greatest(0, value)), 4) AS value FROM u")
def chart_values(spark, sf_dir):
    """Cells of heatmaps, bars and radars, inverted and kept within 0 and 1."""
    return stats.chart_values(stats.benchmark_table(flat_results(spark, sf_dir))).select("system", "level", "metric", rounded("value"))


@query(FLAT + ", x AS (SELECT system, " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in stats.DIMENSIONS) + " FROM m GROUP BY system), b AS (SELECT " + ", ".join(f"(SELECT system FROM x ORDER BY {m} {'ASC' if m == 'hallucination_rate' else 'DESC'}, system LIMIT 1) AS b_{m}" for m in stats.DIMENSIONS) + ") SELECT system, concat(system, ' & ', concat_ws(' & ', " + ", ".join(f"CASE WHEN system = b_{m} THEN concat('\\textbf{{', printf('%.2f', {m}), '}}') ELSE printf('%.2f', {m}) END" for m in stats.DIMENSIONS) + "), ' \\\\') AS line FROM x, b")
def latex_table(spark, sf_dir):
    """Rows of a LaTeX table, the best in bold."""
    table = stats.benchmark_table(flat_results(spark, sf_dir)).where("level is null").select("system", *[F.round(m, 6).alias(m) for m in stats.DIMENSIONS])
    return stats.latex_rows(table)
