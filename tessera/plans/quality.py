"""Benchmark metrics, scores and tables over the bound ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import replies
from tessera.operators import metrics, patterns, quality, stats
from tessera.plans.analytics import PAIRS
from tessera.plans.binding import view
from tessera.plans.patterns import onto
from tessera.plans.registered import query, rounded

# A generated ontology: the bound one without some statements, as the gold one has others less.
SIDES = """WITH o AS (SELECT DISTINCT * FROM {onto}), g AS (SELECT * FROM o WHERE NOT (length(s) + length(o)) % 5 = 0), k AS (SELECT * FROM o WHERE NOT (length(s) + length(o)) % 7 = 0) """


def sides(spark, sf_dir):
    t = onto(spark, sf_dir).distinct()
    n = F.length("s") + F.length("o")
    return t.where(n % 5 != 0), t.where(n % 7 != 0)


@query("""WITH v AS (SELECT CASE WHEN id % 3 = 0 THEN concat('Term ', id) ELSE concat('x', id) END AS label, CAST(embedding AS DOUBLE[]) AS e FROM {vectors}), w AS (SELECT CASE WHEN id % 2 = 0 THEN upper(concat('term ', id)) ELSE concat('y', id) END AS label, CAST(embedding AS DOUBLE[]) AS f FROM {vectors} WHERE label <> 3),
    h AS (SELECT v.label FROM v WHERE lower(label) IN (SELECT lower(label) FROM w) UNION SELECT v.label FROM v, w WHERE v.label <> w.label AND list_cosine_similarity(e, f) >= 0.85)
    SELECT count(*) AS removed, round(avg(CASE WHEN label IN (SELECT label FROM h) THEN 1 ELSE 0 END), 4) AS recovered FROM v""")
def semantic_correctness(spark, sf_dir):
    """Removed labels found again, by label or cosine."""
    rows = view(spark, sf_dir, "vectors")
    text = F.col("id").cast("string")
    removed = rows.select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("Term "), text)).otherwise(F.concat(F.lit("x"), text)).alias("label"), "embedding")
    made = rows.where("label <> 3").select(F.when(F.col("id") % 2 == 0, F.upper(F.concat(F.lit("term "), text))).otherwise(F.concat(F.lit("y"), text)).alias("label"), "embedding")
    return quality.recovered(removed, made).select("removed", rounded("recovered"))


@query("""WITH n AS (SELECT DISTINCT CASE WHEN p_size < 25 THEN upper(p_name) ELSE p_name END AS label FROM part), k AS (SELECT DISTINCT p_name AS label FROM part WHERE p_size > 44), f AS (SELECT label FROM n WHERE label NOT IN (SELECT label FROM k))
    SELECT count(*) AS classes, round(coalesce(avg(CASE WHEN lower(label) IN (SELECT lower(label) FROM k) THEN 1 ELSE 0 END), 1), 4) AS acceptance FROM f""")
def expert_acceptance(spark, sf_dir):
    """New classes that gold knows in another spelling."""
    part = view(spark, sf_dir, "part")
    new = part.select(F.when(F.col("p_size") < 25, F.upper("p_name")).otherwise(F.col("p_name")).alias("label"))
    return quality.expert_acceptance(new, part.where("p_size > 44").select(F.col("p_name").alias("label"))).select("classes", rounded("acceptance"))


@query("""WITH o AS (SELECT DISTINCT * FROM {onto}), c AS (SELECT DISTINCT s AS uri FROM o WHERE p = 'rdf:type' AND o = 'owl:Class'), x AS (SELECT coalesce((SELECT min(o) FROM o WHERE s = uri AND p = 'rdfs:label'), split_part(uri, '#', -1)) AS label,
    coalesce((SELECT min(o) FROM o WHERE s = uri AND p = 'rdfs:comment'), '') AS definition FROM c) SELECT label, max(definition) AS definition FROM x GROUP BY label""")
def concept_definitions(spark, sf_dir):
    """Concepts with their definitions."""
    return quality.concepts(onto(spark, sf_dir))


TURNS = """WITH p AS (SELECT DISTINCT lower(p_name) AS label, string_split(lower(p_name), ' ') AS w FROM part), a AS (SELECT DISTINCT string_split(lower(p_name), ' ') AS w FROM part WHERE p_size = 1), b AS (SELECT DISTINCT string_split(lower(concat(p_name, ' ', p_type)), ' ') AS w FROM part WHERE p_size = 2),
    x AS (SELECT label FROM p, a GROUP BY label HAVING max(len(list_intersect(p.w, a.w)) / len(list_distinct(list_concat(p.w, a.w)))) >= {threshold}),
    y AS (SELECT label FROM p, b WHERE label NOT IN (SELECT label FROM x) GROUP BY label HAVING max(len(list_intersect(p.w, b.w)) / len(list_distinct(list_concat(p.w, b.w)))) >= {threshold})
    SELECT 'first' AS reference, (SELECT count(*) FROM x) AS matched, round(100.0 * (SELECT count(*) FROM x) / (SELECT count(*) FROM p), 4) AS percent UNION ALL
    SELECT 'second', (SELECT count(*) FROM y), round(100.0 * ((SELECT count(*) FROM x) + (SELECT count(*) FROM y)) / (SELECT count(*) FROM p), 4)"""


def turns(spark, sf_dir, threshold):
    part = view(spark, sf_dir, "part")
    refs = [("first", part.where("p_size = 1").select(F.col("p_name").alias("label"))), ("second", part.where("p_size = 2").select(F.concat_ws(" ", "p_name", "p_type").alias("label")))]
    return quality.matched_in_turn(part.select(F.lower("p_name").alias("label")), refs, threshold).select("reference", "matched", rounded("percent"))


@query(TURNS.replace("{threshold}", "0.55"))
def concept_matches(spark, sf_dir):
    """Concepts against references in turn."""
    return turns(spark, sf_dir, 0.55)


@query(TURNS.replace("{threshold}", "0.50"))
def triple_matches(spark, sf_dir):
    """Statements as sentences against references in turn."""
    return turns(spark, sf_dir, 0.50)


@query(SIDES + """, names AS (SELECT 1), gl AS (SELECT DISTINCT lower(coalesce((SELECT min(o) FROM g AS z WHERE z.s = g.s AND z.p = 'rdfs:label'), split_part(split_part(s, '#', -1), '/', -1))) AS l FROM g WHERE p = 'rdf:type' AND o = 'owl:Class'),
    kl AS (SELECT DISTINCT lower(coalesce((SELECT min(o) FROM k AS z WHERE z.s = k.s AND z.p = 'rdfs:label'), split_part(split_part(s, '#', -1), '/', -1))) AS l FROM k WHERE p = 'rdf:type' AND o = 'owl:Class'),
    ge AS (SELECT s, o FROM g WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:')), ke AS (SELECT s, o FROM k WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:')),
    gp AS (SELECT s, coalesce((SELECT min(o) FROM g AS z WHERE z.s = g.s AND p = 'rdfs:domain'), '') AS d, coalesce((SELECT min(o) FROM g AS z WHERE z.s = g.s AND p = 'rdfs:range'), '') AS r FROM g WHERE p = 'rdf:type' AND o = 'owl:ObjectProperty'),
    kp AS (SELECT s, coalesce((SELECT min(o) FROM k AS z WHERE z.s = k.s AND p = 'rdfs:domain'), '') AS d, coalesce((SELECT min(o) FROM k AS z WHERE z.s = k.s AND p = 'rdfs:range'), '') AS r FROM k WHERE p = 'rdf:type' AND o = 'owl:ObjectProperty')
    SELECT 'U1' AS task, count(*) AS questions, round(coalesce(avg(CASE WHEN l IN (SELECT l FROM gl) THEN 1 ELSE 0 END), 0), 4) AS accuracy FROM kl UNION ALL
    SELECT 'U2', count(*), round(coalesce(avg(CASE WHEN concat(s, '|', o) IN (SELECT concat(s, '|', o) FROM ge) THEN 1 ELSE 0 END), 0), 4) FROM ke UNION ALL
    SELECT 'U3', count(*), round(coalesce(avg(CASE WHEN concat(s, '|', d, '|', r) IN (SELECT concat(s, '|', d, '|', r) FROM gp) THEN 1 ELSE 0 END), 0), 4) FROM kp""")
def understanding_proxies(spark, sf_dir):
    """K12."""
    return quality.understanding(*sides(spark, sf_dir)).select("task", "questions", rounded("accuracy"))


REASONING = SIDES.replace("WITH o", "WITH RECURSIVE o") + """, ge AS (SELECT s, o FROM g WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:')), u(n, a) AS (SELECT s, o FROM ge UNION SELECT n, ge.o FROM u JOIN ge ON a = ge.s), ke AS (SELECT s, o FROM k WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:')),
    x AS (SELECT 'R1' AS task, coalesce(avg(CASE WHEN concat(s, '|', o) IN (SELECT concat(n, '|', a) FROM u) THEN 1.0e0 ELSE 0.0e0 END), 0) AS score FROM ke UNION ALL SELECT 'R2', least(1.0e0, count_if(p = 'owl:disjointWith') / 5.0e0) FROM g
    UNION ALL SELECT 'R5', coalesce(avg(CASE WHEN s IN (SELECT s FROM g WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty')) THEN 1.0e0 ELSE 0.0e0 END), 0) FROM k WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty')) """


@query(REASONING + "SELECT task, round(score, 4) AS score FROM x")
def reasoning_proxies(spark, sf_dir):
    """K14."""
    return quality.reasoning(*sides(spark, sf_dir)).select("task", rounded("score"))


@query(REASONING + ", y AS (SELECT * FROM x UNION ALL SELECT 'L2', 0.5e0), z AS (SELECT substr(task, 1, 1) AS capability, avg(score) AS score FROM y GROUP BY 1) SELECT capability, round(score, 4) AS score FROM z UNION ALL SELECT NULL, round(avg(score), 4) FROM z")
def capability_profile(spark, sf_dir):
    """Means by capability and overall."""
    scores = quality.reasoning(*sides(spark, sf_dir)).union(spark.createDataFrame([("L2", 0.5)], "task string, score double"))
    return quality.profile(scores).select("capability", rounded("score"))


@query("""SELECT o_orderpriority AS kind, count(*) AS tests, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END), 4) AS pass_rate FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())""")
def unit_suite(spark, sf_dir):
    """Pass rates by kind and overall."""
    return quality.suite(view(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("kind"), (F.col("o_orderstatus") == "F").alias("passed"))).select("kind", "tests", rounded("pass_rate"))


@query("""SELECT p_brand AS brand, round(0.25 * avg(p_size) / 50 + 0.2 * avg(p_size % 7) / 7 + 0.15 * avg(p_size % 5) / 5 + 0.15 * avg(p_size % 3) / 3 + 0.25 * (avg(p_size % 2) + avg(p_size % 11) / 11) / 2, 4) AS quality, round((avg(p_size % 2) + avg(p_size % 11) / 11) / 2, 4) AS coverage FROM part GROUP BY 1""")
def overall_quality(spark, sf_dir):
    """Combined coverage and overall score."""
    m = lambda k: F.avg(F.col("p_size") % k) / (k if k > 2 else 1)
    rows = view(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("brand")).agg(
        (F.avg("p_size") / 50).alias("consistency"), m(7).alias("coherence"), m(5).alias("modularity"), m(3).alias("expressiveness"), m(2).alias("structural"), m(11).alias("semantic")
    )
    return quality.overall_quality(rows).select("brand", rounded("quality"), rounded("coverage"))


@query("""SELECT o_custkey AS system, round(0.25 * avg(o_orderkey % 11) / 11 + 0.2 * (1 - avg(o_orderkey % 7) / 7) + 0.2 * avg(o_orderkey % 5) / 5 + 0.1 * avg(o_orderkey % 3) / 3 + 0.15 * avg(o_orderkey % 2) + 0.1 * avg(o_orderkey % 13) / 13, 4) AS score FROM orders GROUP BY 1""")
def composite_score(spark, sf_dir):
    """D26."""
    m = lambda k: F.avg(F.col("o_orderkey") % k) / (k if k > 2 else 1)
    return view(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("system")).agg(metrics.composite(m(11), m(7), m(5), m(3), m(2), m(13)).alias("score")).select("system", rounded("score"))


@query("""WITH t AS (SELECT DISTINCT * FROM {onto}), x AS (SELECT count_if(p = 'rdf:type' AND o = 'owl:Class') AS classes, count_if(p = 'rdf:type' AND o = 'owl:ObjectProperty') AS object_properties, count_if(p = 'rdf:type' AND o = 'owl:DatatypeProperty') AS datatype_properties, count_if(p = 'owl:unionOf') AS unions FROM t)
    SELECT *, round(((classes > 0)::INT + (object_properties > 0)::INT + (datatype_properties > 0)::INT + (unions > 0)::INT) / 12, 4) AS variety FROM x""")
def expressiveness(spark, sf_dir):
    """Constructs and their variety."""
    return quality.expressiveness(onto(spark, sf_dir).distinct()).select("classes", "object_properties", "datatype_properties", "unions", rounded("variety"))


@query(SIDES + """, c AS (SELECT 'classes' AS kind, s, 'g' AS w FROM g WHERE p = 'rdf:type' AND o = 'owl:Class' UNION ALL SELECT 'classes', s, 'k' FROM k WHERE p = 'rdf:type' AND o = 'owl:Class' UNION ALL SELECT 'properties', s, 'g' FROM g WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty')
    UNION ALL SELECT 'properties', s, 'k' FROM k WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty')), x AS (SELECT kind, s, bool_or(w = 'k') AS old, bool_or(w = 'g') AS new FROM c GROUP BY kind, s)
    SELECT kind, count_if(old) AS seed, count_if(new) AS generated, count_if(new AND NOT old) AS added FROM x GROUP BY kind""")
def growth_by_kind(spark, sf_dir):
    """Classes and properties against the seed."""
    made, seed = sides(spark, sf_dir)
    return quality.growth(seed, made)


@query("""WITH r AS (SELECT l_shipmode AS size, l_returnflag AS strategy, l_quantity AS score, l_tax > 0.02 AS ok FROM (SELECT *, CASE l_linenumber % 3 WHEN 0 THEN 'small' WHEN 1 THEN 'medium' ELSE 'large' END AS l_shipmode FROM lineitem) AS x), b AS (SELECT size, strategy, round(avg(score), 9) AS m FROM r GROUP BY ALL),
    n AS (SELECT size, strategy, row_number() OVER (PARTITION BY size ORDER BY m DESC, strategy) AS k FROM b) SELECT r.size, count(*) AS runs, round(avg(score), 4) AS mean, min(score) AS least, max(score) AS most, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 4) AS success, any_value(n.strategy) AS best
    FROM r JOIN n ON n.size = r.size AND k = 1 GROUP BY r.size""")
def size_groups(spark, sf_dir):
    """Runs by model size."""
    kind = F.element_at(F.array(F.lit("small"), F.lit("medium"), F.lit("large")), (F.col("l_linenumber") % 3 + 1).cast("int"))
    rows = view(spark, sf_dir, "lineitem").select(kind.alias("size"), F.col("l_returnflag").alias("strategy"), F.col("l_quantity").alias("score"), (F.col("l_tax") > 0.02).alias("ok"))
    return quality.group_summary(rows).select("size", "runs", rounded("mean"), "least", "most", rounded("success"), "best")


@query("""SELECT o_orderpriority AS task, round(avg(CASE o_orderstatus WHEN 'F' THEN o_totalprice END) / 500000 * 100, 1) AS ours, round(avg(o_custkey % 100), 1) AS published FROM orders GROUP BY 1""")
def published_comparison(spark, sf_dir):
    """Our scores beside published ones."""
    o = view(spark, sf_dir, "orders")
    ours = o.where("o_orderstatus = 'F'").groupBy(F.col("o_orderpriority").alias("task")).agg((F.avg("o_totalprice") / 500000).alias("score")).withColumn("model", F.lit("ours"))
    theirs = o.groupBy(F.col("o_orderpriority").alias("task")).agg(F.round(F.avg(F.col("o_custkey") % 100), 1).alias("score")).withColumn("model", F.lit("published"))
    return quality.comparison(ours, theirs)


@query("""WITH t AS (SELECT DISTINCT * FROM {onto}), a AS (SELECT d.s AS attribute, d.o AS class, (SELECT max(o) FROM t WHERE s = d.s AND p = 'owl:cardinality') = '1' AS required, (SELECT min(o) FROM t WHERE s = d.s AND p = 'rdfs:range') AS range FROM t AS d WHERE d.p = 'rdfs:domain' AND starts_with(d.s, 'urn:attr#')),
    i AS (SELECT concat('p', p_partkey) AS id, concat('urn:class#', p_type) AS class, concat('urn:attr#', split_part(p_name, ' ', 1)) AS attribute, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'abc' WHEN p_size % 4 = 2 THEN '12' ELSE '2024-01-01' END AS value FROM part),
    n AS (SELECT id, attribute, count(*) AS n FROM i WHERE value IS NOT NULL GROUP BY ALL), m AS (SELECT DISTINCT i.id, a.attribute FROM i JOIN a ON a.class = i.class AND required),
    v AS (SELECT m.id, m.attribute, CASE WHEN n IS NULL THEN 'minCount' ELSE 'maxCount' END AS violation FROM m LEFT JOIN n ON n.id = m.id AND n.attribute = m.attribute WHERE n IS NULL OR n > 1)
    SELECT * FROM v UNION ALL SELECT DISTINCT i.id, i.attribute, 'datatype' FROM i JOIN a ON a.class = i.class AND a.attribute = i.attribute WHERE value IS NOT NULL AND ((range = 'xsd:integer' AND value <> '12') OR (range = 'xsd:float' AND value <> '12') OR (range = 'xsd:date' AND value <> '2024-01-01'))""")
def shape_violations(spark, sf_dir):
    """Instances against counts and datatypes."""
    part = view(spark, sf_dir, "part")
    k = F.col("p_size") % 4
    value = F.when(k == 0, None).when(k == 1, "abc").when(k == 2, "12").otherwise("2024-01-01")
    rows = part.select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("urn:class#"), "p_type").alias("class"), F.concat(F.lit("urn:attr#"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("attribute"), value.alias("value"))
    return quality.shape_violations(onto(spark, sf_dir), rows)


@query(None)
def paired_p_values(spark, sf_dir):
    """Two-sided p of the paired t."""
    found = stats.paired_statistics(stats.paired(view(spark, sf_dir, "results"), "RF", "NO")).select("metric", "n", "t")
    return quality.with_p(found).select("metric", "n", rounded("t"), rounded("p", 6))


@query(PAIRS + """SELECT metric, round(avg(a), 4) AS mean_a, round(avg(b), 4) AS mean_b, round(CASE metric WHEN 'hallucination' THEN (avg(b) - avg(a)) ELSE (avg(a) - avg(b)) END / nullif(abs(avg(b)), 0) * 100, 3) AS improvement FROM q GROUP BY metric""")
def improvements(spark, sf_dir):
    """Improvement in percent, inverted for hallucination."""
    q = stats.paired(view(spark, sf_dir, "results"), "RF", "NO")
    change = F.when(F.col("metric") == "hallucination", F.avg("b") - F.avg("a")).otherwise(F.avg("a") - F.avg("b"))
    by = q.groupBy("metric").agg(F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), (change / F.nullif(F.abs(F.avg("b")), F.lit(0.0)) * 100).alias("improvement"))
    return by.select("metric", rounded("mean_a"), rounded("mean_b"), F.round("improvement", 3).alias("improvement"))


@query("""WITH m AS (SELECT l_returnflag AS system, round(avg(l_quantity) / 50, 6) AS quality, round(avg(l_tax), 6) AS errors FROM lineitem GROUP BY 1), b AS (SELECT max(quality) AS q, min(errors) AS e FROM m)
    SELECT system, concat('| ', system, ' | ', CASE WHEN quality = q THEN printf('**%.3f**', quality) ELSE printf('%.3f', quality) END, ' | ', CASE WHEN errors = e THEN printf('**%.3f**', errors) ELSE printf('%.3f', errors) END, ' |') AS line FROM m, b""")
def markdown_table(spark, sf_dir):
    """A table in Markdown, the best in bold."""
    table = view(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("system")).agg(F.round(F.avg("l_quantity") / 50, 6).alias("quality"), F.round(F.avg("l_tax"), 6).alias("errors"))
    return quality.markdown(table, "system", ["quality", "errors"], ("errors",))


@query("""WITH o AS (SELECT p_partkey, concat(CASE p_size % 12 WHEN 0 THEN 'http://purl.obolibrary.org/obo/ENVO_' WHEN 1 THEN 'http://purl.obolibrary.org/obo/envo.owl#' WHEN 2 THEN 'http://purl.bioontology.org/ontology/SNOMEDCT/' WHEN 3 THEN 'https://spec.edmcouncil.org/fibo/' WHEN 4 THEN 'http://www.geonames.org/x' WHEN 5 THEN 'https://schema.org/Thing'
    WHEN 6 THEN 'http://www.w3.org/ns/prov#' WHEN 7 THEN 'http://example.org/plan.owl#C' WHEN 8 THEN 'http://example.org/OBI_' WHEN 9 THEN 'http://dbpedia.org/resource/A' WHEN 10 THEN 'http://example.org/FOODON/foodon_' ELSE 'http://example.org/core.rdf' END, CASE WHEN p_size % 12 IN (0, 2, 8, 10) THEN p_partkey::VARCHAR ELSE '' END) AS iri,
    CASE p_size % 12 WHEN 0 THEN 'ENVO' WHEN 1 THEN 'ENVO' WHEN 2 THEN 'SNOMEDCT' WHEN 3 THEN 'FIBO' WHEN 4 THEN 'GeoNames' WHEN 5 THEN 'Schema.org' WHEN 6 THEN 'W3C' WHEN 7 THEN 'plan' WHEN 8 THEN 'OBI' WHEN 9 THEN 'DBpedia' WHEN 10 THEN 'FoodOn' ELSE 'core' END AS name FROM part)
    SELECT name, count(*) AS iris FROM o GROUP BY name""")
def ontology_names(spark, sf_dir):
    """Ontologies by the names in their IRIs."""
    # One IRI of each kind.
    kinds = (
        "http://purl.obolibrary.org/obo/ENVO_", "http://purl.obolibrary.org/obo/envo.owl#", "http://purl.bioontology.org/ontology/SNOMEDCT/", "https://spec.edmcouncil.org/fibo/", "http://www.geonames.org/x", "https://schema.org/Thing",
        "http://www.w3.org/ns/prov#", "http://example.org/plan.owl#C", "http://example.org/OBI_", "http://dbpedia.org/resource/A", "http://example.org/FOODON/foodon_", "http://example.org/core.rdf",
    )
    at = F.col("p_size") % 12
    iri = F.concat(F.element_at(F.array(*map(F.lit, kinds)), (at + 1).cast("int")), F.when(at.isin(0, 2, 8, 10), F.col("p_partkey").cast("string")).otherwise(""))
    return view(spark, sf_dir, "part").groupBy(replies.ontology_name(iri).alias("name")).agg(F.count("*").alias("iris"))
