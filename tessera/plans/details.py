"""Hierarchy statistics, cases of reduction, inherited shapes, explanations and contexts over the bound ontology and graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import gaps, graph, layers, metrics, patterns, quality, retrieval, stats
from tessera.plans.analytics import PAIRS
from tessera.plans.binding import view
from tessera.plans.patterns import onto
from tessera.plans.quality import SIDES, sides
from tessera.plans.registered import query, rounded


@query("""WITH RECURSIVE t AS (SELECT DISTINCT child, parent FROM {class_tree}), c AS (SELECT DISTINCT child AS uri FROM t WHERE length(child) % 7 > 0 UNION SELECT n_name FROM nation), d(node, depth) AS (SELECT 'Thing', 0 UNION SELECT child, depth + 1 FROM d JOIN t ON parent = node),
    m AS (SELECT node, min(depth) AS depth FROM d GROUP BY node), k AS (SELECT parent AS node, count(*) AS n FROM t GROUP BY parent), r AS (SELECT uri, depth, n, uri IN (SELECT child FROM t) AS below FROM c LEFT JOIN m ON m.node = uri LEFT JOIN k ON k.node = uri)
    SELECT count(*) AS classes, coalesce(min(depth), 0) AS depth_min, coalesce(max(depth), 0) AS depth_max, round(avg(depth), 4) AS depth_mean, quantile_cont(depth, 0.5) AS depth_median, round(stddev_samp(depth), 4) AS depth_stdev, round(avg(n), 4) AS branching_mean, max(n) AS branching_max,
    round(avg(CASE WHEN n IS NULL THEN 1 ELSE 0 END), 4) AS leaf_ratio, count_if(NOT below AND uri <> 'Thing') AS orphans FROM r""")
def hierarchy_metrics(spark, sf_dir):
    """Depths from the top class, branching, leaves and orphans."""
    tree = view(spark, sf_dir, "class_tree")
    classes = tree.where("length(child) % 7 > 0").select(F.col("child").alias("uri")).union(view(spark, sf_dir, "nation").select("n_name"))
    found = graph.hierarchy_metrics(classes, tree, "Thing")
    return found.select("classes", "orphans", *[rounded(c) for c in found.columns if c not in ("classes", "orphans")])


DEPENDENT = """WITH t AS (SELECT DISTINCT * FROM {onto}), d AS (SELECT DISTINCT o AS uri, s AS property FROM t WHERE p IN ('rdfs:domain', 'rdfs:range') AND s IN (SELECT s FROM t WHERE p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty')))"""


@query(DEPENDENT + " SELECT uri, property FROM d")
def dependent_properties(spark, sf_dir):
    """Properties that have a class as domain or range."""
    return layers.dependent_properties(onto(spark, sf_dir))


@query(DEPENDENT + """, c AS (SELECT DISTINCT s AS uri FROM t WHERE p = 'rdf:type' AND o IN ('owl:Class', 'rdfs:Class')), n AS (SELECT uri, count(*) AS n FROM d GROUP BY uri), r AS (SELECT c.uri, coalesce(n, 0) AS dependents, row_number() OVER (ORDER BY coalesce(n, 0), md5(concat('42:', c.uri)), c.uri) AS nth, count(*) OVER () AS total FROM c LEFT JOIN n ON n.uri = c.uri)
    SELECT uri, dependents, nth FROM r WHERE nth <= greatest(1, floor(total * 0.75))""")
def shuffled_periphery(spark, sf_dir):
    """Three quarters of the classes, those with fewest dependent properties first, shuffled by a seed."""
    t = onto(spark, sf_dir)
    return layers.shuffled_periphery(patterns.typed(t, patterns.CLASSES), layers.dependent_properties(t), 0.75, 42)


@query("""WITH e AS (SELECT * FROM {kg_edges}), b AS (SELECT src AS a, dst AS z FROM e WHERE src <> dst UNION SELECT dst, src FROM e WHERE src <> dst), g AS (SELECT a AS id, least(count(*), 20) AS degree FROM b GROUP BY a), r AS (SELECT entity_type, id, row_number() OVER (PARTITION BY entity_type ORDER BY id) AS n FROM {kg_nodes})
    SELECT entity_type, count(*) AS entities, round(avg(coalesce(degree, 0)), 4) AS score FROM r LEFT JOIN g USING (id) WHERE n <= 5 GROUP BY entity_type""")
def structural_scores(spark, sf_dir):
    """Neighbours, up to twenty, of each type's first five entities; both limits are the feature."""
    entities = view(spark, sf_dir, "kg_nodes").select("entity_type", F.col("id").alias("seq"), "id")
    return gaps.structural_scores(entities, graph.degrees(view(spark, sf_dir, "kg_edges"))).select("entity_type", "entities", rounded("score"))


@query("""WITH g AS (SELECT p_type AS entity_type, count(*) AS frequency, CASE WHEN length(p_type) % 2 = 0 THEN min(p_brand) END AS closest_class, count(DISTINCT p_brand) / 25.0e0 AS distance, list_sort(list(DISTINCT p_brand)) AS examples, CASE WHEN length(p_type) % 3 = 0 THEN max(p_name) END AS evidence FROM part GROUP BY p_type)
    SELECT entity_type, concat('Gap Candidate: ', entity_type, chr(10), '  Frequency: ', frequency, chr(10), '  Closest seed class: ', coalesce(closest_class, 'none'), chr(10), '  Semantic distance: ', printf('%.2f', distance), chr(10), '  Examples: ', array_to_string(examples[1:3], ', '), chr(10), chr(10), coalesce(evidence, '(No graph evidence found for this gap candidate.)')) AS context FROM g""")
def gap_contexts(spark, sf_dir):
    """What is known of each gap, as text."""
    n = F.length("entity_type")
    found = view(spark, sf_dir, "part").groupBy(F.col("p_type").alias("entity_type")).agg(F.count("*").alias("frequency"), F.min("p_brand").alias("b"), (F.countDistinct("p_brand") / 25.0).alias("distance"), F.array_sort(F.collect_set("p_brand")).alias("examples"), F.max("p_name").alias("e"))
    return gaps.gap_contexts(found.withColumns({"closest_class": F.when(n % 2 == 0, F.col("b")), "evidence": F.when(n % 3 == 0, F.col("e"))}))


@query("""WITH x AS (SELECT l_orderkey AS path_id, count(*) AS length, 0.4 * avg(1 - l_discount) AS confidence, 0.45 * avg(CASE WHEN contains(lower(p_type), 'large') OR contains(lower(p_type), 'promo') THEN 1 ELSE 0 END) AS relevance, 0.15 / count(*) AS brevity FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY l_orderkey)
    SELECT path_id, length, round(confidence, 4) AS confidence, round(relevance, 4) AS relevance, round(brevity, 4) AS brevity, round(confidence + relevance + brevity, 4) AS score FROM x""")
def path_breakdown(spark, sf_dir):
    """What each path's score is made of."""
    rows = view(spark, sf_dir, "lineitem").join(view(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    relations = rows.select(F.col("l_orderkey").alias("path_id"), F.col("p_type").alias("rel"), (1 - F.col("l_discount")).alias("confidence"))
    return retrieval.path_breakdown(relations, ["LARGE", "PROMO"]).select("path_id", "length", *[rounded(c) for c in ("confidence", "relevance", "brevity", "score")])


@query(SIDES + ", " + ", ".join(f"{t}e AS (SELECT d.s, d.o AS a, r.o AS b FROM {t} AS d JOIN {t} AS r ON r.s = d.s AND r.p = 'rdfs:range' WHERE d.p = 'rdfs:domain')" for t in "gk") + """, x AS (SELECT (SELECT count(*) FROM (SELECT * FROM ge INTERSECT SELECT * FROM ke) AS i) AS matched, (SELECT count(*) FROM ge) AS predicted, (SELECT count(*) FROM ke) AS expected)
    SELECT matched, predicted, expected, round(matched / predicted, 4) AS precision, round(matched / expected, 4) AS recall, round(2.0 * matched / (predicted + expected), 4) AS f1 FROM x""")
def property_end_f1(spark, sf_dir):
    """Domains and ranges of a generated ontology against gold's."""
    ends = lambda t: patterns.pairs(t, "rdfs:domain", "uri", "domain").join(patterns.pairs(t, "rdfs:range", "uri", "range"), "uri")
    generated, gold = sides(spark, sf_dir)
    found = metrics.edge_f1(ends(generated), ends(gold))
    return found.select("matched", "predicted", "expected", rounded("precision"), rounded("recall"), rounded("f1"))


@query("""WITH RECURSIVE t AS (SELECT DISTINCT * FROM {onto}), up(n, a) AS (SELECT s, o FROM t WHERE p = 'rdfs:subClassOf' UNION SELECT n, o FROM up JOIN t ON s = a AND p = 'rdfs:subClassOf'), i AS (SELECT concat('p', p_partkey) AS id, concat('urn:class#', p_brand, '/', p_type) AS class, concat('urn:attr#', split_part(p_name, ' ', 1)) AS attribute,
        CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'abc' WHEN p_size % 4 = 2 THEN '12' ELSE '2024-01-01' END AS value FROM part UNION ALL SELECT concat('p', p_partkey), concat('urn:class#', p_brand, '/', p_type), concat('urn:prop#', p_brand), CASE WHEN p_partkey % 2 = 0 THEN concat('n', p_partkey % 25) ELSE concat('p', p_partkey) END FROM part
        UNION ALL SELECT concat('n', n_nationkey), concat('urn:class#', n_name), 'urn:none', NULL FROM nation),
    y AS (SELECT DISTINCT id, class FROM i UNION SELECT id, a FROM i JOIN up ON n = class), v AS (SELECT DISTINCT id, attribute, value FROM i WHERE value IS NOT NULL),
    r AS (SELECT d.s AS attribute, d.o AS class, (SELECT max(o) FROM t WHERE s = d.s AND p = 'owl:cardinality') = '1' AS required, (SELECT min(o) FROM t WHERE s = d.s AND p = 'rdfs:range') AS range FROM t AS d WHERE d.p = 'rdfs:domain' AND starts_with(d.s, 'urn:attr#')),
    due AS (SELECT id, attribute, bool_or(coalesce(required, false)) AS required, min(range) AS range FROM y JOIN r USING (class) GROUP BY id, attribute), n AS (SELECT id, attribute, count(*) AS n FROM v GROUP BY ALL),
    o AS (SELECT DISTINCT y.id, d.s AS attribute, g.o AS range, value FROM y JOIN t AS d ON d.o = y.class AND d.p = 'rdfs:domain' AND starts_with(d.s, 'urn:prop#') JOIN t AS g ON g.s = d.s AND g.p = 'rdfs:range' JOIN v ON v.id = y.id AND v.attribute = d.s)
    SELECT id, attribute, CASE WHEN n IS NULL THEN 'minCount' ELSE 'maxCount' END AS violation FROM due LEFT JOIN n USING (id, attribute) WHERE required AND (n IS NULL OR n > 1)
    UNION ALL SELECT DISTINCT id, attribute, 'datatype' FROM due JOIN v USING (id, attribute) WHERE (range = 'xsd:integer' AND value <> '12') OR (range = 'xsd:float' AND value <> '12') OR (range = 'xsd:date' AND value <> '2024-01-01')
    UNION ALL SELECT DISTINCT id, attribute, 'class' FROM o WHERE concat(value, '|', range) NOT IN (SELECT concat(id, '|', class) FROM y)""")
def inherited_violations(spark, sf_dir):
    """Instances against what their classes and all ancestors ask for, and values against property ranges."""
    part, nation = view(spark, sf_dir, "part"), view(spark, sf_dir, "nation")
    key, k = F.col("p_partkey"), F.col("p_size") % 4
    named = lambda c: F.concat(F.lit("p"), c.cast("string"))
    cls = F.concat(F.lit("urn:class#"), "p_brand", F.lit("/"), "p_type").alias("class")
    value = F.when(k == 0, None).when(k == 1, "abc").when(k == 2, "12").otherwise("2024-01-01")
    rows = part.select(named(key).alias("id"), cls, F.concat(F.lit("urn:attr#"), F.split_part("p_name", F.lit(" "), F.lit(1))).alias("attribute"), value.alias("value"))
    other = F.when(key % 2 == 0, F.concat(F.lit("n"), (key % 25).cast("string"))).otherwise(named(key))
    rows = rows.unionByName(part.select(named(key).alias("id"), cls, F.concat(F.lit("urn:prop#"), "p_brand").alias("attribute"), other.alias("value")))
    rows = rows.unionByName(nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id"), F.concat(F.lit("urn:class#"), "n_name").alias("class"), F.lit("urn:none").alias("attribute"), F.lit(None).cast("string").alias("value")))
    return quality.inherited_violations(onto(spark, sf_dir), rows)


@query(PAIRS + " SELECT metric, count(*) AS n, round(avg(a - b), 4) AS difference FROM q GROUP BY metric")
def strict_pairs(spark, sf_dir):
    """Pairs of two systems that have results on the same test cases; others are an error."""
    r = view(spark, sf_dir, "results")
    both = r.where("system in ('RF', 'NO')").groupBy("test_case", "level").agg(F.countDistinct("system").alias("k")).where("k = 2").select("test_case", "level")
    pairs = stats.paired_strictly(r.join(both, ["test_case", "level"], "left_semi"), "RF", "NO")
    return pairs.groupBy("metric").agg(F.count("*").alias("n"), F.avg(F.col("a") - F.col("b")).alias("difference")).select("metric", "n", rounded("difference"))
