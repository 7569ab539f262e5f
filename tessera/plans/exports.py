"""Exports and changes of the bound ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import exports, feedback, layers
from tessera.plans.binding import view
from tessera.plans.patterns import EXPORT, ONTO, onto
from tessera.plans.registered import query
from tessera.sources import ontologies

LOCAL = "split_part(split_part({}, '#', -1), '/', -1)"


@query(ONTO + f"SELECT concat({LOCAL.format('s')}, ' ', split_part(p, ':', -1), ' ', {LOCAL.format('o')}) AS sentence FROM t")
def triple_sentences(spark, sf_dir):
    """H18."""
    return exports.sentences(onto(spark, sf_dir))


@query("""WITH e AS (SELECT * FROM {kg_edges}), n AS (SELECT * FROM {kg_nodes})
    SELECT src, dst, concat(coalesce(a.label, src), ' -[', rel, ']-> ', coalesce(b.label, dst)) AS line FROM e LEFT JOIN n AS a ON a.id = src LEFT JOIN n AS b ON b.id = dst""")
def subgraph_text(spark, sf_dir):
    """Edges as lines of text."""
    return exports.subgraph_text(view(spark, sf_dir, "kg_edges"), view(spark, sf_dir, "kg_nodes"))


OWN = """, k AS (SELECT s, max(o) AS n FROM t WHERE p = 'owl:cardinality' GROUP BY s), g AS (SELECT uri, min(range) AS range FROM r GROUP BY uri),
    w AS (SELECT domain AS class, d.uri AS attribute, g.range, k.n, CASE WHEN g.range LIKE '%string' THEN 'string' WHEN g.range LIKE '%integer' THEN 'integer' WHEN g.range LIKE '%float' THEN 'float' ELSE 'date' END AS kind
          FROM d JOIN a ON a.uri = d.uri LEFT JOIN g ON g.uri = d.uri LEFT JOIN k ON k.s = d.uri) """


@query(ONTO + OWN + """, b AS (SELECT class, string_agg(line, chr(10) ORDER BY line) AS body FROM (SELECT class, concat('  sh:property [ sh:path ', attribute, ' ; sh:datatype ', range,
    CASE WHEN n = '1' THEN ' ; sh:minCount 1 ; sh:maxCount 1' WHEN n IS NOT NULL THEN ' ; sh:minCount 0' ELSE '' END, ' ]') AS line FROM w) AS x GROUP BY class)
    SELECT uri, concat(uri, 'Shape a sh:NodeShape', chr(10), '  sh:targetClass ', uri, CASE WHEN body IS NULL THEN '' ELSE concat(chr(10), body) END) AS shape FROM c LEFT JOIN b ON class = uri""")
def class_shapes(spark, sf_dir):
    """A shape for every class."""
    return exports.shapes(onto(spark, sf_dir))


@query(ONTO + OWN + f""", b AS (SELECT class, string_agg(concat('{{{{"p":"', attribute, '","o":"$(', {LOCAL.format('attribute')}, ')', CASE kind WHEN 'string' THEN '' ELSE concat('~', kind) END, '"}}}}'), ',' ORDER BY attribute) AS po FROM w GROUP BY class)
    SELECT uri AS class, concat('{{{{"s":"data:', {LOCAL.format('uri')}, '/$(id)","type":"', uri, '","po":[', coalesce(po, ''), ']}}}}') AS document FROM c LEFT JOIN b ON class = uri""".replace("{{", "{").replace("}}", "}"))
def class_mappings(spark, sf_dir):
    """A mapping document for every class."""
    return exports.mappings(onto(spark, sf_dir))


CID = "concat(CASE WHEN regexp_matches({0}, '^[A-Z]') THEN 'cls:' ELSE 'rel:' END, {0})"


@query(ONTO + OWN + EXPORT + f""", j AS (SELECT class, string_agg(concat('{{"id":"', {CID.format(LOCAL.format('attribute'))}, '","dataType":"', kind, '","required":', CASE WHEN n = '1' THEN 'true' ELSE 'false' END, '}}'), ',' ORDER BY attribute) AS items FROM w GROUP BY class)
    SELECT uri, concat('{{"id":"', {CID.format(LOCAL.format('uri'))}, '","label":"', lower(regexp_replace({LOCAL.format('uri')}, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '","parent":"', CASE WHEN parent IS NULL THEN '' ELSE {CID.format(LOCAL.format('parent'))} END,
    '","attributes":[', coalesce(items, ''), ']}}') AS json FROM x LEFT JOIN j ON class = uri""")
def nested_ontology(spark, sf_dir):
    """Classes with attributes as JSON."""
    return exports.nested(onto(spark, sf_dir))


@query("""SELECT id, concat('ex:', replace(id, ':', '_'), ' a ex:', replace(entity_type, ' ', '_'), ' ; rdfs:label "', replace(replace(label, chr(92), concat(chr(92), chr(92))), '"', concat(chr(92), '"')), '" .') AS turtle FROM {kg_nodes}""")
def turtle_nodes(spark, sf_dir):
    """H21."""
    return exports.turtle(view(spark, sf_dir, "kg_nodes"))


@query("""WITH r AS (SELECT concat('urn:evidence#', event_id) AS ev, concat('urn:element#', user_id) AS element, concat('doc', event_id % 50) AS document, props AS passage, floor(value) / 1000.0 AS confidence, user_id % 7 + 1 AS phase FROM events)
    SELECT DISTINCT s, p, o FROM (SELECT ev AS s, 'rdf:type' AS p, 'prov:Entity' AS o FROM r UNION ALL SELECT ev, 'prov:wasQuotedFrom', document FROM r UNION ALL SELECT ev, 'prov:value', passage FROM r
    UNION ALL SELECT ev, 'ex:confidence', printf('%.4f', confidence) FROM r UNION ALL SELECT ev, 'ex:phase', CAST(phase AS VARCHAR) FROM r UNION ALL SELECT element, 'prov:wasDerivedFrom', ev FROM r) AS x WHERE o IS NOT NULL""")
def provenance_triples(spark, sf_dir):
    """Evidence records as triples."""
    return exports.provenance(evidence(spark, sf_dir))


def evidence(spark, sf_dir):
    e = view(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("seq"), F.concat(F.lit("urn:element#"), F.col("user_id").cast("string")).alias("element"), F.concat(F.lit("doc"), (F.col("event_id") % 50).cast("string")).alias("document"),
                    F.col("props").alias("passage"), (F.floor("value") / 1000.0).alias("confidence"), (F.col("user_id") % 7 + 1).alias("phase"))


NEW = """, w AS (SELECT concat('urn:new#', c_custkey) AS uri, c_name AS label, concat('urn:class#', c_mktsegment) AS parent, CASE WHEN c_custkey % 2 = 0 THEN concat('Customer ', c_custkey) END AS comment FROM customer),
    f AS (SELECT uri AS s, 'rdf:type' AS p, 'owl:Class' AS o FROM w UNION ALL SELECT uri, 'rdfs:label', label FROM w UNION ALL SELECT uri, 'rdfs:subClassOf', parent FROM w UNION ALL SELECT uri, 'rdfs:comment', comment FROM w WHERE comment IS NOT NULL) """


def new_classes(spark, sf_dir):
    c = view(spark, sf_dir, "customer")
    note = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("Customer "), F.col("c_custkey").cast("string")))
    return c.select(F.concat(F.lit("urn:new#"), F.col("c_custkey").cast("string")).alias("uri"), F.col("c_name").alias("label"), F.concat(F.lit("urn:class#"), "c_mktsegment").alias("parent"), note.alias("comment"))


@query("WITH z AS (SELECT 1)" + NEW + "SELECT DISTINCT graph, s, p, o FROM (SELECT graph, s, p, o FROM {triples} UNION ALL SELECT 'urn:graph:staging', s, p, o FROM f) AS x")
def insert_classes(spark, sf_dir):
    """New classes as triples of the staging graph."""
    return exports.inserted(view(spark, sf_dir, "triples"), new_classes(spark, sf_dir), "urn:graph:staging").select("graph", "s", "p", "o")


@query("""WITH t AS (SELECT DISTINCT graph, s, p, o FROM {triples}), m AS (SELECT DISTINCT concat('urn:class#', n_name) AS uri FROM nation)
    SELECT * FROM t WHERE NOT (graph = 'urn:graph:seed' AND p = 'rdfs:subClassOf' AND s IN (SELECT uri FROM m)) UNION SELECT 'urn:graph:seed', uri, 'rdfs:subClassOf', 'urn:class#World' FROM m""")
def reparent_classes(spark, sf_dir):
    """Nations moved up."""
    moves = view(spark, sf_dir, "nation").select(F.concat(F.lit("urn:class#"), "n_name").alias("uri"), F.lit("urn:class#World").alias("parent"))
    return exports.reparented(view(spark, sf_dir, "triples"), moves, layers.SEED).select("graph", "s", "p", "o")


@query("""WITH c AS (SELECT l_orderkey AS batch, CAST(l_linenumber AS BIGINT) * 1000000000 + l_partkey * 10000 + l_suppkey AS seq, bool_and(l_returnflag <> 'R') AS ok FROM lineitem GROUP BY ALL),
    b AS (SELECT *, coalesce(sum(CASE WHEN ok THEN 0 ELSE 1 END) OVER (PARTITION BY batch ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS n FROM c)
    SELECT batch, seq, CASE WHEN n > 0 THEN 'skipped' WHEN ok THEN 'applied' ELSE 'failed' END AS status FROM b""")
def bulk_changes(spark, sf_dir):
    """A batch stops at its first error."""
    seq = F.col("l_linenumber").cast("long") * 1_000_000_000 + F.col("l_partkey") * 10_000 + F.col("l_suppkey")
    rows = view(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("batch"), seq.alias("seq")).agg(F.bool_and(F.col("l_returnflag") != "R").alias("ok"))
    return exports.bulk(rows)


@query("""WITH d AS (SELECT proposal, max_by(decision, seq) AS decision FROM {decisions} GROUP BY proposal), w AS (SELECT p.id, p.label, p.parent FROM (SELECT * FROM {proposals}) AS p JOIN d ON d.proposal = p.id WHERE decision = 'accept')
    SELECT DISTINCT s, p, o FROM (SELECT s, p, o FROM {triples} WHERE graph = 'urn:graph:seed' UNION ALL SELECT concat('urn:new#', id), 'rdf:type', 'owl:Class' FROM w
    UNION ALL SELECT concat('urn:new#', id), 'rdfs:label', label FROM w UNION ALL SELECT concat('urn:new#', id), 'rdfs:subClassOf', concat('urn:class#', parent) FROM w) AS x""")
def seeded_export(spark, sf_dir):
    """The seed with accepted proposals."""
    accepted = feedback.accepted(view(spark, sf_dir, "proposals"), view(spark, sf_dir, "decisions"))
    return exports.seeded_export(view(spark, sf_dir, "triples"), accepted, layers.SEED)


@query("SELECT DISTINCT s, p, o FROM {triples} WHERE graph = 'urn:graph:ext-v2'")
def layer_export(spark, sf_dir):
    """One layer; a missing one is an error."""
    return exports.layer(view(spark, sf_dir, "triples"), "urn:graph:ext-v2")


@query("""WITH c AS (SELECT concat('customer', c_custkey, '.ttl') AS file, concat('urn:c#c', c_custkey) AS s, * FROM customer)
    SELECT file, s, 'http://www.w3.org/1999/02/22-rdf-syntax-ns#type' AS p, concat('urn:k#', c_mktsegment) AS o, 'iri' AS o_kind, NULL AS o_datatype, NULL AS o_lang FROM c
    UNION ALL SELECT file, s, 'http://www.w3.org/2000/01/rdf-schema#label', c_name, 'literal', NULL, 'en' FROM c
    UNION ALL SELECT file, s, 'urn:k#nation', CAST(c_nationkey AS VARCHAR), 'literal', 'http://www.w3.org/2001/XMLSchema#integer', NULL FROM c
    UNION ALL SELECT file, s, 'urn:k#near', concat('urn:c#c', c_custkey + 1), 'iri', NULL, NULL FROM c UNION ALL SELECT file, s, 'urn:k#near', concat('urn:c#c', c_custkey + 2), 'iri', NULL, NULL FROM c""")
def parsed_turtle(spark, sf_dir):
    """Triples of Turtle documents, one made of each customer."""
    key = F.col("c_custkey").cast("string")
    head = F.lit("@prefix rdfs: <http://www.w3.org/2000/01/rdf-schema#> . PREFIX k: <urn:k#>\n@base <urn:c> . # customers\n")
    body = [F.lit("<#c"), key, F.lit("> a k:"), F.col("c_mktsegment"), F.lit(' ;\n  rdfs:label "'), F.col("c_name"), F.lit('"@en ; k:nation '), F.col("c_nationkey").cast("string")]
    near = [F.lit(" ;\n  k:near <urn:c#c"), (F.col("c_custkey") + 1).cast("string"), F.lit(">, <urn:c#c"), (F.col("c_custkey") + 2).cast("string"), F.lit("> .\n")]
    files = view(spark, sf_dir, "customer").select(F.concat(F.lit("customer"), key, F.lit(".ttl")).alias("file"), F.concat(head, *body, *near).alias("content"))
    return ontologies.parse_files(files)
