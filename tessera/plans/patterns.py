"""Graph patterns over the bound ontology."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import patterns
from tessera.plans.binding import view
from tessera.plans.registered import query

ONTO = """WITH t AS (SELECT DISTINCT * FROM {onto}), l AS (SELECT s AS uri, min(o) AS label FROM t WHERE p = 'rdfs:label' GROUP BY s),
    c AS (SELECT DISTINCT s AS uri FROM t WHERE p = 'rdf:type' AND o IN ('owl:Class', 'rdfs:Class')),
    q AS (SELECT DISTINCT s AS uri FROM t WHERE p = 'rdf:type' AND o = 'owl:ObjectProperty'),
    a AS (SELECT DISTINCT s AS uri FROM t WHERE p = 'rdf:type' AND o = 'owl:DatatypeProperty'),
    d AS (SELECT s AS uri, o AS domain FROM t WHERE p = 'rdfs:domain'), r AS (SELECT s AS uri, o AS range FROM t WHERE p = 'rdfs:range'),
    up AS (SELECT s AS uri, min(o) AS parent FROM t WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:') GROUP BY s),
    cp AS (SELECT c.uri, coalesce(label, regexp_extract(c.uri, '[^#/]*$')) AS label, parent FROM c LEFT JOIN l ON l.uri = c.uri LEFT JOIN up ON up.uri = c.uri)
    """


def onto(spark, sf_dir):
    return view(spark, sf_dir, "onto")


@query(ONTO + "SELECT c.uri, o AS label FROM c JOIN t ON t.s = c.uri AND p = 'rdfs:label' WHERE lower(o) = 'france' OR lower(o) = 'large' ORDER BY c.uri LIMIT 1")
def class_by_label(spark, sf_dir):
    """One class by its label (the limit is the feature)."""
    found = patterns.class_by_label(onto(spark, sf_dir), "france").union(patterns.class_by_label(onto(spark, sf_dir), "LARGE"))
    return found.orderBy("uri").limit(1)


@query(ONTO + "SELECT s AS uri, o AS synonym FROM t WHERE p = 'skos:altLabel'")
def class_synonyms(spark, sf_dir):
    """B03."""
    return patterns.synonyms(onto(spark, sf_dir))


@query(ONTO + "SELECT domain AS class, d.uri AS property, range, o AS label FROM d JOIN r ON r.uri = d.uri JOIN t ON t.s = d.uri AND p = 'rdfs:label'")
def domain_properties(spark, sf_dir):
    """Properties of classes with range and label."""
    return patterns.domain_properties(onto(spark, sf_dir))


@query(ONTO + "SELECT * FROM cp")
def classes_with_parent(spark, sf_dir):
    """Classes with one parent."""
    return patterns.classes_with_parent(onto(spark, sf_dir))


ENDS = ", x AS (SELECT uri, string_agg(DISTINCT domain, '|' ORDER BY domain) AS domains FROM d GROUP BY uri), y AS (SELECT uri, string_agg(DISTINCT range, '|' ORDER BY range) AS ranges FROM r GROUP BY uri) "


@query(ONTO + ENDS + """SELECT q.uri, coalesce(label, regexp_extract(q.uri, '[^#/]*$')) AS label, coalesce(domains, '') AS domains, coalesce(ranges, '') AS ranges
    FROM q LEFT JOIN l ON l.uri = q.uri LEFT JOIN x ON x.uri = q.uri LEFT JOIN y ON y.uri = q.uri""")
def object_property_list(spark, sf_dir):
    """Object properties with domains and ranges."""
    return patterns.object_properties(onto(spark, sf_dir))


EDGES = ", e AS (SELECT o AS parent, s AS child FROM t WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:') AND s IN (SELECT uri FROM c) AND o IN (SELECT uri FROM c)) "


@query(ONTO + EDGES + "SELECT * FROM e")
def class_edges(spark, sf_dir):
    """B07."""
    return patterns.class_edges(onto(spark, sf_dir))


@query(ONTO + EDGES + "SELECT (SELECT count(*) FROM c) AS classes, (SELECT count(*) FROM q) AS properties, (SELECT count(*) FROM e) AS edges")
def ontology_summary(spark, sf_dir):
    """B08."""
    return patterns.ontology_summary(onto(spark, sf_dir))


@query(ONTO + "SELECT cp.uri, cp.label, parent, coalesce(l.label, regexp_extract(parent, '[^#/]*$')) AS parent_label FROM cp LEFT JOIN l ON l.uri = parent")
def hierarchy_rows(spark, sf_dir):
    """The hierarchy with labels of both ends."""
    return patterns.hierarchy_rows(onto(spark, sf_dir))


@query(ONTO + """SELECT cp.uri, concat('- ', cp.label, CASE WHEN parent IS NULL THEN ' (root)' ELSE concat(' < ', coalesce(l.label, regexp_extract(parent, '[^#/]*$'))) END) AS line
    FROM cp LEFT JOIN l ON l.uri = parent""")
def hierarchy_text(spark, sf_dir):
    """A line for each class."""
    return patterns.hierarchy_text(onto(spark, sf_dir))


@query(ONTO + """SELECT q.uri, l.label, domain, m.label AS domain_label, range, n.label AS range_label FROM q LEFT JOIN l ON l.uri = q.uri LEFT JOIN d ON d.uri = q.uri
    LEFT JOIN l AS m ON m.uri = domain LEFT JOIN r ON r.uri = q.uri LEFT JOIN l AS n ON n.uri = range""")
def relation_list(spark, sf_dir):
    """B10."""
    return patterns.relations(onto(spark, sf_dir))


@query(ONTO + """SELECT domain AS class, d.uri AS attribute, g.range, CASE WHEN g.range LIKE '%string' THEN 'string' WHEN g.range LIKE '%integer' THEN 'integer' WHEN g.range LIKE '%float' THEN 'float' ELSE 'date' END AS kind,
    k.o AS cardinality, coalesce(k.o = '1', false) AS required FROM d JOIN a ON a.uri = d.uri LEFT JOIN (SELECT uri, min(range) AS range FROM r GROUP BY uri) AS g ON g.uri = d.uri
    LEFT JOIN (SELECT s, max(o) AS o FROM t WHERE p = 'owl:cardinality' GROUP BY s) AS k ON k.s = d.uri""")
def class_attributes(spark, sf_dir):
    """Datatype properties of classes with their JSON types."""
    return patterns.class_attributes(onto(spark, sf_dir))


@query(ONTO + """SELECT q.uri, coalesce(label, regexp_extract(q.uri, '[^#/]*$')) AS label, o AS inverse FROM q LEFT JOIN l ON l.uri = q.uri LEFT JOIN t ON t.s = q.uri AND p = 'owl:inverseOf'""")
def inverse_relations(spark, sf_dir):
    """B12."""
    return patterns.inverse_relations(onto(spark, sf_dir))


@query(ONTO + """SELECT b.uri, kind, domain, range FROM (SELECT uri, 'object' AS kind FROM q UNION ALL SELECT uri, 'data' FROM a) AS b LEFT JOIN d ON d.uri = b.uri LEFT JOIN r ON r.uri = b.uri""")
def property_load(spark, sf_dir):
    """B13."""
    return patterns.property_load(onto(spark, sf_dir))


ASKED = ", k AS (SELECT DISTINCT concat('urn:class#', n_name) AS uri FROM nation UNION SELECT concat('urn:class#', c_mktsegment) FROM customer UNION SELECT concat('urn:prop#', p_brand) FROM part) "


def asked(spark, sf_dir):
    named = lambda table, kind, c: view(spark, sf_dir, table).select(F.concat(F.lit(f"urn:{kind}#"), c).alias("uri"))
    return named("nation", "class", "n_name").union(named("customer", "class", "c_mktsegment")).union(named("part", "prop", "p_brand")).distinct()


@query(ONTO + ASKED + "SELECT uri, uri IN (SELECT s FROM t UNION SELECT o FROM t) AS present FROM k")
def iri_existence(spark, sf_dir):
    """Whether an IRI occurs in any triple."""
    return patterns.existing(onto(spark, sf_dir), asked(spark, sf_dir))


@query(ONTO + ASKED + "SELECT uri, uri IN (SELECT uri FROM c) AS present FROM k")
def class_existence(spark, sf_dir):
    """Whether an IRI is a class of the ontology or a layer of it."""
    return patterns.existing_classes(onto(spark, sf_dir), asked(spark, sf_dir))


@query(ONTO + """SELECT CASE WHEN count_if(p IN ('owl:disjointWith', 'owl:cardinality')) > 0 THEN 'DL' WHEN count_if(p = 'owl:inverseOf') > 0 THEN 'QL' ELSE 'RDFS' END AS profile FROM t""")
def owl_profile(spark, sf_dir):
    """B26."""
    return patterns.owl_profile(onto(spark, sf_dir))


AT = ", n AS (SELECT domain AS class, uri AS property, 0 AS \"end\" FROM d UNION ALL SELECT range, uri, 1 FROM r) "


@query(ONTO + AT + "SELECT class, regexp_extract(property, '[^#/]*$') AS property, \"end\" FROM n".replace("regexp_extract(property, '[^#/]*$')", "split_part(property, '#', -1)"))
def relations_for_type(spark, sf_dir):
    """Properties of each type by end."""
    return patterns.relations_for_type(onto(spark, sf_dir))


@query(ONTO + AT + "SELECT DISTINCT n.class, m.class AS related FROM n JOIN n AS m ON n.property = m.property AND n.\"end\" = 1 - m.\"end\" WHERE n.class <> m.class")
def related_types(spark, sf_dir):
    """Types at the other end of a property."""
    return patterns.related_types(onto(spark, sf_dir))


NAMES = """, k AS (SELECT DISTINCT split_part(split_part(uri, '#', -1), '/', -1) AS name FROM c),
    e AS (SELECT DISTINCT split_part(split_part(s, '#', -1), '/', -1) AS name, split_part(split_part(o, '#', -1), '/', -1) AS parent FROM t WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:')),
    z AS (SELECT DISTINCT split_part(split_part(domain, '#', -1), '/', -1) AS name, split_part(uri, '#', -1) AS property, 0 AS n FROM d UNION ALL SELECT DISTINCT split_part(split_part(range, '#', -1), '/', -1), split_part(uri, '#', -1), 1 FROM r),
    g AS (SELECT k.name, (SELECT max(parent) FROM e WHERE e.name = k.name) AS parent, coalesce((SELECT string_agg(DISTINCT e.name, '|' ORDER BY e.name) FROM e WHERE e.parent = k.name), '') AS children,
    coalesce((SELECT string_agg(DISTINCT property, '|' ORDER BY property) FROM z WHERE z.name = k.name AND n = 0), '') AS as_domain,
    coalesce((SELECT string_agg(DISTINCT property, '|' ORDER BY property) FROM z WHERE z.name = k.name AND n = 1), '') AS as_range FROM k) """


@query(ONTO + NAMES + "SELECT * FROM g")
def tbox_cards(spark, sf_dir):
    """Parent, children and properties of each class by local name."""
    return patterns.tbox(onto(spark, sf_dir))


EXPORT = """, b AS (SELECT s AS uri, min(o) AS parent FROM t WHERE p = 'rdfs:subClassOf' AND NOT starts_with(o, '_:') AND o <> 'urn:class#Thing' GROUP BY s),
    x AS (SELECT cp.uri, label, b.parent, coalesce((SELECT min(o) FROM t WHERE s = cp.uri AND p = 'rdfs:comment'), '') AS comment FROM cp LEFT JOIN b ON b.uri = cp.uri) """


@query(ONTO + EXPORT + "SELECT * FROM x")
def export_rows(spark, sf_dir):
    """Classes for export."""
    return patterns.export_rows(onto(spark, sf_dir))


@query(ONTO + EXPORT + "SELECT uri, CASE comment WHEN '' THEN label ELSE concat(label, ': ', comment) END AS text FROM x")
def index_texts(spark, sf_dir):
    """Texts to embed."""
    return patterns.index_texts(onto(spark, sf_dir))


@query(ONTO + """SELECT count_if(p = 'rdf:type' AND o IN ('owl:Class', 'rdfs:Class')) AS classes, count_if(p = 'rdf:type' AND o IN ('owl:ObjectProperty', 'owl:DatatypeProperty')) AS properties,
    count_if(p = 'rdfs:label') AS labels FROM t""")
def ontology_counts(spark, sf_dir):
    """Classes, properties and labels."""
    return patterns.instance_counts(onto(spark, sf_dir))
