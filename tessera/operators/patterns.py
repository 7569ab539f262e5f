"""Graph patterns over one ontology's triples (s, p, o): classes, properties, hierarchy rows and existence tests.

Each is a few equi-joins of filtered triples. Of several labels or parents the smallest counts, so results don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import json_type, local_name

CLASSES, OBJECTS, DATA = ("owl:Class", "rdfs:Class"), ("owl:ObjectProperty",), ("owl:DatatypeProperty",)


def pairs(triples: DataFrame, p: str, a: str, b: str) -> DataFrame:
    """Distinct subjects and objects of a predicate, under names of your own."""
    return triples.where(F.col("p") == p).select(F.col("s").alias(a), F.col("o").alias(b)).distinct()


def typed(triples: DataFrame, kinds: tuple[str, ...], name: str = "uri") -> DataFrame:
    return triples.where((F.col("p") == "rdf:type") & F.col("o").isin(*kinds)).select(F.col("s").alias(name)).distinct()


def labels(triples: DataFrame, uri: str = "uri", label: str = "label") -> DataFrame:
    return triples.where("p = 'rdfs:label'").groupBy(F.col("s").alias(uri)).agg(F.min("o").alias(label))


def blank(c: str) -> Column:
    return F.startswith(F.col(c), F.lit("_:"))


def joined(c: str | Column) -> Column:
    """Distinct values in order, as one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), "|")


def class_by_label(triples: DataFrame, label: str) -> DataFrame:
    """The first class that carries the label, ignoring case."""
    hit = triples.where((F.col("p") == "rdfs:label") & (F.lower("o") == label.lower())).select(F.col("s").alias("uri"), F.col("o").alias("label"))
    return hit.join(typed(triples, CLASSES), "uri", "left_semi").orderBy("uri", "label").limit(1)


def synonyms(triples: DataFrame) -> DataFrame:
    return pairs(triples, "skos:altLabel", "uri", "synonym")


def domain_properties(triples: DataFrame) -> DataFrame:
    """Properties of each class that have a domain, a range and a label: (class, property, range, label)."""
    own = pairs(triples, "rdfs:domain", "property", "class").join(pairs(triples, "rdfs:range", "property", "range"), "property")
    return own.join(pairs(triples, "rdfs:label", "property", "label"), "property").select("class", "property", "range", "label")


def parents(triples: DataFrame) -> DataFrame:
    """One parent a class, (uri, parent); blank nodes don't count."""
    up = pairs(triples, "rdfs:subClassOf", "uri", "parent").where(~blank("uri") & ~blank("parent"))
    return up.groupBy("uri").agg(F.min("parent").alias("parent"))


def classes_with_parent(triples: DataFrame) -> DataFrame:
    """(uri, label, parent): label or local name, and parent or null, of every class that isn't blank."""
    rows = typed(triples, CLASSES).where(~blank("uri")).join(labels(triples), "uri", "left").join(parents(triples), "uri", "left")
    return rows.select("uri", F.coalesce("label", local_name(F.col("uri"))).alias("label"), "parent")


def object_properties(triples: DataFrame) -> DataFrame:
    """(uri, label, domains, ranges), the latter as texts of distinct values."""
    ends = triples.where("p in ('rdfs:domain', 'rdfs:range')").groupBy(F.col("s").alias("uri")).agg(
        joined(F.when(F.col("p") == "rdfs:domain", F.col("o"))).alias("domains"), joined(F.when(F.col("p") == "rdfs:range", F.col("o"))).alias("ranges")
    )
    rows = typed(triples, OBJECTS).join(labels(triples), "uri", "left").join(ends, "uri", "left")
    return rows.select("uri", F.coalesce("label", local_name(F.col("uri"))).alias("label"), F.coalesce("domains", F.lit("")).alias("domains"), F.coalesce("ranges", F.lit("")).alias("ranges"))


def class_edges(triples: DataFrame) -> DataFrame:
    """(parent, child) where both are classes and neither is blank."""
    edges = pairs(triples, "rdfs:subClassOf", "child", "parent").where(~blank("child") & ~blank("parent"))
    known = typed(triples, CLASSES)
    for c in ("child", "parent"):
        edges = edges.join(known.withColumnRenamed("uri", c), c, "left_semi")
    return edges.select("parent", "child")


def ontology_summary(triples: DataFrame) -> DataFrame:
    """How many classes, object properties and class edges, as one row."""
    parts = {"classes": classes_with_parent(triples), "properties": object_properties(triples), "edges": class_edges(triples)}
    rows = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("kind"), "n")
        rows = one if rows is None else rows.union(one)
    return rows.agg(*[F.max(F.when(F.col("kind") == name, F.col("n"))).alias(name) for name in parts])


def hierarchy_rows(triples: DataFrame) -> DataFrame:
    """(uri, label, parent, parent_label) of every class, labels of both ends falling back on local names."""
    rows = classes_with_parent(triples).join(labels(triples, "parent", "parent_label"), "parent", "left")
    return rows.select("uri", "label", "parent", F.coalesce("parent_label", local_name(F.col("parent"))).alias("parent_label"))


def hierarchy_text(triples: DataFrame) -> DataFrame:
    """One line a class and parent, roots saying so."""
    rows = hierarchy_rows(triples)
    return rows.select("uri", F.concat(F.lit("- "), "label", F.when(F.col("parent").isNull(), " (root)").otherwise(F.concat(F.lit(" < "), "parent_label"))).alias("line"))


def relations(triples: DataFrame) -> DataFrame:
    """Object properties with each domain and range, and the labels of all three: outer joins, so gaps stay as nulls."""
    rows = typed(triples, OBJECTS).join(labels(triples), "uri", "left")
    for end in ("domain", "range"):
        rows = rows.join(pairs(triples, f"rdfs:{end}", "uri", end), "uri", "left").join(labels(triples, end, f"{end}_label"), end, "left")
    return rows.select("uri", "label", "domain", "domain_label", "range", "range_label")


def class_attributes(triples: DataFrame) -> DataFrame:
    """Datatype properties of each class: (class, attribute, range, kind, cardinality, required), required with cardinality 1."""
    rows = pairs(triples, "rdfs:domain", "attribute", "class").join(typed(triples, DATA, "attribute"), "attribute", "left_semi")
    ranges = triples.where("p = 'rdfs:range'").groupBy(F.col("s").alias("attribute")).agg(F.min("o").alias("range"))
    counts = triples.where("p = 'owl:cardinality'").groupBy(F.col("s").alias("attribute")).agg(F.max("o").alias("cardinality"))
    rows = rows.join(ranges, "attribute", "left").join(counts, "attribute", "left")
    required = F.coalesce(F.col("cardinality") == "1", F.lit(False))
    return rows.select("class", "attribute", "range", json_type(F.col("range")).alias("kind"), "cardinality", required.alias("required"))


def inverse_relations(triples: DataFrame) -> DataFrame:
    """(uri, label, inverse): every object property, its inverse or null."""
    rows = typed(triples, OBJECTS).join(labels(triples), "uri", "left").join(pairs(triples, "owl:inverseOf", "uri", "inverse"), "uri", "left")
    return rows.select("uri", F.coalesce("label", local_name(F.col("uri"))).alias("label"), "inverse")


def property_load(triples: DataFrame) -> DataFrame:
    """(uri, kind, domain, range): object and datatype properties together."""
    both = typed(triples, OBJECTS).withColumn("kind", F.lit("object")).unionByName(typed(triples, DATA).withColumn("kind", F.lit("data")))
    return both.join(pairs(triples, "rdfs:domain", "uri", "domain"), "uri", "left").join(pairs(triples, "rdfs:range", "uri", "range"), "uri", "left")


def existing(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """Which of the uris (uri) are subject or object of any triple."""
    used = triples.select(F.col("s").alias("uri")).union(triples.select("o")).distinct().withColumn("present", F.lit(True))
    return uris.select("uri").distinct().join(used, "uri", "left").select("uri", F.coalesce("present", F.lit(False)).alias("present"))


def existing_classes(triples: DataFrame, uris: DataFrame) -> DataFrame:
    """Which of the uris (uri) are classes."""
    known = typed(triples, CLASSES).withColumn("present", F.lit(True))
    return uris.select("uri").distinct().join(known, "uri", "left").select("uri", F.coalesce("present", F.lit(False)).alias("present"))


def owl_profile(triples: DataFrame) -> DataFrame:
    """The first profile of DL, EL, QL and RL one of whose constructs occurs; RDFS if none does."""
    # Constructs by profile, in order of precedence.
    constructs = {
        "DL": ("owl:disjointWith", "owl:complementOf", "owl:unionOf", "owl:cardinality"),
        "EL": ("owl:someValuesFrom", "owl:intersectionOf"),
        "QL": ("owl:inverseOf",),
        "RL": ("owl:hasValue", "owl:allValuesFrom"),
    }
    out = F.lit("RDFS")
    for name, used in reversed(constructs.items()):
        out = F.when(F.coalesce(F.bool_or(F.col("p").isin(*used) | F.col("o").isin(*used)), F.lit(False)), name).otherwise(out)
    return triples.agg(out.alias("profile"))


def ends(triples: DataFrame) -> DataFrame:
    """(class, property, end): where a class is domain (0) or range (1) of a property."""
    return pairs(triples, "rdfs:domain", "property", "class").withColumn("end", F.lit(0)).unionByName(pairs(triples, "rdfs:range", "property", "class").withColumn("end", F.lit(1)))


def relations_for_type(triples: DataFrame) -> DataFrame:
    """(class, property, end): the properties that a class is domain of, and those that it is range of."""
    return ends(triples).select("class", local_name(F.col("property")).alias("property"), "end")


def related_types(triples: DataFrame) -> DataFrame:
    """(class, related): classes at the other end of a class's properties."""
    at = ends(triples)
    other = at.select(F.col("class").alias("related"), "property", (1 - F.col("end")).alias("end"))
    return at.join(other, ["property", "end"]).where("class <> related").select("class", "related").distinct()


def tbox(triples: DataFrame) -> DataFrame:
    """A card for each class by local name: parent (the last in order), children, and properties by end."""
    name = lambda c: local_name(F.col(c))
    edges = pairs(triples, "rdfs:subClassOf", "child", "parent").where(~blank("parent")).select(name("child").alias("name"), name("parent").alias("parent"))
    up = edges.groupBy("name").agg(F.max("parent").alias("parent"))
    down = edges.groupBy(F.col("parent").alias("name")).agg(joined("name").alias("children"))
    at = ends(triples).select(name("class").alias("name"), name("property").alias("property"), "end").groupBy("name").agg(
        joined(F.when(F.col("end") == 0, F.col("property"))).alias("as_domain"), joined(F.when(F.col("end") == 1, F.col("property"))).alias("as_range")
    )
    rows = typed(triples, CLASSES).select(name("uri").alias("name")).distinct()
    for part in (up, down, at):
        rows = rows.join(part, "name", "left")
    return rows.select("name", "parent", *[F.coalesce(c, F.lit("")).alias(c) for c in ("children", "as_domain", "as_range")])


def export_rows(triples: DataFrame, top: str = "urn:class#Thing") -> DataFrame:
    """(uri, label, parent, comment) of each class, once, without a parent that is the top."""
    notes = triples.where("p = 'rdfs:comment'").groupBy(F.col("s").alias("uri")).agg(F.min("o").alias("comment"))
    up = parents(triples.where(F.col("o") != top))
    rows = typed(triples, CLASSES).join(labels(triples), "uri", "left").join(up, "uri", "left").join(notes, "uri", "left")
    return rows.select("uri", F.coalesce("label", local_name(F.col("uri"))).alias("label"), "parent", F.coalesce("comment", F.lit("")).alias("comment"))


def index_texts(triples: DataFrame) -> DataFrame:
    """What is embedded for a class: its label, with the definition after a colon if there is one."""
    rows = export_rows(triples)
    return rows.select("uri", F.concat_ws(": ", "label", F.nullif("comment", F.lit(""))).alias("text"))


def instance_counts(triples: DataFrame) -> DataFrame:
    """Classes (both vocabularies), properties of three kinds, and labels, as one row."""
    kind = lambda *k: F.count_if((F.col("p") == "rdf:type") & F.col("o").isin(*k))
    rows = triples.distinct()
    return rows.agg(kind(*CLASSES).alias("classes"), kind(*OBJECTS, *DATA, "owl:AnnotationProperty", "rdf:Property").alias("properties"), F.count_if(F.col("p") == "rdfs:label").alias("labels"))
