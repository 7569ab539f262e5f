"""Texts and documents made from an ontology's triples, and triples made from records. Lines and documents are columns; nothing
is gathered beyond one class's properties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import compact_id, json_type, local_name, spaced_label
from tessera.operators import patterns


def lines(parts: Column) -> Column:
    return F.array_join(parts, "\n")


def sentences(triples: DataFrame) -> DataFrame:
    """One sentence of local names a triple."""
    return triples.select(F.concat_ws(" ", local_name(F.col("s")), F.element_at(F.split("p", ":"), -1), local_name(F.col("o"))).alias("sentence"))


def subgraph_text(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges (src, dst, rel) as lines with the ends' labels, ids where a node (id, label) has none."""
    named = [nodes.select(F.col("id").alias(c), F.col("label").alias(f"{c}_label")) for c in ("src", "dst")]
    rows = edges.join(named[0], "src", "left").join(named[1], "dst", "left")
    return rows.select("src", "dst", F.concat(F.coalesce("src_label", "src"), F.lit(" -["), "rel", F.lit("]-> "), F.coalesce("dst_label", "dst")).alias("line"))


def shapes(triples: DataFrame) -> DataFrame:
    """A node shape for each class: target, and a property shape a line with datatype and counts, in order."""
    own = patterns.class_attributes(triples)
    counts = F.when(F.col("cardinality") == "1", " ; sh:minCount 1 ; sh:maxCount 1").when(F.col("cardinality").isNotNull(), " ; sh:minCount 0").otherwise("")
    line = F.concat(F.lit("  sh:property [ sh:path "), "attribute", F.lit(" ; sh:datatype "), "range", counts, F.lit(" ]"))
    props = own.groupBy("class").agg(lines(F.array_sort(F.collect_list(line))).alias("body"))
    rows = patterns.typed(triples, patterns.CLASSES).join(props.withColumnRenamed("class", "uri"), "uri", "left")
    head = F.concat(F.col("uri"), F.lit("Shape a sh:NodeShape\n  sh:targetClass "), "uri")
    return rows.select("uri", F.concat_ws("\n", head, "body").alias("shape"))


def mappings(triples: DataFrame) -> DataFrame:
    """A mapping document for each class as JSON: subject template, type, and pairs of predicate and reference, typed
    unless they are strings."""
    own = patterns.class_attributes(triples)
    name = local_name(F.col("attribute"))
    kind = json_type(F.col("range"))
    value = F.concat(F.lit("$("), name, F.lit(")"), F.when(kind == "string", "").otherwise(F.concat(F.lit("~"), kind)))
    pairs = own.groupBy("class").agg(F.array_sort(F.collect_list(F.struct(F.col("attribute").alias("p"), value.alias("o")))).alias("po"))
    rows = patterns.typed(triples, patterns.CLASSES, "class").join(pairs, "class", "left")
    empty = F.array().cast("array<struct<p:string,o:string>>")
    doc = F.struct(F.concat(F.lit("data:"), local_name(F.col("class")), F.lit("/$(id)")).alias("s"), F.col("class").alias("type"), F.coalesce("po", empty).alias("po"))
    return rows.select("class", F.to_json(doc).alias("document"))


def nested(triples: DataFrame) -> DataFrame:
    """Each class with its compact id, spaced label, parent's compact id and attributes as one JSON text."""
    own = patterns.class_attributes(triples)
    attributes = own.groupBy(F.col("class").alias("uri")).agg(
        F.array_sort(F.collect_list(F.struct(compact_id(F.col("attribute")).alias("id"), F.col("kind").alias("dataType"), "required"))).alias("attributes")
    )
    rows = patterns.export_rows(triples).join(attributes, "uri", "left")
    empty = F.array().cast("array<struct<id:string,dataType:string,required:boolean>>")
    doc = F.struct(compact_id(F.col("uri")).alias("id"), spaced_label(F.col("uri")).alias("label"), F.coalesce(compact_id(F.col("parent")), F.lit("")).alias("parent"), F.coalesce("attributes", empty).alias("attributes"))
    return rows.select("uri", F.to_json(doc).alias("json"))


def turtle(nodes: DataFrame, prefix: str = "ex") -> DataFrame:
    """nodes (id, label, entity_type) as Turtle snippets, quotes and backslashes in labels escaped."""
    literal = F.replace(F.replace("label", F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    subject = F.concat(F.lit(f"{prefix}:"), F.replace("id", F.lit(":"), F.lit("_")))
    return nodes.select("id", F.concat(subject, F.lit(f" a {prefix}:"), F.replace("entity_type", F.lit(" "), F.lit("_")), F.lit(' ; rdfs:label "'), literal, F.lit('" .')).alias("turtle"))


def provenance(records: DataFrame) -> DataFrame:
    """records (seq, element, document, passage, confidence, phase) as triples: five a record, and the element's derivation."""
    at = F.concat(F.lit("urn:evidence#"), F.col("seq").cast("string"))
    row = lambda s, p, o: F.struct(s.alias("s"), F.lit(p).alias("p"), o.alias("o"))
    made = F.array(
        row(at, "rdf:type", F.lit("prov:Entity")),
        row(at, "prov:wasQuotedFrom", F.col("document")),
        row(at, "prov:value", F.col("passage")),
        row(at, "ex:confidence", F.format_string("%.4f", "confidence")),
        row(at, "ex:phase", F.col("phase").cast("string")),
        row(F.col("element"), "prov:wasDerivedFrom", at),
    )
    return records.select(F.explode(made).alias("t")).select("t.*").where("o is not null").distinct()


def class_triples(classes: DataFrame, graph: str) -> DataFrame:
    """classes (uri, label, parent, comment) as triples of a graph; nulls make none."""
    row = lambda p, o: F.struct(F.col("uri").alias("s"), F.lit(p).alias("p"), o.cast("string").alias("o"))
    made = F.array(row("rdf:type", F.lit("owl:Class")), row("rdfs:label", F.col("label")), row("rdfs:subClassOf", F.col("parent")), row("rdfs:comment", F.col("comment")))
    return classes.select(F.explode(made).alias("t")).select(F.lit(graph).alias("graph"), "t.*").where("o is not null").distinct()


def inserted(triples: DataFrame, classes: DataFrame, graph: str) -> DataFrame:
    """The triples with new classes in a graph; what is there already isn't added twice."""
    return triples.unionByName(class_triples(classes, graph)).distinct()


def reparented(triples: DataFrame, moves: DataFrame, graph: str) -> DataFrame:
    """The old parents of the moved classes (uri, parent) in a graph replaced by the new one."""
    target = moves.groupBy("uri").agg(F.max("parent").alias("parent"))
    old = (F.col("graph") == graph) & (F.col("p") == "rdfs:subClassOf")
    kept = triples.join(target, (F.col("s") == F.col("uri")) & old, "left_anti")
    new = target.select(F.lit(graph).alias("graph"), F.col("uri").alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.col("parent").alias("o"))
    return kept.unionByName(new).distinct()


def bulk(changes: DataFrame) -> DataFrame:
    """changes (batch, seq, ok) with what becomes of each when a batch stops at its first error: applied, failed or
    skipped. Earlier changes stay applied."""
    from pyspark.sql import Window

    before = F.sum((~F.col("ok")).cast("int")).over(Window.partitionBy("batch").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    return changes.select("batch", "seq", F.when(F.coalesce(before, F.lit(0)) > 0, "skipped").when(F.col("ok"), "applied").otherwise("failed").alias("status"))


def seeded_export(triples: DataFrame, accepted: DataFrame, seed: str) -> DataFrame:
    """The seed graph with accepted proposals (id, label, parent) as classes."""
    classes = accepted.select(F.concat(F.lit("urn:new#"), F.col("id").cast("string")).alias("uri"), "label", F.concat(F.lit("urn:class#"), "parent").alias("parent"), F.lit(None).cast("string").alias("comment"))
    return triples.where(F.col("graph") == seed).unionByName(class_triples(classes, seed)).select("s", "p", "o").distinct()


def layer(triples: DataFrame, graph: str) -> DataFrame:
    """One layer's triples; a layer that isn't there is an error."""
    rows = triples.where(F.col("graph") == graph).select("s", "p", "o").distinct()
    if rows.isEmpty():
        raise KeyError(graph)
    return rows
