"""Ontology files in RDF/XML and Turtle as triples (s, p, o, o_kind, o_datatype, o_lang) with the name of their file.

Files come through Spark's binary reader, so from any store that it reads, a row a file; a task parses a file at a time,
RDF/XML element by element. The format follows the name's suffix. Relative IRIs are joined to the base, blank nodes are named
after the file's number within the table (a hash of its name), so that files don't share any.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Suffixes of formats, and names of the vocabularies that the formats themselves use.
FORMATS = {"ttl": "turtle", "turtle": "turtle", "nt": "turtle", "owl": "xml", "rdf": "xml", "xml": "xml"}
RDF, XML, XSD = "http://www.w3.org/1999/02/22-rdf-syntax-ns#", "{http://www.w3.org/XML/1998/namespace}", "http://www.w3.org/2001/XMLSchema#"
SCHEMA = "file string, s string, p string, o string, o_kind string, o_datatype string, o_lang string"
TRIPLES = 8_192  # that go on together, or those of one file


class Term(NamedTuple):
    value: str
    kind: str = "iri"
    datatype: str | None = None
    lang: str | None = None


class Document:
    """What both formats need: a base, fresh blank nodes and the triples found."""

    def __init__(self, name: str, base: str = "") -> None:
        self.base, self.tag, self.fresh, self.triples = base, f"{zlib.crc32(name.encode()):08x}", 0, []

    def blank(self, label: str | None = None) -> Term:
        if label is None:
            self.fresh += 1
        return Term(f"_:f{self.tag}" + (f"n{self.fresh}" if label is None else f"l{label}"), "blank")

    def iri(self, reference: str, base: str | None = None) -> Term:
        base = self.base if base is None else base
        if reference.startswith("#"):
            return Term(base.split("#")[0] + reference)
        return Term(urljoin(base, reference) if base and not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", reference) else reference)

    def add(self, s: Term, p: str, o: Term) -> None:
        self.triples.append((s.value, p, *o))

    def listed(self, items: list[Term]) -> Term:
        """The head of a list of the items."""
        head = Term(f"{RDF}nil")
        for item in reversed(items):
            node = self.blank()
            self.add(node, f"{RDF}first", item)
            self.add(node, f"{RDF}rest", head)
            head = node
        return head


class XmlDocument(Document):
    """RDF/XML: node elements hold property elements, which hold node elements, texts or references."""

    def node(self, e: ElementTree.Element, base: str, lang: str | None) -> Term:
        base, lang = e.get(f"{XML}base", base), e.get(f"{XML}lang", lang)
        about, ident, label = (e.get(f"{{{RDF}}}{k}") for k in ("about", "ID", "nodeID"))
        s = self.iri(about, base) if about is not None else self.iri(f"#{ident}", base) if ident is not None else self.blank(label)
        if plain(e.tag) != f"{RDF}Description":
            self.add(s, f"{RDF}type", Term(plain(e.tag)))
        self.attributes(s, e, lang)
        nth = 0
        for child in e:
            p = plain(child.tag)
            if p == f"{RDF}li":
                nth += 1
                p = f"{RDF}_{nth}"
            self.add(s, p, self.value(child, child.get(f"{XML}base", base), child.get(f"{XML}lang", lang)))
        return s

    def attributes(self, s: Term, e: ElementTree.Element, lang: str | None) -> bool:
        found = False
        for k, v in e.attrib.items():
            if k.startswith("{") and not k.startswith((f"{{{RDF}}}", XML)):
                self.add(s, plain(k), Term(v, "literal", None, lang))
                found = True
        return found

    def value(self, e: ElementTree.Element, base: str, lang: str | None) -> Term:
        resource, label, kind, datatype = (e.get(f"{{{RDF}}}{k}") for k in ("resource", "nodeID", "parseType", "datatype"))
        if kind == "Literal":
            return Term((e.text or "") + "".join(ElementTree.tostring(c, "unicode") for c in e), "literal", f"{RDF}XMLLiteral")
        if kind == "Collection":
            return self.listed([self.node(c, base, lang) for c in e])
        if kind == "Resource":
            s = self.blank()
            for child in e:
                self.add(s, plain(child.tag), self.value(child, base, child.get(f"{XML}lang", lang)))
            return s
        if resource is not None or label is not None or not len(e) and not e.text and any(k.startswith("{") and not k.startswith((f"{{{RDF}}}", XML)) for k in e.attrib):
            o = self.iri(resource, base) if resource is not None else self.blank(label)
            self.attributes(o, e, lang)
            return o
        if len(e):
            return self.node(e[0], base, lang)
        return Term(e.text or "", "literal", self.iri(datatype, base).value if datatype else None, None if datatype else lang)

    def parse(self, content: bytes) -> None:
        parser = ElementTree.XMLPullParser(("start", "end"))
        parser.feed(content)
        parser.close()
        depth, root = 0, None
        for event, e in parser.read_events():
            depth += 1 if event == "start" else -1
            if root is None:
                root = e
                if plain(e.tag) != f"{RDF}RDF":
                    raise ValueError(f"no RDF/XML: the root is {e.tag}")
                self.base = e.get(f"{XML}base", self.base)
            elif event == "end" and depth == 1:
                self.node(e, self.base, root.get(f"{XML}lang"))
                root.clear()


def plain(tag: str) -> str:
    return tag[1:].replace("}", "", 1) if tag.startswith("{") else tag


TOKEN = re.compile(
    r"""(?:\s|\#[^\n]*)*(?:(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<text>\"\"\"(?:[^"\\]|\\.|"(?!""))*\"\"\"|'''(?:[^'\\]|\\.|'(?!''))*'''|"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')"""
    r"""|(?P<word>@prefix|@base|(?i:prefix|base)(?=\s))|@(?P<lang>[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<mark>\^\^|[.;,\[\]()](?!\d))"""
    r"""|(?P<number>[+-]?(?:\d+\.?\d*(?:[eE][+-]?\d+)|\d*\.\d+|\d+))|_:(?P<blank>\w(?:[\w.-]*[\w-])?)|(?P<name>(?:[^\W\d_](?:[\w.-]*[\w-])?)?:(?:(?:[\w:%-]|\\.)(?:(?:[\w:.%-]|\\.)*(?:[\w:%-]|\\.))?)?)|(?P<bare>a|true|false)(?![\w:]))""",
    re.S,
)
ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", re.S)


def unescaped(text: str) -> str:
    return ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}.get(m[1], m[1]), text)


class TurtleDocument(Document):
    """Turtle, and so N-Triples: prefixes, predicate and object lists, blank nodes in brackets, collections and literals."""

    def parse(self, content: bytes) -> None:
        self.text, self.at, self.prefixes = content.decode(), 0, {}
        self.forward()
        while self.kind:
            if self.kind == "word":
                self.directive()
            else:
                self.statement()

    def forward(self) -> tuple[str | None, str]:
        """Step to the next token; the one left behind."""
        left = getattr(self, "kind", None), getattr(self, "token", "")
        m = TOKEN.match(self.text, self.at)
        if m:
            self.kind, self.token, self.at = m.lastgroup, m[m.lastgroup], m.end()
        elif re.fullmatch(r"(?:\s|#[^\n]*)*", self.text[self.at :]):
            self.kind, self.token = None, ""
        else:
            raise ValueError(f"no Turtle at {self.text[self.at : self.at + 40]!r}")
        return left

    def expect(self, mark: str) -> str:
        if not self.marked(mark):
            raise ValueError(f"{mark} wanted before {self.text[self.at : self.at + 40]!r}")
        return self.forward()[1]

    def directive(self) -> None:
        word = self.forward()[1].lower()
        if word.endswith("prefix"):
            name = self.forward()[1]
            self.prefixes[name.rstrip(":")] = self.iri(self.forward()[1][1:-1]).value
        else:
            self.base = self.iri(self.forward()[1][1:-1]).value
        if word.startswith("@"):
            self.expect(".")

    def statement(self) -> None:
        bare = self.marked("[")
        s = self.term()
        if not (bare and self.marked(".")):
            self.predicates(s)
        self.expect(".")

    def predicates(self, s: Term) -> None:
        while True:
            if self.kind == "bare" and self.token == "a":
                p = Term(f"{RDF}type")
                self.forward()
            else:
                p = self.term()
            self.add(s, p.value, self.term())
            while self.marked(","):
                self.forward()
                self.add(s, p.value, self.term())
            if not self.marked(";"):
                return
            while self.marked(";"):
                self.forward()
            if self.marked(".") or self.marked("]"):
                return

    def marked(self, mark: str) -> bool:
        return self.kind == "mark" and self.token == mark

    def term(self) -> Term:
        kind, token = self.forward()
        if kind == "iri":
            return self.iri(unescaped(token[1:-1]))
        if kind == "name":
            prefix, local = token.split(":", 1)
            if prefix not in self.prefixes:
                raise ValueError(f"no prefix {prefix}")
            return Term(self.prefixes[prefix] + re.sub(r"\\(.)", r"\1", local))
        if kind == "blank":
            return self.blank(token)
        if kind == "text":
            size = 3 if token[:3] in ('"""', "'''") and len(token) > 5 else 1
            value = unescaped(token[size:-size])
            if self.kind == "lang":
                return Term(value, "literal", None, self.forward()[1])
            if self.marked("^^"):
                self.forward()
                return Term(value, "literal", self.term().value)
            return Term(value, "literal")
        if kind == "number":
            return Term(token, "literal", XSD + ("double" if re.search("[eE]", token) else "decimal" if "." in token else "integer"))
        if kind == "bare" and token != "a":
            return Term(token, "literal", XSD + "boolean")
        if kind == "mark" and token == "[":
            s = self.blank()
            if not self.marked("]"):
                self.predicates(s)
            self.expect("]")
            return s
        if kind == "mark" and token == "(":
            items = []
            while not self.marked(")"):
                items.append(self.term())
            self.forward()
            return self.listed(items)
        raise ValueError(f"no term: {token!r} before {self.text[self.at : self.at + 40]!r}")


def parsed(name: str, content: bytes) -> list[tuple]:
    """The triples of one file, by the format that its suffix names."""
    kind = FORMATS.get(name.rsplit(".", 1)[-1].lower())
    if kind is None:
        raise ValueError(f"no format known for {name}")
    document = XmlDocument(name) if kind == "xml" else TurtleDocument(name)
    document.parse(content)
    return document.triples


def parse_files(files: DataFrame, strict: bool = True) -> DataFrame:
    """Distinct triples of files (file, content). A file that can't be parsed fails the query if `strict`, else it gives nothing;
    what was read of it before the fault doesn't count. Null and empty contents give nothing."""

    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = content.as_py()
                try:
                    rows = parsed(name or "", content) if content else []
                except (ValueError, ElementTree.ParseError) as fault:
                    if strict:
                        raise ValueError(f"{name}: {fault}") from fault
                    rows = []
                found += [(name, *row) for row in rows]
                if len(found) >= TRIPLES:
                    yield columns(found, names)
                    found = []
            yield columns(found, names)

    spark = files.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    # Files may come many to a split, and parsing takes far longer than reading: they are dealt out.
    dealt = files.select("file", F.col("content").cast("binary")).repartition(parts, F.xxhash64("file", "content"))
    return dealt.mapInArrow(run, SCHEMA).distinct()


def columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    held = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in held], names)


def read_ontologies(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Triples of all files under a path whose suffix is a known format's."""
    known = "*.{" + ",".join(FORMATS) + "}"
    files = spark.read.format("binaryFile").option("pathGlobFilter", known).option("recursiveFileLookup", "true").load(path)
    return parse_files(files.select(F.col("path").alias("file"), "content"), strict)
