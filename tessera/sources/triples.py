"""N-Triples files as rows (s, p, o, o_kind, o_datatype, o_lang), and back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NODE = r"(<[^>]*>|_:[^\s<>\"]+)"
LINE = rf'^\s*{NODE}\s*<([^>]*)>\s*({NODE}|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*\.\s*(#.*)?$'
ESCAPES = [("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")]


def _bare(term):
    return F.regexp_replace(term, "^<|>$", "")


def read_triples(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Distinct triples of N-Triples text. Comments and blank lines are passed over. Other lines that aren't a triple fail
    the query if `strict`, else they are passed over too. \\u escapes are left as they are."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    part = lambda n: F.regexp_extract("value", LINE, n)
    whole = F.col("value").rlike(LINE)
    good = lines.where(whole) if not strict else lines.where(whole | F.raise_error(F.concat(F.lit("no triple: "), F.col("value"))).cast("boolean"))
    literal = part(5)
    for plain, escaped in reversed(ESCAPES[1:]):
        literal = F.regexp_replace(literal, r"(?<!\\)((?:\\\\)*)" + "\\" + escaped, "$1" + plain)
    literal = F.replace(literal, F.lit("\\\\"), F.lit("\\"))
    is_node = part(4) != ""
    return good.select(
        _bare(part(1)).alias("s"),
        part(2).alias("p"),
        F.when(is_node, _bare(part(4))).otherwise(literal).alias("o"),
        F.when(part(4).startswith("_:"), "blank").when(is_node, "iri").otherwise("literal").alias("o_kind"),
        F.nullif(part(6), F.lit("")).alias("o_datatype"),
        F.nullif(part(7), F.lit("")).alias("o_lang"),
    ).distinct()


def ntriples(triples: DataFrame) -> DataFrame:
    """One column `value` of N-Triples lines."""
    node = lambda c: F.when(c.startswith("_:"), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    text = F.col("o")
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    tail = F.when(F.col("o_datatype").isNotNull(), F.concat(F.lit("^^<"), "o_datatype", F.lit(">"))).when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang"))
    literal = F.concat(F.lit('"'), text, F.lit('"'), F.coalesce(tail, F.lit("")))
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o")))
    return triples.select(F.concat(node(F.col("s")), F.lit(" <"), "p", F.lit("> "), obj, F.lit(" .")).alias("value"))


def write_triples(triples: DataFrame, path: str, mode: str = "error") -> None:
    ntriples(triples).write.mode(mode).text(path)
