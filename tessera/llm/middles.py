"""Fill-in-the-middle transformation of whole texts in an Arrow-batched pandas UDF.

A text's units are found by one regular expression; their end offsets stand in a compact array, in which the two cuts are
looked up. Which form a document takes, and where it is cut, are read off a SHA-256 of its id, so reruns agree and rows
need neither order nor company: there is no shuffle.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.common import small_batches, table

# The units, the markers, the seed, and the shares (in a hundred) that are rearranged, and of these put suffix first.
UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, RATE, SUFFIX_FIRST = 42, 50, 80
FIELDS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def draws(seed: int, key: str) -> list[int]:
    """Four numbers below 2**32 of a document's key."""
    hexes = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return [int(hexes[8 * i : 8 * i + 8], 16) for i in range(4)]


def unit_ends(text: str, pattern: regex.Pattern) -> array:
    """The offset behind each unit, in code points."""
    return array("q", (m.end() for m in pattern.finditer(text)))


def rearranged(key: str, text: str, pattern: regex.Pattern, seed: int, rate: int, suffix_first: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output, output_sha256) of one text."""
    ends = unit_ends(text, pattern)
    n, (h1, h2, h3, h4) = len(ends), draws(seed, key)
    if not text or h3 % 100 >= rate or any(m in text for m in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text, digest(text)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, b = (ends[i - 1] if i else 0 for i in (low, high))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        form, output = "spm", f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    else:
        form, output = "psm", f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"
    return n, form, a, b - a, output, digest(output)


def restored(output: str, form: str) -> str:
    """The text again. Markers can't occur in a rearranged text, nor arise where it meets one, so the first of each is it."""
    if form == "plain":
        return output
    second = PREFIX if form == "spm" else SUFFIX
    opening, rest = output[len(PREFIX) :].split(second, 1)
    closing, middle = rest.split(MIDDLE, 1)
    prefix, suffix = (closing, opening) if form == "spm" else (opening, closing)
    return prefix + middle + suffix


def rearrange(key: Column, text: Column, unit: str = UNIT, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> Column:
    """A struct of FIELDS for a key and a text, both strings."""

    @F.pandas_udf(FIELDS)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        names = [x.split()[0] for x in FIELDS.split(", ")]
        for keys, texts in batches:
            out = pd.DataFrame([rearranged(k, t, pattern, seed, rate, suffix_first) for k, t in zip(keys, texts, strict=True)], columns=names)
            yield out.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    return run(key, text)


@F.pandas_udf(StringType())
def restored_sha256(outputs: pd.Series, forms: pd.Series) -> pd.Series:
    return pd.Series([digest(restored(o, f)) for o, f in zip(outputs, forms, strict=True)], dtype="object")


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id_col, n, form, prefix_chars, middle_chars, output, output_sha256) of every row.

    A null text is empty, and empty texts are plain; a null id counts as the empty string. Repeated rows have equal results,
    rows of one id and other texts the same draws. Texts that hold a marker are plain, however long the text; a very long text
    costs its own size and eight bytes a unit. An empty table gives an empty result; other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    key = F.coalesce(F.col("id").cast("string"), F.lit(""))
    return rows.select(F.col("id").alias(id_col), rearrange(key, F.col("text"), **options).alias("made")).select(id_col, "made.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", restored_sha256("output", "form").alias("restored_sha256"))


SQL = r"""
WITH units AS (
    SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u
    FROM documents),
drawn AS (
    SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
           ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM units),
cuts AS (
    SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn),
parts AS (
    SELECT doc_id, text, n, form, coalesce(array_to_string(u[1:a], ''), '') AS prefix, coalesce(array_to_string(u[a + 1:b], ''), '') AS middle,
           coalesce(array_to_string(u[b + 1:], ''), '') AS suffix
    FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(prefix) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE prefix || middle || suffix END) AS restored_sha256
FROM parts"""
