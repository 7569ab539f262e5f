"""Fill-in-the-middle against a slow version, and texts of every kind."""

from __future__ import annotations

import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import middles, registry
from tests.oracle import SMALL

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "form string, doc_id long, text string, n long"


def slow(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i : i + 8], 16) for i in range(0, 32, 8))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_the_query(spark):
    df = registry.QUERIES["op13_middles"](spark, SMALL)
    assert dict(df.dtypes) == {"doc_id": "bigint", "n": "bigint", "form": "string", "prefix_chars": "bigint", "middle_chars": "bigint", "output_sha256": "string", "restored_sha256": "string"}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in df.collect()}
    assert got.keys() == texts.keys()
    for k, text in texts.items():
        *want, output = slow(k, text)
        assert [got[k][c] for c in ("n", "form", "prefix_chars", "middle_chars")] == want
        assert got[k]["output_sha256"] == middles.digest(output) and got[k]["restored_sha256"] == middles.digest(text or "")


def test_texts_of_every_kind(spark):
    texts = [None, "", " ", "\t\n", "a", " a ", "a  b\x0b c", "ß é 日本 \U0001f600 x", "has <P> in", "<S>", "a <M", "<", "<M <S <P >", "w " * 300_000, " wide space"]
    rows = [("x", i, t, 7) for i, t in enumerate(texts * 40)] + [("x", None, "null id here", 7)] * 2
    got = middles.transform(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    want = sorted((str(r[1]), *map(str, slow(r[1], r[2]))) for r in rows)
    assert sorted((str(r["doc_id"]), *(str(r[c]) for c in ("n", "form", "prefix_chars", "middle_chars", "output"))) for r in got) == want
    assert {r["form"] for r in got} == {"plain", "spm", "psm"}


def test_an_empty_table(spark):
    assert middles.transform(spark.createDataFrame([], SCHEMA)).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**40), st.text(alphabet="<>PSM \ta ", max_size=40))
def test_round_trip(doc_id, text):
    n, form, a, b, output, sha = middles.rearranged(str(doc_id), text, middles.regex.compile(middles.UNIT), 42, 100, 50)
    assert middles.restored(output, form) == text and sha == middles.digest(output)
