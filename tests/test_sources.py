"""Readers, writers and the stream of signals on small files."""

import json

import pytest

from tessera.sources.extractions import read_entities
from tessera.sources.triples import read_triples, write_triples
from tessera.streaming.signals import read_signals, windowed_acceptance

ROWS = [
    ("http://x/A", "http://x/is", "http://x/B", "iri", None, None),
    ("_:b1", "http://x/is", "_:b2", "blank", None, None),
    ("http://x/A", "http://x/label", 'a "quoted" \\n back\\slash\nline\tend', "literal", None, "en"),
    ("http://x/A", "http://x/n", "3", "literal", "http://x/int", None),
    ("http://x/A", "http://x/label", "", "literal", None, None),
]
SCHEMA = "s string, p string, o string, o_kind string, o_datatype string, o_lang string"


def test_triples_round_trip(spark, tmp_path):
    write_triples(spark.createDataFrame(ROWS + ROWS[:1], SCHEMA), f"{tmp_path}/t")
    assert sorted(map(str, map(tuple, read_triples(spark, f"{tmp_path}/t").collect()))) == sorted(map(str, ROWS))


def test_lines_that_are_no_triples(spark, tmp_path):
    (tmp_path / "x.nt").write_text("# comment\n\n<a> <b> <c> . # more\nnonsense\n")
    assert read_triples(spark, f"{tmp_path}/x.nt", strict=False).count() == 1
    with pytest.raises(Exception, match="no triple"):
        read_triples(spark, f"{tmp_path}/x.nt").collect()


def test_checkpoints(spark, tmp_path):
    evidence = [{"source_id": "d1", "text_span": "one"}, {"source_id": "d2"}]
    entities = [{"id": "1", "label": "Action", "entity_type": "Action", "confidence": 0.78, "evidence": evidence}, {"label": "Permit"}]
    (tmp_path / "c.json").write_text(json.dumps({"entities": entities}, indent=1))
    full, bare = sorted(read_entities(spark, f"{tmp_path}/c.json").collect(), key=lambda r: r["label"])
    assert (full["frequency"], full["source_ids"], full["evidence_spans"]) == (2, ["d1", "d2"], ["one", ""])
    assert (bare["id"], bare["confidence"], bare["frequency"], bare["aliases"]) == ("", 0.0, 0, [])


def test_windowed_acceptance(spark, tmp_path):
    def row(i, decision, at):
        return json.dumps({"signal_id": i, "element_type": "class", "decision": decision, "timestamp": f"2024-01-01T{at}:00Z"})

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text("\n".join([row("1", "accept", "10:05"), row("2", "reject", "10:30"), row("1", "accept", "10:05"), row("3", "accept", "11:10")]))
    out = windowed_acceptance(read_signals(spark, f"{tmp_path}/in"))
    (tmp_path / "in" / "b.json").write_text(row("4", "accept", "14:00"))
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    got = [(r["signals"], r["accepted"], r["rate"]) for r in spark.read.parquet(f"{tmp_path}/out").orderBy("start").collect()]
    assert got == [(2, 1, 0.5), (1, 1, 1.0)]
