"""Echo chambers in batch and as a stream."""

from __future__ import annotations

import datetime
import json
import random

from tessera.operators import debate
from tessera.streaming.debates import trivial_rounds_stream

SCHEMA = "debate long, seq long, ts timestamp, message_type string, approves boolean, issues long"


def made(seed: int, n: int = 300) -> list[dict]:
    rng = random.Random(seed)
    start = datetime.datetime(2024, 1, 1)
    return [
        {"debate": rng.randrange(6), "seq": i, "ts": (start + datetime.timedelta(seconds=20 * i)).isoformat() + "Z", "message_type": rng.choice(["review"] * 4 + ["proposal"]), "approves": rng.choice([True] * 9 + [False, None]), "issues": rng.choice([0] * 9 + [2, None])}
        for i in range(n)
    ]


def slow(rows):
    out = set()
    for d in {r["debate"] for r in rows}:
        seen, on_end = [], 0
        for r in sorted((r for r in rows if r["debate"] == d and r["message_type"] == "review"), key=lambda r: r["seq"]):
            seen.append(bool(r["approves"]) and not r["issues"])
            on_end = on_end + 1 if all(seen[-3:]) else 0
            out.add((d, r["seq"], on_end))
    return out


def test_rounds_in_batch(spark, tmp_path):
    rows = made(1)
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)))
    df = spark.read.schema(SCHEMA).json(str(tmp_path))
    assert {tuple(r) for r in debate.trivial_rounds(df).collect()} == slow(rows)
    longest = {}
    for d, _, n in slow(rows):
        longest[d] = max(n, longest.get(d, 0))
    assert {r["debate"]: r["longest"] for r in debate.echo_chambers(df).collect()} == longest


def test_shuffled_batches_and_a_restart_give_the_rows_of_the_batch(spark, tmp_path):
    rows = made(2)
    rng = random.Random(5)
    rows_late = sorted(rows, key=lambda r: r["seq"] + rng.randrange(60))  # out of order by up to twenty minutes
    end = {"debate": 99, "seq": 10**6, "ts": "2024-02-01T00:00:00Z", "message_type": "review", "approves": True, "issues": 0}
    source = tmp_path / "in"
    source.mkdir()

    def run():
        df = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
        out = trivial_rounds_stream(df, "30 minutes").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append")
        out.trigger(availableNow=True).start().awaitTermination(200)

    for k in range(3):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows_late[k * 60 : k * 60 + 60])))
    run()
    for k in range(3, 5):
        (source / f"{k}.json").write_text("\n".join(map(json.dumps, rows_late[k * 60 : k * 60 + 60])))
    (source / "5.json").write_text(json.dumps(end))
    run()
    (source / "6.json").write_text(json.dumps(end | {"seq": 10**6 + 1, "ts": "2024-02-02T00:00:00Z"}))
    run()
    got = [tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").where("debate <> 99").collect()]
    assert len(got) == len(set(got)) and set(got) == slow(rows)
