"""Echo chambers in a stream of debate messages: rounds of reviews that approve and raise nothing, counted per debate."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.debate import LAST_REVIEWS, clean_review

STATE = "flags string, rounds long, pending string"
OUT = "debate long, seq long, rounds long"


def advanced(flags: list[bool], rounds: int, clean: bool) -> tuple[list[bool], int]:
    """The last reviews' flags and the number of rounds on end after another review."""
    flags = [*flags, clean][-LAST_REVIEWS:]
    return flags, rounds + 1 if all(flags) else 0


def trivial_rounds_stream(messages: DataFrame, late: str = "1 hour", idle: str = "30 days") -> DataFrame:
    """As debate.trivial_rounds over a stream (debate, seq, ts, message_type, approves, issues), in append mode.

    Messages may come in any order within the allowed lateness: a debate's reviews wait until the watermark has passed them
    and are then counted in order of (ts, seq). What is kept for a debate is its last flags, its count and the reviews that
    wait; it is forgotten when the debate has been silent for `idle`.
    """
    silence = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        flags, rounds, pending = [], 0, []
        if state.exists:
            flags, rounds, pending = json.loads(state.get[0]), state.get[1], json.loads(state.get[2])
        for frame in frames:
            pending += [[int(t.value // 1_000_000), int(s), bool(c)] for t, s, c in zip(frame["ts"], frame["seq"], frame["clean"], strict=True)]
        mark = state.getCurrentWatermarkMs()
        pending.sort()
        ready = [p for p in pending if p[0] <= mark]
        pending = pending[len(ready) :]
        out = []
        for _, seq, clean in ready:
            flags, rounds = advanced(flags, rounds, clean)
            out.append((key[0], seq, rounds))
        if state.hasTimedOut and not pending and not ready:
            state.remove()
        else:
            state.update((json.dumps(flags), rounds, json.dumps(pending)))
            state.setTimeoutTimestamp(max(pending[0][0], mark + 1) if pending else max(mark, 0) + silence)
        yield pd.DataFrame(out, columns=["debate", "seq", "rounds"])

    reviews = messages.where("message_type = 'review'").select("debate", "seq", "ts", clean_review().alias("clean"))
    return reviews.withWatermark("ts", late).groupBy("debate").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
