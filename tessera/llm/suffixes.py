"""Exact substring deduplication by distributed prefix doubling over sampled positions.

A string of so many symbols, bytes or words, is removed wherever it starts more than once. Positions are ranked by a first
part of their string and then, at growing offsets, by the pair of the rank that they have and that of what follows;
positions whose rank is unique drop out after each step. Ranks are 64-bit hashes, equal for equal symbols, since only
equality is asked for.

The first ranking needs few positions: each string is represented by its anchor, the position in it whose rank over `gram`
symbols is smallest (leftmost of equals). Anchors depend on symbols alone, so equal strings have anchors at equal places,
and a string whose anchor has a unique rank is unique. Anchors with repeated ranks are compared with all the symbols that
their strings cover; where these repeat as a whole, every string of that anchor does. For the rest, one representative of
each distinct surrounding standing for all its copies, starts are taken in steps of STEP by their distance to the anchor:
what all strings of a step share is ranked first, and only steps of repeated rank are ranked start by start.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, drop, keep, table
from tessera.llm.words import Block, blocks, mix, packed_texts, powers, prefix_sums, span_hashes, unpacked, word_hashes

LENGTH = 400  # bytes
PASSAGE = 51  # words: the shortest passage of over 50
STEP = 16  # starts at most
STEPS = 4_096  # that a task ranks at a time
PLACE = np.uint64(0x9E3779B97F4A7C15)
NEVER = np.uint64(2**64 - 1)
UNITS = ("bytes", "words")


def gram(length: int, unit: int) -> int:
    """Symbols that the first rank covers: enough to be rare, few enough that anchors lie far apart."""
    return max(1, length // (2, 3)[unit])


def symbols(b: Block, unit: int) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums over the block's bytes (unit 0) or words (1), for span_hashes, and each text's first symbol, one more at
    the end. Words are runs of bytes other than white space; what lies between them doesn't count."""
    sums = prefix_sums(b.data)
    if unit == 0:
        return sums, b.offsets
    first, end, row = b.words()
    hashes = word_hashes(b.data, first, end) if len(first) else np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(len(hashes))[0][: len(hashes)], out=out[1:])
    return out, np.concatenate([[0], np.cumsum(np.bincount(row, minlength=b.last - b.first))])


def sliding_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Entry p: the smallest of values[p : p + width], for every whole window."""
    n = len(values)
    padded = np.full(-(-n // width) * width, NEVER, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def anchors(sums: np.ndarray, offsets: np.ndarray, length: int, unit: int) -> tuple[np.ndarray, ...]:
    """For each anchor: its text's row in the block, the first and last start of its strings in the text, its own place,
    its rank, and a hash of all symbols of these strings and of its place in them."""
    size, n = gram(length, unit), len(sums) - 1
    sizes = np.diff(offsets)
    if not (sizes >= length).any():
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    at = np.arange(n - size + 1)
    ranks = span_hashes(sums, at, at + size) ^ np.uint64(unit)
    low = np.uint64(int(n).bit_length())
    keys = (ranks >> low << low) | at.astype(np.uint64)
    best = (sliding_minimum(keys, length - size + 1) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    whole = np.zeros(n + 1, np.int64)
    long = np.flatnonzero(sizes >= length)
    whole[offsets[long]] += 1
    whole[offsets[long + 1] - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(whole[:-1]))
    best = best[starts]
    row = np.searchsorted(offsets[1:], starts, "right")
    new = np.flatnonzero(np.concatenate([[True], (best[1:] != best[:-1]) | (row[1:] != row[:-1])]))
    first, anchor, row = starts[new], best[new], row[new]
    last = np.concatenate([starts[new[1:] - 1], starts[-1:]])
    around = mix(span_hashes(sums, first, last + length) + (anchor - first).astype(np.uint64) * PLACE + np.uint64(unit))
    return row, first - offsets[row], last - offsets[row], anchor - offsets[row], ranks[anchor], around


def anchor_rows(docs: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """Rows (row, text) to (row, first, reach, unit, rank, around): one row an anchor; a text is known by its row key, and
    reach holds how far the last start and the anchor lie behind the first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(1)):
                for unit, length in lengths.items():
                    row, first, last, anchor, rank, around = anchors(*symbols(b, unit), length, unit)
                    reach = (last - first << 32) + anchor - first
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(row + b.first)), pa.array(first.astype(np.int32)), pa.array(reach), pa.array(np.full(len(row), unit, np.int8))]
                        + [pa.array(x.view(np.int64)) for x in (rank, around)],
                        ["row", "first", "reach", "unit", "rank", "around"],
                    )

    return docs.mapInArrow(run, "row long, first int, reach long, unit byte, rank long, around long")


def steps(texts: DataFrame, wanted: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """(row, unit, alone, core, first, ranks): the starts of the wanted runs (row, first, reach, unit, alone) in steps. core
    is the rank of what all strings of a step share, ranks those of its starts' whole strings, `first` being the first."""
    listed = wanted.groupBy("row").agg(F.collect_list(F.struct("first", "reach", "unit", "alone")).alias("runs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in enumerate(unpacked(batch.column(1))):
                runs = pa.Table.from_struct_array(batch.column(2)[i].values)
                b = Block(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)]))
                units = runs["unit"].to_numpy()
                for unit, length in lengths.items():
                    some = np.flatnonzero(units == unit)
                    if not len(some):
                        continue
                    sums, _ = symbols(b, unit)
                    width = min(STEP, length // 2)
                    first, reach = (runs[c].to_numpy()[some].astype(np.int64) for c in ("first", "reach"))
                    last, anchor = first + (reach >> 32), first + (reach & 0xFFFFFFFF)
                    n = (anchor - first) // width - (anchor - last) // width + 1
                    of = np.repeat(np.arange(len(n)), n)
                    step = np.repeat((anchor - first) // width, n) - (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
                    final = anchor[of] - step * width  # the last start that the step can have
                    begin, end = np.maximum(final - width + 1, first[of]), np.minimum(final, last[of])
                    core = mix(span_hashes(sums, final, final - width + 1 + length) + step.astype(np.uint64) * PLACE + np.uint64(unit))
                    alone = runs["alone"].combine_chunks().take(pa.array(some[of]))
                    for k in range(0, len(of), STEPS):
                        part = slice(k, k + STEPS)
                        count = (end - begin + 1)[part]
                        until = np.cumsum(count)
                        at = np.arange(until[-1]) + np.repeat(begin[part] - until + count, count)
                        rank = mix(span_hashes(sums, at, at + length // 2) * PLACE + span_hashes(sums, at + length // 2, at + length) + np.uint64(unit))
                        yield pa.RecordBatch.from_arrays(
                            [pa.repeat(batch.column(0)[i], len(count)), pa.array(np.full(len(count), unit, np.int8)), alone.slice(k, STEPS), pa.array(core[part].view(np.int64))]
                            + [pa.array(begin[part].astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], until]).astype(np.int32)), pa.array(rank.view(np.int64)))],
                            ["row", "unit", "alone", "core", "first", "ranks"],
                        )

    rows = texts.join(listed, "row").select("row", "packed", "runs")
    return rows.mapInArrow(run, "row long, unit byte, alone boolean, core long, first int, ranks array<long>")


def repeated(rows: DataFrame, key: str) -> DataFrame:
    """The keys that occur more than once, where there is a mark `alone` in a row that has it; written out so that a join on
    a hot key can be split."""
    counts = rows.groupBy(key).agg(F.count("*").alias("n"), F.max("alone" if "alone" in rows.columns else F.lit(True)).alias("any"))
    return cut(counts.where("n > 1 and any").select(key))


def repeated_starts(docs: DataFrame, texts: DataFrame, lengths: dict[int, int]) -> DataFrame:
    """(row, unit, first, last): runs of starts whose strings start anywhere else too; lengths by unit."""
    place = ["row", "first", "reach", "unit"]
    found = anchor_rows(docs, lengths)
    met = keep(found.join(repeated(found, "rank"), "rank"))

    kinds = met.groupBy("around").agg(
        F.count("*").alias("n"), F.first("rank").alias("rank"), F.min(F.struct(*place)).alias("one")
    )
    kinds = keep(kinds.withColumn("alone", F.col("n") == 1).select("around", "rank", "alone", "one.*"))
    last = (F.col("first") + F.shiftright("reach", 32)).cast("int")
    whole = met.join(kinds.where("not alone").select("around"), "around").select("row", "unit", "first", last.alias("last"))
    open_ranks = cut(kinds.groupBy("rank").agg(F.max("alone").alias("any")).where("any").select("rank"))
    wanted = kinds.join(open_ranks, "rank").select(*place, "alone")

    each = keep(steps(texts, wanted, lengths))
    near = keep(each.join(repeated(each, "core"), "core").select("row", "unit", "alone", F.posexplode("ranks").alias("nth", "rank"), "first"))
    single = near.where("alone").join(repeated(near, "rank"), "rank").select("row", "unit", (F.col("first") + F.col("nth")).alias("first"))
    runs = keep(whole.union(single.withColumn("last", F.col("first"))))
    drop(met, kinds, each, near)
    return runs


def cut_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, carry: list[str] | None = None, unit: str = "bytes", passage: int | None = None
) -> DataFrame:
    """(id_col, n_bytes, spans, kept, passage_words) of every row, and the columns to carry along.

    Strings are `length` bytes or words long. spans are the maximal removed byte runs [start, end), in order, of words from
    the first one's start to the last one's end; kept is what is left, as bytes, since a run of bytes may begin or end inside a
    character. Strings are judged on the input; matches may overlap and lie in one text, never across texts. With `passage`,
    passage_words counts the words that lie in strings of so many words that start elsewhere too, without removing them;
    else it is null. Null texts are empty. Repeated rows repeat each other, so texts of `length` and more in them vanish.
    Null ids are kept. Shorter texts stay whole. Other columns are not looked at, and an empty table gives an empty result.
    """
    if length < 2 or (passage or 2) < 2 or unit not in UNITS or (unit == "words" and passage):
        raise ValueError("strings have at least 2 symbols, bytes or words; passages are marked beside bytes")
    main = UNITS.index(unit)
    lengths = {main: length} | ({1: passage} if passage else {})
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rest = F.struct(*[F.col(f"`{c}`") for c in carry or []]) if carry else F.struct(F.lit(0).alias("_"))
    # Keys of rows are written out with them, so that a task that runs again gives the same ones.
    rows = keep(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), rest.alias("rest"), text.alias("text")))
    texts = packed_texts(rows.select("row", "id", "rest", "text"))
    runs = repeated_starts(rows.select("row", "text"), packed_texts(rows.select("row", "text")), lengths)
    listed = runs.groupBy("row").agg(F.collect_list(F.struct("unit", "first", "last")).alias("runs"))

    def covered(runs: pa.Table, unit: int, n: int) -> np.ndarray:
        """Which of a text's symbols lie in a repeated string."""
        depth = np.zeros(n + 1, np.int32)
        some = runs["unit"].to_numpy() == unit
        np.add.at(depth, runs["first"].to_numpy()[some], 1)
        np.add.at(depth, runs["last"].to_numpy()[some] + lengths[unit], -1)
        return np.cumsum(depth[:-1]) > 0

    def edges(gone: np.ndarray) -> np.ndarray:
        return np.flatnonzero(np.diff(gone, prepend=False, append=False)).reshape(-1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, spans, kept, marked = [], [], [], []
            for text, found in zip(unpacked(batch.column(2)), batch.column(3), strict=True):
                sizes.append(len(text))
                marked.append(0 if passage else None)
                if not found.is_valid:
                    spans.append([])
                    kept.append(text)
                    continue
                places, data = pa.Table.from_struct_array(found.values), np.frombuffer(text, np.uint8)
                first, end, _ = Block(0, 1, data, np.array([0, len(text)])).words() if 1 in lengths else (np.zeros(0, int),) * 3
                if passage:
                    marked[-1] = int(covered(places, 1, len(first)).sum())
                if main == 0:
                    gone = covered(places, 0, len(text))
                else:
                    depth = np.zeros(len(text) + 1, np.int32)
                    ends = edges(covered(places, 1, len(first)))
                    depth[first[ends[:, 0]]] += 1
                    depth[end[ends[:, 1] - 1]] -= 1
                    gone = np.cumsum(depth[:-1]) > 0
                spans.append([{"start": int(a), "end": int(z)} for a, z in edges(gone)])
                kept.append(data[~gone].tobytes())
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary()), pa.array(marked, pa.int64())],
                ["id", "rest", "n_bytes", "spans", "kept", "passage_words"],
            )

    done = texts.join(listed, "row", "left").select("id", "rest", "packed", "runs")
    kinds = [texts.schema[c].dataType.simpleString() for c in ("id", "rest")]
    out = done.mapInArrow(run, f"id {kinds[0]}, rest {kinds[1]}, n_bytes long, spans array<struct<start:int,end:int>>, kept binary, passage_words long")
    carried = [F.col("rest").getField(c).alias(c) for c in carry or []]
    return out.select(F.col("id").alias(id_col), "n_bytes", "spans", "kept", "passage_words", *carried)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the contract's columns, how many words lie in passages of over 50 words that occur elsewhere too, which can
    be shorter than 400 bytes."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]))
    return cut_repeats(table(spark, sf_dir, "documents"), passage=PASSAGE).select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "passage_words"
    )
