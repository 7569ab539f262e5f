"""Best-fit packing of documents into token sequences, in bulk-synchronous rounds.

A round range-sorts the gaps of open sequences and the waiting documents together by size, largest first, gaps before
documents of the same size. Swept in that order, each document takes the gap seen last, which is the smallest that holds
it; gaps and documents thus match like brackets. Every partition sweeps its own range: its sums are first chained on the
driver (a few numbers a partition), so it knows how deep the nesting is where it begins. A document and its gap are
neighbours at one depth. Gaps are then updated and the round repeats. Documents that find no gap come numbered in order
of size; those larger than every gap open new sequences, as few as their tokens need, largest first. Gaps much larger
than any waiting document are offered in several slots at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, keep, table
from tessera.llm.encode import tokenizer_path, word_encoder
from tessera.llm.words import blocks

LENGTH, END = 4096, 1
SLOTS = 64
PART = 20_000  # rows in a partition of the rounds' tables, which get smaller than the cluster's usual number is made for


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END, path: str | None = None) -> DataFrame:
    """(id_col, piece, start, length, ids): each text's token ids and `end`, cut into pieces of `length` only if longer.

    ids are unsigned 32-bit little-endian. Null and empty texts are one piece holding `end`.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(path)
        for batch in batches:
            for b in blocks(batch.column(1), 1 << 21):
                ids, counts = encoder.encode(b)
                after = np.cumsum(counts)
                full = np.insert(ids, after, end).astype("<u4")
                counts = counts + 1
                begin = np.cumsum(counts) - counts
                n = -(-counts // length)
                row = np.repeat(np.arange(len(counts)), n)
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start = piece * length
                size = np.minimum(counts[row] - start, length)
                first = begin[row] + start
                raw = full.tobytes()
                cut_ids = [raw[4 * a : 4 * (a + k)] for a, k in zip(first.tolist(), size.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row + b.first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(size), pa.array(cut_ids, pa.binary())],
                    ["id", "piece", "start", "length", "ids"],
                )

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


def swept(offered: DataFrame, parts: int) -> DataFrame:
    """Rows (kind, key, slot, size, gap), kind 0 for slots of gaps and 1 for items, with `level`, the depth at which a row
    is matched, and `nth`, which numbers the items that find no gap from 1 on, largest first (level is then -nth)."""
    names = ["kind", "key", "slot", "size", "gap", "level"]
    order = [F.col("size").desc(), F.col("kind"), F.col("key"), F.col("slot")]
    ranged = cut(offered.repartitionByRange(parts, *order).sortWithinPartitions(*order)).select(F.spark_partition_id().alias("part"), "*")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net, low, part = 0, 0, None
        for batch in batches:
            if batch.num_rows:
                nets = net + np.cumsum(1 - 2 * batch.column(1).to_numpy().astype(np.int64))
                part, net, low = batch.column(0)[0].as_py(), int(nets[-1]), min(low, int(nets.min()))
        if part is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([net]), pa.array([low])], ["part", "net", "low"])

    before, net, low = {}, 0, 0
    for r in sorted(ranged.select("part", "kind").mapInArrow(sums, "part int, net long, low long").collect()):
        before[r["part"]] = net, low
        net, low = net + r["net"], min(low, net + r["low"])

    def levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if net is None:
                net, low = before[batch.column(0)[0].as_py()]
            item = batch.column(1).to_numpy() == 1
            nets = net + np.cumsum(np.where(item, -1, 1))
            lows = np.minimum(np.minimum.accumulate(nets), low)
            alone = lows < np.concatenate([[low], lows[:-1]])
            level = np.where(alone, lows, nets - lows + item)
            net, low = int(nets[-1]), int(lows[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(level)], names)

    return ranged.mapInArrow(levels, "kind int, key long, slot int, size long, gap long, level long").coalesce(parts)


def best_fit(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Items (item, size), item unique and sizes 1..length, to (item, size, bin, round, slot): in a bin, sizes add up to
    at most `length`. Bins are named by the item that opened them."""
    opens = F.col("size") * 2 > length
    parts = -(-items.count() // PART) + 1
    first = cut(items.select("item", "size", opens.alias("opens")))
    done = [first.where("opens").select("item", "size", F.col("item").alias("bin"), F.lit(0).alias("round"), F.lit(0).alias("slot"))]
    gaps = first.where(F.col("opens") & (F.col("size") < length)).select(F.col("item").alias("bin"), (F.lit(length) - F.col("size")).alias("gap"))
    todo = first.where(~F.col("opens")).select("item", "size")
    turn = 0
    while True:
        # At most as many rows as a sequence has tokens, twice.
        seen = todo.select(F.lit(1).alias("kind"), "size").union(gaps.select(F.lit(0), "gap")).groupBy("kind", "size").count().collect()
        waiting = sorted(((r["size"], r["count"]) for r in seen if r["kind"] == 1), reverse=True)
        if not waiting:
            break
        widest = max((r["size"] for r in seen if r["kind"] == 0), default=0)
        turn += 1
        largest, least = waiting[0][0], waiting[-1][0]
        tokens = sum(size * n for size, n in waiting if size > widest)
        slots = F.least(F.greatest(F.floor(F.col("gap") / F.lit(largest)), F.lit(1)), F.lit(SLOTS)).cast("int")
        offered = (
            gaps.where(F.col("gap") >= least)  # no waiting item will ever fit a smaller one
            .withColumn("slots", slots)
            .select(F.lit(0).alias("kind"), F.col("bin").alias("key"), F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), F.floor(F.col("gap") / F.col("slots")).alias("size"), "gap")
            .union(todo.select(F.lit(1), "item", F.lit(0), "size", F.lit(None).cast("long")))
        )
        nested = Window.partitionBy("level").orderBy(F.col("size").desc(), "kind")
        met = swept(offered, parts).withColumns({"held": F.lag(F.struct("key", "slot")).over(nested), "taken": F.lead("size").over(nested)})
        met = cut(met.coalesce(parts))
        new = (F.col("kind") == 1) & F.col("level").between(-(-(-tokens // length)), -1)
        done.append(met.where("kind = 1 and level > 0").select(F.col("key").alias("item"), "size", "held.key", F.lit(turn), "held.slot"))
        if tokens:
            done.append(met.where(new).select(F.col("key").alias("item"), "size", "key", F.lit(turn), F.lit(0)))
        gaps = met.where("kind = 0").groupBy(F.col("key").alias("bin")).agg((F.first("gap") - F.sum(F.coalesce("taken", F.lit(0)))).alias("gap")).where("gap > 0").coalesce(parts)
        gaps = gaps.union(met.where(new & (F.col("size") < length)).select("key", F.lit(length) - F.col("size")))
        todo = met.where((F.col("kind") == 1) & (F.col("level") < 0) & ~new).select(F.col("key").alias("item"), "size")
    whole = done[0]
    for part in done[1:]:
        whole = whole.union(part)
    return whole


def pack(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows with a `length` column (1..length) get sequence_id and a gapless offset in it; other columns stay.

    Rows may repeat and hold nulls elsewhere: each row is an item of its own. An empty table gives an empty result. The
    sequences' order and numbers mean nothing.
    """
    rows = keep(pieces.withColumn("item", F.monotonically_increasing_id()))
    fit = best_fit(rows.select("item", F.col("length").cast("long").alias("size")), length)
    inside = Window.partitionBy("bin").orderBy("round", "slot", "item").rowsBetween(Window.unboundedPreceding, -1)
    spots = fit.select("item", F.col("bin").alias("sequence_id"), F.coalesce(F.sum("size").over(inside), F.lit(0)).alias("offset"))
    return rows.join(spots, "item").drop("item")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = token_pieces(table(spark, sf_dir, "documents"))
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
