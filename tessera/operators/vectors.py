"""Similarity of embedding columns (id, embedding): thresholds and nearest rows, by pivots and blocks.

Pivots are rows far from each other. A right row lies in the cell of its nearest pivot, at an angle to it; cells are cut into
blocks of neighbouring angles. Angles between vectors obey the triangle inequality, so a left row's angles to the pivots say
which blocks can hold a vector near enough, and it meets no others. Blocks are sent in shelves and left rows in slots; what meets is
compared in matrix products inside tasks, and only what passes becomes rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from tessera.functions.text import dot
from tessera.lineage import settle

BLOCK = 2_048
SHELF, SHELF_BYTES, SHARES = 1 << 18, 128 << 20, 8  # rows and bytes of a side that a task holds at most, and shares of a side that has rows enough
ROWS_A_PIVOT, MOST_PIVOTS, SAMPLE = 512, 4_096, 4_096
BINS = 256  # of angles to a pivot
SLACK = 1e-6  # radians that rounding may cost
TIE = 1e-9  # similarities so near are equal


class Cells(NamedTuple):
    """Blocks of the right side: the cell each lies in (-1 for vectors without length), its angles and its rows."""

    pivots: np.ndarray
    cell: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: np.ndarray
    first: np.ndarray  # (cells + 1, BINS): the first block of a bin, the last row being for vectors without length
    splits: np.ndarray


def unit_rows(rows: DataFrame, width: int) -> DataFrame:
    """(id, unit): vectors as bytes, of floats as floats and of other numbers as doubles, shorter ones being filled up with zeros. They
    become unit vectors where they are read (`stacked`), so floats aren't sent as doubles."""
    sound = rows.where("id is not null and embedding is not null")
    kind = "float" if rows.schema["embedding"].dataType.elementType == FloatType() else "double"
    item = sound.select("id", F.transform("embedding", lambda x: F.coalesce(x.cast(kind), F.lit(0).cast(kind))).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column(1)
            out = np.zeros((len(v), width), np.float32 if kind == "float" else np.float64)
            out[np.arange(width) < np.diff(v.offsets.to_numpy())[:, None]] = v.flatten().to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in out], pa.binary())], ["id", "unit"])

    return item.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, unit binary")


def stacked(column: pa.Array, width: int) -> np.ndarray:
    """Unit vectors in doubles, zero where there is no length, of vectors as bytes."""
    data = b"".join(column.to_pylist())
    out = np.frombuffer(data, np.float32 if len(data) == 4 * width * len(column) else np.float64).reshape(-1, width).astype(np.float64)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, norm, out=out, where=norm > 0)


def far_apart(rows: np.ndarray, k: int) -> np.ndarray:
    """k of the rows, each the one farthest from those taken before."""
    rows = rows[np.linalg.norm(rows, axis=1) > 0.5]
    if not len(rows):
        return rows
    taken = [0]
    near = rows @ rows[0]
    while len(taken) < min(k, len(rows)):
        taken.append(int(near.argmin()))
        near = np.maximum(near, rows @ rows[taken[-1]])
    return rows[taken]


def angles(units: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(units @ pivots.T, -1, 1))


def in_cells(units: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """(id, unit, cell, bin): where each row lies."""
    kind = units.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            u = stacked(batch.column(1), width)
            cell, bin_ = np.full(len(u), -1, np.int32), np.zeros(len(u), np.int32)
            some = np.flatnonzero(np.linalg.norm(u, axis=1) > 0.5)
            if len(some) and len(pivots):
                near = angles(u[some], pivots)
                cell[some] = near.argmin(1)
                bin_[some] = np.minimum(near.min(1) * BINS / np.pi, BINS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(bin_)], ["id", "unit", "cell", "bin"])

    return units.mapInArrow(run, f"id {kind}, unit binary, cell int, bin int")


def cut_in_blocks(placed: DataFrame, pivots: np.ndarray) -> Cells:
    """Blocks of at most BLOCK rows of neighbouring angles; a bin of more rows is several blocks. The counts of bins, a table of
    the size of the pivots, are what reaches the driver."""
    n = np.zeros((len(pivots) + 1, BINS), np.int64)
    for r in placed.groupBy("cell", "bin").count().collect():
        n[r["cell"], r["bin"]] = r["count"]
    first, splits, blocks = np.zeros(n.shape, np.int64), np.ones(n.shape, np.int64), []
    for cell in range(len(n)):
        held = 0
        for b in np.flatnonzero(n[cell]).tolist():
            parts = max(1, -(-int(n[cell, b]) // BLOCK))
            if parts > 1 or not held or held + n[cell, b] > BLOCK:
                first[cell, b], splits[cell, b] = len(blocks), parts
                blocks += [[cell if cell < len(pivots) else -1, b, b + 1, -(-int(n[cell, b]) // parts)] for _ in range(parts)]
                held = 0 if parts > 1 else int(n[cell, b])
            else:
                first[cell, b] = len(blocks) - 1
                blocks[-1][2], blocks[-1][3] = b + 1, blocks[-1][3] + int(n[cell, b])
                held += int(n[cell, b])
    table = np.array(blocks, np.int64).reshape(-1, 4)
    return Cells(pivots, table[:, 0], table[:, 1] * np.pi / BINS, table[:, 2] * np.pi / BINS, table[:, 3], first, splits)


def share(rows: int, width: int) -> int:
    """How many rows of a side one task holds: a share of all, at most what SHELF and SHELF_BYTES allow, at least a block."""
    return max(BLOCK, min(SHELF, SHELF_BYTES // (8 * width + 64), -(-rows // SHARES)))


def shelved(cells: Cells, width: int) -> np.ndarray:
    """The shelf of each block: neighbouring blocks of about one share of rows, so that a row is sent once to all of them."""
    return (np.cumsum(cells.size) - cells.size) // share(int(cells.size.sum()), width)


def right_rows(placed: DataFrame, cells: Cells) -> DataFrame:
    """(block, id, unit): the rows of the right side with their blocks."""
    kind = placed.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            cell, bin_ = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            block = cells.first[cell, bin_] + (at + np.arange(len(cell))) % cells.splits[cell, bin_]
            at += len(cell)
            yield pa.RecordBatch.from_arrays([pa.array(block), batch.column(0), batch.column(1)], ["block", "id", "unit"])

    return placed.mapInArrow(run, f"block long, id {kind}, unit binary")


def bounds(u: np.ndarray, cells: Cells) -> np.ndarray:
    """(rows, blocks): an angle that no vector of the block is nearer than. Vectors without length are at a right angle to all."""
    out = np.full((len(u), len(cells.cell)), np.pi / 2)
    some = np.flatnonzero(np.linalg.norm(u, axis=1) > 0.5)
    held = np.flatnonzero(cells.cell >= 0)
    if len(some) and len(held):
        to = angles(u[some], cells.pivots)
        a = to[:, cells.cell[held]]
        least = np.maximum(np.maximum(a - cells.high[held], cells.low[held] - a), (a - to.min(1)[:, None]) / 2)
        out[np.ix_(some, held)] = np.maximum(least, 0)
    return out


class Slots(NamedTuple):
    """Where left rows go: rows of a cell, and of cells next to it, share a slot; a cell of more rows than a share has several."""

    first: np.ndarray
    splits: np.ndarray
    many: int


def in_slots(left: DataFrame, cells: Cells, width: int) -> Slots:
    counts = np.zeros(len(cells.pivots) + 1, np.int64)
    for r in left.groupBy("cell").count().collect():  # at most a row a pivot
        counts[r["cell"]] = r["count"]
    most = share(int(counts.sum()), width)
    splits = np.maximum(-(-counts // most), 1)
    first, slot, held = np.zeros(len(counts), np.int64), 0, 0
    for cell, (n, k) in enumerate(zip(counts.tolist(), splits.tolist(), strict=True)):
        if held and held + n > most:
            slot, held = slot + 1, 0
        first[cell] = slot
        slot, held = (slot + k, 0) if k > 1 else (slot, held + n)
    return Slots(first, splits, slot + 1)


def meetings(
    left: DataFrame, cells: Cells, width: int, choose: Callable[[np.ndarray, np.ndarray], np.ndarray], shelf: np.ndarray | None = None, slots: Slots | None = None
) -> DataFrame:
    """(block, slot, id, unit, bar) for rows (id, unit, cell, bin, bar): the blocks that `choose` takes for each row by its bounds
    and its bar; with `shelf`, the shelf of each block, a row for each shelf that holds such blocks in their place."""
    slots = slots or in_slots(left, cells, width)
    held, starts = (np.arange(len(cells.cell)),) * 2 if shelf is None else np.unique(shelf, return_index=True)
    kind = left.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = 0
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                u, cell = stacked(some.column(1), width), some.column(2).to_numpy()
                chosen = choose(bounds(u, cells), some.column(4).to_numpy())
                row, place = np.nonzero(np.logical_or.reduceat(chosen, starts, axis=1) if len(starts) else chosen)
                slot = slots.first[cell] + (at + np.arange(len(cell))) % slots.splits[cell]
                at += len(cell)
                took = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(held[place]), pa.array(slot[row]), some.column(0).take(took), some.column(1).take(took), some.column(4).take(took)], ["block", "slot", "id", "unit", "bar"]
                )

    return left.mapInArrow(run, f"block long, slot long, id {kind}, unit binary, bar double")


class Best:
    """The `top` best candidates (row, column) of each of a few left rows, by similarity to nine digits and then by right id, or
    by right id alone."""

    def __init__(self, floor: np.ndarray, top: int, order: np.ndarray, by_id: bool) -> None:
        self.floor, self.top, self.order, self.by_id, self.new, self.parts = floor, top, order, by_id, 0, []
        self.most = np.full(len(floor), len(order))  # ids from here on are too large
        self.add(*(np.zeros(0, t) for t in (np.int64, np.int64, np.float64)))

    def add(self, row: np.ndarray, column: np.ndarray, near: np.ndarray) -> None:
        if self.by_id:
            row, column, near = (x[self.order[column] <= self.most[row]] for x in (row, column, near))
        self.parts.append((row, column, near))
        self.new += len(row)
        if self.new > self.top * len(self.floor):
            self.settle()

    def settle(self) -> tuple[np.ndarray, ...]:
        """(row, column, similarity, similarity to nine digits) of the best so far; a row's last one is the bar for what comes."""
        row, column, near = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        nine = np.round(near, 9)
        by = np.lexsort((self.order[column], row) if self.by_id else (self.order[column], -nine, row))
        sorted_ = row[by]
        nth = np.arange(len(by)) - np.searchsorted(sorted_, sorted_, "left")
        by = by[nth < self.top]
        row, column, near, nine, last = row[by], column[by], near[by], nine[by], nth[nth < self.top] == self.top - 1
        if self.by_id:
            self.most[row[last]] = self.order[column[last]]
        else:
            self.floor[row[last]] = np.maximum(self.floor[row[last]], nine[last] - TIE)
        self.parts, self.new = [(row, column, near)], 0
        return row, column, near, nine


def compared(left: DataFrame, right: DataFrame, cells: Cells, width: int, choose: Callable[[np.ndarray, np.ndarray], np.ndarray], slack: float, top: int | None, by_id: bool = False) -> DataFrame:
    """(left_id, right_id, similarity) of what meets, at or above the left row's bar; with `top` only the best of a shelf for each row,
    and the similarity to nine digits, by which they are the best, unless the smallest ids are wanted; with a `top` of 0 only (left_id),
    once a shelf. Equal ids don't meet.

    Both sides are cut into shares: a task holds a slot of the left and a shelf of the right side, so a row is sent as often as the other
    side has shares, whatever the number of blocks that it meets there; a shelf goes only to slots of which a row meets one of its blocks.
    """
    shelf, slots = shelved(cells, width), in_slots(left, cells, width)
    first, last = left.schema["id"].dataType, right.schema["id"].dataType
    meet = meetings(left, cells, width, choose, shelf, slots)
    a = meet.select(F.col("block").alias("shelf"), "slot", F.col("id").alias("left_id"), F.lit(None).cast(last).alias("right_id"), "unit", "bar", F.lit(-1).cast("long").alias("block"))
    on = F.element_at(F.lit(shelf.tolist()).cast("array<long>"), (F.col("block") + 1).cast("int")).alias("shelf")
    wanted: list[list[int]] = [[] for _ in range(int(shelf.max(initial=-1)) + 1)]
    for r in meet.select("block", "slot").distinct().collect():  # at most a row for each shelf and slot
        wanted[r["block"]].append(r["slot"])
    to = F.element_at(F.lit([",".join(map(str, sorted(x))) for x in wanted]).cast("array<string>"), (F.col("shelf") + 1).cast("int"))
    sent = right_rows(right, cells).withColumn("shelf", on).withColumn("to", to).where("to <> ''")
    b = sent.select("shelf", F.explode(F.split("to", ",").cast("array<long>")).alias("slot"), F.lit(None).cast(first).alias("left_id"), F.col("id").alias("right_id"), "unit", F.lit(None).cast("double").alias("bar"), "block")
    places = cells._replace(first=None, splits=None)  # what bounds need
    names = ["left_id", "right_id", "similarity", "nine"][: 3 if top is None else 4 if top else 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches))
        sides = [held.filter(mask) for mask in (pc.less(held["block"], 0), pc.greater_equal(held["block"], 0))]
        if not all(map(len, sides)):
            return
        x, y = sides
        ids = pc.unique(y["right_id"])
        ids = ids.take(pc.sort_indices(ids))
        y = y.take(pa.array(np.lexsort((pc.index_in(y["right_id"], ids).to_numpy(), y["block"].to_numpy()))))
        i, j = x["left_id"].combine_chunks(), y["right_id"].combine_chunks()
        order = pc.index_in(j, ids).to_numpy()
        own = pc.index_in(i, ids).fill_null(-1).to_numpy(zero_copy_only=False) if i.type == j.type else np.full(len(i), -1)
        u, v, bar = stacked(x["unit"], width), stacked(y["unit"], width), x["bar"].to_numpy()
        block, begin = np.unique(y["block"].to_numpy(), return_index=True)
        end = np.append(begin[1:], len(j))

        def out(rows: np.ndarray, columns: np.ndarray, *values: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([i.take(pa.array(rows)), j.take(pa.array(columns)), *map(pa.array, values)][: len(names)], names)

        for at in range(0, len(i), BLOCK):
            some = slice(at, at + BLOCK)
            chosen, floor = choose(bounds(u[some], places), bar[some]), bar[some] - slack
            best = Best(floor, top, order, by_id) if top else None
            met = np.zeros(len(floor), bool)
            for k, z, e in zip(block.tolist(), begin.tolist(), end.tolist(), strict=True):
                rows = np.flatnonzero(chosen[:, k] & ~met)
                if not len(rows):
                    continue
                near = u[some][rows] @ v[z:e].T
                near[np.isnan(near)] = -np.inf
                low, high = (np.searchsorted(order[z:e], own[some][rows], way) for way in ("left", "right"))
                for r in np.flatnonzero(high > low):
                    near[r, low[r] : high[r]] = -np.inf
                good = near >= floor[rows, None]
                if top and not by_id and near.shape[1] > top and np.count_nonzero(good) > 4 * top * len(rows):
                    good &= near >= (np.partition(near, -top, axis=1)[:, -top] - TIE)[:, None]
                if top == 0:
                    met[rows[good.any(1)]] = True
                    continue
                r, c = np.nonzero(good)
                if best is not None:
                    best.add(rows[r], c + z, near[r, c])
                elif len(r):
                    yield out(rows[r] + at, c + z, near[r, c])
            if best is not None:
                row, *rest = best.settle()
                yield out(row + at, *rest)
            if top == 0:
                rows = np.flatnonzero(met)
                yield out(rows + at, np.zeros(len(rows), np.int64))

    schema = ", ".join([f"left_id {first.simpleString()}", f"right_id {last.simpleString()}", "similarity double", "nine double"][: len(names)])
    return a.unionByName(b).groupBy("shelf", "slot").applyInArrow(run, schema)


def prepared(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame, Cells, int]:
    """Both sides in cells, the right side's blocks, and the width of all vectors."""
    size = F.max(F.size("embedding")).alias("n")
    width = max(1, *[df.where("embedding is not null").agg(size).first()["n"] or 0 for df in (left, right)])
    b = unit_rows(right, width)
    k = min(MOST_PIVOTS, -(-right.count() // ROWS_A_PIVOT))
    sample = b.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("unit").toArrow()["unit"].combine_chunks()
    pivots = far_apart(stacked(sample, width), k)
    placed = settle(in_cells(b, pivots, width))
    return settle(in_cells(unit_rows(left, width), pivots, width)), placed, cut_in_blocks(placed, pivots), width


def near_enough(least: np.ndarray, bar: np.ndarray) -> np.ndarray:
    return least <= np.arccos(np.clip(bar - 2 * TIE, -1, 1))[:, None] + SLACK


def above(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """All pairs of a cosine of at least the threshold. Vectors of unequal length are compared as if the shorter one went on
    with zeros; null ids and vectors take no part."""
    a, b, cells, width = prepared(left, right)
    return compared(a.withColumn("bar", F.lit(float(threshold))), b, cells, width, near_enough, 0.0, None)


def linked(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """(left_id) of the left rows that a right row of another id reaches the threshold with."""
    a, b, cells, width = prepared(left, right)
    return compared(a.withColumn("bar", F.lit(float(threshold))), b, cells, width, near_enough, 0.0, 0).distinct()


def first_beyond(left: DataFrame, right: DataFrame, threshold: float, most: int) -> DataFrame:
    """The first right rows by id, at most so many of each left row, whose cosine is over the threshold, numbered (nth)."""
    a, b, cells, width = prepared(left, right)
    over = float(np.nextafter(threshold, 2.0))
    few = compared(a.withColumn("bar", F.lit(over)), b, cells, width, near_enough, 0.0, most, by_id=True).drop("nine")
    return few.withColumn("nth", F.row_number().over(Window.partitionBy("left_id").orderBy("right_id"))).where(F.col("nth") <= most)


def nearest(left: DataFrame, right: DataFrame, k: int, threshold: float | None = None, where: Column | str | None = None) -> DataFrame:
    """The k most similar right rows of each left row with their rank, of those that a condition on the right side selects and
    that reach the threshold; ties by right id.

    A row first meets the blocks of the smallest bounds that hold k rows; its k-th best there is the bar for all others.
    """
    a, b, cells, width = prepared(left, right if where is None else right.where(where))
    least = -1.0 if threshold is None else float(threshold)

    def first(bound: np.ndarray, bar: np.ndarray) -> np.ndarray:
        order = np.argsort(bound, axis=1, kind="stable")
        size = cells.size[order]
        took = np.zeros(bound.shape, bool)
        np.put_along_axis(took, order, np.cumsum(size, axis=1) - size < k + 1, axis=1)
        return took

    a = a.withColumn("bar", F.lit(least))
    order = Window.partitionBy("left_id").orderBy(F.col("nine").desc(), "right_id")
    if len(cells.cell) > 1:
        tried = compared(a, b, cells, width, first, TIE, k)
        bar = tried.withColumn("nth", F.row_number().over(order)).where(F.col("nth") == k).select(F.col("left_id").alias("id"), F.col("similarity").alias("kth"))
        a = settle(a.join(bar, "id", "left").withColumn("bar", F.greatest("bar", F.coalesce("kth", F.lit(-1.0)))).drop("kth"))
    met = compared(a, b, cells, width, near_enough, TIE, k)
    if threshold is not None:
        met = met.where(F.col("similarity") >= least)
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("nine")


def coherence(items: DataFrame) -> DataFrame:
    """Mean cosine over unordered pairs, 1 with fewer than two: of n unit vectors, (length of their sum squared - sum of
    their squared lengths) / (n (n - 1)), so one pass does."""
    v = F.col("embedding")
    norm = F.sqrt(dot(v, v))
    unit = items.where("embedding is not null").select(norm.alias("norm"), F.posexplode("embedding").alias("at", "x"))
    sums = unit.groupBy("at").agg(F.sum(F.when(F.col("norm") > 0, F.col("x").cast("double") / F.col("norm"))).alias("s")).agg(F.sum(F.col("s") * F.col("s")).alias("square"))
    size = items.agg(F.count("embedding").alias("n"), F.coalesce(F.count_if(dot(v, v) > 0), F.lit(0)).alias("own"))
    pairs = F.col("n") * (F.col("n") - 1)
    value = (F.col("square") - F.col("own")) / F.nullif(pairs, F.lit(0))
    return size.join(F.broadcast(sums)).select(F.coalesce(F.when(F.col("n") > 1, value), F.lit(1.0)).alias("coherence"), F.expr("n * (n - 1) div 2").alias("pairs"))  # one row each
