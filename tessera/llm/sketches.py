"""Document fingerprints by threshold-scaled sketches.

A sketch holds every hash of a text's five-word shingles below a fixed fraction of the hash range. Sketches of parts merge
by union, and the containment of one text in another is estimated from the hashes that both hold, however unequal the two
are. So that no text with words goes without, the smallest hash is held too.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import partitions, table
from tessera.llm.words import LOWER, blocks, mix, packed_texts, unpacked, word_hashes

SHINGLE, FRACTION = 5, 1 / 4
STEP = np.uint64(0x9E3779B97F4A7C15)


def sketches(texts: list[bytes], shingle: int = SHINGLE, fraction: float = FRACTION) -> list[np.ndarray]:
    """Each text's sketch: ascending distinct hashes. Fewer words than a shingle has make one shingle; none make none."""
    limit = np.uint64(int(fraction * 2**64))
    out: list[np.ndarray] = []
    for b in blocks(pa.array(texts, pa.binary())):
        starts, ends, row = b.words()
        hashes = word_hashes(LOWER[b.data], starts, ends)
        counts = np.bincount(row, minlength=b.last - b.first)
        total = np.zeros(len(hashes), np.uint64)
        until = (np.cumsum(counts))[row]
        for o in range(shingle):
            at = np.arange(len(hashes)) + o
            inside = at < until
            total[inside] = mix(total[inside] * STEP + hashes[at[inside]])
        spare = np.minimum(counts, shingle)[row]
        whole = np.arange(len(hashes)) + spare <= until
        keep = whole & (total < limit)
        begins = np.cumsum(counts) - counts
        some = np.flatnonzero(counts)
        if len(some):
            smallest = np.minimum.reduceat(np.where(whole, total, np.uint64(2**64 - 1)), begins[some])
            keep |= whole & (total == np.repeat(smallest, counts[some]))
        held, owner = total[keep], row[keep]
        order = np.lexsort((held, owner))
        held, owner = held[order], owner[order]
        fresh = np.concatenate([[True], (held[1:] != held[:-1]) | (owner[1:] != owner[:-1])]) if len(held) else np.zeros(0, bool)
        held, owner = held[fresh], owner[fresh]
        out += np.split(held, np.searchsorted(owner, np.arange(1, b.last - b.first)))
    return out


def merged(*parts: np.ndarray) -> np.ndarray:
    return np.unique(np.concatenate(parts))


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of a's shingles that b has; 1 if neither has any, 0 if only one has none."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """The larger of the two containments."""
    return containment(a, b) if len(a) <= len(b) else containment(b, a)


def rendered(sketch: np.ndarray) -> str:
    return sketch.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, fingerprint) of every row, lower-case hexadecimal; null counts as empty, whose fingerprint is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(rendered, sketches(texts)), pa.string())], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string").withColumnRenamed("id", id_col)


def successions(docs: DataFrame) -> DataFrame:
    """Rows (id, text) dealt into runs of descending id, each run followed by the first row of the next: (run, halo, down,
    tie, id, packed), sorted within partitions. After the last run comes the first. One shuffle of the texts.

    Null ids come last; equal ids follow a hash of their texts. Runs are bounded by approximate quantiles of the ids, one
    run a shuffle partition.
    """
    n = partitions(docs.sparkSession)
    down = F.bitwise_not(F.coalesce(F.col("id"), F.lit(-(2**63))))
    rows = docs.select("id", down.alias("down"), F.xxhash64("text").alias("tie"), "text")
    bounds = sorted(set(rows.stat.approxQuantile("down", [i / n for i in range(1, n)], 0.2 / n)))
    run: Column = F.lit(0)
    if bounds:
        run = F.size(F.filter(F.array(*[F.lit(int(x)) for x in bounds]), lambda x: x < F.col("down")))
    rows = rows.withColumn("run", run)
    heads = rows.groupBy("run").agg(F.min(F.struct("down", "tie")).alias("head")).select("run", "head.*").collect()  # at most n rows
    heads.sort(key=lambda r: r["run"])
    follows = {(h["down"], h["tie"]): heads[i - 1]["run"] for i, h in enumerate(heads)}
    before = docs.sparkSession.createDataFrame([(d, t, r) for (d, t), r in follows.items()], "down long, tie long, before int")
    halo = rows.join(F.broadcast(before), ["down", "tie"]).select("id", "down", "tie", "text", F.col("before").alias("run"))
    both = rows.select("run", F.lit(False).alias("halo"), "down", "tie", "id", "text").unionByName(halo.withColumn("halo", F.lit(True)))
    packed = packed_texts(both.select("run", "halo", "down", "tie", "id", "text"))
    return packed.repartitionByRange(n, "run").sortWithinPartitions("run", "halo", "down", "tie")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row by descending id.

    The edited text has the last half of the code points replaced by the first as many of the next row's text (or all of
    it). Null texts are empty; a single row is its own next; repeated rows follow each other; an empty table gives an
    empty result; other columns are not looked at.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = successions(docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left: list[tuple] = []  # the last row seen: run, halo, id, text
        names = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                seen = left + list(zip(part["run"].to_pylist(), part["halo"].to_pylist(), part["id"].to_pylist(), unpacked(part["packed"]), strict=True))
                left = seen[-1:]
                out = []
                own = sketches([x[3] for x in seen])
                texts = [x[3].decode() for x in seen]
                pairs = [i for i in range(len(seen) - 1) if not seen[i][1] and seen[i][0] == seen[i + 1][0]]
                edited = []
                for i in pairs:
                    half = len(texts[i]) // 2
                    edited.append((texts[i][: len(texts[i]) - half] + texts[i + 1][:half]).encode())
                for i, new, sketch in zip(pairs, edited, sketches(edited), strict=True):
                    near = likeness(own[i], sketch), likeness(own[i], own[i + 1])
                    out.append((seen[i][2], len(texts[i]), hashlib.sha256(new).hexdigest(), rendered(own[i]), rendered(sketch), *near))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                columns = list(zip(*out, strict=True)) if out else [()] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    schema = "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(table(spark, sf_dir, "documents"))
