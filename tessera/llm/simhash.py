"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. Of three differing bits one segment holds at most one, so two
linked fingerprints share that segment with one bit wildcarded: 64 signatures a fingerprint, an equality join, and a
check of the whole distance. Signatures of unusually many fingerprints are first refined by the same rule on the other
segment, cut into halves of 16 bits, which again loses no link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, partitions, table
from tessera.llm.components import components
from tessera.llm.words import LOWER, blocks

DISTANCE, SHINGLE, SEED = 3, 3, 42
CROWDED = 2_000  # fingerprints under one signature beyond which the signature is refined


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Bit i is 1 if over half of the shingles' hashes have it; 0 for a text without words."""
    words = text.split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = min(shingle, len(words)) - 1
    spans = zip(starts[: len(starts) - last].tolist(), ends[last:].tolist(), strict=True)
    hashes = np.array([xxhash.xxh64_intdigest(joined[a:z], SEED) for a, z in spans], ">u8")
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65536):
        total += np.unpackbits(hashes[at : at + 65536].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big", signed=False)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp): a signed 64-bit fingerprint of each row's whole text; null and blank texts get 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros(batch.num_rows, np.uint64)
            for b in blocks(batch.column(1)):
                low = LOWER[b.data].tobytes()
                for i in range(b.last - b.first):
                    out[b.first + i] = fingerprint(low[b.offsets[i] : b.offsets[i + 1]])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, fp long")


def wildcards(segment: Column, bits: int, tag: int) -> Column:
    """The segment's variants with one bit cleared, each with the bit's number (from `tag`) above its own bits."""
    return F.array(*[segment.bitwiseAND(F.lit(((1 << bits) - 1) & ~(1 << i))).bitwiseOR(F.lit((tag + i) << bits)) for i in range(bits)])


def segment(fp: Column, low: int, bits: int) -> Column:
    return F.shiftrightunsigned(fp, low).bitwiseAND(F.lit((1 << bits) - 1))


def pairs(signed: DataFrame, key: list[str], distance: int) -> DataFrame:
    """Linked pairs a < b among rows (key..., fp) that share a key."""
    left, right = signed.withColumnRenamed("fp", "a"), signed.withColumnRenamed("fp", "b")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    return left.join(right, key).where((F.col("a") < F.col("b")) & near).select("a", "b")


def links(distinct: DataFrame, distance: int = DISTANCE, crowded: int = CROWDED) -> DataFrame:
    """All pairs (a, b) of distinct fingerprints at most `distance` (up to 3) bits apart, repeats possible."""
    if not 0 <= distance <= 3:
        raise ValueError("two segments find pairs of up to 3 differing bits")
    low, high = segment(F.col("fp"), 0, 32), segment(F.col("fp"), 32, 32)
    # Each row becomes 64, so they are dealt anew: by another hash, as the grouping by fp stands in few partitions.
    spread = cut(distinct.repartition(partitions(distinct.sparkSession), F.xxhash64("fp", F.lit(1))))
    signed = spread.select("fp", F.explode(F.concat(wildcards(low, 32, 0), wildcards(high, 32, 32))).alias("key"))
    shared = signed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(signed.join(shared, "key"))
    few = met.where(F.col("n") <= crowded).select("key", "fp")
    rest = F.when(F.col("key") < F.lit(32 << 32), high).otherwise(low)  # the segment that the key leaves out
    many = met.where(F.col("n") > crowded).select(
        "key",
        "fp",
        F.explode(F.concat(wildcards(rest.bitwiseAND(F.lit(0xFFFF)), 16, 0), wildcards(F.shiftrightunsigned(rest, 16), 16, 16))).alias("part"),
    )
    return pairs(few, ["key"], distance).union(pairs(many, ["key", "part"], distance))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """(id_col, fingerprint, component_id) of every row.

    Texts are lower-cased (A-Z) and cut into word shingles; equal fingerprints are one node; nodes at most `distance`
    bits apart link. component_id is the smallest id reachable, null ids being passed over (null if all are). Null,
    empty and blank texts have fingerprint zero and link like any other. Repeated rows come back as often as they occur;
    other columns are not looked at. An empty table gives an empty result.
    """
    rows = cut(fingerprints(docs, id_col, text_col))
    nodes = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = components(links(nodes.select("fp"), distance))
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fp", "component_id")
    return rows.join(named, "fp").select(
        F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
