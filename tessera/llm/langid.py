"""Language identification by nearest centroids.

Texts become normalised TF-IDF vectors of hashed byte trigrams over letters. Each language has several centroids,
clustered by cosine from a bounded sample of its texts; a text takes the language of the nearest one. A text farther from
it than nearly all of that centroid's own sample is flagged as rejected.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import drop, fold, keep, sampled_within, table
from tessera.llm.words import LOWER, Block, blocks

DIM, CENTROIDS, ROUNDS = 1 << 12, 4, 8
SAMPLE = 1_000  # texts a language from which centroids are clustered, distinct ones, chosen by a hash of the text
REJECTED = 0.002  # share of a centroid's own sample that lies beyond its reach
UNDETERMINED = "und"
LETTERS = np.where((np.arange(256) >= 128) | ((np.arange(256) >= 97) & (np.arange(256) <= 122)), np.arange(256), 32).astype(np.uint32)


class Model(NamedTuple):
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray  # (centroids, DIM), unit length
    language_of: np.ndarray
    reach: np.ndarray  # the least cosine that isn't rejected


def counts(b: Block) -> np.ndarray:
    """(texts, DIM) trigram counts; whatever isn't a letter counts as a space."""
    out = np.zeros((b.last - b.first, DIM), np.float32)
    n = len(b.data)
    if n < 3:
        return out
    c = LETTERS[LOWER[b.data]]
    code = (c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA6B) + c[2:] * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F)
    code = (code >> np.uint32(32 - 12)).astype(np.int64)
    blank = (c[:-2] == 32) & (c[1:-1] == 32) & (c[2:] == 32)
    code[blank] = -1
    for i in range(len(out)):
        of = code[b.offsets[i] : max(b.offsets[i], b.offsets[i + 1] - 2)]
        of = of[of >= 0]
        if len(of):
            out[i] = np.bincount(of, minlength=DIM)
    return out


def vectors(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Unit TF-IDF rows, with damped counts; zero where a text has no trigram."""
    v = np.log1p(tf) * idf
    norm = np.sqrt((v * v).sum(1, keepdims=True))
    return v / np.where(norm > 0, norm, 1)


def clustered(rows: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Up to k unit centroids by cosine k-means, seeded with rows far from those taken before."""
    seeds = [rows.mean(0)]
    near = rows @ seeds[0]
    for _ in range(min(k, len(rows)) - 1):
        seeds.append(rows[int(near.argmin())])
        near = np.maximum(near, rows @ seeds[-1])
    c = np.array(seeds)
    for _ in range(rounds):
        own = (rows @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, own, rows)
        norm = np.linalg.norm(sums, axis=1)
        c = sums[norm > 0] / norm[norm > 0, None]
    return c


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many of all texts each trigram number occurs, and the number of texts; DIM sums reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(DIM + 1, np.int64)
        for batch in batches:
            for b in blocks(batch.column(0)):
                df[:DIM] += (counts(b) > 0).sum(0)
                df[DIM] += b.last - b.first
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(DIM + 1)), pa.array(df)], ["at", "n"])

    sums = docs.select(text_col).mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(DIM + 1, np.int64)
    df[sums["at"].to_numpy()] = sums["n"].to_numpy()
    return df[:DIM], int(df[DIM])


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from rows with a text and a language: trigram statistics from all, centroids from SAMPLE distinct texts a language,
    a task for each language. Centroids, and a number for each text of the sample, are what reaches the driver."""
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    df, total = document_frequencies(known, "text")
    idf = np.log((1 + total) / (1 + df)).astype(np.float32) + 1
    sample = keep(sampled_within(known, SAMPLE, "lang"))

    def centred(held: pa.Table) -> pa.Table:
        unit = np.concatenate([vectors(counts(b), idf) for b in blocks(held["text"])])
        c = clustered(unit, CENTROIDS).astype(np.float32)
        return pa.table({"lang": pa.repeat(held["lang"][0], len(c)), "centroid": pa.array([x.tobytes() for x in c], pa.binary())})

    got = sample.groupBy("lang").applyInArrow(centred, "lang string, centroid binary").toArrow()
    rows = sorted(zip(got["lang"].to_pylist(), got["centroid"].to_pylist(), strict=True))
    languages = sorted({x for x, _ in rows})
    centroids = np.frombuffer(b"".join(c for _, c in rows), np.float32).reshape(-1, DIM)
    of = np.array([languages.index(x) for x, _ in rows], np.int64)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column(0)):
                cosines = vectors(counts(b), idf) @ centroids.T
                best = cosines.argmax(1)
                yield pa.RecordBatch.from_arrays([pa.array(best), pa.array(cosines[np.arange(len(best)), best].astype(np.float64))], ["best", "cosine"])

    reach = np.zeros(len(of))
    if len(of):
        least = sample.select("text").mapInArrow(near, "best long, cosine double").groupBy("best").agg(F.percentile("cosine", F.lit(REJECTED)).alias("reach"))
        for r in least.collect():  # a row a centroid
            reach[r["best"]] = r["reach"]
    drop(sample)
    return Model(languages, idf, centroids, of, reach)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", reject: bool = True) -> DataFrame:
    """(id_col, lang_pred, score, rejected) of every row.

    score is the cosine to the nearest centroid, in 0..1; of equally near ones the first by language counts. However long a text, it
    is a vector of DIM numbers. `und` where the text is null or has no letter, where nothing
    was learned, and with `reject` also where the text is rejected. Only the text is looked at. Repeated rows come back as
    often as they occur; an empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size depends on the number of languages alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.languages, UNDETERMINED], object)
        for batch in batches:
            lang, score = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            far = np.zeros(batch.num_rows, bool)
            for b in blocks(batch.column(1)):
                if not len(model.centroids):
                    continue
                near = vectors(counts(b), model.idf) @ model.centroids.T
                best = near.argmax(1)
                plain = np.concatenate([[0], np.cumsum((LETTERS[LOWER[b.data]] != 32) & (b.data < 128))])
                lettered = plain[b.offsets[1:]] > plain[b.offsets[:-1]]
                for i in np.flatnonzero(~lettered):
                    text = b.data[b.offsets[i] : b.offsets[i + 1]].tobytes().decode()
                    lettered[i] = any(c.isalpha() for c in text)
                part = slice(b.first, b.last)
                value = near[np.arange(len(best)), best]
                lang[part] = np.where(lettered, model.language_of[best], len(names) - 1)
                score[part] = np.where(lettered, np.clip(value, 0, 1), 0)
                far[part] = value < model.reach[best]
            if reject:
                lang[far] = len(names) - 1
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[lang], pa.string()), pa.array(score), pa.array(far)], ["id", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, lang_pred string, score double, rejected boolean").withColumnRenamed("id", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(fold("doc_id", 3) != 1))
    return predict(docs, model, reject=False).select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected"
    )
