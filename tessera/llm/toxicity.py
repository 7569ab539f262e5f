"""Toxicity by a convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings, one of the whole word and one of its first four bytes. Filters over one, two
and three words are max-pooled over the whole text into a logistic output. Trained on a bounded sample of labelled rows;
part of the sample sets a decision threshold for each language, and the language of a text is guessed from its words, so
that a score of one half is the threshold. Scoring is one pass over the documents without a shuffle.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fold, table
from tessera.llm.words import LOWER, Block, blocks, prefix_sums, span_hashes

WORDS, STEMS, STEM_BYTES = 1 << 15, 1 << 13, 4
DIM, FILTERS, WIDTHS = 16, 8, (1, 2, 3)
PAD = max(WIDTHS)
MOST_TOXIC, MOST_CLEAN = 2_000, 4_000  # labelled rows of either kind that are learned from, chosen by a hash of the id
MOST_WORDS = 20_000_000  # words of these rows: rows beyond, in the order of the hash, aren't learned from
STEPS, BATCH, RATE = 900, 32, 0.05


class Model(NamedTuple):
    words: np.ndarray  # (WORDS + 1, DIM); the last row stands for padding
    stems: np.ndarray  # (STEMS + 1, DIM)
    taps: np.ndarray  # (DIM, sum(WIDTHS) * FILTERS): a filter's weights for each word that it spans
    bias: np.ndarray  # (len(WIDTHS) * FILTERS)
    out: np.ndarray  # (len(WIDTHS) * FILTERS)
    shift: float
    guess: np.ndarray  # (STEMS + 1, languages): log-likelihoods
    thresholds: np.ndarray  # (languages)


def padded_words(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word and stem numbers of the block's texts, each text followed by padding; each text's first place; its words."""
    starts, ends, row = b.words()
    texts = b.last - b.first
    counts = np.bincount(row, minlength=texts)
    begin = np.cumsum(counts + PAD) - counts - PAD
    sums = prefix_sums(LOWER[b.data])
    word, stem = np.full(len(starts) + PAD * texts, WORDS), np.full(len(starts) + PAD * texts, STEMS)
    place = np.arange(len(starts)) + PAD * row
    word[place] = (span_hashes(sums, starts, ends) & np.uint64(WORDS - 1)).astype(np.int64)
    stem[place] = (span_hashes(sums, starts, np.minimum(starts + STEM_BYTES, ends)) & np.uint64(STEMS - 1)).astype(np.int64)
    return word, stem, begin, counts


def responses(tapped: np.ndarray, begin: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each filter at each place; minus infinity where a window starts in the padding after the first place."""
    n = len(tapped)
    out = np.full((n, len(WIDTHS) * FILTERS), -np.inf, np.float32)
    at = 0
    for k, width in enumerate(WIDTHS):
        total = tapped[: n - width + 1, at : at + FILTERS].copy()
        for o in range(1, width):
            total += tapped[o : n - width + 1 + o, at + o * FILTERS : at + (o + 1) * FILTERS]
        out[: n - width + 1, k * FILTERS : (k + 1) * FILTERS] = total
        at += width * FILTERS
    for extra in range(1, PAD):
        out[begin + counts + extra] = -np.inf
    return out


def logits(model: Model, word: np.ndarray, stem: np.ndarray, begin: np.ndarray, counts: np.ndarray, tables: tuple | None = None) -> np.ndarray:
    tapped = tables[0][word] + tables[1][stem] if tables else (model.words[word] + model.stems[stem]) @ model.taps
    pooled = np.maximum.reduceat(responses(tapped, begin, counts), begin, axis=0)
    return np.maximum(pooled + model.bias, 0) @ model.out + model.shift


def guesses(model: Model, stem: np.ndarray, begin: np.ndarray) -> np.ndarray:
    return np.add.reduceat(model.guess[stem], begin, axis=0).argmax(1)


def train(texts: list[tuple[np.ndarray, np.ndarray]], toxic: np.ndarray, lang: np.ndarray, weight: np.ndarray) -> Model:
    """Fit on (words, stems) pairs with labels; every fifth text is held back to set the thresholds.

    weight is what a text stands for among all labelled rows. A language without held-back texts of both kinds shares
    the threshold of all languages.
    """
    rng = np.random.default_rng(7)
    languages = max(1, int(lang.max(initial=0)) + 1)
    parts = len(WIDTHS) * FILTERS
    words = rng.normal(0, 0.1, (WORDS + 1, DIM)).astype(np.float32)
    stems = rng.normal(0, 0.1, (STEMS + 1, DIM)).astype(np.float32)
    words[WORDS] = stems[STEMS] = 0
    taps = rng.normal(0, 0.25, (DIM, sum(WIDTHS) * FILTERS)).astype(np.float32)
    bias, out = np.zeros(parts, np.float32), rng.normal(0, 0.3, parts).astype(np.float32)
    guess = np.ones((STEMS + 1, languages))
    for (_, stem), k in zip(texts, lang, strict=True):
        if k >= 0:
            np.add.at(guess[:, k], stem, 1)
    guess = np.log(guess / guess.sum(0)).astype(np.float32)
    guess[STEMS] = 0
    model = Model(words, stems, taps, bias, out, 0.0, guess, np.zeros(languages, np.float32))
    learn = np.arange(len(texts)) % 5 != 4
    kinds = [np.flatnonzero(learn & (toxic == y)) for y in (0, 1)]
    if not all(map(len, kinds)):
        return model._replace(shift=-2.0 if not len(kinds[1]) else 2.0)
    squares = [np.full_like(x, 1e-6) for x in (words, stems, taps, bias, out)]
    shift = 0.0

    def numbers(i: int) -> tuple[np.ndarray, np.ndarray]:
        """One text's words and stems, padded."""
        out = [np.full(len(x) + PAD, pad, np.int64) for x, pad in zip(texts[i], (WORDS, STEMS), strict=True)]
        for held, x in zip(out, texts[i], strict=True):
            held[: len(x)] = x
        return out[0], out[1]

    def outline(i: int) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(1, np.int64), np.array([len(texts[i][0])])

    filter_of = np.concatenate([np.tile(np.arange(FILTERS) + k * FILTERS, w) for k, w in enumerate(WIDTHS)])
    offset_of = np.concatenate([np.repeat(np.arange(w), FILTERS) for w in WIDTHS])
    for step in range(STEPS):
        chosen = np.concatenate([rng.choice(k, BATCH // 2) for k in kinds])
        pooled, seen_words, seen_stems = np.zeros((len(chosen), parts), np.float32), [], []
        for at, i in enumerate(chosen.tolist()):  # a text at a time, so that long ones cost no more than their own length
            word, stem = numbers(i)
            seen = responses((words[word] + stems[stem]) @ taps, *outline(i))
            best = seen.argmax(0)
            pooled[at] = seen[best, np.arange(parts)]
            spots = best[filter_of] + offset_of  # the word that each tap saw
            seen_words.append(word[spots])
            seen_stems.append(stem[spots])
        word, stem = np.array(seen_words), np.array(seen_stems)  # (texts, taps)
        active = np.maximum(pooled + bias, 0)
        wrong = (1 / (1 + np.exp(-np.clip(active @ out + shift, -30, 30))) - toxic[chosen]) / len(chosen)
        back = wrong[:, None] * out * (active > 0)
        pull = back[:, filter_of]
        into = (pull[:, :, None] * taps.T[None]).reshape(-1, DIM)
        grads = [
            None,
            None,
            np.einsum("bt,btd->dt", pull, words[word] + stems[stem]),
            back.sum(0),
            active.T @ wrong + 1e-4 * out,
        ]
        pace = RATE * (1 - step / STEPS)
        for x, s, seen, pad in ((words, squares[0], word, WORDS), (stems, squares[1], stem, STEMS)):
            touched, which = np.unique(seen.reshape(-1), return_inverse=True)
            g = np.zeros((len(touched), DIM), np.float32)
            np.add.at(g, which, into)
            s[touched] += g * g
            x[touched] -= pace * g / np.sqrt(s[touched])
            x[pad] = 0
        for x, s, g in zip((taps, bias, out), squares[2:], grads[2:], strict=True):
            s += g * g
            x -= pace * g / np.sqrt(s)
        shift -= pace * float(wrong.sum())
    model = model._replace(shift=shift)
    held = np.flatnonzero(~learn)
    scores = np.array([logits(model, *numbers(i), *outline(i))[0] for i in held.tolist()])

    def threshold(of: np.ndarray) -> float | None:
        """Half way between the best cut's neighbours: the cut with the least weight on the wrong side."""
        y, s, w = toxic[held][of], scores[of], weight[held][of]
        if not (0 < y.sum() < len(y)):
            return None
        order = np.argsort(s)
        s, below = s[order], np.cumsum(np.where(y == 1, w, -w)[order])
        cut = int(np.argmin(np.concatenate([[0], below])))
        if cut == len(s):
            return float(s[-1]) + 1.0
        return float(s[cut] + (s[cut - 1] if cut else s[cut] - 2.0)) / 2

    common = threshold(np.ones(len(held), bool))
    common = 0.0 if common is None else common
    own = [threshold(lang[held] == k) for k in range(languages)]
    return model._replace(thresholds=np.array([common if t is None else t for t in own], np.float32))


def features(docs: DataFrame, text_col: str) -> DataFrame:
    """The other columns with a text's word and stem numbers as bytes."""
    names = [c for c in docs.columns if c != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, stems = [], []
            for b in blocks(batch.column(len(names))):
                word, stem, begin, counts = padded_words(b)
                for a, n in zip(begin.tolist(), counts.tolist(), strict=True):
                    words.append(word[a : a + n].astype("<u2").tobytes())
                    stems.append(stem[a : a + n].astype("<u2").tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(words, pa.binary()), pa.array(stems, pa.binary())], [*names, "words", "stems"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*names, text_col).mapInArrow(run, f"{kinds}, words binary, stems binary")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Train on the labelled texts of `labels` (id_col, toxic), at most MOST_TOXIC and MOST_CLEAN rows of them.

    A row without a label or text isn't learned from; several labels of one id count as toxic if any is; of equal hashes the
    smaller id comes first; a null language only serves for the common threshold. One task trains, and only the model, of
    a fixed size, reaches the driver.
    """
    known = labels.where("toxic is not null").groupBy(F.col(id_col).alias("id")).agg(F.max("toxic").cast("int").alias("toxic"))
    pick = F.xxhash64("id")
    sample = None
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().where("toxic in (0, 1)").collect()}
    for kind, most in ((1, MOST_TOXIC), (0, MOST_CLEAN)):
        part = known.where(F.col("toxic") == kind).orderBy(pick, "id").limit(most)
        sample = part if sample is None else sample.union(part)
    rows = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    bounded = features(rows.join(F.broadcast(sample), "id"), "text").orderBy(F.xxhash64("id"), "id", "words").limit(MOST_TOXIC + MOST_CLEAN)

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([stored(trained(batches, totals))], pa.binary())], ["model"])

    made = bounded.select("toxic", "lang", "words", "stems").mapInArrow(learn, "model binary").collect()
    return restored(made[0]["model"]) if made else trained(iter(()), totals)


def trained(batches: Iterator[pa.RecordBatch], totals: dict[int, int]) -> Model:
    """A model from batches (toxic, lang, words, stems), with `totals` labelled rows of either kind in all."""
    toxic, lang, texts, words = [], [], [], 0
    for batch in batches:
        for y, name, word, stem in zip(*(batch.column(i) for i in range(4)), strict=True):
            if texts and words >= MOST_WORDS:
                break
            toxic.append(y.as_py())
            lang.append(name.as_py())
            texts.append((np.frombuffer(word.as_py(), "<u2"), np.frombuffer(stem.as_py(), "<u2")))
            words += len(texts[-1][0])
    names = sorted({x for x in lang if x is not None})
    numbers = np.array([names.index(x) if x is not None else -1 for x in lang], np.int64)
    kinds = np.array(toxic, np.float32)
    have = {k: max(1.0, float((kinds == k).sum())) for k in (0, 1)}
    weight = np.array([totals.get(int(y), 1) / have[int(y)] for y in kinds])
    return train(texts, kinds, numbers, weight)


def stored(model: Model) -> bytes:
    out = io.BytesIO()
    np.savez(out, **model._asdict())
    return out.getvalue()


def restored(data: bytes) -> Model:
    with np.load(io.BytesIO(data)) as held:
        return Model(**{k: float(held[k]) if k == "shift" else held[k] for k in Model._fields})


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with `score` in 0..1, one half being the threshold; all their columns stay, one called score being replaced.

    Nothing but the text is looked at. Null and empty texts get the score of a text without words.
    """
    names = [c for c in docs.columns if c != "score"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed size, whatever the input
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = model.words @ model.taps, model.stems @ model.taps
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for b in blocks(batch.column(at)):
                word, stem, begin, counts = padded_words(b)
                x = logits(model, word, stem, begin, counts, tables) - model.thresholds[guesses(model, stem, begin)]
                out[b.first : b.last] = 1 / (1 + np.exp(-np.clip(x.astype(np.float64), -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*names, "score"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names)
    return docs.select(*[f"`{c}`" for c in names]).mapInArrow(run, f"{kinds}, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.where(fold("doc_id", 5) != 0))
    return score(docs.select("doc_id", "text"), model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
