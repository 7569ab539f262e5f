"""Every registered query on the smallest tables: its columns, and its rows against brute force."""

from __future__ import annotations

import bisect
import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tessera.llm import encode, registry

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    read = lambda name: [r.asDict() for r in spark.read.parquet(f"{SMALL}/{name}.parquet").collect()]
    return {name: read(name) for name in ("documents", "labels", "embeddings", "conversations")}


def rows(spark, name, columns):
    df = registry.QUERIES[name](spark, SMALL)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in columns} == columns
    return df.collect()


def fold(doc_id, k):
    return zlib.crc32(str(doc_id).encode()) % k


def low_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_op1(spark, tables):
    got = rows(spark, "op1_scoring", {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"})
    texts = {d["doc_id"]: low_words(d["text"]) + [None] for d in tables["documents"]}
    c = Counter(w for k, t in texts.items() if fold(k, 10) for w in t)
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts)
    for r in got:
        t = texts[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (fold(r["doc_id"], 10) == 0, len(t), sum(c[w] > 0 for w in t), n)
        assert r["base_score"] == pytest.approx(sum(np.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel=1e-9)
        assert np.isfinite(r["score"]) and r["score"] < 0


def test_op2(spark, tables):
    got = rows(spark, "op2_toxicity", {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in tables["documents"])
    assert all(r["held_out"] == (fold(r["doc_id"], 5) == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    toxic = {x["doc_id"]: x["toxic"] for x in tables["labels"]}
    assert np.mean([r["predicted"] == toxic[r["doc_id"]] for r in got if r["doc_id"] in toxic]) > 0.9


def test_op3(spark, tables):
    got = rows(spark, "op3_mixing", {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"})
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in tables["documents"]}
    source = {d["doc_id"]: d["source"] for d in tables["documents"]}
    totals = Counter()
    for k, n in size.items():
        totals[source[k]] += n
    names = sorted(totals, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    left, free, target = 1.5 * sum(totals.values()), set(names), {}
    while True:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * totals[s]}
        if not full:
            break
        for s in full:
            target[s] = 2.0 * totals[s]
            left -= target[s]
        free -= full
    target |= {s: level * weight[s] for s in free}
    taken = Counter()
    for r in got:
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == totals[source[r["doc_id"]]] and r["target"] == pytest.approx(target[source[r["doc_id"]]])
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[source[r["doc_id"]]] += r["taken"]
    largest = {s: max(n for k, n in size.items() if source[k] == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)


def test_op4(spark, tables):
    got = {r["doc_id"]: r for r in rows(spark, "op4_sketches", {"doc_id": "bigint", "n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"})}
    order = sorted(tables["documents"], key=lambda d: -d["doc_id"])
    by_text, errors = defaultdict(set), []

    def grams(text):
        w = low_words(text)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    for i, d in enumerate(order):
        text, other = d["text"] or "", order[(i + 1) % len(order)]["text"] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        r = got[d["doc_id"]]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        by_text[text].add(r["fingerprint"])
        a, b = grams(text), grams(edited)
        if len(a | b) > 400:
            errors.append(abs(r["near_edited"] - len(a & b) / min(len(a), len(b))))
    assert all(len(x) == 1 for x in by_text.values())
    assert np.mean(errors) < 0.06


def test_op5(spark, tables):
    got = rows(spark, "op5_langid", {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    docs = {d["doc_id"]: d for d in tables["documents"]}
    assert len(got) == len(docs)
    hits = []
    for r in got:
        d = docs[r["doc_id"]]
        assert r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1
        letters = any(c.isalpha() for c in d["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        if r["held_out"] and letters and d["lang"] is not None:
            hits.append(r["lang_pred"] == d["lang"])
    assert np.mean(hits) >= 0.95


def test_op6(spark, tables):
    got = defaultdict(list)
    for r in rows(spark, "op6_neighbours", {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}):
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    v = {e["vec_id"]: np.array(e["embedding"], np.float64) for e in tables["embeddings"] if e["embedding"] is not None and None not in e["embedding"]}
    v = {k: x for k, x in v.items() if np.isfinite(x).all() and x.any()}
    ids = sorted(v)
    matrix = np.array([v[k] for k in ids])
    assert sorted(got) == [k for k in ids if k % 20 == 0]
    hits = []
    for q, found in got.items():
        found.sort()
        exact = matrix @ v[q]
        want = [k for k in sorted(ids, key=lambda k: (-exact[ids.index(k)], k)) if k != q][:20]
        assert [r for r, *_ in found] == list(range(1, 21)) and [(-s, k) for _, k, s in found] == sorted((-s, k) for _, k, s in found)
        assert all(abs(s - v[q] @ v[k]) < 1e-9 for _, k, s in found)
        hits.append(len({k for _, k, _ in found} & set(want)) / 20)
    assert np.mean(hits) >= 0.9


def test_op7(spark, tables):
    got = {r["conv_id"]: r for r in rows(spark, "op7_chat", {"conv_id": "bigint", "n_turns": "bigint", "turns_sha256": "string", "loss_chars": "bigint", "loss_sha256": "string", "formatted_chars": "bigint"})}
    turns = defaultdict(list)
    for t in sorted(tables["conversations"], key=lambda t: (t["conv_id"], t["turn"])):
        turns[t["conv_id"]].append((t["role"], t["text"] or ""))
    turns[-1] = [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]
    assert set(got) == set(turns)
    for k, said in turns.items():
        r, learned = got[k], "".join(t for role, t in said if role == "assistant")
        assert r["n_turns"] == len(said) and r["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in said).encode()).hexdigest()
        assert r["loss_chars"] == len(learned) and r["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
        assert r["formatted_chars"] > sum(len(t) for _, t in said)


def test_op8(spark, tables):
    from tokenizers import Tokenizer

    got = rows(spark, "op8_packing", {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"})
    whole, want = Tokenizer.from_file(encode.tokenizer_path()), []
    for d in tables["documents"]:
        ids = whole.encode(d["text"] or "", add_special_tokens=False).ids + [1]
        want += [(d["doc_id"], k, 4096 * k, len(ids[4096 * k : 4096 * k + 4096]), zlib.crc32(np.array(ids[4096 * k : 4096 * k + 4096], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))]
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        ends = np.cumsum([0] + [n for _, n in sorted(spans)])
        assert [o for o, _ in sorted(spans)] == ends[:-1].tolist() and ends[-1] <= 4096
    gaps, n = [], 0
    for size in sorted((x[3] for x in want), reverse=True):  # sequential best fit, largest first
        i = bisect.bisect_left(gaps, size)
        gap = gaps.pop(i) if i < len(gaps) else 4096
        n += gap == 4096
        if gap > size:
            bisect.insort(gaps, gap - size)
    assert len(bins) <= 1.01 * n + 1


def test_op9(spark, tables):
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in rows(spark, "op9_simhash", {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})}

    def fp(text):
        w = low_words(text)
        if not w:
            return 0
        h = np.array([xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))], np.uint64)
        return sum(1 << b for b in range(64) if 2 * int((h >> np.uint64(b) & np.uint64(1)).sum()) > len(h))

    prints = {d["doc_id"]: fp(d["text"]) for d in tables["documents"]}
    group = {k: k for k in prints}
    moved = True
    while moved:
        moved = False
        for a, x in prints.items():
            near = min(group[b] for b, y in prints.items() if (x ^ y).bit_count() <= 3)
            moved |= near < group[a]
            group[a] = min(near, group[a])
    assert got == {k: (f"{x:016x}", group[k]) for k, x in prints.items()}


def test_op10(spark, tables):
    got = {r["doc_id"]: r for r in rows(spark, "op10_suffixes", {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string", "passage_words": "bigint"})}
    texts = {d["doc_id"]: (d["text"] or "").encode() for d in tables["documents"]}
    seen = Counter(t[i : i + 400] for t in texts.values() for i in range(len(t) - 399))
    split = {k: t.decode().split() for k, t in texts.items()}
    passages = Counter(tuple(w[i : i + 51]) for w in split.values() for i in range(len(w) - 50))
    for k, t in texts.items():
        gone, marked = np.zeros(len(t), bool), np.zeros(len(split[k]), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        for i in range(len(split[k]) - 50):
            if passages[tuple(split[k][i : i + 51])] > 1:
                marked[i : i + 51] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        r = got[k]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], r["passage_words"]) == (len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest(), int(marked.sum()))
