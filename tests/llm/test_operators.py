"""The training-data operators against brute force, with nulls, ties, repeats, empty tables and clashing columns."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tessera.llm import attention, chat, encode, langid, mixing, neighbours, packing, scoring, simhash, sketches, suffixes, toxicity, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, id long, fingerprint string, size int"
VOCABULARY = [a + b for a in ("ka", "lo", "mi", "ne", "ru", "ta") for b in ("ba", "do", "fi", "gu", "pe", "so", "vy")]


def documents(spark, rows):
    """rows (doc_id, text[, lang[, source]]) with further columns whose names the operators use themselves."""
    full = [(*r, *(None,) * (4 - len(r)))[:4] + (None, 0.5, 7, "x", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(rng.choice(VOCABULARY, n))


@pytest.fixture(scope="module")
def varied(spark):
    base = prose(1, 60)
    edited = base.split()
    edited[20] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(edited)), (4, None), (5, ""), (6, " \n\t"), (7, "One Two"), (7, "One Two"), (None, "no id here at all"), (8, prose(2, 4000)), (9, prose(3, 200) + " " + base + " " + prose(4, 50))]
    rows += [(10 + i, prose(10 + i, 30), "ab"[i % 2], f"s{i % 3}" if i else None) for i in range(12)]
    return rows, documents(spark, rows)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def word_list(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_simhash_equals_brute_force(spark, varied):
    rows, docs = varied
    def fp(t):
        w = word_list(t)
        if not w:
            return 0
        h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fp(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    group[i] = group[j] = min(group[i], group[j])
    smallest = {g: min((r[0] for r, x in zip(rows, group) if x == g and r[0] is not None), default=None) for g in group}
    want = sorted(((r[0], f"{p:016x}", smallest[g]) for r, p, g in zip(rows, prints, group)), key=str)
    got = sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str)
    assert got == want
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("crowded", [2, 1000])
def test_links_lose_nothing(spark, crowded):
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 2**63))
    points = {centre}
    for _ in range(150):
        x = centre if rng.random() < 0.5 else int(rng.choice(list(points)))
        for b in rng.choice(64, int(rng.integers(1, 4)), replace=False):
            x ^= 1 << int(b)
        points.add(x & (2**64 - 1))
    signed = [p - 2**64 if p >= 2**63 else p for p in points]
    got = {tuple(r) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"), 3, crowded).collect()}
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3}
    assert got == want


def cut_by_force(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield gone


@pytest.mark.parametrize("length", [40, 400])
def test_cut_repeats_equals_brute_force(spark, varied, length):
    rows, docs = varied
    rows = [*rows, (50, "ab" * 500), (51, "é" * 300), (52, "x" * 399), (53, "q" + "x" * 399)]
    docs = documents(spark, rows)
    texts = [(r[1] or "").encode() for r in rows]
    want = []
    for r, t, gone in zip(rows, texts, cut_by_force(texts, length), strict=True):
        edges = np.flatnonzero(np.diff(gone.astype(int), prepend=0, append=0)).reshape(-1, 2)
        want.append((r[0], len(t), [tuple(map(int, e)) for e in edges], np.frombuffer(t, np.uint8)[~gone].tobytes()))
    got = [(r["doc_id"], r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in suffixes.cut_repeats(docs, length=length).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert suffixes.cut_repeats(empty(spark)).count() == 0


def test_passages_equal_brute_force(spark):
    """Passages of just over 50 words, shorter and longer than 400 bytes, across texts and within one."""
    short, long = " ".join(["ab", "cde", "f"] * 17), prose(77, 52)
    rows = [(1, "start " + short + " x y"), (2, "other \t words " + short.replace(" ", "  ") + " z"), (3, long), (4, prose(5, 90) + " " + long + " end"), (5, prose(6, 300)), (6, None), (7, "one two"), (8, ""), (8, " ".join(short.split()[:49]))]
    rows += [(20 + i, prose(30 + i, 70) + " " + prose(99, 85)) for i in range(30)]
    assert len(short) < 400 < len(prose(99, 85))
    docs = documents(spark, rows)
    split = [(r[1] or "").split() for r in rows]
    gone = list(cut_by_force([tuple(w) for w in split], 51))
    want = sorted((r[0], int(g.sum())) for r, g in zip(rows, gone, strict=True))
    marked = suffixes.cut_repeats(docs, passage=51).collect()
    assert sorted((r["doc_id"], r["passage_words"]) for r in marked) == want
    plain = {str((r["doc_id"], r["spans"])) for r in suffixes.cut_repeats(docs).collect()}
    assert {str((r["doc_id"], r["spans"])) for r in marked} == plain
    kept = sorted((r["doc_id"], bytes(r["kept"]).decode().split()) for r in suffixes.cut_repeats(docs, length=51, unit="words").collect())
    assert kept == sorted((r[0], [w for w, x in zip(ws, g, strict=True) if not x]) for r, ws, g in zip(rows, split, gone, strict=True))
    assert dict(want)[1] >= 51 and dict(want)[2] >= 51 and dict(want)[3] == 52 and dict(want)[5] == 0


def test_mixing_meets_targets(spark):
    rng = np.random.default_rng(0)
    rows = [(i, prose(i, int(rng.integers(1, 120))), None, ["big", "mid", "low", None][min(3, int(rng.exponential(0.9)))]) for i in range(400)]
    rows += [(1000 + i, "same words here", None, "big") for i in range(200)] + [(2000, None, None, "mid"), (2001, "", None, "void")]
    got = mixing.mix(documents(spark, rows)).collect()
    assert len(got) == len(rows) and all(r["copies"] in (0, 1, 2) for r in got)
    sizes, taken, targets = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["size"] * r["copies"]
        targets[r["source"]] = r["target"]
    assert sum(targets.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, t in targets.items():
        assert t <= 2 * sizes[s] + 1e-6 and abs(taken[s] - t) <= 120
    order = sorted((s for s in sizes if s is not None)) + [None]
    level = {s: targets[s] / (3, 1, 2)[i % 3] for i, s in enumerate(order) if targets[s] < 2 * sizes[s] - 1e-6}
    assert max(level.values()) == pytest.approx(min(level.values()))
    again = mixing.mix(documents(spark, rows)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(empty(spark)).count() == 0


def test_edits_equal_brute_force(spark):
    rows = [(i, prose(i, 40 + i)) for i in range(30)] + [(40, None), (41, ""), (42, "É" * 7), (43, "a b")]
    got = {r["doc_id"]: r for r in sketches.edits(documents(spark, rows)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    for i, (k, t) in enumerate(order):
        t, n = t or "", (order[(i + 1) % len(order)][1] or "")
        half = len(t) // 2
        edited = t[: len(t) - half] + n[:half]
        assert got[k]["n_chars"] == len(t) and got[k]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[k]["near_edited"] <= 1 and 0 <= got[k]["near_next"] <= 1
    same = {r["doc_id"]: r["fingerprint"] for r in sketches.fingerprints(documents(spark, [(1, "a b c d e f"), (2, "A b c d e F"), (3, "x")])).collect()}
    assert same[1] == same[2] != same[3]
    assert sketches.edits(empty(spark)).count() == 0


def test_sketches_merge_and_estimate():
    a, b = prose(5, 2000), prose(6, 200)
    whole, part = sketches.sketches([(a + " " + b).encode(), b.encode()])
    assert sketches.containment(part, whole) > 0.95 and len(part) < len(whole) / 5
    first, second = sketches.sketches([a.encode(), b.encode()])
    merged = sketches.merged(first, second)
    assert len(np.setdiff1d(merged, whole)) == 0 and len(whole) - len(merged) <= 8


def test_language_by_centroids(spark):
    make = lambda syllables, seed: " ".join("".join(np.random.default_rng(seed * 1000 + i).choice(syllables, 3)) for i in range(40))
    kinds = {"xx": ["ka", "lo", "mi"], "yy": ["sch", "ung", "ter"], "zz": ["é", "ou", "que"]}
    rows = [(100 * k + i, make(s, 100 * k + i), lang) for k, (lang, s) in enumerate(kinds.items()) for i in range(20)]
    model = langid.fit(documents(spark, rows + [(900, "lost", None), (901, None, "xx")]))
    tests = [(1000 + 100 * k + i, make(s, 5000 + 100 * k + i)) for k, s in enumerate(kinds.values()) for i in range(10)] + [(1, None), (2, ""), (3, "12 !?"), (4, "мир")]
    got = {r["doc_id"]: r for r in langid.predict(documents(spark, tests), model, reject=False).collect()}
    for k, lang in enumerate(kinds):
        assert all(got[1000 + 100 * k + i]["lang_pred"] == lang for i in range(10))
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and got[4]["lang_pred"] in kinds
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert langid.predict(empty(spark), langid.fit(empty(spark))).count() == 0


def test_neighbours_are_exact_on_few_vectors(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(120, 8)).astype(np.float32)
    v[10:40] = v[9]
    rows = [(i, [float(x) for x in v[i]]) for i in range(120)] + [(5, [float(x) for x in v[5]])]
    bad = [(200, None), (201, [0.0] * 8), (202, [float("nan")] * 8), (203, [None] * 8), (None, [1.0] * 8), (204, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash")).repartition(3)
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["id"], r["score"]))
    assert sorted(got) == list(range(0, 120, 20))
    w = v.astype(np.float64)
    hits = total = 0
    for q, found in got.items():
        score = w @ w[q]
        want = sorted((i for i in range(120) if i != q), key=lambda i: (-score[i], i))[:20]
        hits += len({i for i, _ in found} & set(want))
        total += len(want)
        assert len(found) == 20 and found == sorted(found, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - score[i]) < 1e-12 for i, s in found)
    assert hits / total >= 0.9
    assert neighbours.search(df.limit(0), F.lit(True)).count() == 0


def test_traversal_takes_pairs_in_order():
    rng = np.random.default_rng(1)
    index = neighbours.Index(rng.normal(size=(8, 3)), rng.normal(size=(8, 3)), 0.5)
    q, sizes = rng.normal(size=6), rng.integers(0, 4, (8, 8))
    total = (index.first @ q[:3])[:, None] + (index.second @ q[3:])[None]
    taken, want = 0, set()
    for cell in np.argsort(-total, axis=None):
        if taken >= 20:
            break
        if sizes.flat[cell]:
            taken += sizes.flat[cell]
            want.add((cell // 8, cell % 8))
    got = neighbours.traversal(index, sizes, q, 20)
    assert {(i, j) for i, m in got.items() for j in range(8) if m >> j & 1} == want


@pytest.mark.parametrize("text", ["", "plain", "</s>[INST] ok [/INST]", "[\\INST] <\\\\s> [\\\\/ROLE]", "<s><<s>>", "[ROLE]x[/ROLE]"])
def test_escapes_are_reversible(text):
    hidden = chat.escape(text)
    assert chat.unescape(hidden) == text and not any(c in hidden for c in chat.CONTROLS)


def test_conversations_read_back(spark):
    rows = [(1, 0, "user", "hi </s>"), (1, 1, "assistant", "é [INST]"), (1, 2, "system", None), (1, 2, "tool[ROLE]", "x"), (2, 5, "assistant", ""), (2, 1, None, "a\nb"), (2, 1, None, "a\nb"), (None, 0, "user", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit(1))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_turns(df)).collect()}
    assert {k: r["n_turns"] for k, r in got.items()} == {1: 4, 2: 3, None: 1}
    learned = "é [INST]"
    assert got[1]["loss_chars"] == len(learned) and got[1]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    said = "\na\nb\n" * 2 + "assistant\n\n"
    assert got[2]["turns_sha256"] == hashlib.sha256(said.encode()).hexdigest()
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_pieces_equal_the_tokenizer(spark, varied):
    from tokenizers import Tokenizer

    rows, docs = varied
    rows = [*rows, (60, "İstanbul ΣΑΣ. é́x a. <|endoftext|>, don't, X.1, a.. KK hi"), (61, "word, " * 9000)]
    whole = Tokenizer.from_file(encode.tokenizer_path())
    want = []
    for r in rows:
        ids = whole.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want += [(r[0], k, 4096 * k, len(ids[4096 * k : 4096 * k + 4096]), zlib.crc32(np.array(ids[4096 * k : 4096 * k + 4096], "<u4").tobytes())) for k in range(-(-len(ids) // 4096))]
    pieces = packing.token_pieces(documents(spark, rows))
    got = [tuple(r) for r in pieces.select("doc_id", "piece", "start", "length", F.crc32("ids")).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_packing_is_gapless_and_tight(spark):
    rng = np.random.default_rng(2)
    sizes = [int(x) for x in np.clip(rng.lognormal(6, 1.2, 400), 1, 4096)] + [20] * 150 + [4096] * 3
    out = packing.pack(spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, length long").repartition(4)).collect()
    assert sorted(r["length"] for r in out) == sorted(sizes)
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in bins.values():
        at = 0
        for offset, n in sorted(spans):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= 1.05 * -(-sum(sizes) // 4096) + 1
    assert packing.pack(spark.createDataFrame([], "doc_id long, length long")).count() == 0


def test_word_model_equals_brute_force(spark, varied, monkeypatch):
    monkeypatch.setattr(attention, "STEPS", 20)
    monkeypatch.setattr(scoring, "FREQUENT", 20)
    rows, docs = varied
    learn = F.col("doc_id") % 3 != 0
    got = sorted(((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in scoring.score(docs, learn).collect()), key=str)
    train = [word_list(r[1]) + [None] for r in rows if r[0] is not None and r[0] % 3 != 0]
    c = Counter(w for t in train for w in t)
    total, kinds, want = sum(c.values()), len(c), []
    for r in rows:
        t = word_list(r[1]) + [None]
        want.append((r[0], len(t), sum(c[w] > 0 for w in t), total, round(sum(np.log10((c[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t), 6)))
    assert got == sorted(want, key=str)
    assert scoring.score(empty(spark), learn).count() == 0


def test_the_network_learns_from_every_text(spark, monkeypatch):
    """More texts than the 1,500 that it once learned from: every number gets a row of its own."""
    monkeypatch.setattr(attention, "STEPS", 5)
    path = scoring.tokenizer_path(scoring.VOCABULARY_FILE)
    docs = spark.createDataFrame([(i, f"{i // 4} {i // 4}") for i in range(3600)], "id long, text string")
    model = scoring.fit(docs, scoring.word_counts(docs.select("text")), path)
    ids = [encode.byte_encoder(path).tokenizer.encode_ordinary(f" {i}") for i in range(900)]
    assert all(model.row_of[k] < attention.OWN for x in ids for k in x)


def test_slopes_are_those_of_the_loss():
    rng = np.random.default_rng(2)
    ids, counts = rng.integers(0, 40, 300), np.array([100, 150, 50])
    class_of = rng.integers(0, attention.CLASSES, attention.VOCABULARY)
    row_of = attention.rows_of(np.bincount(ids, minlength=attention.VOCABULARY), class_of)
    net = attention.Network(*[x.astype(float) for x in attention.untrained(rng.poisson(1, (attention.OWN + attention.CLASSES, attention.CLASSES)).astype(float))])
    inputs, targets, _ = attention.windows(ids, np.cumsum(counts) - counts, counts)
    padded = np.concatenate([ids, [attention.END, attention.END]])
    seen, goal, real = row_of[padded[inputs]], class_of[padded[targets]], targets != -2

    def loss():
        _, gathered, *_ = attention.attend(net, seen, inputs != -2)
        logits = attention.class_logits(net, seen[:, attention.PAST :], gathered)[2]
        logs = np.take_along_axis(logits, goal[:, :, None], 2)[:, :, 0] - np.log(np.exp(logits).sum(2))
        return -logs[real].mean()

    found = attention.slopes(net, seen, inputs != -2, goal, real)
    for x, g in zip(net, found, strict=True):
        at, step = np.unravel_index(np.abs(g).argmax(), g.shape), 1e-5
        value, sides = x[at], []
        for s in (step, -step):
            x[at] = value + s
            sides.append(loss())
        x[at] = value
        assert (sides[0] - sides[1]) / (2 * step) == pytest.approx(g[at], rel=1e-2)


def test_model_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    class_of = rng.integers(0, attention.CLASSES, attention.VOCABULARY)
    logs = attention.inner_logs(rng.integers(0, 3, (attention.CLASSES + 1, attention.VOCABULARY)), class_of)
    for row in (0, attention.START):
        sums = np.bincount(class_of, weights=10.0 ** logs[row].astype(np.float64), minlength=attention.CLASSES)
        assert np.allclose(sums, 1, atol=1e-3)


def test_next_ids_add_up_to_one_in_each_class():
    """After any id, the ids of a class share its whole mass, whether their pair is counted or not."""
    rng = np.random.default_rng(3)
    class_of = rng.integers(0, attention.CLASSES, attention.VOCABULARY)
    row_of = attention.OWN + class_of
    own = rng.permutation(attention.VOCABULARY)[: attention.OWN - 5]
    row_of[own] = np.arange(len(own))
    logs = attention.inner_logs(rng.integers(0, 3, (attention.CLASSES + 1, attention.VOCABULARY)), class_of)
    pairs = rng.poisson(0.05, (attention.OWN + 1, attention.OWN)) * (np.arange(attention.OWN) < len(own))
    others = rng.poisson(0.5, (attention.OWN + 1, attention.CLASSES))
    found, rest = attention.pair_logs(pairs, others, logs, row_of, class_of)
    frequent = row_of < attention.OWN
    for r in (0, 17, attention.OWN):
        behind = logs[attention.START if r == attention.OWN else class_of[own[r]]].astype(np.float64)
        p = 10.0 ** np.where(frequent, found[r][np.where(frequent, row_of, 0)], behind + rest[r][class_of])
        assert np.allclose(np.bincount(class_of, weights=p, minlength=attention.CLASSES), 1, atol=2e-3)


def test_windows_score_each_id_once():
    counts = np.array([1, 31, 32, 33, 100])
    begin = np.cumsum(counts) - counts
    inputs, targets, owner = attention.windows(np.zeros(counts.sum(), int), begin, counts)
    goals = targets[targets >= 0]
    assert sorted(goals.tolist()) == list(range(counts.sum()))
    for row, goal, o in zip(inputs, targets, owner, strict=True):
        for k, g in enumerate(goal):
            if g >= 0:
                before = row[attention.PAST + k]
                assert before == (g - 1 if g > begin[o] else -1)


def test_toxicity_learns_and_scores_everything(spark):
    rng = np.random.default_rng(8)
    rows, labels = [], []
    for i in range(300):
        t = prose(500 + i, int(rng.integers(5, 60))).split()
        toxic = i % 3 == 0
        if toxic:
            t.insert(int(rng.integers(0, len(t))), str(rng.choice(["vilebad", "hatefoo"])))
        rows.append((i, " ".join(t), "ab"[i % 2]))
        labels.append((i, int(toxic)))
    labels += [(1, None), (None, 1), (999, 1)]
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(documents(spark, rows), marks.where("doc_id % 5 <> 0"))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(documents(spark, rows + [(400, None), (401, "")]), model).collect()}
    held = [i for i in range(0, 300, 5)]
    assert np.mean([(got[i] >= 0.5) == (i % 3 == 0) for i in held]) > 0.9
    assert got[400] == got[401] < 0.5 and all(0 <= s <= 1 for s in got.values())
    nothing = toxicity.fit(empty(spark), marks.limit(0))
    assert toxicity.score(empty(spark), nothing).count() == 0


def test_words_and_hashes():
    import pyarrow as pa

    texts = ["a bc\td", "", None, "  x\n", "bc"]
    (b,) = words.blocks(pa.array(texts))
    starts, ends, row = b.words()
    raw = b.data.tobytes()
    assert [(r, raw[s:e]) for s, e, r in zip(starts, ends, row, strict=True)] == [(0, b"a"), (0, b"bc"), (0, b"d"), (3, b"x"), (4, b"bc")]
    h = words.span_hashes(words.prefix_sums(b.data), starts, ends)
    assert h[1] == h[4] and len(set(h.tolist())) == 4
