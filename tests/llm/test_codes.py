"""Vector codes against plain scans."""

from __future__ import annotations

import math
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import codes, registry
from tests.oracle import SMALL, differences

SCHEMA = "label int, code string, vec_id long, embedding array<double>, v int"


def plain(rows, parts=8, entries=16, rounds=6):
    """(codes and errors by row number, codebooks) of rows (id, label, vector), by whole scans in Python's integers."""
    good = [r for r in rows if r[2] is not None and all(x is not None and math.isfinite(x) for x in r[2])]
    width = -(-max((len(r[2]) for r in good), default=0) // parts)
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    q = [[math.floor(4096 * x) for x in r[2]] + [0] * (parts * width - len(r[2])) for r in good]
    books = [[v[p * width : (p + 1) * width] for v in q[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        own = [[min((far(v[p * width : (p + 1) * width], c), e) for e, c in enumerate(books[p])) for p in range(parts)] for v in q]
        if turn == rounds:
            break
        for p in range(parts):
            for e in range(len(books[p])):
                held = [v[p * width : (p + 1) * width] for v, o in zip(q, own, strict=True) if o[p][1] == e]
                if held:
                    books[p][e] = [sum(c) // len(held) for c in zip(*held, strict=True)]
    out = sorted(((r[0] is None, r[0] or 0, r[1], "".join(f"{e:02x}" for _, e in o), sum(d for d, _ in o)) for r, o in zip(good, own, strict=True)), key=str)
    return out, books


def check(spark, rows):
    df = spark.createDataFrame([(r[1], "x", r[0], r[2], 1) for r in rows], SCHEMA)
    made = codes.compress(df)
    got = sorted(((r["id"] is None, r["id"] or 0, r["label"], bytes(r["code"]).hex(), r["error"]) for r in made.rows.collect()), key=str)
    want, books = plain(rows)
    assert [g[:4] for g in got] == [w[:4] for w in want]
    assert [g[4] for g in got] == [w[4] if w[4] < 2**63 else None for w in want]
    assert [[[int(c) for c in e] for e in b] for b in made.codebooks] == books
    return made


def test_rows_of_every_kind(spark):
    draw = np.random.default_rng(3)
    rows = [(i, i % 3 if i % 7 else None, [float(x) for x in draw.normal(size=16) + 3 * (i % 5)]) for i in range(150)]
    rows += [(150, 1, rows[3][2]), (3, 1, rows[3][2]), (3, 2, rows[4][2]), (None, None, rows[5][2]), (151, 0, None), (152, 0, [math.nan] * 16)]
    rows += [(153, 0, [1.0, None] * 8), (154, 0, [math.inf] + [0.0] * 15), (155, 0, [0.5] * 9), (156, 0, []), (157, 0, [0.0] * 16)]
    made = check(spark, rows)
    sums = defaultdict(int)
    for r in made.rows.collect():
        sums[r["label"]] += r["error"]
    assert {(r["label"], r["label_error"]) for r in codes.label_errors(made.rows).collect()} == set(sums.items())


def test_ties_go_to_the_lower_entry(spark):
    check(spark, [(i, 0, [float((i * j) % 3) / 4096 for j in range(16)]) for i in range(60)])


@pytest.mark.parametrize("n", [0, 1, 5])
def test_few_rows(spark, n):
    check(spark, [(i, 0, [float(i * j) for j in range(16)]) for i in range(n)])


def test_one_vector_many_times(spark):
    check(spark, [(i, 0, [0.25] * 8) for i in range(40)])


def test_values_beyond_64_bits(spark):
    check(spark, [(i, 0, [float(i) * 10.0 ** (j % 9 + i % 12) for j in range(16)]) for i in range(40)])


def test_bounds_spare_scans():
    draw = np.random.default_rng(1)
    x = (draw.integers(0, 16, (5000, 1, 1)) * 4000 + draw.integers(-300, 300, (5000, 1, 8))).astype(np.int64)
    book = x[:400:25].transpose(1, 0, 2).copy()
    code, upper, lower = np.zeros((5000, 1), np.uint8), np.full((5000, 1), np.inf), np.zeros((5000, 1))
    scans = []
    for _ in range(5):
        scans.append(codes.settled(x, code, upper, lower, book, codes.half_ways(book)))
        assert (code[:, 0] == codes.squares(x[:, 0], book[0]).argmin(1)).all()
        new = book.copy()
        for e in range(16):
            if (code[:, 0] == e).any():
                new[0, e] = x[code[:, 0] == e, 0].sum(0) // (code[:, 0] == e).sum()
        moves, book = codes.Moves.between(book, new), new
        upper = (upper + moves.own[0][code]) * codes.UP
        lower = np.maximum((lower - moves.others[0][code]) * codes.DOWN, 0)
    assert scans[0] > 4000 and scans[-1] < 1500


def test_decoded_vectors_are_near(spark):
    made = codes.compress(spark.read.parquet(f"{SMALL}/embeddings.parquet"))
    back = {r["id"]: r["v"] for r in codes.decoded(made).collect()}
    errors = {r["id"]: r["error"] for r in made.rows.collect()}
    for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()[:50]:
        off = sum((math.floor(4096 * x) - 4096 * y) ** 2 for x, y in zip(r["embedding"], back[r["vec_id"]], strict=True))
        assert off == pytest.approx(errors[r["vec_id"]])


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_rows_equal_the_sql(spark, name):
    assert differences(spark, name, registry.QUERIES[name], registry.ORACLES[name]) == ""
