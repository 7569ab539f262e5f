"""Closure by doubling, paths between many pairs, and hubs, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict, deque

import numpy as np
import pytest

from tessera.operators import graph, rules


def tree(spark, edges):
    return spark.createDataFrame(edges, "child string, parent string")


def brute_closure(edges):
    up = defaultdict(set)
    for c, p in edges:
        if c is not None and p is not None:
            up[c].add(p)
    out = {}
    for start in list(up):
        queue = deque((p, 1) for p in up[start])
        while queue:
            node, d = queue.popleft()
            if (start, node) not in out:
                out[start, node] = d
                queue.extend((p, d + 1) for p in up[node])
    return out


def closed(spark, edges):
    return {(r["node"], r["ancestor"]): r["depth"] for r in graph.closure(tree(spark, edges)).collect()}


def test_closure_of_random_trees_and_cycles(spark):
    rng = random.Random(3)
    for n, m in ((12, 10), (15, 30), (30, 35)):
        edges = [(f"c{rng.randrange(n)}", f"c{rng.randrange(n)}") for _ in range(m)] + [(None, "c1"), ("c1", None)]
        assert closed(spark, edges) == brute_closure(edges)


def test_rings_and_their_first_classes(spark):
    ring = [(f"a{i}", f"a{(i + 1) % 10}") for i in range(10)]
    two = [("s", "x"), ("x", "s"), ("s", "y"), ("y", "z"), ("z", "s"), ("q", "s")]
    assert closed(spark, ring + two) == brute_closure(ring + two)
    classes = spark.createDataFrame(ring + two, "uri string, parent string")
    assert sorted(r["affected"] for r in rules.cycles(classes).collect()) == ["a0", "s"]


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    rounds = []
    settle = graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: rounds.append(1) or settle(df))
    n = 1000
    found = graph.closure(tree(spark, [(f"n{i}", f"n{i + 1}") for i in range(n)]))
    assert found.count() == n * (n + 1) // 2 and found.agg({"depth": "max"}).first()[0] == n
    assert len(rounds) <= 12


def random_edges(rng, nodes, n):
    return [(f"e{rng.randrange(nodes):02d}", f"e{rng.randrange(nodes):02d}", rng.choice("PQ"), 1.0) for _ in range(n)]


EDGE = "src string, dst string, rel string, confidence double"


@pytest.mark.parametrize("most", [1, 2, 3, 4])
def test_paths_between_all_pairs(spark, most):
    rng = random.Random(most)
    edges = random_edges(rng, 25, 45)
    near = defaultdict(set)
    for a, b, *_ in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    wanted = [f"e{i:02d}" for i in range(10)]
    want = []

    def walk(path, target):
        if path[-1] == target:
            return want.append((path[0], target, tuple(path)))
        if len(path) <= most:
            for b in near[path[-1]]:
                if b not in path:
                    walk([*path, b], target)

    for s in wanted:
        for t in wanted:
            if s < t:
                walk([s], t)
    df = spark.createDataFrame(edges, EDGE)
    paths = graph.connecting_paths(df, spark.createDataFrame([(x,) for x in [*wanted, None, "e01"]], "id string"), most)
    assert sorted((r["source"], r["target"], tuple(r["path"])) for r in paths.collect()) == sorted(want)
    nodes = {x for *_, p in want for x in p}
    assert {r["id"] for r in graph.path_nodes(paths).collect()} == nodes
    steps = {frozenset(x) for *_, p in want for x in zip(p, p[1:])}  # noqa: B905
    assert {tuple(r) for r in graph.path_relations(paths, df).collect()} == {(a, r, b) for a, b, r, _ in edges if frozenset((a, b)) in steps and a != b}


@pytest.mark.parametrize("hub, few", [(4096, 10), (3, 10_000), (3, 0)])
def test_hubs_in_parts_change_nothing(spark, monkeypatch, hub, few):
    monkeypatch.setattr(graph, "HUB", hub)
    monkeypatch.setattr(graph, "FEW_HUBS", few)
    rng = random.Random(1)
    edges = random_edges(rng, 30, 60) + [("hub", f"e{i:02d}", "P", 1.0) for i in range(25)]
    near = defaultdict(set)
    for a, b, *_ in edges:
        if a != b:
            near[a].add(b), near[b].add(a)
    df, seeds = spark.createDataFrame(edges, EDGE), spark.createDataFrame([("e01",), ("e02",)], "id string")
    rank = {"e01": 0.5, "e02": 0.5}
    for _ in range(6):
        after = defaultdict(float, {"e01": 0.075, "e02": 0.075})
        for a, r in rank.items():
            for b in near[a]:
                after[b] += 0.85 * r / len(near[a])
        rank = after
    got = {r["id"]: r["rank"] for r in graph.pagerank(df, seeds, rounds=6).collect()}
    assert got == pytest.approx(dict(rank))
    dist = {"e01": 0, "e02": 0}
    queue = deque(dist)
    while queue:
        a = queue.popleft()
        for b in near[a]:
            if b not in dist:
                dist[b] = dist[a] + 1
                queue.append(b)
    assert {r["id"]: r["hop"] for r in graph.hops(df, seeds, 3).collect()} == {k: d for k, d in dist.items() if d <= 3}


def test_shuffles_grow_with_the_table(spark, tmp_path, monkeypatch):
    from tessera.plans import binding

    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.range(200_000).write.parquet(str(tmp_path / "lineitem.parquet"))
        monkeypatch.setattr(binding, "PARTITION_BYTES", 20_000)
        assert binding.view(spark, str(tmp_path), "lineitem").count() == 200_000
        assert int(spark.conf.get("spark.sql.shuffle.partitions")) > 20
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_seeds_with_enough_nodes_go_no_further(spark):
    """A star of forty nodes, each with a leaf, and a chain, which goes on."""
    rows = [("s", f"m{i}") for i in range(40)] + [(f"m{i}", f"leaf{i}") for i in range(40)] + [("t", "t1"), ("t1", "t2"), ("t2", "t3")]
    edges = spark.createDataFrame([(a, b, "r", 1.0) for a, b in rows], "src string, dst string, rel string, confidence double")
    starts = spark.createDataFrame([(1, "s"), (2, "t")], "seed int, id string")
    got = {(r["seed"], r["id"]): r["hop"] for r in graph.hops_from(edges, starts, 3, enough=30).collect()}
    assert got == {(1, "s"): 0} | {(1, f"m{i}"): 1 for i in range(40)} | {(2, "t"): 0, (2, "t1"): 1, (2, "t2"): 2, (2, "t3"): 3}


def test_paths_look_only_as_far_as_the_steps_after_the_first(spark, monkeypatch):
    """Hops of three steps would reach the whole graph where paths of three steps need those of two."""
    asked, plain = [], graph.hops_from
    monkeypatch.setattr(graph, "hops_from", lambda edges, starts, most, *more: asked.append(most) or plain(edges, starts, most, *more))
    edges = spark.createDataFrame([("a", "b", "r", 1.0), ("b", "c", "r", 1.0), ("c", "d", "r", 1.0)], "src string, dst string, rel string, confidence double")
    ends = spark.createDataFrame([("a",), ("d",)], "id string")
    assert [tuple(r) for r in graph.connecting_paths(edges, ends, 3).collect()] == [("a", "d", ["a", "b", "c", "d"])]
    assert [r["path"] for r in graph.simple_paths(edges, "a", "d", 3).collect()] == [["a", "b", "c", "d"]]
    assert asked == [2, 2]


def test_ranks_are_sent_once_a_block_and_not_once_an_edge(spark, monkeypatch):
    """A dense graph of few and many nodes, with a loop, a doubled edge and a seed without edges, against matrix products."""
    monkeypatch.setattr(graph, "BLOCK_EDGES", 500)
    rng = np.random.default_rng(4)
    pairs = [(f"p{i}", f"s{j}") for i in range(400) for j in rng.choice(40, 30, replace=False)]
    df = spark.createDataFrame([*pairs, (pairs[0][1], pairs[0][0]), pairs[1], ("s0", "s0"), (None, "s1")], "src string, dst string")
    blocks = graph.in_blocks(df)
    held, places = blocks.held.collect(), blocks.places.count()
    assert len(held) == len(pairs) and len({r["block"] for r in held}) > 10
    assert places <= 400 + 40 * len({r["block"] for r in held}) < len(pairs) / 2
    blocks.release()
    names = sorted({x for p in pairs for x in p})
    at = {x: i for i, x in enumerate(names)}
    step = np.zeros((len(names), len(names)))
    for a, b in pairs:
        step[at[a], at[b]] = step[at[b], at[a]] = 1
    step /= step.sum(0)
    base = np.zeros(len(names))
    base[at["p3"]] = base[at["s2"]] = 1 / 3
    want = base
    for _ in range(6):
        want = 0.85 * step @ want + 0.15 * base
    got = {r["id"]: r["rank"] for r in graph.pagerank(df, spark.createDataFrame([("p3",), ("s2",), ("gone",)], "id string"), rounds=6).collect()}
    assert got.pop("gone") == pytest.approx(0.05)
    assert got == pytest.approx(dict(zip(names, want, strict=True)))
