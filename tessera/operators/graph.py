"""Graph operators as frontier joins over an edge table (src, dst, rel, confidence).

Loops run over hops, never over rows; every step is a join and a distinct or an aggregate.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.lineage import settle


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge from either end: (a, b)."""
    return edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).union(edges.select("dst", "src")).where("a <> b").distinct()


HUB = 4_096  # neighbours of a node that one task sees at a time
FEW_HUBS = 10_000  # that are broadcast; beyond, joins shuffle them
BLOCK_EDGES = 4_000_000  # about so many edges in a block, which one task sees at a time


class Adjacency(NamedTuple):
    """Neighbours (a, part, b) in both directions, and the nodes (a, parts) that have more than HUB and so several parts. Neighbours stay
    partitioned by node and part while they are kept."""

    steps: DataFrame
    hubs: DataFrame
    many: int  # hubs

    def parted(self, rows: DataFrame, node: str) -> DataFrame:
        """Rows once for each part of their node, in the column `part`."""
        if not self.many:
            return rows.withColumn("part", F.lit(0).cast("long"))
        hubs = F.broadcast(self.hubs) if self.many <= FEW_HUBS else self.hubs
        met = rows.join(hubs, rows[node] == hubs["a"], "left").drop("a")
        return met.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("parts", F.lit(1).cast("long")) - 1))).drop("parts")

    def release(self) -> None:
        self.steps.unpersist()


def adjacency(edges: DataFrame) -> Adjacency:
    """Neighbours of all nodes, kept in memory or on disk until they are released."""
    both = settle(both_ways(edges))
    degree = both.groupBy("a").agg(F.count("*").alias("n"))
    hubs = settle(degree.where(F.col("n") > HUB).select("a", F.ceil(F.col("n") / HUB).alias("parts")))
    many = hubs.count()
    known = both.join(F.broadcast(hubs) if many <= FEW_HUBS else hubs, "a", "left")
    dealt = known.select("a", F.coalesce(F.pmod(F.xxhash64("b"), F.col("parts")), F.lit(0)).cast("long").alias("part"), "b")
    partitions = int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return Adjacency(dealt.repartition(partitions, "a", "part").persist(), hubs, many)


def hops(edges: DataFrame, seeds: DataFrame, most: int) -> DataFrame:
    """(id, hop): the fewest steps, up to `most`, from any of the seeds (id), ignoring direction."""
    return hops_from(edges, seeds.select(F.lit(0).alias("seed"), "id"), most).select("id", "hop")


def hops_from(edges: DataFrame, starts: DataFrame, most: int, limits: DataFrame | None = None, enough: int | None = None) -> DataFrame:
    """(seed, id, hop) for rows (seed, id) of starts: the fewest steps, up to `most`, from any start of a seed; with rows (seed, limit) up
    to a seed's own limit if that is less, and none from seeds without one. With `enough` a seed goes no further once a hop has
    brought it to that many nodes beside its starts; all of that hop are returned."""
    near = adjacency(edges)
    seen = frontier = settle(starts.select("seed", "id").distinct().withColumn("hop", F.lit(0)))
    for hop in range(1, most + 1):
        if limits is not None:
            frontier = frontier.join(limits.where(F.col("limit") >= hop), "seed", "left_semi")
        if enough is not None and hop > 1:
            full = seen.where("hop > 0").groupBy("seed").agg(F.count("*").alias("n")).where(F.col("n") >= enough)
            frontier = frontier.join(full, "seed", "left_anti")
        reached = near.parted(frontier, "id").withColumnRenamed("id", "a").join(near.steps, ["a", "part"]).select("seed", F.col("b").alias("id")).distinct()
        frontier = settle(reached.join(seen.select("seed", "id"), ["seed", "id"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    near.release()
    return seen


def neighbourhood(edges: DataFrame, seeds: DataFrame, most_hops: int = 1, most_nodes: int = 50) -> DataFrame:
    """Nodes within so many hops: the first by id, and the seeds in any case."""
    found = hops(edges, seeds, most_hops)
    return found.where("hop > 0").orderBy("id").limit(most_nodes).union(found.where("hop = 0"))


def shortest_paths(edges: DataFrame, source: str, most: int = 4) -> DataFrame:
    """(id, length, path): from one node to every node within `most` steps, ignoring direction; of equally short paths
    the one that sorts first."""
    steps = settle(both_ways(edges))
    spark = edges.sparkSession
    seen = spark.range(1).select(F.lit(source).alias("id"), F.lit(0).alias("length"), F.lit(source).alias("path"))
    frontier = seen
    for n in range(1, most + 1):
        on = frontier.join(steps, frontier["id"] == steps["a"]).select(F.col("b").alias("id"), F.concat_ws(">", "path", "b").alias("path"))
        best = on.groupBy("id").agg(F.min("path").alias("path"))
        frontier = settle(best.join(seen.select("id"), "id", "left_anti").select("id", F.lit(n).alias("length"), "path"))
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    return seen


def hop_decay(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, top: int = 20, most: int = 3) -> DataFrame:
    """Scores damping ** hop by the hop at which a node is first reached; the top ones, ties by id."""
    return hops(edges, seeds, most).select("id", "hop", F.pow(F.lit(damping), "hop").alias("score")).orderBy(F.col("score").desc(), "id").limit(top)


class Blocks(NamedTuple):
    """Undirected edges (block, low, high) of numbered nodes (id, n, num), n being neighbours: an edge lies with its end of fewer
    neighbours, so no node brings more than about the root of twice the edges into a block. `places` (num, to, share) are the blocks
    where a node has edges, with 1 / n. Edges stay partitioned by block and places by number while they are kept."""

    nodes: DataFrame
    held: DataFrame
    places: DataFrame

    def release(self) -> None:
        self.held.unpersist()
        self.places.unpersist()


def in_blocks(edges: DataFrame) -> Blocks:
    spark = edges.sparkSession
    pairs = settle(edges.where("src <> dst").select(F.least("src", "dst").alias("x"), F.greatest("src", "dst").alias("y")).distinct())
    nodes = pairs.select(F.explode(F.array("x", "y")).alias("id")).groupBy("id").agg(F.count("*").alias("n"))
    nodes = settle(nodes.withColumn("num", F.monotonically_increasing_id()))
    many = max(2 * spark.sparkContext.defaultParallelism, -(-pairs.count() // BLOCK_EDGES))
    end = lambda name: nodes.select(F.col("id").alias(name), F.struct("n", "num").alias(f"of_{name}"))
    ends = pairs.join(end("x"), "x").join(end("y"), "y").select(F.least("of_x", "of_y")["num"].alias("low"), F.greatest("of_x", "of_y")["num"].alias("high"))
    ends = settle(ends.select(F.pmod(F.xxhash64("low"), F.lit(many)).alias("block"), "low", "high"))
    held = ends.repartition(many, "block").sortWithinPartitions("block", "low").persist()
    places = held.select("block", F.explode(F.array("low", "high")).alias("num")).distinct().join(nodes.select("num", (1.0 / F.col("n")).alias("share")), "num")
    places = settle(places.select("num", F.col("block").alias("to"), "share"))
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return Blocks(nodes, held, places.repartition(partitions, "num").sortWithinPartitions("num").persist())


def passed_on(edges: pa.Table, sent: pa.Table) -> pa.Table:
    """(num, rank): what the nodes of a block get over its edges, of the values (num, value) that all its nodes send over each edge."""
    num, value = (sent[c].to_numpy() for c in ("num", "value"))
    order = np.argsort(num)
    num, value = num[order], value[order]
    low, high = (np.searchsorted(num, edges[c].to_numpy()) for c in ("low", "high"))
    got = np.bincount(low, value[high], len(num)) + np.bincount(high, value[low], len(num))
    some = got > 0
    return pa.table({"num": num[some], "rank": got[some]})


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """Personalised PageRank over undirected edges; what would leave nodes without edges goes back to the seeds. Each round a node's rank
    goes once to each block where it has edges, and a block's sums come back once a node: no row is sent an edge."""
    blocks = in_blocks(edges)
    start = seeds.select("id").distinct()
    start = settle(start.withColumn("base", F.lit(1.0 / max(1, start.count()))))
    known = settle(start.join(blocks.nodes, "id").select("num", "base"))
    back = known.select("num", (F.col("base") * (1 - damping)).alias("rank"))
    ranks = known.select("num", F.col("base").alias("rank"))
    for n in range(1, rounds + 1):
        value = F.coalesce("rank", F.lit(0.0)) * F.col("share") * damping
        sent = blocks.places.join(ranks, "num", "left").select("to", "num", value.alias("value"))
        flow = blocks.held.groupBy("block").cogroup(sent.groupBy("to")).applyInArrow(passed_on, "num long, rank double")
        ranks = flow.unionAll(back).groupBy("num").agg(F.sum("rank").alias("rank"))
        if n % 5 == 0 or n == rounds:
            ranks = settle(ranks)
    blocks.release()
    alone = start.join(blocks.nodes, "id", "left_anti").select("id", F.col("base") * ((1 - damping) if rounds else 1.0))
    return blocks.nodes.join(ranks, "num").select("id", "rank").unionAll(alone)


def closure(tree: DataFrame) -> DataFrame:
    """(node, ancestor, depth): all ancestors of a child-parent table (child, parent) by the fewest steps; a class in a cycle is its
    own ancestor.

    Paths double: whatever lies more than k and up to 2k steps up lies up to k steps above what lies exactly k steps up, so a
    chain of d classes takes log2(d) rounds, and pairs that are new are made once for each way at that middle.
    """
    up = tree.select(F.col("child").alias("node"), F.col("parent").alias("ancestor")).where("node is not null and ancestor is not null")
    found = settle(up.distinct().withColumn("depth", F.lit(1)))
    reach = 1
    while True:
        middle = found.where(F.col("depth") == reach).select("node", F.col("ancestor").alias("via"))
        above = found.select(F.col("node").alias("via"), "ancestor", "depth")
        new = middle.join(above, "via").groupBy("node", "ancestor").agg((F.min("depth") + reach).alias("depth"))
        new = settle(new.join(found.select("node", "ancestor"), ["node", "ancestor"], "left_anti"))
        if new.isEmpty():
            return found
        found, reach = found.union(new), 2 * reach


def longest(tree: DataFrame) -> DataFrame:
    """(node, depth): steps of the longest chain up from each node; on a cycle the walk ends before a node comes again, so
    what lies on or below one counts by its fewest steps to each ancestor."""
    up = settle(tree.select("child", "parent").where("child is not null and parent is not null and child <> parent").distinct())
    level = up.select(F.col("parent").alias("node")).union(up.select("child")).distinct().withColumn("depth", F.lit(0))
    above = closure(up)
    looped = above.where("node = ancestor").select("node")
    bad = above.join(looped.withColumnRenamed("node", "ancestor"), "ancestor", "left_semi").select("node").distinct()
    acyclic = settle(up.join(bad, up["child"] == bad["node"], "left_anti"))
    best = settle(level)
    while True:
        best_of = acyclic.join(best, acyclic["parent"] == best["node"]).groupBy(F.col("child").alias("node")).agg((F.max("depth") + 1).alias("deeper"))
        after = settle(best.join(best_of, "node", "left").select("node", F.greatest("depth", F.coalesce("deeper", F.lit(0))).alias("depth"), (F.coalesce("deeper", F.lit(0)) > F.col("depth")).alias("moved")))
        best = after.select("node", "depth")
        if after.where("moved").isEmpty():
            break
    short = above.join(bad, "node", "left_semi").groupBy("node").agg(F.max("depth").alias("near"))
    return best.join(short, "node", "left").select("node", F.greatest("depth", F.coalesce("near", F.lit(0))).alias("depth"))


def descendants(tree: DataFrame, root: str) -> DataFrame:
    """All that lie below a node by the fewest steps, the node itself included at depth 0."""
    spark = tree.sparkSession
    tree = settle(tree.select("child", "parent"))
    seen = frontier = spark.range(1).select(F.lit(root).alias("node"), F.lit(0).alias("depth"))
    depth = 0
    while True:
        depth += 1
        under = frontier.join(tree, frontier["node"] == tree["parent"]).select(F.col("child").alias("node")).distinct()
        frontier = settle(under.join(seen.select("node"), "node", "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            return seen
        seen = seen.union(frontier)


def chain_depth(tree: DataFrame) -> DataFrame:
    """Nodes on the longest chain from any class up."""
    return longest(tree).agg((F.max("depth") + 1).alias("max_depth"))


def branching(tree: DataFrame) -> DataFrame:
    """Mean number of children of classes that have any."""
    return tree.agg((F.count("*") / F.countDistinct("parent")).alias("branching"))


def structure(tree: DataFrame) -> DataFrame:
    """Roots, leaves, their share of all classes, and depth statistics from the roots."""
    nodes = tree.select(F.col("child").alias("node")).union(tree.select("parent")).distinct()
    rows = nodes.join(longest(tree), "node", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    parents = tree.select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(1))
    rows = rows.join(parents, "node", "left")
    return rows.agg(
        F.count("*").alias("classes"),
        F.count_if(F.col("depth") == 0).alias("roots"),
        F.count_if(F.col("inner").isNull()).alias("leaves"),
        (F.count_if(F.col("inner").isNull()) / F.count("*")).alias("leaf_ratio"),
        F.max("depth").alias("max_depth"),
        F.avg("depth").alias("mean_depth"),
        F.percentile("depth", 0.5).alias("median_depth"),
        F.stddev_samp("depth").alias("sd_depth"),
    )


def simple_paths(edges: DataFrame, source: str, target: str, most: int, relations: list[str] | None = None) -> DataFrame:
    """All paths between two nodes of up to `most` steps without a repeated node, ignoring direction; with `relations`, only
    over edges of these kinds. A path goes on only to nodes from which the target is near enough for what is left."""
    if relations is not None:
        edges = edges.where(F.col("rel").isin(relations))
    steps = settle(both_ways(edges))
    goal = edges.sparkSession.range(1).select(F.lit(target).alias("id"))
    near = settle(hops(edges, goal, most - 1).select(F.col("id").alias("b"), F.col("hop").alias("left")))  # a step is made before any is left
    paths = edges.sparkSession.range(1).select(F.array(F.lit(source)).alias("path"))
    done = None
    for n in range(1, most + 1):
        useful = steps.join(near.where(F.col("left") <= most - n), "b").select("a", "b")
        last = F.element_at("path", -1)
        paths = paths.join(useful, last == F.col("a")).where(~F.array_contains("path", F.col("b"))).select(F.concat("path", F.array("b")).alias("path"))
        paths = settle(paths)
        hit = paths.where(F.element_at("path", -1) == target)
        done = hit if done is None else done.union(hit)
        paths = paths.where(F.element_at("path", -1) != target)
    return done


def half_paths(edges: DataFrame, near: DataFrame, starts: DataFrame, most: int, steps: int) -> list[DataFrame]:
    """For n = 0..steps the paths (seed, path) of n steps without a repeated node from starts (id), as far as another start lies
    near enough, by rows (id, seed, hop), for `most` steps in all."""
    both = settle(both_ways(edges))
    nearest = near.groupBy("id").agg(F.min(F.struct("hop", "seed")).alias("one"))
    second = near.join(nearest, "id").where("seed <> one.seed").groupBy("id").agg(F.min("hop").alias("next"))
    left = settle(nearest.join(second, "id", "left"))
    out = [starts.select(F.col("id").alias("seed"), F.array("id").alias("path"))]
    for n in range(1, steps + 1):
        on = out[-1].withColumn("a", F.element_at("path", -1)).join(both, "a").where(~F.array_contains("path", F.col("b")))
        hop = F.when(F.col("one.seed") != F.col("seed"), F.col("one.hop")).otherwise(F.col("next"))
        kept = on.join(left, on["b"] == left["id"]).where(hop <= most - n)
        out.append(settle(kept.select("seed", F.concat("path", F.array("b")).alias("path"))))
    return out


def connecting_paths(edges: DataFrame, entities: DataFrame, most: int = 3) -> DataFrame:
    """(source, target, path) of all paths of up to `most` steps without a repeated node, ignoring direction, between any two
    of the entities (id), source < target.

    Paths grow from every entity at once, up to the half, and only where another entity is near enough for the steps that are
    left; two halves that end in one node and share no other make a path.
    """
    starts = settle(entities.select("id").where("id is not null").distinct())
    near = settle(hops_from(edges, starts.select(F.col("id").alias("seed"), "id"), most - 1))  # a step is made before any is left
    halves = half_paths(edges, near, starts, most, (most + 1) // 2)
    done = None
    for length in range(1, most + 1):
        a = halves[(length + 1) // 2].select(F.col("seed").alias("source"), F.col("path").alias("head"), F.element_at("path", -1).alias("mid"))
        b = halves[length // 2].select(F.col("seed").alias("target"), F.col("path").alias("tail"), F.element_at("path", -1).alias("mid"))
        met = a.join(b, "mid").where((F.col("source") < F.col("target")) & (F.size(F.array_intersect("head", "tail")) == 1))
        whole = met.select("source", "target", F.concat("head", F.slice(F.reverse("tail"), 2, F.greatest(F.size("tail") - 1, F.lit(1)))).alias("path"))
        done = whole if done is None else done.union(whole)
    return done


def path_nodes(paths: DataFrame) -> DataFrame:
    """The distinct nodes (id) of paths."""
    return paths.select(F.explode("path").alias("id")).distinct()


def path_relations(paths: DataFrame, edges: DataFrame) -> DataFrame:
    """The distinct edges (src, rel, dst) that paths go along, in either direction and of any relation."""
    steps = paths.select(F.explode(F.arrays_zip(F.slice("path", 1, F.size("path") - 1).alias("a"), F.slice("path", 2, F.size("path") - 1).alias("b"))).alias("s")).select("s.a", "s.b").distinct()
    ways = steps.union(steps.select("b", "a")).distinct()
    return edges.join(ways, (edges["src"] == ways["a"]) & (edges["dst"] == ways["b"]), "left_semi").select("src", "rel", "dst").distinct()


def degrees(edges: DataFrame, cap: int = 20) -> DataFrame:
    """Distinct neighbours of each node, counted up to a cap."""
    return both_ways(edges).groupBy(F.col("a").alias("id")).agg(F.least(F.count("*"), F.lit(cap)).alias("degree"))


def entity_search(nodes: DataFrame, terms: list[str], most: int = 20) -> DataFrame:
    """nodes (id, label, properties, ...) whose id equals a term or whose label or properties hold one, ignoring case; the first by
    id. The terms are a question's, so few."""
    low = [t.lower() for t in terms]
    hit = F.lower("id").isin(low)
    for t in low:
        hit = hit | F.contains(F.lower("label"), F.lit(t)) | F.contains(F.lower("properties"), F.lit(t))
    return nodes.where(hit).distinct().orderBy("id").limit(most)


def neighbours(edges: DataFrame, nodes: DataFrame, wanted: DataFrame, most: int = 10) -> DataFrame:
    """(id, other, rel, way, label): up to so many neighbours of each wanted node (id), by id, with the edge's direction."""
    from pyspark.sql import Window

    out = edges.select(F.col("src").alias("id"), F.col("dst").alias("other"), "rel", F.lit("out").alias("way"))
    both = out.union(edges.select("dst", "src", "rel", F.lit("in"))).join(wanted, "id", "left_semi").distinct()
    few = both.withColumn("nth", F.row_number().over(Window.partitionBy("id").orderBy("other", "rel", "way"))).where(F.col("nth") <= most)
    return few.join(nodes.select(F.col("id").alias("other"), "label"), "other", "left").select("id", "other", "rel", "way", "label")


def modularity(tree: DataFrame) -> DataFrame:
    """Mean depth of all classes over first parents, mean number of hierarchy edges at a class, and 1 / (1 + difference)."""
    first = tree.groupBy("child").agg(F.min("parent").alias("parent"))
    ends = tree.select(F.col("child").alias("node")).unionAll(tree.select("parent")).groupBy("node").agg(F.count("*").alias("n"))
    rows = ends.join(longest(first), "node", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
    means = rows.agg(F.avg("depth").alias("mean_depth"), F.avg("n").alias("connectivity"))
    return means.withColumn("modularity", 1 / (1 + F.abs(F.col("mean_depth") - F.col("connectivity"))))


def hierarchy_metrics(classes: DataFrame, tree: DataFrame, top: str) -> DataFrame:
    """One row for classes (uri) and a class tree (child, parent): least, largest, mean, median and spread of the fewest steps from the
    top class, of those that can be reached from it; mean and most children of classes that have any; the share without
    children; and how many but the top have no parent. Statistics of nothing are 0, and so is the spread of one."""
    all_of = classes.select(F.col("uri").alias("node")).where("node is not null").distinct()
    edges = tree.select("child", "parent").where("child is not null and parent is not null").distinct()
    depth = descendants(edges, top)
    children = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("children"))
    below = edges.select(F.col("child").alias("node")).distinct().withColumn("below", F.lit(True))
    rows = all_of.join(depth, "node", "left").join(children, "node", "left").join(below, "node", "left")
    none = lambda c: F.coalesce(c.cast("double"), F.lit(0.0))
    return rows.agg(
        F.count("*").alias("classes"),
        none(F.min("depth")).alias("depth_min"),
        none(F.max("depth")).alias("depth_max"),
        none(F.avg("depth")).alias("depth_mean"),
        none(F.percentile("depth", 0.5)).alias("depth_median"),
        none(F.stddev_samp("depth")).alias("depth_stdev"),
        none(F.avg("children")).alias("branching_mean"),
        none(F.max("children")).alias("branching_max"),
        none(F.avg(F.col("children").isNull().cast("int"))).alias("leaf_ratio"),
        F.count_if(F.col("below").isNull() & (F.col("node") != top)).alias("orphans"),
    )
