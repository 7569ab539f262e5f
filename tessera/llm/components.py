"""Connected components of an edge list by distributed hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut

PART = 50_000


def components(edges: DataFrame) -> DataFrame:
    """Rows (a, b) of 64-bit nodes to rows (node, root), root being the smallest node reachable.

    Each round a node and its present root both take the smallest root seen among neighbours, then roots are followed
    twice, so long chains shrink geometrically. Nodes without an edge don't occur. Only the count of changed rows
    reaches the driver. Tables of a round have a partition for every PART edges, so that many rounds over few edges leave few files.
    """
    both = cut(
        edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a is not null and b is not null and a <> b").distinct()
    )
    parts = both.count() // PART + 1
    both = both.coalesce(parts)
    roots = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least("a", "b")).alias("root")).coalesce(parts))
    while True:
        seen = both.join(roots.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        offers = roots.join(seen, "node").select("node", "root", F.least("near", "root").alias("near")).coalesce(parts)
        best = (
            offers.select("node", "near")
            .union(offers.where("near < root").select(F.col("root").alias("node"), "near"))
            .groupBy("node")
            .agg(F.min("near").alias("near"))
        )
        hooked = roots.join(best, "node").select("node", "root", F.least("root", "near").alias("to")).coalesce(parts)
        jump = hooked.select(F.col("node").alias("to"), F.col("to").alias("far"))
        after = cut(hooked.join(jump, "to").select("node", F.col("far").alias("root"), (F.col("far") < F.col("root")).alias("moved")).coalesce(parts))
        roots = after.select("node", "root")
        if not after.where("moved").limit(1).count():
            return roots
