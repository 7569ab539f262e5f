"""Review decisions and feedback signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.gaps import keep_first


def last_decisions(decisions: DataFrame) -> DataFrame:
    """The last decision (by seq) on each proposal."""
    return decisions.groupBy("proposal").agg(F.max_by("decision", "seq").alias("decision"), F.max("seq").alias("seq"))


def accepted(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals whose last decision accepts them, however it is spelled."""
    yes = last_decisions(decisions).where(F.col("decision").isin("accept", "accepted"))
    return proposals.join(yes, proposals["id"] == yes["proposal"]).drop("proposal", "decision")


def pending(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    return proposals.join(decisions, proposals["id"] == decisions["proposal"], "left_anti")


def reviewer_agreement(decisions: DataFrame) -> DataFrame:
    """Among proposals with two decisions or more, the share with one verdict; 0 if there are none."""
    by = decisions.groupBy("proposal").agg(F.count("*").alias("n"), F.countDistinct("decision").alias("kinds")).where("n >= 2")
    return by.agg(F.count("*").alias("proposals"), F.coalesce(F.avg((F.col("kinds") == 1).cast("int")), F.lit(0.0)).alias("agreement"))


def status(decisions: DataFrame, kinds: tuple[str, ...] = ("accept", "reject", "revise")) -> DataFrame:
    return decisions.agg(F.count("*").alias("total"), *[F.count_if(F.col("decision") == k).alias(k) for k in kinds])


def acceptance(signals: DataFrame, by: list[str] | None = None) -> DataFrame:
    return signals.groupBy(*by or []).agg(F.count("*").alias("n"), F.avg((F.col("decision") == "accepted").cast("int")).alias("rate"))


def acceptance_trend(signals: DataFrame, partition: str, window: int = 5) -> DataFrame:
    """Acceptance over the last `window` signals of a partition, for whole windows; where there are fewer in all, one row
    with their overall rate."""
    order = Window.partitionBy(partition).orderBy("seq")
    ok = (F.col("decision") == "accepted").cast("int")
    rows = signals.withColumns(
        {
            "rate": F.avg(ok).over(order.rowsBetween(-(window - 1), 0)),
            "nth": F.row_number().over(order),
            "all": F.count("*").over(Window.partitionBy(partition)),
        }
    )
    return rows.where((F.col("nth") >= window) | ((F.col("all") < window) & (F.col("nth") == F.col("all")))).select(partition, "seq", "rate")


def rejection_reasons(signals: DataFrame, last: int = 3) -> DataFrame:
    """Reasons (their first 100 characters) for rejections by how often they occur, with the last elements."""
    said = signals.where("decision = 'rejected'").withColumn("reason", F.coalesce(F.nullif(F.substring("rationale", 1, 100), F.lit("")), F.lit("unspecified")))
    counts = said.groupBy("reason").agg(F.count("*").alias("n"))
    latest = keep_first(said.withColumn("back", -F.col("seq")), "reason", "back", last)
    names = latest.groupBy("reason").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "element"))), lambda x: x["element"]), "|").alias("examples"))
    return counts.join(names, "reason")


def recent_examples(signals: DataFrame, n: int = 3) -> DataFrame:
    """The last n accepted elements of each phase."""
    order = Window.partitionBy("phase").orderBy(F.col("seq").desc())
    return signals.where("decision = 'accepted'").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= n).select("phase", "nth", "seq", "element")


def improvements(series: DataFrame, key: str = "iteration", value: str = "value") -> DataFrame:
    """Each iteration's change to the one before; the first one's is its value."""
    order = Window.partitionBy().orderBy(key)
    return series.withColumn("improvement", F.col(value) - F.coalesce(F.lag(value).over(order), F.lit(0.0)))


def convergence(series: DataFrame, threshold: float = 0.02) -> DataFrame:
    """First, last and change of a series (iteration, value), and the first iteration after the first whose improvement is
    below the threshold, also a negative one."""
    rows = improvements(series)
    first = F.min(F.when((F.col("improvement") < threshold) & (F.col("iteration") > 1), F.col("iteration")))
    return rows.agg(
        F.count("*").alias("iterations"),
        F.min_by("value", "iteration").alias("first_value"),
        F.max_by("value", "iteration").alias("last_value"),
        (F.max_by("value", "iteration") - F.min_by("value", "iteration")).alias("delta"),
        first.alias("converged_at"),
        F.avg("improvement").alias("mean_improvement"),
    )
