"""Analyses of debates: messages (debate, seq, role, message_type, approves, issues, reasoning)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def in_order():
    return Window.partitionBy("debate").orderBy("seq")


def consensus(messages: DataFrame) -> DataFrame:
    """Whether all reviews after a debate's last proposal or revision approve, and there is one; an unknown approval counts
    as none."""
    change = F.col("message_type").isin("proposal", "revision")
    marked = messages.withColumn("last", F.max(F.when(change, F.col("seq"))).over(Window.partitionBy("debate")))
    after = (F.col("message_type") == "review") & (F.col("seq") > F.coalesce("last", F.lit(-1)))
    return marked.groupBy("debate").agg(
        F.count_if(after).alias("reviews"),
        (F.coalesce(F.bool_and(F.when(after, F.coalesce("approves", F.lit(False)))), F.lit(False))).alias("consensus"),
    )


def latest_proposals(messages: DataFrame) -> DataFrame:
    return messages.where("message_type = 'proposal'").groupBy("debate").agg(F.max_by("reasoning", "seq").alias("proposal"), F.max("seq").alias("seq"))


LAST_REVIEWS = 3


def clean_review() -> Column:
    """Whether a review approves and raises no issue; an unknown approval is none, an unknown number of issues none."""
    return F.coalesce("approves", F.lit(False)) & (F.coalesce("issues", F.lit(0)) == 0)


def trivial_rounds(messages: DataFrame) -> DataFrame:
    """(debate, seq, rounds) for each review: for how many reviews on end the last three (or all, if fewer) were clean."""
    reviews = messages.where("message_type = 'review'").withColumn("clean", clean_review())
    near = F.bool_and("clean").over(in_order().rowsBetween(1 - LAST_REVIEWS, 0))
    marked = reviews.withColumn("trivial", near).withColumn("island", F.sum((~F.col("trivial")).cast("int")).over(in_order()))
    on_end = F.count_if("trivial").over(Window.partitionBy("debate", "island").orderBy("seq"))
    return marked.select("debate", "seq", F.when(F.col("trivial"), on_end).otherwise(0).alias("rounds"))


def echo_chambers(messages: DataFrame) -> DataFrame:
    """The most rounds on end in which a debate's last three reviews approved and raised nothing."""
    return trivial_rounds(messages).groupBy("debate").agg(F.max("rounds").alias("longest"))


def growing_revisions(messages: DataFrame) -> DataFrame:
    """Debates in which some three proposals in a row don't get shorter."""
    sized = messages.where("message_type = 'proposal'").withColumn("size", F.length("reasoning"))
    sized = sized.withColumns({"one": F.lag("size", 1).over(in_order()), "two": F.lag("size", 2).over(in_order())})
    return sized.groupBy("debate").agg(F.coalesce(F.bool_or((F.col("size") >= F.col("one")) & (F.col("one") >= F.col("two"))), F.lit(False)).alias("growing"))


def delphi(messages: DataFrame, least: int = 2, share: float = 0.8) -> DataFrame:
    """Convergence: at least two known approvals of which 80 % are positive."""
    known = messages.groupBy("debate").agg(F.count("approves").alias("known"), F.avg(F.col("approves").cast("int")).alias("mean"))
    return known.select("debate", "known", "mean", F.coalesce((F.col("known") >= least) & (F.col("mean") >= share), F.lit(False)).alias("converged"))


def outcomes(messages: DataFrame) -> DataFrame:
    """CONSENSUS if the reviews among the last three messages all approve, REVISED if there was a second proposal, else
    ESCALATED; unknown approvals are passed over."""
    last = messages.withColumn("back", F.row_number().over(Window.partitionBy("debate").orderBy(F.col("seq").desc())))
    near = (F.col("back") <= 3) & (F.col("message_type") == "review") & F.col("approves").isNotNull()
    agreed = F.coalesce(F.bool_and(F.when(near, F.col("approves"))), F.lit(False))
    again = F.count_if(F.col("message_type") == "proposal") > 1
    return last.groupBy("debate").agg(F.when(agreed, "CONSENSUS").when(again, "REVISED").otherwise("ESCALATED").alias("outcome"))


def unresolved(issues: DataFrame, revisions: DataFrame) -> DataFrame:
    """issues (debate, issue) that no revision (debate, reasoning) of the debate mentions, ignoring case."""
    told = revisions.select(F.col("debate").alias("d"), F.lower("reasoning").alias("said"))
    return issues.join(told, (F.col("debate") == F.col("d")) & F.contains("said", F.lower("issue")), "left_anti")


def verdicts(issues: DataFrame, revisions: DataFrame) -> DataFrame:
    """REVISED with nothing unresolved, PARTIAL with fewer than three, else ESCALATED; and how many were resolved."""
    left = unresolved(issues, revisions).groupBy("debate").agg(F.count("*").alias("open"))
    raised = issues.groupBy("debate").agg(F.count("*").alias("raised"))
    both = raised.join(left, "debate", "left").withColumn("open", F.coalesce("open", F.lit(0)))
    return both.select("debate", "raised", "open", (F.col("raised") - F.col("open")).alias("resolved"), F.when(F.col("open") == 0, "REVISED").when(F.col("open") < 3, "PARTIAL").otherwise("ESCALATED").alias("verdict"))


def health(messages: DataFrame) -> DataFrame:
    """Messages, reviews, approvals and approval rate of each debate."""
    reviews = F.count_if(F.col("message_type") == "review")
    return messages.groupBy("debate").agg(
        F.count("*").alias("messages"), reviews.alias("reviews"), F.count_if("approves").alias("approvals"), F.coalesce(F.count_if("approves") / F.nullif(reviews, F.lit(0)), F.lit(0.0)).alias("approval_rate")
    )


def transcripts(messages: DataFrame, most: int = 500) -> DataFrame:
    """A debate's lines in order, each cut at so many characters."""
    line = F.concat(F.col("role"), F.lit(": "), F.substring("reasoning", 1, most))
    lines = F.array_sort(F.collect_list(F.struct("seq", line.alias("line"))))
    return messages.groupBy("debate").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("transcript"))
