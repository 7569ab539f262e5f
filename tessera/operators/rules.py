"""Hierarchy rules over classes (uri, label, parent, is_new, disjoint); each gives (rule, severity, affected)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.graph import closure

SEVERITIES = ("ERROR", "WARNING", "INFO")


def found(rows: DataFrame, rule: str, severity: str, affected: str) -> DataFrame:
    return rows.select(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(affected).alias("affected"))


def children(classes: DataFrame) -> DataFrame:
    some = classes.where("parent is not null")
    return some.groupBy("parent").agg(F.count("*").alias("n"), F.count_if("disjoint").alias("disjoint"))


def single_child(classes: DataFrame) -> DataFrame:
    return found(children(classes).where("n = 1"), "single_child", "WARNING", "parent")


def too_many_children(classes: DataFrame, most: int = 12) -> DataFrame:
    return found(children(classes).where(F.col("n") > most), "too_many_children", "WARNING", "parent")


def no_disjoint_siblings(classes: DataFrame) -> DataFrame:
    return found(children(classes).where("n between 2 and 8 and disjoint = 0"), "no_disjoint_siblings", "INFO", "parent")


def ancestors(classes: DataFrame) -> DataFrame:
    return closure(classes.where("parent is not null").select(F.col("uri").alias("child"), "parent"))


def uneven_depth(classes: DataFrame, most: int = 2, up: DataFrame | None = None) -> DataFrame:
    """Parents of two or more children whose subtrees differ in height by more than `most`."""
    tree = classes.where("parent is not null").select(F.col("uri").alias("child"), "parent")
    height = (ancestors(classes) if up is None else up).groupBy(F.col("ancestor").alias("uri")).agg(F.max("depth").alias("height"))
    tall = tree.join(height, tree["child"] == height["uri"], "left").select("parent", F.coalesce("height", F.lit(0)).alias("height"))
    spread = tall.groupBy("parent").agg(F.count("*").alias("n"), (F.max("height") - F.min("height")).alias("spread"))
    return found(spread.where((F.col("n") >= 2) & (F.col("spread") > most)), "uneven_depth", "INFO", "parent")


def cycles(classes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """The first class of each cycle, of any length: classes that reach each other both ways."""
    up = (ancestors(classes) if up is None else up).select("node", "ancestor")
    back = up.select(F.col("node").alias("ancestor"), F.col("ancestor").alias("node"))
    cycle = up.join(back, ["node", "ancestor"]).groupBy("node").agg(F.min("ancestor").alias("mate"))
    return found(cycle.select(F.least("node", "mate").alias("first")).distinct(), "cycle", "ERROR", "first")


def naming(classes: DataFrame) -> DataFrame:
    """Labels of new classes that begin in lower case, look plural, or are all capitals."""
    new = classes.where("is_new")
    low = found(new.where(F.col("label").rlike("^[a-z]")), "lower_case_label", "WARNING", "uri")
    plural = found(new.where(F.col("label").rlike("s$") & ~F.col("label").rlike("(ss|us|is)$") & (F.length("label") > 3)), "plural_label", "INFO", "uri")
    capitals = found(new.where((F.upper("label") == F.col("label")) & (F.lower("label") != F.col("label")) & (F.length("label") > 1)), "all_capitals_label", "INFO", "uri")
    return low.union(plural).union(capitals)


def redundant_properties(properties: DataFrame, classes: DataFrame, up: DataFrame | None = None) -> DataFrame:
    """Properties (name, uri) attached to a class and to one of its ancestors."""
    own = properties.select("name", F.col("uri").alias("node")).join(ancestors(classes) if up is None else up, "node")
    above = properties.select("name", F.col("uri").alias("ancestor"))
    return found(own.join(above, ["name", "ancestor"]).select(F.concat_ws("@", "name", "node").alias("at")).distinct(), "redundant_property", "WARNING", "at")


def all_rules(classes: DataFrame, properties: DataFrame) -> DataFrame:
    """Every rule's findings, errors first. Ancestors are looked for once."""
    up = ancestors(classes)
    parts = [single_child(classes), too_many_children(classes), uneven_depth(classes, up=up), cycles(classes, up), naming(classes), no_disjoint_siblings(classes), redundant_properties(properties, classes, up)]
    order = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return reduce(DataFrame.union, parts).orderBy(order, "rule", "affected")
