"""Benchmark tables and paired statistics over results (system, test_case, level, metrics...)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METRICS = ("semantic", "hallucination", "coverage")
INVERTED = ("hallucination",)


def master_table(results: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Means by system, and by system and level, in one pass; a missing metric counts as 0. level is null in the former."""
    means = [F.avg(F.coalesce(m, F.lit(0.0))).alias(m) for m in metrics]
    return results.groupingSets([["system"], ["system", "level"]], "system", "level").agg(F.count("*").alias("n"), *means)


def unpivoted(results: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    rest = [c for c in results.columns if c not in metrics]
    return results.unpivot(rest, list(metrics), "metric", "value")


def ranking(results: DataFrame, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """The best system by each metric; the least is best for inverted ones; ties by system."""
    means = unpivoted(results, metrics).groupBy("metric", "system").agg(F.round(F.avg("value"), 6).alias("mean"))
    good = F.when(F.col("metric").isin(*INVERTED), -F.col("mean")).otherwise(F.col("mean"))
    order = Window.partitionBy("metric").orderBy(good.desc(), "system")
    return means.withColumn("nth", F.row_number().over(order)).where("nth = 1").select("metric", "system", "mean")


def deltas(results: DataFrame, reference: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Each system's means minus the reference system's; inverted metrics turn round."""
    means = unpivoted(results, metrics).groupBy("metric", "system").agg(F.avg("value").alias("mean"))
    base = means.where(F.col("system") == reference).select("metric", F.col("mean").alias("base"))
    sign = F.when(F.col("metric").isin(*INVERTED), -1.0).otherwise(1.0)
    return means.join(base, "metric").where(F.col("system") != reference).select("metric", "system", ((F.col("mean") - F.col("base")) * sign).alias("delta"))


def paired(results: DataFrame, a: str, b: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """Two systems' values on the test cases that both have: (metric, test_case, level, a, b)."""
    rows = unpivoted(results, metrics)
    side = lambda name, to: rows.where(F.col("system") == name).select("metric", "test_case", "level", F.col("value").alias(to))
    return side(a, "a").join(side(b, "b"), ["metric", "test_case", "level"])


def paired_statistics(pairs: DataFrame) -> DataFrame:
    """By metric: pairs, mean difference, paired t and Cohen's d on the pooled deviation, with its size in words."""
    d = F.col("a") - F.col("b")
    n = F.count("*")
    pooled = F.sqrt((F.var_samp("a") + F.var_samp("b")) / 2)
    by = pairs.groupBy("metric").agg(n.alias("n"), F.avg(d).alias("mean_difference"), (F.avg(d) / F.nullif(F.stddev_samp(d) / F.sqrt(n), F.lit(0.0))).alias("t"), (F.avg(d) / F.nullif(pooled, F.lit(0.0))).alias("cohens_d"))
    size = F.abs("cohens_d")
    return by.withColumn("effect", F.when(size < 0.2, "negligible").when(size < 0.5, "small").when(size < 0.8, "medium").otherwise("large"))


PRIME = 2_147_483_647
# The chances that a Poisson(1) draw is at most 0, 1, 2, ...
POISSON = (0.3678794412, 0.7357588823, 0.9196986029, 0.9810118431, 0.9963401532, 0.9994058152)


def poisson_weights(pair: np.ndarray, resample: np.ndarray, seed: int) -> np.ndarray:
    """(pairs, resamples): Poisson(1) draws from a hash by squares modulo a prime."""
    x = (pair[:, None] * 48_271 + resample * 69_621 + seed) % PRIME
    y = (x * x + 12_345) % PRIME
    return np.searchsorted(POISSON, (y * y + resample) % PRIME / float(PRIME), "right")


def bootstrap(pairs: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """pairs (metric, pair, a, b), pair being a number: by metric the 2.5 and 97.5 percentiles of the mean difference over
    Poisson resamples, all drawn in one pass. A task keeps two running sums a resample and a metric and hands on these, so
    nothing grows with pairs times resamples. Each pair's weight in a resample is drawn from a hash, so a rerun gives the same
    interval. Pairs with a null side take no part.
    """
    every = np.arange(1, resamples + 1, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            metric, pair = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_numpy()
            d = batch.column(2).to_numpy()
            for name in sorted(set(metric.tolist())):
                own = np.flatnonzero(metric == name)
                total = sums.setdefault(name, np.zeros((2, resamples)))
                for k in range(0, len(own), 64):
                    some = own[k : k + 64]
                    w = poisson_weights(pair[some] % PRIME, every, seed)
                    total += d[some] @ w, w.sum(0)
        for name, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * resamples), pa.array(every), pa.array(total[0]), pa.array(total[1])], ["metric", "resample", "d", "w"])

    rows = pairs.where("metric is not null and pair is not null and a is not null and b is not null")
    drawn = rows.select("metric", F.col("pair").cast("long"), (F.col("a") - F.col("b")).cast("double").alias("d")).mapInArrow(run, "metric string, resample long, d double, w double")
    means = drawn.groupBy("metric", "resample").agg((F.sum("d") / F.nullif(F.sum("w"), F.lit(0.0))).alias("mean"))
    return means.groupBy("metric").agg(F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"))


def difficulty_curve(results: DataFrame, metric: str, levels: list[str]) -> DataFrame:
    return results.groupBy("system").pivot("level", levels).agg(F.avg(metric))


# The eleven metrics of a benchmark table, and where those of nested results lie, with what they are divided by.
DIMENSIONS = ("semantic_correctness", "hallucination_rate", "cq_coverage", "hierarchy_quality", "domain_compliance", "expert_acceptance", "composite_score")
NESTED = {
    "semantic_match_concept": ("match_percentage", 100.0), "semantic_match_triple": ("match_percentage", 100.0),
    "owlunit_pass_rate": ("owlunit_suite.pass_rate", 1.0), "ontourl_overall": ("ontourl_profile.overall_avg", 1.0),
}
SHOWN = DIMENSIONS[:6]  # what charts show
HEADS = ("Sem.", "Hal.", "CQ", "Hier.", "Dom.", "Exp.", "Comp.")  # of the seven in a printed table


def flat_metrics(results: DataFrame) -> DataFrame:
    """results (system, level, metrics as VARIANT) with a column a metric; what is missing, null or no number counts 0."""
    at = lambda path, scale: F.coalesce(F.try_variant_get("metrics", path, "double") / scale, F.lit(0.0))
    nested = {m: at(f"$.{path}" if "." in path else f"$.{m}.{path}", scale) for m, (path, scale) in NESTED.items()}
    return results.select("system", "level", *[at(f"$.{m}", 1.0).alias(m) for m in DIMENSIONS], *[c.alias(m) for m, c in nested.items()])


def benchmark_table(results: DataFrame) -> DataFrame:
    """Means of the eleven metrics by system, level being null, and by system and level, in one pass."""
    return master_table(flat_metrics(results), (*DIMENSIONS, *NESTED))


def chart_values(table: DataFrame, metrics: tuple[str, ...] = SHOWN, inverted: tuple[str, ...] = ("hallucination_rate",)) -> DataFrame:
    """(system, level, metric, value): a benchmark table's cells as charts show them, inverted where less is better and kept within 0
    and 1; a missing one is 0 before it is inverted. Rows of a level make a heatmap, rows without one bars and radars."""
    rows = table.select("system", "level", *[F.col(m).cast("double").alias(m) for m in metrics]).unpivot(["system", "level"], list(metrics), "metric", "value")
    good = F.coalesce("value", F.lit(0.0))
    good = F.when(F.col("metric").isin(*inverted), 1 - good).otherwise(good)
    return rows.select("system", "level", "metric", F.least(F.greatest(good, F.lit(0.0)), F.lit(1.0)).alias("value"))


def latex_rows(table: DataFrame, metrics: tuple[str, ...] = DIMENSIONS, inverted: tuple[str, ...] = ("hallucination_rate",)) -> DataFrame:
    """(system, line): a LaTeX table row for each system of a table of means, two decimals, the best value of a column in bold; of equal
    ones the first system's. `latex_frame` gives what stands around them."""
    keyed = table.select("system", *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics])
    order = lambda m: F.struct((F.col(m) if m in inverted else -F.col(m)).alias("v"), F.col("system"))
    first = keyed.agg(*[F.min_by("system", order(m)).alias(f"best_{m}") for m in metrics])
    text = lambda m: F.format_string("%.2f", F.col(m))
    cell = lambda m: F.when(F.col("system") == F.col(f"best_{m}"), F.concat(F.lit("\\textbf{"), text(m), F.lit("}"))).otherwise(text(m))
    return keyed.join(F.broadcast(first)).select("system", F.concat(F.concat_ws(" & ", "system", *map(cell, metrics)), F.lit(" \\\\")).alias("line"))  # one row


def latex_frame(caption: str, heads: tuple[str, ...] = HEADS) -> tuple[str, str]:
    """What stands before and after a LaTeX table's rows, the last column set apart."""
    columns = "l|" + "c" * (len(heads) - 1) + "|c"
    above = ["\\begin{table}[t]", "\\centering", f"\\caption{{{caption}}}", f"\\begin{{tabular}}{{{columns}}}", "\\toprule", " & ".join(("System", *heads)) + " \\\\", "\\midrule"]
    return "\n".join(above), "\n".join(("\\bottomrule", "\\end{tabular}", "\\end{table}"))


def paired_strictly(results: DataFrame, a: str, b: str, metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """As `paired`, but an error where the two systems don't have the same number of results, or not on the same test cases."""
    rows = results.where(F.col("system").isin(a, b)).groupBy("test_case", "level").agg(F.count_if(F.col("system") == a).alias("a"), F.count_if(F.col("system") == b).alias("b"))
    off = rows.where("a <> b or a > 1").count()
    if off:
        raise ValueError(f"{off} test cases don't have one result of {a} and one of {b}")
    return paired(results, a, b, metrics)
