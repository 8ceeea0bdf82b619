"""Means over seeds, differences between arms, and taxonomies over reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.classify import failure_phase, report_class
from tessera.operators.score import FLAGS, pass_counts


def result_rows(reports: DataFrame, arms: tuple[str, ...], *keys: str, **figures: Callable[[Column], Column]) -> DataFrame:
    """One row for each result of each arm of report documents, with the reports' keys, and figures of its arm's report by name."""
    by_arm = F.inline(F.array(*[F.struct(F.lit(a).alias("arm"), F.col(a)["rows"].alias("rows"), *[f(F.col(a)).alias(n) for n, f in figures.items()]) for a in arms]))
    # A column of its own, as else each result would carry its arm's whole list along.
    rows = reports.select(*keys, by_arm).select(*keys, "arm", *figures, F.explode("rows").alias("r"))
    return rows.select(*keys, "arm", *figures, "r.id", "r.family", *[f"r.{f}" for f in FLAGS], *[f"r.{f[:-3]}_error" for f in FLAGS])


def mean_std(rates: DataFrame, keys: list[str], *measures: str) -> DataFrame:
    """Mean and population standard deviation of each measure by keys, 0 and 0 if there is none.

    rates has a row for each seed; groups that a seed lacks are not filled in.
    """
    columns = [x for m in measures for x in (F.coalesce(F.avg(m), F.lit(0.0)).alias(f"{m}_mean"), F.coalesce(F.stddev_pop(m), F.lit(0.0)).alias(f"{m}_std"))]
    return rates.groupBy(*keys).agg(*columns)


def summary_over_seeds(results: DataFrame, seed: str, *keys: str) -> DataFrame:
    """Rates of each seed first, then their mean and deviation by keys."""
    return mean_std(pass_counts(results, *keys, seed), list(keys), "transform_rate", "compile_at_1", "test_at_1")


def arm_delta(summary: DataFrame, keys: list[str], arm: str, first: str, second: str, *measures: str) -> DataFrame:
    """second minus first of each measure."""
    wide = summary.groupBy(*keys).pivot(arm, [first, second]).agg(*[F.first(m).alias(m) for m in measures], F.count(F.lit(1)).alias("_n"))
    return wide.select(*keys, *[(F.col(f"{second}_{m}") - F.col(f"{first}_{m}")).alias(f"delta_{m}") for m in measures])


def report_taxonomy(results: DataFrame, *keys: str) -> DataFrame:
    """Counts of failure classes over reports, classified again from the rows."""
    phase = failure_phase(*[F.col(f) for f in FLAGS])
    message = F.when(F.col("phase") == "transform", F.col("transform_error")).when(F.col("phase") == "compile", F.col("compile_error")).otherwise(F.col("test_error"))
    rows = results.withColumn("phase", phase).filter(F.col("phase").isNotNull()).withColumn("failure_class", report_class(message, F.col("phase")))
    return rows.groupBy(*keys, "failure_class").agg(F.count("*").alias("count"))


def recombined(results: DataFrame, protocol: str, arm: str, choice: dict[str, str]) -> DataFrame:
    """The rows of each arm from the protocol that choice names for it (strict attribution)."""
    pick = F.lit(False)
    for a, p in choice.items():
        pick = pick | ((F.col(arm) == a) & (F.col(protocol) == p))
    return results.filter(pick)
