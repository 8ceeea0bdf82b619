"""Counts, rates and failure histograms of evaluations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.classify import evaluation_class, failure_phase
from tessera.functions.text import safe_ratio

FLAGS = ("transform_ok", "compile_ok", "test_ok")


def pass_counts(results: DataFrame, *keys: str) -> DataFrame:
    """Totals, passes and rates of result rows by keys; a missing flag is a failure."""
    counts = results.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if("transform_ok").alias("transform_pass"),
        F.count_if("compile_ok").alias("compile_pass"),
        F.count_if("test_ok").alias("test_pass"),
    )
    return counts.withColumns({
        "transform_rate": safe_ratio(F.col("transform_pass"), F.col("total")),
        "compile_at_1": safe_ratio(F.col("compile_pass"), F.col("total")),
        "test_at_1": safe_ratio(F.col("test_pass"), F.col("total")),
    })


def failures(results: DataFrame) -> DataFrame:
    """The rows that failed, with failure_phase, message and failure_class."""
    phase = failure_phase(*[F.col(f) for f in FLAGS])
    message = F.when(F.col("failure_phase") == "transform", F.col("transform_error")).when(F.col("failure_phase") == "compile", F.col("compile_error")).otherwise(F.col("test_error"))
    return (
        results.withColumn("failure_phase", phase)
        .filter(F.col("failure_phase").isNotNull())
        .withColumn("message", F.coalesce(message, F.lit("")))
        .withColumn("failure_class", evaluation_class(F.col("message"), F.col("failure_phase")))
    )


def histogram(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("count"))


def two_level_histogram(df: DataFrame, outer: str, inner: str, value: str) -> DataFrame:
    """Counts of value by outer, and by outer and inner, in one pass; inner is null in the first."""
    sets = [[F.col(outer), F.col(value)], [F.col(outer), F.col(inner), F.col(value)]]
    return df.groupingSets(sets, outer, inner, value).agg(F.count("*").alias("count"), F.grouping(inner).alias("level"))


def top_per_group(counts: DataFrame, group: str | list[str], name: str, count: str, k: int) -> DataFrame:
    """The k largest counts of each group, ties by name."""
    groups = [group] if isinstance(group, str) else group
    w = Window.partitionBy(*groups).orderBy(F.desc(count), name)
    return counts.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def most_common(df: DataFrame, name: str, position: str) -> DataFrame:
    """(name, count, first) by falling count, ties in the order of first occurrence."""
    return df.groupBy(name).agg(F.count("*").alias("count"), F.min(position).alias("first")).orderBy(F.desc("count"), "first")


def one_sided(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that only one of two tables has: (key, side)."""
    a, b = left.select(key).distinct().withColumn("_l", F.lit(True)), right.select(key).distinct().withColumn("_r", F.lit(True))
    both = a.join(b, key, "full_outer").filter("_l is null or _r is null")
    return both.select(key, F.when(F.col("_r").isNull(), "left").otherwise("right").alias("side"))


def mismatches(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """(key, expected, actual) where the values differ, null-safe, or one side is missing."""
    joined = expected.select(key, F.col(value).alias("expected")).join(actual.select(key, F.col(value).alias("actual")), key, "full_outer")
    return joined.filter(~F.col("expected").eqNullSafe(F.col("actual")))
