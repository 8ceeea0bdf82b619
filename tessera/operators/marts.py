"""Flat report tables and chart frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import round6
from tessera.operators.aggregate import arm_delta, summary_over_seeds
from tessera.operators.order import fixed_order
from tessera.operators.score import failures, pass_counts
from tessera.sources.writers import SPLITS

MEASURES = ("compile_at_1", "test_at_1", "transform_rate")


def seed_metrics(results: DataFrame) -> DataFrame:
    """(seed, arm): passes and rates, rounded."""
    counts = pass_counts(results, "seed", "arm")
    return counts.withColumns({m: round6(F.col(m)) for m in MEASURES})


def failure_rows(results: DataFrame) -> DataFrame:
    """The failed rows of each seed and arm with their phase."""
    return failures(results).select("seed", "arm", "id", "family", "failure_phase", "transform_ok", "compile_ok", "test_ok", "transform_error", "compile_error", "test_error")


def metrics_by_run(results: DataFrame, first: str, second: str) -> DataFrame:
    """One row for each run: each arm's means and deviations over seeds, and the differences; all rounded.

    A run with one seed has deviation 0.
    """
    summary = summary_over_seeds(results, "seed", "run_key", "arm")
    reports = results.groupBy("run_key").agg(F.count_distinct("seed").alias("num_reports"))
    names = [f"{m}_{s}" for m in MEASURES for s in ("mean", "std")]
    wide = summary.groupBy("run_key").pivot("arm", [first, second]).agg(*[F.first(n).alias(n) for n in names])
    delta = arm_delta(summary, ["run_key"], "arm", first, second, "compile_at_1_mean", "test_at_1_mean")
    joined = reports.join(wide, "run_key").join(delta, "run_key")
    return joined.select("run_key", "num_reports", *[round6(F.col(f"{a}_{n}")).alias(f"{a}_{n}") for a in (first, second) for n in names], round6(F.col("delta_compile_at_1_mean")).alias("delta_compile"), round6(F.col("delta_test_at_1_mean")).alias("delta_test"))


def family_metrics_by_run(results: DataFrame) -> DataFrame:
    found = summary_over_seeds(results, "seed", "run_key", "arm", "family")
    return found.select("run_key", "arm", "family", *[round6(F.col(f"{m}_{s}")).alias(f"{n}_{s}") for m, n in (("compile_at_1", "compile"), ("test_at_1", "test")) for s in ("mean", "std")])


def arm_bars(runs: DataFrame, arms: tuple[str, str]) -> DataFrame:
    """(run_key, metric, arm, value) of metrics_by_run: the bars of a chart of both arms by metric."""
    bars = [F.struct(F.lit(label).alias("metric"), F.lit(a).alias("arm"), F.col(f"{a}_{m}_mean").alias("value")) for label, m in (("compile@1", "compile_at_1"), ("test@1", "test_at_1")) for a in arms]
    return runs.select("run_key", F.inline(F.array(*bars)))


def progression(runs: DataFrame, arm: str, order: list[str]) -> DataFrame:
    """(at, run_key, value) of metrics_by_run: an arm's test@1 over runs in a given order, from 0; other runs are left out."""
    at = F.array_position(F.array(*[F.lit(r) for r in order]), F.col("run_key"))
    return runs.filter(F.col("run_key").isin(*order)).select((at - 1).cast("int").alias("at"), "run_key", F.col(f"{arm}_test_at_1_mean").alias("value"))


def split_counts(tasks: DataFrame, *keys: str, split: str = "split", names: tuple[str, ...] = SPLITS) -> DataFrame:
    """Rows of each split by keys, zeros included; total_count is the sum of the named splits only."""
    wide = tasks.groupBy(*keys).agg(*[F.count_if(F.col(split) == s).alias(f"{s}_count") for s in names])
    total = F.lit(0)
    for s in names:
        total = total + F.col(f"{s}_count")
    return wide.withColumn("total_count", total.cast("long"))


def dataset_overview(tasks: DataFrame, gates: DataFrame, exports: DataFrame, generation: DataFrame) -> DataFrame:
    """One row for each dataset_version, with what side documents say about it, if anything.

    gates (dataset_version, all_pass), exports (dataset_version, language, split,
    rows), generation (dataset_version, added_tasks, families_added).
    """
    counts = split_counts(tasks, "dataset_version").drop("total_count")
    more = tasks.groupBy("dataset_version").agg(F.count("*").alias("total_tasks"), F.count_distinct(F.nullif("family", F.lit(""))).alias("family_count"))
    wide = exports.withColumn("c", F.concat_ws("_", F.lit("export"), "language", "split")).groupBy("dataset_version").pivot("c").agg(F.first("rows"))
    out = more.join(counts, "dataset_version").join(gates, "dataset_version", "left").join(generation.withColumn("families_added", F.array_join("families_added", ";")), "dataset_version", "left").join(wide, "dataset_version", "left")
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c not in ("dataset_version", "total_tasks", "family_count") and not c.endswith("_count") else F.col(c) for c in out.columns])


def zero_filled(counts: DataFrame, count: str, **domains: list[str]) -> DataFrame:
    """counts over the whole grid of the named domains, 0 where there is none."""
    grid = None
    for name, values in domains.items():
        column = F.explode(F.array(*[F.lit(v) for v in values])).alias(name)
        grid = counts.sparkSession.range(1).select(column) if grid is None else grid.select("*", column)
    return grid.join(counts, list(domains), "left").na.fill(0, [count])


def in_order(df: DataFrame, column: str, order: list[str], *more: str) -> DataFrame:
    """Sorted by a fixed order of a column's values; others come last."""
    return df.orderBy(fixed_order(column, order), *more)
