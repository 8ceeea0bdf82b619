"""Report documents, run tables and console lines of evaluations and gates.

A document has one row for each report and holds counts only; the rows that it
counts stay a table of their own (`result_rows`, `failures`), which may be of any
size.  Maps in documents have one entry for each family or class.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.classify import evaluation_class, failure_phase
from tessera.functions.text import round6, safe_ratio
from tessera.operators.aggregate import mean_std, report_taxonomy
from tessera.operators.score import FLAGS, failures, histogram, pass_counts, top_per_group

RATES = ("compile_at_1", "test_at_1", "transform_rate")


def _three(value: Column | str) -> Column:
    """Three decimals, ties to even, for printing."""
    return F.bround(value, 3)


def _as_map(counts: DataFrame, keys: list[str], name: str, value: Column, alias: str) -> DataFrame:
    return counts.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(name), value.alias("value"))))).alias(alias))


def _cells(results: DataFrame, at: list[str], *more: Column) -> DataFrame:
    """Counts by at, family, failure phase and class (both null where nothing failed), with more aggregates."""
    phase, message = failure_phase(*[F.col(f) for f in FLAGS]), F.coalesce(*[F.when(F.col("failure_phase") == f[:-3], F.col(f"{f[:-3]}_error")) for f in FLAGS], F.lit(""))
    known = results.withColumn("failure_phase", phase)
    known = known.withColumn("failure_class", F.when(F.col("failure_phase").isNotNull(), evaluation_class(message, F.col("failure_phase"))))
    passed = [F.count_if(f).alias(n) for f, n in zip(FLAGS, ("transform", "compile", "test"), strict=True)]
    return known.groupBy(*at, "family", "failure_phase", "failure_class").agg(F.count("*").alias("total"), *passed, *more)


def _reports(cells: DataFrame, at: list[str], *more: Column) -> DataFrame:
    """One row for each of at, with more aggregates; the maps come from the cells' list, which has few entries."""
    totals = [F.sum("total").alias("total"), *[F.sum(n).alias(f"{n}_pass") for n in ("transform", "compile", "test")]]
    entry = F.struct("family", "failure_phase", "failure_class", "total", "compile", "test")
    found = cells.groupBy(*at).agg(*totals, F.collect_list(entry).alias("_cells"), *more)

    def counted(name: str, value, cells: Column) -> Column:
        names = F.array_sort(F.array_distinct(F.transform(cells, lambda c: c[name])))
        return F.map_from_arrays(names, F.transform(names, lambda n: value(F.filter(cells, lambda c: c[name].eqNullSafe(n)))))

    def total(of: str):
        return lambda cells: F.aggregate(cells, F.lit(0).cast("long"), lambda n, c: n + c[of])

    family = lambda cells: F.struct(*[total(n)(cells).alias(n) for n in ("total", "compile", "test")])
    failed = F.filter("_cells", lambda c: c["failure_phase"].isNotNull())
    return found.withColumns({
        **{n: safe_ratio(F.col(p), F.col("total")) for n, p in (("transform_rate", "transform_pass"), ("compile_at_1", "compile_pass"), ("test_at_1", "test_pass"))},
        "per_family": counted("family", family, F.col("_cells")),
        "failure_phase_counts": counted("failure_phase", total("total"), failed),
        "failure_taxonomy": counted("failure_class", total("total"), failed),
    }).drop("_cells")


def arm_reports(results: DataFrame, *keys: str) -> DataFrame:
    """One row for each of keys and arm: passes, rates, and counts by family, failure phase and class as maps."""
    at = [*keys, "arm"]
    return _reports(_cells(results, at), at)


def seed_documents(results: DataFrame, first: str, second: str, *keys: str) -> DataFrame:
    """(keys, first, second): the report of each seed with both arms as structs; an arm without results is null."""
    reports = arm_reports(results, *keys)
    body = F.struct(*[c for c in reports.columns if c not in keys])
    return reports.groupBy(*keys).pivot("arm", [first, second]).agg(F.first(body))


def documents_with_rows(results: DataFrame, first: str, second: str, *keys: str) -> DataFrame:
    """(keys, first, second) as in seed_documents, each arm with its result rows too, by id.

    All rows of a key and arm are in one document, so keys must be such that these are few.
    """
    at = [*keys, "arm"]
    row = F.struct("id", "family", "arm", *[c for f in ("transform", "compile", "test") for c in (f"{f}_ok", f"{f}_error")])
    # Dealt out by key once; no later step has to move rows again.
    cells = _cells(results.repartition(*keys), at, F.collect_list(row).alias("rows"))
    reports = _reports(cells, at, F.sort_array(F.flatten(F.collect_list("rows"))).alias("rows"))
    reports = reports.select(*[c for c in reports.columns if c != "rows"], "rows")
    body = F.struct(*[c for c in reports.columns if c not in keys])
    return reports.groupBy(*keys).pivot("arm", [first, second]).agg(F.first(body))


def document_files(documents: DataFrame, path: Column) -> DataFrame:
    """(path, value): each document as the JSON text of a file of its own."""
    return documents.select(path.alias("path"), F.to_json(F.struct("*")).alias("value"))


def aggregate_documents(results: DataFrame, seed: str, first: str, second: str, *keys: str) -> DataFrame:
    """One row for each of keys: num_reports, summary and error taxonomy by arm, and second minus first."""
    rates = pass_counts(results, *keys, "arm", seed)
    stats = mean_std(rates, [*keys, "arm"], *RATES)
    classes = _as_map(report_taxonomy(results, *keys, "arm"), [*keys, "arm"], "failure_class", F.col("count"), "classes")
    stats = stats.join(classes, [*keys, "arm"], "left")
    arm = F.struct(*[F.struct(F.col(f"{m}_mean").alias("mean"), F.col(f"{m}_std").alias("std")).alias(m) for m in RATES])
    wide = stats.groupBy(*keys).pivot("arm", [first, second]).agg(F.first(arm).alias("summary"), F.first("classes").alias("classes"))
    reports = results.groupBy(*keys).agg(F.count_distinct(seed).alias("num_reports"))
    delta = [(F.col(f"{second}_summary")[m]["mean"] - F.col(f"{first}_summary")[m]["mean"]).alias(f"{m}_mean") for m in RATES[:2]]
    return reports.join(wide, list(keys)).select(
        *keys, "num_reports",
        F.struct(*[F.col(f"{a}_summary").alias(a) for a in (first, second)]).alias("summary"),
        F.struct(*[F.col(f"{a}_classes").alias(a) for a in (first, second)]).alias("error_taxonomy"),
        F.struct(*delta).alias("delta"),
    )


def run_specs(spark: SparkSession, specs: list[tuple[str, str, str, str]]) -> DataFrame:
    """The dimension of runs: (run_key, run_label, kind, report_path), kind aggregate or seed."""
    return spark.createDataFrame(specs, "run_key string, run_label string, kind string, report_path string")


def run_rows(specs: DataFrame, aggregates: DataFrame, seeds: DataFrame, first: str, second: str) -> DataFrame:
    """One flat row for each run whose report exists: means and deviations of both arms, and second minus first.

    aggregates and seeds are documents with a report_path.  A seed document has
    deviations of 0 and counts as one report; figures have six decimals.
    """

    def row(docs: DataFrame, count: Column, mean, std, delta) -> DataFrame:
        joined = specs.join(docs, "report_path")  # the specs are few, so they are broadcast
        cells = [round6(f(a, m)).alias(f"{a}_{m}_{n}") for a in (first, second) for m in RATES for n, f in (("mean", mean), ("std", std))]
        return joined.select("run_key", "run_label", "report_path", count.cast("int").alias("num_reports"), *cells, *[round6(delta(m)).alias(f"delta_{m[: m.index('_')]}") for m in RATES[:2]])

    def of_seed(arm: str, measure: str) -> Column:
        return safe_ratio(F.col(arm)["transform_pass"], F.col(arm)["total"]) if measure == "transform_rate" else F.col(arm)[measure]

    whole = row(
        aggregates, F.coalesce("num_reports", F.lit(1)), lambda a, m: F.col("summary")[a][m]["mean"], lambda a, m: F.coalesce(F.col("summary")[a][m]["std"], F.lit(0.0)),
        lambda m: F.col("delta")[f"{m}_mean"],
    )
    single = row(seeds, F.lit(1), of_seed, lambda a, m: F.lit(0.0), lambda m: of_seed(second, m) - of_seed(first, m))
    return whole.unionByName(single)


def top_classes(results: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k most frequent failure classes by keys, ties by name."""
    return top_per_group(histogram(failures(results), *keys, "failure_class"), list(keys), "failure_class", "count", k)


def summary_lines(results: DataFrame, *keys: str) -> DataFrame:
    """(keys, arm, part, line): the console summary of each seed; in the order of part and line it is the printed text."""
    at = [*keys, "arm"]
    counts = pass_counts(results, *at)
    head = F.array(
        F.format_string("- total: %d", "total"),
        F.format_string("- transform pass: %d/%d", "transform_pass", "total"),
        F.format_string("- compile@1: %d/%d = %.3f", "compile_pass", "total", _three("compile_at_1")),
        F.format_string("- test@1: %d/%d = %.3f", "test_pass", "total", _three("test_at_1")),
    )
    parts = counts.select(*at, F.posexplode(head).alias("part", "line"))
    families = pass_counts(results, *at, "family").select(*at, F.lit(10).alias("part"), F.format_string("  - %s: compile %d/%d, test %d/%d", "family", "compile_pass", "total", "test_pass", "total").alias("line"))
    top = top_classes(results, 5, *at).select(*at, (F.lit(20) + F.col("rank")).alias("part"), F.format_string("  - %s: %d", "failure_class", "count").alias("line"))
    best = top_classes(results, 3, *at, "family").groupBy(*at, "family").agg(F.sort_array(F.collect_list(F.struct("rank", F.format_string("%s=%d", "failure_class", "count").alias("s")))).alias("c"))
    by_family = best.select(*at, F.lit(30).alias("part"), F.concat(F.lit("  - "), "family", F.lit(": "), F.array_join(F.col("c.s"), ", ")).alias("line"))
    return parts.unionByName(families).unionByName(top).unionByName(by_family)


def aggregate_lines(documents: DataFrame, first: str, second: str, *keys: str) -> DataFrame:
    """(keys, part, line): mean and deviation of each arm and the differences, for the console."""
    lines = [F.format_string("Reports aggregated: %d", "num_reports")]
    for arm in (first, second):
        cell = lambda m, n, a=arm: _three(F.col("summary")[a][m][n])
        lines += [F.format_string(f"{arm}: {label} mean±std: %.3f ± %.3f", cell(m, "mean"), cell(m, "std")) for m, label in zip(RATES, ("compile@1", "test@1", "transform"), strict=True)]
    lines += [F.format_string(f"{label} mean delta: %+.3f", _three(F.col("delta")[f"{m}_mean"])) for m, label in zip(RATES, ("compile@1", "test@1"))]
    return documents.select(*keys, F.posexplode(F.array(*lines)).alias("part", "line"))


GATES = (
    ("Pipeline stability", "gate_pipeline_stability"), ("Determinism", "gate_determinism"), ("Data quality", "gate_data_quality"),
    ("Purity", "gate_purity"), ("Split hygiene", "gate_split_hygiene"), ("Overall", "all_pass"),
)


def gate_lines(report: DataFrame, purity_threshold: float) -> DataFrame:
    """(part, line): PASS or FAIL of each gate of a one-row report; the purity line shows the ratio."""

    def line(name: str, gate: str) -> Column:
        said = F.concat(F.lit(f"- {name}: "), F.when(F.col(gate), "PASS").otherwise("FAIL"))
        if gate != "gate_purity":
            return said
        return F.concat(said, F.format_string(" (%.3f %s %.3f)", _three("purity_ratio"), F.when(F.col(gate), ">=").otherwise("<"), F.lit(purity_threshold)))

    return report.select(F.posexplode(F.array(*[line(n, g) for n, g in GATES])).alias("part", "line"))


def gate_documents(report: DataFrame, split_errors: DataFrame, results: DataFrame) -> DataFrame:
    """(kind, value): JSON rows, one for the gates and their figures, one for each split error and each task.

    The tasks are not gathered into one document, so that there may be any number.
    """
    head = report.select(F.lit("gates").alias("kind"), F.to_json(F.struct("*")).alias("value"))
    splits = split_errors.select(F.lit("split_error").alias("kind"), F.to_json(F.struct("*")).alias("value"))
    return head.unionByName(splits).unionByName(results.select(F.lit("task").alias("kind"), F.to_json(F.struct("*")).alias("value")))


def at_least(df: DataFrame, condition: Column, n: int = 1) -> DataFrame:
    """One row (successes, enough): how many rows meet the condition, and whether n do."""
    return df.agg(F.count_if(condition).alias("successes")).withColumn("enough", F.col("successes") >= n)


def settings_document(spark: SparkSession, **settings: object) -> DataFrame:
    """(value): the paths and settings of a run as one JSON document."""
    return spark.range(1).select(F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in settings.items()])).alias("value"))
