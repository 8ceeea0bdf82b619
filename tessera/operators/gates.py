"""Validation of task manifests, split hygiene and quality gates."""

from __future__ import annotations

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from tessera.functions.text import safe_ratio, strip
from tessera.sources.writers import SPLITS

FIELDS = ("id", "split", "family", "prompt_path", "rust_path", "tests_path")


def _kind(fields: Column, field: str) -> Column:
    """The type of a field: null if absent, VOID if it is an explicit null."""
    return F.when(F.map_contains_key(fields, field), F.coalesce(F.schema_of_variant(F.try_element_at(fields, F.lit(field))), F.lit("VOID")))


def record_errors(fields: Column) -> Column:
    """All the rules that a manifest record, a map of its fields as VARIANTs, breaks; absent and null fields differ."""

    def text(field: str) -> Column:
        return F.when(_kind(fields, field) == "STRING", F.try_variant_get(F.try_element_at(fields, F.lit(field)), "$", "string"))

    def rule(ok: Column, message: str) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(message))

    deps, unsafe, tests = _kind(fields, "deps"), _kind(fields, "unsafe"), _kind(fields, "tests_path")
    filled = [rule(text(f) != "", f"'{f}' must be a non-empty string") for f in ("id", "family", "prompt_path", "rust_path")]
    found = F.array(
        filled[0],
        rule(text("split").isin(*SPLITS), "'split' must be one of ['test', 'train', 'val']"),
        *filled[1:],
        rule(tests.isNull() | tests.isin("VOID", "STRING"), "'tests_path' must be a string when present"),
        rule(deps.isNull() | deps.isin("ARRAY<STRING>", "ARRAY<VOID>") & F.coalesce(~_has_null(F.try_element_at(fields, F.lit("deps"))), F.lit(True)), "'deps' must be a string list"),
        rule(unsafe.isNull() | (unsafe == "BOOLEAN"), "'unsafe' must be boolean"),
    )
    return F.filter(found, lambda x: x.isNotNull())


def _has_null(value: Column) -> Column:
    return F.exists(F.try_variant_get(value, "$", "array<string>"), lambda x: x.isNull())


def parse_manifest(lines: DataFrame, seen: Observation | None = None) -> DataFrame:
    """Manifest lines (line, value) with their record's fields and errors, each as `line N: ...`.

    Blank lines are left out but counted.  A record without errors whose id an
    earlier one had is an error; only rows with no errors are tasks.  `seen` observes
    the number of records, and of those with errors of their own, in the same pass.
    """
    parsed = lines.withColumn("value", strip(F.col("value"))).filter("value <> ''").withColumn("doc", F.try_parse_json("value"))
    parsed = parsed.withColumn("fields", F.try_variant_get("doc", "$", "map<string,variant>"))  # null if it is no object
    errors = F.when(F.col("doc").isNull(), F.array(F.lit("invalid JSON"))).when(F.col("fields").isNull(), F.array(F.lit("each JSONL record must be an object"))).otherwise(record_errors(F.col("fields")))
    checked = parsed.withColumn("errors", errors)
    fields = [F.when(F.size("errors") == 0, F.try_variant_get("doc", f"$.{f}", "string")).alias(f) for f in FIELDS]
    rows = checked.select("line", "errors", *fields, F.coalesce(F.try_variant_get("doc", "$.deps", "array<string>"), F.expr("cast(array() as array<string>)")).alias("deps"), F.coalesce(F.try_variant_get("doc", "$.unsafe", "boolean"), F.lit(False)).alias("unsafe"))
    if seen is not None:
        rows = rows.observe(seen, F.count("*").alias("records"), F.count_if(F.size("errors") > 0).alias("with_errors"))
    # Rows without an id are no group: each goes by its line.
    same = Window.partitionBy("id", F.when(F.col("id").isNull(), F.col("line"))).orderBy("line")
    again = (F.row_number().over(same) > 1) & F.col("id").isNotNull()
    rows = rows.withColumn("errors", F.when(again, F.array(F.concat(F.lit("duplicate id '"), "id", F.lit("'")))).otherwise(F.col("errors")))
    numbered = F.transform("errors", lambda e: F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), e))
    return rows.withColumn("errors", numbered)


NO_RECORDS = "manifest contains no task records"


def observed(seen: Observation) -> dict[str, int]:
    """What parse_manifest has observed; zeros where Spark, at run time, left the observing node out because no line came to it."""
    try:
        return seen.get
    except Py4JJavaError:
        return {"records": 0, "with_errors": 0}


def manifest_problems(seen: Observation) -> list[str]:
    """Errors of the manifest as a whole, after an action on the rows that were observed while they were parsed."""
    figures = observed(seen)
    return [] if figures["records"] > figures["with_errors"] else [NO_RECORDS]


def policy_errors(tasks: DataFrame, allow_deps: bool = False, allow_unsafe: bool = False) -> DataFrame:
    """tasks with the errors of dependencies and unsafe code, where these are not allowed."""
    found = F.array(
        F.when((F.size("deps") > 0) & ~F.lit(allow_deps), F.lit("task declares dependencies")),
        F.when(F.col("unsafe") & ~F.lit(allow_unsafe), F.lit("task is marked unsafe")),
    )
    return tasks.withColumn("errors", F.concat("errors", F.filter(found, lambda x: x.isNotNull())))


def missing_files(tasks: DataFrame, path: str, files: DataFrame) -> DataFrame:
    """Tasks whose file is not among files (path)."""
    return tasks.filter(F.col(path).isNotNull()).join(files.select(F.col("path").alias(path)), path, "left_anti")


def first_by_key(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def split_hygiene(tasks: DataFrame, family: str, split: str) -> DataFrame:
    """(family, splits): families in more than one split, the splits sorted and joined."""
    sets = tasks.groupBy(family).agg(F.array_sort(F.collect_set(split)).alias("splits"))
    return sets.filter(F.size("splits") > 1).select(family, F.array_join("splits", ", ").alias("splits"))


def gate_report(results: DataFrame, split_errors: DataFrame, purity_threshold: float) -> DataFrame:
    """One row: counts, purity and gates of task results.

    results: family, used_verbatim, reduce_ok, reduce_deterministic, restore_ok,
    roundtrip_compile_ok, errors.  A task whose conversion failed has no verbatim
    item and so counts as pure.
    """
    stats = results.agg(
        F.count("*").alias("total_tasks"),
        F.count_if(F.size("errors") > 0).alias("tasks_with_errors"),
        F.count_if(F.col("reduce_ok") & F.col("restore_ok")).alias("stable_count"),
        F.count_if("reduce_deterministic").alias("deterministic_count"),
        F.count_if("roundtrip_compile_ok").alias("compile_count"),
        F.count_if(~F.coalesce("used_verbatim", F.lit(False))).alias("non_verbatim_count"),
        F.count_distinct("family").alias("families"),
    ).withColumn("purity_ratio", safe_ratio(F.col("non_verbatim_count"), F.col("total_tasks")))
    with_splits = stats.crossJoin(split_errors.agg(F.count("*").alias("split_errors")))  # one row each
    gates = {
        "gate_pipeline_stability": F.col("stable_count") == F.col("total_tasks"),
        "gate_determinism": F.col("deterministic_count") == F.col("total_tasks"),
        "gate_data_quality": F.col("compile_count") == F.col("total_tasks"),
        "gate_purity": F.col("purity_ratio") >= purity_threshold,
        "gate_split_hygiene": F.col("split_errors") == 0,
    }
    every = F.lit(True)
    for g in gates.values():
        every = every & g
    return with_splits.withColumns(gates | {"all_pass": every})
