"""Task rows from templates over whole-number ranges."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import code_signature, strip, with_contract

# Each family's split, number of tasks, start of ids, prompt and code.  {id} is the task's name,
# {k} its number with three digits, {i} the number, {i+n} and {i*n} what they say.
TEMPLATES = {
    "arith_add_const": ("train", 30, "add_const", "# Add Constant\n\nImplement a function that adds {i} to an input `i32`.", "pub fn {id}(x: i32) -> i32 {\n    x + {i}\n}"),
    "arith_mul_const": ("train", 30, "mul_const", "# Multiply Constant\n\nImplement a function that multiplies an input `i32` by {i+1}.", "pub fn {id}(x: i32) -> i32 {\n    x * {i+1}\n}"),
    "option_some_const": ("train", 20, "option_some", "# Return Some Constant\n\nImplement a function that returns `Some({i+10})`.", "pub fn {id}() -> Option<i32> {\n    Some({i+10})\n}"),
    "option_map_add_const": ("train", 20, "option_map_add", "# Map Option Add\n\nImplement a function that adds {i} to an `Option<i32>` using `map`.", "pub fn {id}(input: Option<i32>) -> Option<i32> {\n    input.map(|n| n + {i})\n}"),
    "vec_push_const": ("train", 20, "vec_push", "# Push Value To Vec\n\nImplement a function that pushes {i*3} into a new vector and returns it.", "pub fn {id}() -> Vec<i32> {\n    let mut v = Vec::new();\n    v.push({i*3});\n    v\n}"),
    "vec_with_capacity": ("train", 20, "vec_capacity", "# Vec With Capacity\n\nImplement a function that returns a vector with capacity {i+5}.", "pub fn {id}() -> Vec<i32> {\n    Vec::with_capacity({i+5})\n}"),
    "helper_call_inc": ("train", 20, "helper_inc", "# Helper Call\n\nImplement a helper function and call it to add {i}.", "fn inc_{k}(x: i32) -> i32 {\n    x + {i}\n}\n\npub fn {id}(x: i32) -> i32 {\n    inc_{k}(x)\n}"),
    "result_ok_const": ("val", 20, "result_ok", "# Return Ok Constant\n\nImplement a function that returns `Ok({i+100})` with unit error type.", "pub fn {id}() -> Result<i32, ()> {\n    Ok({i+100})\n}"),
    "type_alias_result": ("val", 10, "alias_result", "# Result Type Alias\n\nDefine a generic result alias and return `Ok({i+200})`.", "type Alias{k}<T> = Result<T, ()>;\n\npub fn {id}() -> Alias{k}<i32> {\n    Ok({i+200})\n}"),
    "closure_shift_const": ("test", 10, "closure_shift", "# Closure Shift\n\nImplement a function using a closure that adds {i+2} to input.", "pub fn {id}(x: i32) -> i32 {\n    let f = |n| n + {i+2};\n    f(x)\n}"),
    "result_unwrap_or_const": ("test", 10, "result_unwrap_or", "# Result Unwrap Or\n\nImplement a function that unwraps `Result<i32, String>` or returns {i}.", "pub fn {id}(input: Result<i32, String>) -> i32 {\n    input.unwrap_or({i})\n}"),
    "vec_pop_basic": ("test", 10, "vec_pop", "# Pop From Vector\n\nImplement a function that pops from `vec![{i}, {i+1}, {i+2}]`.", "pub fn {id}() -> Option<i32> {\n    let mut v = vec![{i}, {i+1}, {i+2}];\n    v.pop()\n}"),
    "result_unwrap_or_train": ("train", 60, "result_unwrap_or_train", "# Result Unwrap Or (Train)\n\nImplement a function that takes `Result<i32, String>` and returns `input.unwrap_or({i})`.", "pub fn {id}(input: Result<i32, String>) -> i32 {\n    input.unwrap_or({i})\n}"),
    "vec_pop_train": ("train", 60, "vec_pop_train", "# Vec Pop (Train)\n\nImplement a function that pops from `vec![{i}, {i+1}, {i+2}]` and returns `Option<i32>`.", "pub fn {id}() -> Option<i32> {\n    let mut v = vec![{i}, {i+1}, {i+2}];\n    v.pop()\n}"),
    "option_unwrap_or_train": ("train", 40, "option_unwrap_or_train", "# Option Unwrap Or (Train)\n\nImplement a function that takes `Option<i32>` and returns `input.unwrap_or({i+2})`.", "pub fn {id}(input: Option<i32>) -> i32 {\n    input.unwrap_or({i+2})\n}"),
}
ADDED_FAMILIES = ("result_unwrap_or_train", "vec_pop_train", "option_unwrap_or_train")
FAMILIES = tuple(f for f in TEMPLATES if f not in ADDED_FAMILIES)
_SLOT = re.compile(r"\{(id|k|i)(?:([+*])(\d+))?\}")


def task_id(family: Column, number: Column, width: int = 3) -> Column:
    return F.concat_ws("_", family, F.lpad(number.cast("string"), width, "0"))


def filled(template: str, name: Column, number: Column) -> Column:
    """A template with its slots filled for a task."""
    parts, at = [], 0
    for slot in _SLOT.finditer(template):
        value = {"id": name, "k": F.lpad(number.cast("string"), 3, "0"), "i": number}[slot[1]]
        if slot[2]:
            value = value + int(slot[3]) if slot[2] == "+" else value * int(slot[3])
        parts += [F.lit(template[at : slot.start()]), value.cast("string")]
        at = slot.end()
    return F.concat(*parts, F.lit(template[at:]))


def template_columns(family: Column, name: Column, number: Column) -> tuple[Column, Column]:
    """(prompt, code) of a task by its family; null for a family without a template."""
    prompt = code = F.lit(None).cast("string")
    for f, (*_, p, c) in TEMPLATES.items():
        prompt = F.when(family == f, filled(p, name, number)).otherwise(prompt)
        code = F.when(family == f, filled(c, name, number)).otherwise(code)
    return prompt, code


def task_grid(spark: SparkSession, families: tuple[str, ...] = FAMILIES) -> DataFrame:
    """Tasks 1 to n of each family: (id, family, split, number, prompt_path, rust_path, deps, unsafe, prompt, code)."""
    dim = spark.createDataFrame([(f, *TEMPLATES[f][:3]) for f in families], "family string, split string, n int, prefix string")
    grid = dim.select("family", "split", "prefix", F.explode(F.sequence(F.lit(1), "n")).alias("number"))
    named = grid.withColumn("id", task_id(F.col("prefix"), F.col("number")))
    prompt, code = template_columns(F.col("family"), F.col("id"), F.col("number"))
    return named.select(
        "id", "family", "split", "number",
        F.concat(F.lit("prompts/"), "id", F.lit(".md")).alias("prompt_path"), F.concat(F.lit("rust/"), "id", F.lit(".rs")).alias("rust_path"),
        F.expr("cast(array() as array<string>)").alias("deps"), F.lit(False).alias("unsafe"), prompt.alias("prompt"), code.alias("code"),
    )


def manifest_rows(tasks: DataFrame) -> DataFrame:
    """(value): the manifest's JSON rows, without prompt and code."""
    return tasks.select(F.to_json(F.struct("id", "split", "family", "prompt_path", "rust_path", "deps", "unsafe")).alias("value"))


def task_files(tasks: DataFrame) -> DataFrame:
    """(path, value): the prompt, with its contract, and the solution of each task, to be written as files or kept as rows."""
    prompt = with_contract(F.col("prompt"), code_signature(F.col("code"), F.col("id")))
    files = F.array(F.struct(F.col("prompt_path").alias("path"), F.concat(prompt, F.lit("\n")).alias("value")), F.struct(F.col("rust_path").alias("path"), F.concat(strip(F.col("code")), F.lit("\n")).alias("value")))
    return tasks.select(F.inline(files))


def generation_summary(tasks: DataFrame, source: str, added: tuple[str, ...] = ADDED_FAMILIES) -> DataFrame:
    """One row (base_source, total_tasks, added_tasks, families_added)."""
    is_added = F.col("family").isin(*added)
    return tasks.agg(F.lit(source).alias("base_source"), F.count("*").alias("total_tasks"), F.count_if(is_added).alias("added_tasks")).withColumn("families_added", F.array(*[F.lit(f) for f in added]))


def extend(base: DataFrame, added: DataFrame) -> DataFrame:
    """All tasks of both; raises if an id comes twice."""
    both = base.unionByName(added)
    twice = both.groupBy("id").count().filter("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids come more than once: {[r['id'] for r in twice]}")
    return both
