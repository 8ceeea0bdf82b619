"""What the registered queries share: the driver's tables as results and tasks, and the SQL of the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import taskgen


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as evaluation results: the flags follow from the value, the arm from the user, the seed is the day."""
    v = F.col("value")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("event_type").alias("family"), F.when(F.col("user_id") % 2 == 0, "base").otherwise("wordy").alias("arm"),
        F.to_date("ts").cast("string").alias("seed"), (v >= 5).alias("transform_ok"), (v >= 15).alias("compile_ok"), (v >= 30).alias("test_ok"),
        F.when(v < 2, "Error: Parse error: UnexpectedToken").when(v < 5, "Error: Oxidation failed: x").otherwise("").alias("transform_error"),
        F.when(v < 8, "error: cannot find value").when(v < 15, "error: mismatched types").otherwise("").alias("compile_error"),
        F.when(v < 22, "assertion failed: left == right").when(v < 30, "this function takes 1 argument").otherwise("").alias("test_error"),
    )


RESULTS_SQL = """results AS (
  SELECT event_id AS id, event_type AS family, CASE WHEN user_id % 2 = 0 THEN 'base' ELSE 'wordy' END AS arm,
    strftime(ts, '%Y-%m-%d') AS seed, value >= 5 AS transform_ok, value >= 15 AS compile_ok, value >= 30 AS test_ok, value AS v
  FROM events
), failed AS (
  SELECT *, CASE WHEN NOT transform_ok THEN 'transform' WHEN NOT compile_ok THEN 'compile' ELSE 'test' END AS failure_phase,
    CASE WHEN v < 2 THEN 'wordy_parse_error' WHEN v < 5 THEN 'conversion_error' WHEN v < 8 THEN 'name_resolution' WHEN v < 15 THEN 'type_mismatch'
         WHEN v < 22 THEN 'behavior_assertion' ELSE 'wrong_signature_or_call' END AS failure_class
  FROM results WHERE NOT (transform_ok AND compile_ok AND test_ok)
)"""


def task_keys(spark, d):
    """The family, number and id of a task for each part; ids have six digits, so that longer numbers can share one."""
    family = F.element_at(F.array(*[F.lit(f) for f in taskgen.TEMPLATES]), (F.col("p_partkey") % len(taskgen.TEMPLATES) + 1).cast("int"))
    return table(spark, d, "part").select(family.alias("family"), F.col("p_partkey").alias("number"), "p_brand").withColumn("id", taskgen.task_id(F.col("family"), F.col("number"), 6))


def with_templates(keys):
    prompt, code = taskgen.template_columns(F.col("family"), F.col("id"), F.col("number"))
    return keys.withColumns({"prompt": prompt, "code": code})


def tasks(spark, d):
    """A task for each part: the family and the number from its key; parts are small, so they are dealt out before the texts are made."""
    return with_templates(task_keys(spark, d).repartition("number"))


RATES = "count(*) FILTER (transform_ok) / count(*)::DOUBLE AS tr, count(*) FILTER (compile_ok) / count(*)::DOUBLE AS co, count(*) FILTER (test_ok) / count(*)::DOUBLE AS te"
RESERVED = ", ".join(f"'{w}'" for w in T.RESERVED_WORDS)
KEYWORDS = ", ".join(f"'{w}'" for w in T.KEYWORDS)
COLLAPSED = r"trim(regexp_replace(text, '[\t\n\x0B\f\r\x{85}\p{Z}]+', ' ', 'g'))"
_TEMPLATES_SQL = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in (f, t[3], t[4])) + f", {n})" for n, (f, t) in enumerate(taskgen.TEMPLATES.items()))


def _fill(column: str) -> str:
    """The SQL that puts a task's values into a template."""
    for slot, value in [("{id}", "id"), ("{k}", "lpad(number::VARCHAR, 3, '0')"), ("{i}", "number::VARCHAR"), ("{i*3}", "(number * 3)::VARCHAR"), *[(f"{{i+{n}}}", f"(number + {n})::VARCHAR") for n in (1, 2, 5, 10, 100, 200)]]:
        column = f"replace({column}, '{slot}', {value})"
    return column


TASKS_SQL = f"""tasks AS (
  SELECT family, number, p_brand, id, {_fill("prompt")} AS prompt, {_fill("code")} AS code,
    regexp_extract({_fill("code")}, 'pub fn [^{{]*[^{{ ]') AS signature
  FROM (SELECT t.family, p_partkey AS number, p_brand, t.family || '_' || lpad(p_partkey::VARCHAR, 6, '0') AS id, t.prompt, t.code
        FROM part JOIN (VALUES {_TEMPLATES_SQL}) t(family, prompt, code, n) ON p_partkey % {len(taskgen.TEMPLATES)} = t.n)
)"""
