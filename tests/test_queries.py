import pytest
from pyspark.sql import functions as F

from tessera.plans.queries import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, sf_dir, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, sf_dir), SQL[name])


def test_entry_lists_the_same_names():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["seed", "delta_compile_at_1", "delta_test_at_1"]


@pytest.fixture
def long_numbers(spark, tmp_path):
    """Parts whose numbers have more digits than an id, so that some tasks share one; (folder, tables)."""
    numbers = spark.range(100_000, 100_030).union(spark.range(1_000_000, 1_000_300))
    numbers.select(F.col("id").alias("p_partkey"), F.concat(F.lit("Brand#"), F.col("id") % 25).alias("p_brand")).write.parquet(str(tmp_path / "part.parquet"))
    return str(tmp_path), {"part": spark.read.parquet(str(tmp_path / "part.parquet"))}


def test_tasks_that_share_an_id_expect_the_same(spark, same_as_sql, long_numbers):
    folder, tables = long_numbers
    found = QUERIES["task_functions"](spark, folder)
    assert tables["part"].count() < found.filter("coalesce(pos, 0) = 0").count()
    same_as_sql(found, SQL["task_functions"], tables)


def test_tasks_that_share_an_id_have_their_own_files(spark, same_as_sql, long_numbers):
    folder, tables = long_numbers
    same_as_sql(QUERIES["written_tasks"](spark, folder), SQL["written_tasks"], tables)
