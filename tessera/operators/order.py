"""Places in a global order, so that sinks can keep it and queries can show it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.scratch import scratch_folder


def with_place(df: DataFrame, *order: str | Column, place: str = "place") -> DataFrame:
    """df with the place of each row, from 1, in an order that leaves no ties.

    Rows go to range partitions, written once; each is numbered by itself, and the
    counts of those before it, one row for each partition, are added.
    """
    folder = scratch_folder(df.sparkSession, "places")
    ranged = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    ranged.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order))).write.parquet(folder)
    numbered = df.sparkSession.read.parquet(folder)
    counts = numbered.groupBy(F.col("_part").alias("_at")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = numbered.join(counts.select("_at", before.alias("_before")), F.col("_part") == F.col("_at"))
    return found.select(*df.columns, (F.col("_own") + F.col("_before")).cast("long").alias(place))


def fixed_order(column: str, values: list[str]) -> Column:
    """A sort key by a fixed order of values; others, null too, come last."""
    at = F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), F.col(column)), F.lit(0))
    return F.when(at == 0, F.lit(len(values) + 1)).otherwise(at)
