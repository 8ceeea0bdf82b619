"""Intermediate tables in the folder that driver and executors share.

A job that reads an intermediate result more than once, or that must not compute
it twice with different outcomes, writes it here.  The files survive the loss of
executors and cut the lineage.  The folder is the one the cluster names in
``spark.checkpoint.dir``; where that is unset, a session with a local master gets a
temporary one, and any other is refused.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The application's own folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def write_table(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet under the shared folder and return it reread."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _table_prefix(spark: SparkSession) -> str:
    return "work_" + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower() + "_"


def write_buckets(df: DataFrame, name: str, buckets: int, key: str) -> DataFrame:
    """As write_table, in buckets by key; the catalog entry goes with drop_work_tables."""
    table = f"{_table_prefix(df.sparkSession)}{name}_{uuid.uuid4().hex[:12]}"
    df.write.option("compression", "none").option("path", f"{work_dir(df.sparkSession)}/{table}").bucketBy(buckets, key).saveAsTable(table)
    return df.sparkSession.table(table)


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as it takes to be none of df's columns."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def drop_work_tables(spark: SparkSession) -> None:
    """Delete all of this application's intermediate tables."""
    for table in spark.catalog.listTables(pattern=_table_prefix(spark) + "*"):
        spark.sql(f"DROP TABLE IF EXISTS `{table.name}`")
    path = spark._jvm.org.apache.hadoop.fs.Path(work_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
