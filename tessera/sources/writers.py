"""Sinks: text, reports, flat tables and rows by split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPLITS = ("train", "val", "test")


def write_texts(df: DataFrame, text: str, path: str) -> None:
    df.select(F.col(text).alias("value")).write.mode("overwrite").text(path)


def write_csv_table(df: DataFrame, columns: list[str], path: str) -> None:
    """A report table with a header, its columns in order, as one file: it has a row for each group of a report."""
    df.select(*columns).coalesce(1).write.mode("overwrite").csv(path, header=True)


def write_chat_rows(df: DataFrame, path: str) -> None:
    """JSON rows in folders by split and language, in one pass; every split has a folder, rows of other splits are left out."""
    df.filter(F.col("split").isin(*SPLITS)).write.mode("overwrite").partitionBy("split", "language").json(path)
    hadoop = df.sparkSession._jvm.org.apache.hadoop.fs.Path
    for split in SPLITS:  # a split without rows has an empty folder
        folder = hadoop(f"{path}/split={split}")
        folder.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).mkdirs(folder)


def write_in_order(df: DataFrame, path: str, *order: str) -> None:
    """JSON rows sorted as a whole: the files' names follow the order of their rows."""
    df.orderBy(*order).write.mode("overwrite").json(path)


def export_summary(df: DataFrame) -> DataFrame:
    """(language, split, rows) for every language, null too, and known split, zeros included."""
    counts = df.groupBy("language").agg(*[F.count_if(F.col("split") == s).alias(s) for s in SPLITS])
    return counts.select("language", F.inline(F.array(*[F.struct(F.lit(s).alias("split"), F.col(s).alias("rows")) for s in SPLITS])))


def json_report(df: DataFrame, *fields: Column | str) -> DataFrame:
    """(value): each row as one JSON document."""
    return df.select(F.to_json(F.struct(*fields)).alias("value"))


def counts_as_map(df: DataFrame, keys: list[str], name: str, count: str) -> DataFrame:
    """One row for each of keys, with `name -> count` as a map; for documents, not for further work."""
    return df.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(name, count)))).alias("counts"))


def console_lines(df: DataFrame, pattern: str, *columns: str) -> DataFrame:
    """(line): formatted report lines, as in `%-20s %.3f`."""
    return df.select(F.format_string(pattern, *columns).alias("line"))
