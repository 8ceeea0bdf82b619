"""Scans of manifests, chat rows, predictions, reports and source files."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import strip

MESSAGE = "struct<role:string,content:string>"
CHAT_SCHEMA = f"id string, family string, split string, language string, source string, conversations array<{MESSAGE}>"
PREDICTION_SCHEMA = "id string, family string, split string, arm string, prompt string, prediction string, generation_attempts bigint, used_repair boolean"
RESULT = "struct<id:string,family:string,arm:string,transform_ok:boolean,compile_ok:boolean,test_ok:boolean,transform_error:string,compile_error:string,test_error:string>"
FAMILY_COUNTS = "struct<total:bigint,compile:bigint,test:bigint>"
ARM = (
    "struct<arm:string,total:bigint,transform_pass:bigint,compile_pass:bigint,test_pass:bigint,compile_at_1:double,test_at_1:double,"
    f"per_family:map<string,{FAMILY_COUNTS}>,failure_phase_counts:map<string,bigint>,failure_taxonomy:map<string,bigint>,rows:array<{RESULT}>>"
)
MEAN_STD = "struct<mean:double,std:double>"


def whole_files(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, value): each file as one row."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line, value): the lines of files, counted from 1 in each.

    Lines are numbered within the byte ranges that tasks read, and the ranges'
    totals are added up, so that no task holds a whole file.
    """
    read = spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("at"))
    ranges = read.groupBy("path", "start").agg(F.count("*").alias("n"))
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("path", "start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = read.withColumn("k", F.row_number().over(Window.partitionBy("path", "start").orderBy("at")))
    return local.join(ranges, ["path", "start"]).select("path", (F.col("before") + F.col("k")).alias("line"), "value")


def json_lines(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """JSON rows, one on each line; blank lines are skipped and bad ones raise."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(list(paths))


def json_documents(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """Files of one JSON document each, with their path.

    The schema is explicit, so that keys that are data become map keys.
    """
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(list(paths)).withColumn("path", F.col("_metadata.file_path"))


def report_schema(*arms: str) -> str:
    return "inputs map<string,string>, " + ", ".join(f"`{a}` {ARM}" for a in arms)


def existing(spark: SparkSession, *paths: str) -> list[str]:
    """The paths that exist, in order, without repeats."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    return [p for p in dict.fromkeys(paths) if hadoop(p).getFileSystem(conf).exists(hadoop(p))]


def first_complete(spark: SparkSession, candidates: list[str], files: list[str]) -> str:
    """The first folder that has all the files."""
    for folder in dict.fromkeys(candidates):
        if len(existing(spark, *[f"{folder}/{f}" for f in files])) == len(set(files)):
            return folder
    raise FileNotFoundError(f"no folder has all of {files}: {candidates}")


def optional_documents(spark: SparkSession, schema: str, *paths: str) -> DataFrame:
    """json_documents of those paths that exist, with a warning for each other; raises if there is none."""
    found = existing(spark, *paths)
    for path in sorted(set(paths) - set(found)):
        warnings.warn(f"skipped, for it does not exist: {path}", stacklevel=2)
    if not found:
        raise FileNotFoundError(f"none of these exists: {paths}")
    return json_documents(spark, schema, *found)


def splits(spark: SparkSession, schema: str, **paths: str) -> DataFrame:
    """Rows of several files, each with the name of its split."""
    out = None
    for name, path in paths.items():
        part = json_lines(spark, schema, path).withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def dereference(manifest: DataFrame, files: DataFrame, path: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows with their file's text without white space at its ends, rows whose file is missing).

    Spark picks the join; the smaller side is broadcast if its size allows.
    """
    named = files.select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), strip(F.col("value")).alias(text))
    on = F.col(path) == F.col("_path")
    return manifest.join(named, on).drop("_path"), manifest.join(named, on, "left_anti")
