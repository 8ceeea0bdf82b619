"""Tokens of texts as rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.text import tokens


def token_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, kind, text, line, indent), a row for each token of each text, pos and indent from 0, line from 1.

    A line's indent is the number of spaces at its start; line and indent cost a
    window by key, pos, kind and text nothing but the scan.  Keys must be unique;
    a null text has no tokens.
    """
    found = df.select(key, F.posexplode(tokens(F.col(text))).alias("pos", "token")).select(key, "pos", "token.kind", "token.text")
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    line = F.coalesce(F.count_if(F.col("kind") == "newline").over(before), F.lit(0)) + 1
    indent = F.max(F.when(F.col("kind") == "indent", F.col("text").cast("int"))).over(Window.partitionBy(key, "line"))
    return found.withColumn("line", line.cast("int")).withColumn("indent", F.coalesce(indent, F.lit(0)))
