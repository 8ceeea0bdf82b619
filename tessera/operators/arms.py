"""Arms of an evaluation, one of which goes through a user's converter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import compact


def convert_arm(predictions: DataFrame, converted: str, converter: Callable[[DataFrame], DataFrame], folder: str, arm: str = "arm", text: str = "prediction") -> DataFrame:
    """predictions with transform_ok, code and transform_error.

    Rows of the converted arm go through the converter, a stage of the user's that
    adds (ok, output, error) to the rows it gets; what it returns is written to the
    folder and read again, so that it runs once however often the result is read.
    A row without ok counts as failed, a failed one has no code and an error on one
    line.  Rows of all other arms, null ones too, keep their text as code.
    """
    is_converted = F.coalesce(F.col(arm) == converted, F.lit(False))
    ran = converter(predictions.filter(is_converted))
    ran.select(*predictions.columns, "ok", "output", "error").write.mode("overwrite").parquet(folder)
    ok = F.coalesce(F.col("ok"), F.lit(False))
    done = predictions.sparkSession.read.parquet(folder).select(
        *predictions.columns, ok.alias("transform_ok"), F.when(ok, F.coalesce("output", F.lit(""))).otherwise("").alias("code"),
        F.when(ok, "").otherwise(compact(F.coalesce("error", F.lit("")))).alias("transform_error"),
    )
    plain = predictions.filter(~is_converted).select("*", F.lit(True).alias("transform_ok"), F.coalesce(text, F.lit("")).alias("code"), F.lit("").alias("transform_error"))
    return done.unionByName(plain)


def error_kind(error: Column) -> Column:
    """What an error's first words before a colon say, as a name; a leading `Error:` doesn't count. Null if there is no error, `other` without such words."""
    words = F.regexp_extract(error, r"^\s*(?:[Ee]rror:\s*)?([A-Za-z][A-Za-z ]*?)\s*:", 1)
    return F.when(F.coalesce(error, F.lit("")) == "", F.lit(None)).when(words == "", "other").otherwise(F.lower(F.regexp_replace(words, r"\s+", "_")))
