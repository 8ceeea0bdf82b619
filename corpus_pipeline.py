"""A corpus pipeline over `documents`: five stages, each by one operator of tessera.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written
and reread as the next stage's docs; all but the last return docs' columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.language_id import UNKNOWN, fit_documents, language_of
from tessera.llm.line_dedup import drop_boilerplate
from tessera.llm.minhash import drop_near_duplicates
from tessera.llm.mixing import take_mix
from tessera.llm.pieces import encode_decode
from tessera.llm.worktables import write_table

#: Language ID rejects a text if too few of its words are known in its best language.
MIN_KNOWN = 0.4
#: So many words, half of them known, are added to every text, so that a few unknown words reject none.
PRIOR_WORDS = 8


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learnt language; those without a letter, of other languages or of no words at all go."""
    found = docs.select(F.struct("*").alias("row"), language_of(spark, fit_documents(docs), F.col("text")).alias("found"))
    known = (F.col("found.known_share") * F.col("found.words") + PRIOR_WORDS / 2) / (F.col("found.words") + PRIOR_WORDS)
    return found.filter((F.col("found.lang_pred") != UNKNOWN) & (known >= MIN_KNOWN)).select("row.*")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many documents of their source share."""
    return drop_boilerplate(docs, "source", "text").select(*docs.columns)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    return drop_near_duplicates(docs, "doc_id", "text")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once or twice."""
    return take_mix(docs, "doc_id", "source", "text")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids, and whether these decode to the text."""
    return encode_decode(docs, "text")


STAGES = [
    ("language", known_language),
    ("line_dedup", without_boilerplate),
    ("near_dedup", without_near_duplicates),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: Signatures, the classifier and piece ids are beyond SQL; a test compares the whole chain with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each result written and reread."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = write_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
