"""Boilerplate lines by their frequency within a site, in DataFrame functions only.

A line is boilerplate on a host if the share of the host's pages that contain it
exceeds a ratio.  Counting shuffles one (host, line hash) pair for each distinct
line of a page, added up before the shuffle; the lines found are few for each
host (their shares add up to at most the host's mean number of lines) and are
joined back to the pages by host.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.worktables import free_name, write_table

#: Production parameters.
MAX_SHARE = 0.1
MIN_PAGES = 3
BROADCAST_BYTES = 64 << 20  # of flagged lines, at LINE_BYTES each, at most that are broadcast
LINE_BYTES = 32  # of a flagged line's hashes in memory
SALTS = 16  # parts of a host's pages where flagged lines are not broadcast


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _line_key(line: Column) -> Column:
    """Two independent hashes, 96 bits in all; lines count as equal without outer spaces."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.crc32(F.trim(line).cast("binary")).alias("b"))


def site_boilerplate(df: DataFrame, host: str, text: str, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """The boilerplate lines of each host: (host, line, n_pages, host_pages), line a hash pair.

    Null hosts form one host.  Each row is a page, so repeated rows are counted
    as often as they occur; a line counts once a page.  Blank lines never count.
    """
    pages = df.select(F.col(host).alias("host"), F.col(text).alias("text"))
    totals = pages.groupBy("host").agg(F.count("*").alias("host_pages"))
    found = (
        pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: F.trim(x) != ""), _line_key))).alias("line"))
        .groupBy("host", "line")
        .agg(F.count("*").alias("n_pages"))
        .filter(F.col("n_pages") >= min_pages)
    )
    same_host = found["host"].eqNullSafe(totals["host"])
    return found.join(totals, same_host).drop(totals["host"]).filter(F.col("n_pages") > F.lit(float(max_share)) * F.col("host_pages"))


def drop_boilerplate(df: DataFrame, host: str, text: str, max_share: float = MAX_SHARE, min_pages: int = MIN_PAGES) -> DataFrame:
    """df with its boilerplate lines taken out of the text, and n_lines_dropped added.

    A line goes from every page of a host on which more than max_share of the
    pages, and at least min_pages, contain it; a share equal to max_share is not
    more.  Lines are compared without outer spaces; the lines that stay keep their
    spaces and order.  A text whose lines all go becomes empty; null texts stay
    null, with 0 lines dropped.  Texts and lines of any length are read whole.
    Null hosts form one host.  An empty table stays empty.  All columns of df stay,
    whatever their names; if one is called n_lines_dropped, the new one gets an
    underscore more.
    """
    lines = write_table(site_boilerplate(df, host, text, max_share, min_pages).select("host", "line"), "boilerplate")
    small = lines.count() * LINE_BYTES <= BROADCAST_BYTES
    salts = 1 if small else SALTS
    # A struct key compares null hosts as equal.  Lists of lines of known size are
    # broadcast and pages stay where they are; larger ones go to each of a few
    # parts into which every host's pages are dealt.
    parts = lines.select("host", "line", F.explode(F.array(*[F.lit(i) for i in range(salts)])).alias("salt"))
    flagged = parts.groupBy(F.struct("host", "salt").alias("at")).agg(F.collect_list("line").alias("flagged"))
    salt = F.lit(0) if small else F.pmod(F.xxhash64(text), F.lit(salts)).cast("int")
    pages = df.select(F.struct("*").alias("row"), F.struct(F.col(host).alias("host"), salt.alias("salt")).alias("at"), F.col(text).alias("text"))
    hit = pages.join(F.broadcast(flagged) if small else flagged, "at", "left")
    # The set of a page's own flagged lines, so that no line is held against all of a host's.
    own = F.array_intersect(F.transform(_lines(F.col("text")), _line_key), F.col("flagged"))
    hit = hit.withColumn("bad", F.when(F.col("text").isNotNull() & F.col("flagged").isNotNull(), own))
    kept = F.filter(_lines(F.col("text")), lambda x: (F.trim(x) == "") | ~F.array_contains("bad", _line_key(x)))
    same = F.col("bad").isNull() | (F.size("bad") == 0)
    hit = hit.withColumn("kept", F.when(~same, kept))
    dropped = F.when(same, F.lit(0)).otherwise(F.size(_lines(F.col("text"))) - F.size("kept")).cast("long")
    cleaned = F.when(same, F.col("text")).otherwise(F.array_join("kept", "\n"))
    return hit.select(*[cleaned.alias(c) if c == text else F.col("row")[c].alias(c) for c in df.columns], dropped.alias(free_name(df, "n_lines_dropped")))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, their source as host, without the source's boilerplate lines."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    return drop_boilerplate(docs, "source", "text")


OP3_SQL = f"""
WITH pages AS (
  SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents
), totals AS (
  SELECT source, count(*) AS host_pages FROM documents GROUP BY source
), counted AS (
  SELECT source, line, count(*) AS n_pages
  FROM (SELECT source, unnest(list_distinct(list_filter(list_transform(lines, lambda x: trim(x)), lambda x: x <> ''))) AS line FROM pages)
  GROUP BY source, line
), flagged AS (
  SELECT c.source AS host, list(c.line) AS bad
  FROM counted c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n_pages >= {MIN_PAGES} AND c.n_pages > {MAX_SHARE}::DOUBLE * t.host_pages GROUP BY c.source
), kept AS (
  SELECT p.doc_id, p.source, p.text, len(p.lines) AS n,
         CASE WHEN f.bad IS NULL THEN p.lines
              ELSE list_filter(p.lines, lambda x: trim(x) = '' OR NOT list_contains(f.bad, trim(x))) END AS good
  FROM pages p LEFT JOIN flagged f ON p.source IS NOT DISTINCT FROM f.host
)
SELECT doc_id, source,
       CASE WHEN text IS NULL THEN NULL ELSE array_to_string(good, chr(10)) END AS text,
       coalesce(n - len(good), 0)::BIGINT AS n_lines_dropped
FROM kept
"""
