"""Mixing sources to target weights by hash thresholds, in DataFrame functions only.

Every document has a fixed 60-bit hash of its key, source and text.  A source's partial pass takes all
documents whose hash lies below the source's threshold, so growing a budget only
adds documents.  The threshold is found from sums of words by hash bucket: the
first level sums all documents by source and 12 hash bits, the bucket in which
the budget runs out is refined by the next 12 bits, and so on; each level reads
the narrow table of sizes and keeps only its boundary buckets' rows.  Nothing is
sorted by hash and no source is ever brought together in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.worktables import write_table

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MAX_REPEAT = 2
LEVEL_DIGITS = 3  # hexadecimal digits of the hash for each level
LEVELS = 5


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(source, source_size, target, capped) from rows (source, size).

    Sources in code point order, null last, take the weights in turn and share
    `share` times the sum of all sizes.  A target stops at max_repeat times its
    source's size; the excess is shared again by weight among the others until
    none is above.  That fixed point is reached in one pass: in the order of
    size/weight the capped sources come first, and what is left over for the rest
    after capping the first i is a running sum.  The windows here see one row for
    each source.  If share exceeds max_repeat, all sources stop at their caps.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    n = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(n) - 1) % len(weights) + 1).cast("int"))
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(max_repeat)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, rest, everything = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    # What one unit of weight gets if exactly the sources before this one are capped.
    unit = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    marked = ranked.withColumn("unit", unit).withColumn("capped", F.col("cap") <= F.col("unit") * F.col("weight"))
    # The first source that is not capped fixes the unit for all after it.
    level = marked.withColumn("level", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("unit")))).over(everything)["unit"])
    return level.select("source", "source_size", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"), "capped")


def hash_thresholds(rows: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, threshold): rows with a smaller hex hash fit the source's budget.

    rows has (source, hash, size), budgets (source, budget).  The threshold is the
    first hash, in order, at which the running sum of sizes exceeds the budget;
    equal hashes go together.  Sources without a threshold fit whole.
    """
    boundary = budgets.withColumn("prefix", F.lit(""))
    for level in range(1, LEVELS + 1):
        digits = level * LEVEL_DIGITS
        inside = rows.join(
            boundary.select(F.struct("source", "prefix").alias("at"), "budget"),
            F.struct(rows["source"].alias("source"), F.substring(rows["hash"], 1, digits - LEVEL_DIGITS).alias("prefix")) == F.col("at"),
        )
        histogram = inside.groupBy(F.col("at.source").alias("source"), F.col("at.prefix").alias("above"), F.substring("hash", 1, digits).alias("prefix")).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget")
        )
        w = Window.partitionBy("source", "above").orderBy("prefix")  # at most 4096 buckets each
        upto = F.sum("words").over(w.rowsBetween(Window.unboundedPreceding, 0))
        crossing = histogram.withColumn("upto", upto).filter((F.col("upto") > F.col("budget")) & (F.col("upto") - F.col("words") <= F.col("budget")))
        boundary = crossing.select("source", "prefix", (F.col("budget") - (F.col("upto") - F.col("words"))).alias("budget"))
    return boundary.select("source", F.col("prefix").alias("threshold"))


def _keyed(df: DataFrame, key: str, source: str, text: str) -> dict[str, Column]:
    def marked(c: Column) -> Column:
        return F.concat(F.coalesce(F.length(c).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(c, F.lit("")))

    whole = F.concat(*[marked(F.col(c).cast("string")) for c in (key, source, text)])
    return {"source": F.col(source), "size": word_count(F.col(text)), "digest": F.md5(whole.cast("binary"))}


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with `copy`, which numbers those of equal digest from 0, by counts of partitions; no digest's rows meet in one task."""
    placed = write_table(rows.withColumns({"part": F.spark_partition_id(), "arrival": F.monotonically_increasing_id()}), "mixing-copies")
    counts = placed.groupBy("digest", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("digest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    own = F.row_number().over(Window.partitionBy("digest", "part").orderBy("arrival")) - 1
    return placed.withColumn("own", own).join(counts.withColumn("before", before), ["digest", "part"]).withColumn("copy", F.col("own") + F.col("before")).drop("part", "arrival", "own", "n", "before")


def _hashed(rows: DataFrame, repeated: DataFrame) -> DataFrame:
    """rows with their hash, from the digest and the number among equal digests; `repeated` holds the digests of several rows."""
    if repeated.isEmpty():
        numbered = rows.withColumn("copy", F.lit(0).cast("long"))
    else:
        once = rows.join(repeated, "digest", "left_anti").withColumn("copy", F.lit(0).cast("long"))
        numbered = once.unionByName(_numbered(rows.join(repeated, "digest", "left_semi")))
    return numbered.withColumn("hash", F.substring(F.md5(F.concat_ws(":", "digest", "copy").cast("binary")), 1, LEVELS * LEVEL_DIGITS)).drop("digest", "copy")


def _sizes(df: DataFrame, columns: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(the narrow table of columns and hashes, the digests of several rows)."""
    narrow = write_table(df.select(*[c.alias(n) for n, c in columns.items()]), "mixing-sizes")
    repeated = write_table(narrow.groupBy("digest").count().filter("count > 1").select("digest"), "mixing-repeated")
    return write_table(_hashed(narrow, repeated), "mixing-hashes"), repeated


def mixing_plan(narrow: DataFrame, **targets) -> DataFrame:
    """(_source, source_size, target, full, budget, threshold): one row for each source of rows (source, size, hash)."""
    per_source = source_targets(narrow, **targets)
    full = F.when(F.col("capped"), F.round(F.col("target") / F.col("source_size"))).otherwise(F.floor(F.col("target") / F.col("source_size")))
    per_source = per_source.withColumn("full", F.when(F.col("source_size") > 0, full).otherwise(0).cast("long")).withColumn(
        "budget", F.when(F.col("capped"), F.lit(0.0)).otherwise(F.col("target") - F.col("full") * F.col("source_size"))
    )
    per_source = write_table(per_source, "mixing-targets")
    cuts = hash_thresholds(narrow.filter("size > 0"), per_source.filter("budget > 0").select("source", "budget"))
    plan = per_source.join(cuts.select(F.struct("source").alias("_cut"), "threshold"), F.struct(per_source["source"].alias("source")) == F.col("_cut"), "left")
    return write_table(plan.select(F.struct("source").alias("_source"), "source_size", "target", "full", "budget", "threshold"), "mixing-plan")


def _copies(size: Column, hashed: Column) -> Column:
    full, budget, threshold = (F.col(c) for c in ("full", "budget", "threshold"))
    partial = (budget > 0) & (threshold.isNull() | (hashed < threshold))
    return F.when(size > 0, full + partial.cast("long")).otherwise(0).cast("long")


def mix_sources(df: DataFrame, key: str, source: str, text: str, **targets) -> DataFrame:
    """(key, source, size, source_size, target, copies, taken) for every row of df.

    copies says how often the mix takes a document: whole passes over its source
    plus one if its hash is below the source's threshold.  A document never comes
    more than max_repeat times.  Each source's taken words fall short of its target
    by less than the first document that no longer fits.  Texts of any length count
    whole.  Null texts and texts without words have size 0, and null sources form
    one source.  The hash is that of key, source and text, and of a number where
    several rows have the same ones, so rows with null or repeated keys are taken
    each for itself, equal rows count alike, and reruns agree.
    """
    narrow, _ = _sizes(df, {"key": F.col(key), **_keyed(df, key, source, text)})
    plan = mixing_plan(narrow, **targets)
    taken = narrow.join(plan, F.struct(narrow["source"].alias("source")) == F.col("_source"))
    return taken.withColumn("copies", _copies(F.col("size"), F.col("hash"))).select(
        F.col("key").alias(key), F.col("source").alias(source), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def take_mix(df: DataFrame, key: str, source: str, text: str, **targets) -> DataFrame:
    """The mix itself: every row of df as often as mix_sources says, with df's columns.

    Texts are not shuffled while the plan, one row for each source, is small
    enough for Spark to broadcast; only texts of several equal rows are written
    once more, to be numbered.
    """
    keyed = _keyed(df, key, source, text)
    narrow, repeated = _sizes(df, keyed)
    plan = mixing_plan(narrow, **targets)
    rows = _hashed(df.select(F.struct("*").alias("row"), F.struct(F.col(source).alias("source")).alias("_source"), *[keyed[c].alias(c) for c in ("size", "digest")]), repeated)
    times = F.array_repeat(F.lit(0), _copies(F.col("size"), F.col("hash")).cast("int"))
    return rows.join(plan, "_source").select("row", F.explode(times)).select("row.*")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed with weights 3, 1, 2 in turn to 150 % of their words."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix_sources(docs, "doc_id", "source", "text").select("doc_id", "source", "size", "source_size", "target", "copies", "taken")


OP5_SQL = r"""
WITH RECURSIVE sizes AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         md5(coalesce(length(doc_id::VARCHAR)::VARCHAR, '-') || ':' || coalesce(doc_id::VARCHAR, '') || coalesce(length(source)::VARCHAR, '-') || ':' || coalesce(source, '')
             || coalesce(length(text)::VARCHAR, '-') || ':' || coalesce(text, '')) AS digest,
         substr(md5(digest || ':' || (row_number() OVER (PARTITION BY digest) - 1)), 1, 15) AS h
  FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)] AS weight
  FROM sizes GROUP BY source
), ranked AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap FROM per
), units AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS unit
  FROM ranked
), marked AS (
  SELECT *, cap <= unit * weight AS capped FROM units
), targets AS (
  SELECT *, CASE WHEN capped THEN cap ELSE (SELECT arg_min(unit, cap / weight) FROM marked WHERE NOT capped) * weight END AS target FROM marked
), plan AS (
  SELECT *, CASE WHEN source_size = 0 THEN 0 WHEN capped THEN 2 ELSE floor(target / source_size) END::BIGINT AS passes FROM targets
), budgets AS (
  SELECT *, CASE WHEN capped THEN 0 ELSE target - passes * source_size END AS budget FROM plan
), running AS (
  SELECT s.doc_id, s.source, s.size, b.source_size, b.target, b.passes, b.budget,
         sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM sizes s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, source, size, source_size, target,
       CASE WHEN size = 0 THEN 0 ELSE passes + (budget > 0 AND upto <= budget)::BIGINT END::BIGINT AS copies,
       (size * CASE WHEN size = 0 THEN 0 ELSE passes + (budget > 0 AND upto <= budget)::BIGINT END)::BIGINT AS taken
FROM running
"""
