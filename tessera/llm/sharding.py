"""Balanced contiguous shards from global byte-size prefix sums.

Rows are put in one global order, dealt into range partitions, and summed inside
each partition; the partitions' totals (one row each) turn local sums into global
ones, and the global prefix sum is cut at equal targets.  Only keys and sizes are
shuffled, never texts, and no task sees more than one range partition.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.worktables import write_table


#: Rows of one range, about: a row is 40 bytes, so a range stays below a hundred megabytes however large the table is.
RANGE_ROWS = 2_000_000


def assign_shards(df: DataFrame, key: str, text: str, n_shards: int = 8) -> DataFrame:
    """Shard every row of df by the prefix sum of its text's UTF-8 bytes plus 1.

    Returns (key, size, text_crc32, shard, slot, byte_offset): slot counts a
    shard's rows from 0 without gaps, byte_offset is the sum of sizes before the
    row.  A shard holds a contiguous range of the order (key, checksum, size) and
    its bytes differ from total/n_shards by less than the largest row.

    Null texts have size 1 and the checksum of the empty text; null keys come
    first; repeated rows are ordered by their place in the input, and as they are
    alike, any order gives the same result.  Texts of any length count whole and
    stay where they are: only their size and checksum are shuffled.  An empty table
    gives an empty result.
    Other columns, whatever their names, are not carried: join on the key.
    """
    n = F.lit(int(n_shards))
    body = F.coalesce(F.col(text), F.lit(""))
    narrow = df.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
    ).withColumn("arrival", F.monotonically_increasing_id())
    order = ["key", "text_crc32", "size", "arrival"]
    ranges = max(int(narrow.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-narrow.count() // RANGE_ROWS))
    ranged = write_table(narrow.repartitionByRange(ranges, *order).withColumn("part", F.spark_partition_id()), "sharding")

    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # One row for each range partition; this window's input grows with the
    # number of partitions, not with the rows.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy()
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rows_before"),
        F.sum("bytes").over(all_of).alias("total"),
    )
    local = Window.partitionBy("part").orderBy(*order)
    placed = (
        ranged.withColumn("local_bytes", F.sum("size").over(local.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("local_row", F.row_number().over(local) - 1)
        .join(F.broadcast(offsets), "part")  # one row for each range partition
        .withColumn("byte_offset", F.col("bytes_before") + F.col("local_bytes"))
        .withColumn("row_offset", F.col("rows_before") + F.col("local_row"))
        # The shard in which the row's middle byte lies; whole-number arithmetic.
        .withColumn("shard", F.expr(f"int(((2 * byte_offset + size) * {int(n_shards)}) div (2 * total))"))
        .withColumn("shard", F.least("shard", n - 1))
    )
    placed = write_table(placed.select("key", "size", "text_crc32", "shard", "row_offset", "byte_offset"), "sharded")
    first = placed.groupBy("shard").agg(F.min("row_offset").alias("first_row"))  # n_shards rows
    return placed.join(F.broadcast(first), "shard").select(
        F.col("key").alias(key), "size", "text_crc32", "shard",
        (F.col("row_offset") - F.col("first_row")).alias("slot"), "byte_offset",
    )


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7, sizes near equal."""
    sharded = assign_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", 8)
    return sharded.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "byte_offset",
    )


OP1_SQL = """
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) AS c FROM (SELECT unnest(range(256)) AS n))
), summed AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 1)::BIGINT AS size,
    xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)::BIGINT AS text_crc32
  FROM documents, crc_table
), running AS (
  SELECT *, coalesce(sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset, (sum(size) OVER ())::BIGINT AS total
  FROM summed
), placed AS (
  SELECT *, least(((2 * byte_offset + size) * 8) // (2 * total), 7)::INTEGER AS shard FROM running
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY byte_offset) - 1)::BIGINT AS slot, NULL::INTEGER AS grown_shard, byte_offset
FROM placed
"""
