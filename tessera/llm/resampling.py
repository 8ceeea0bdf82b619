"""Importance resampling of documents towards a target's distribution of hashed n-grams.

Texts stay UTF-8 bytes: one 256-byte table lower-cases A-Z and turns every
separator into a blank, and `bytes.split` gives the words.  A feature is a run of
1 to max_n words joined by one space; its checksum is that of the run without its
last word, continued over a space and that word (`zlib.crc32` takes the former as
its seed), so that no feature is ever put together.  Counters add up equal words
of a slice before they are looked at one by one.

A bucket's gain is the logarithm of its share in the target over its share in the
corpus, both smoothed by one, in thousandths, rounded down.  A document's weight is
the sum of its features' gains; with a Gumbel number of its own, drawn from a hash
of its key, added to it, the highest scores are a sample without replacement in
proportion to the exponential of the weights.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.worktables import write_table

#: Production parameters.
MAX_N = 1
BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
SLICE_BYTES = 1 << 20  # of a text that are split at once

_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def word_slices(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text, in lists of at most SLICE_BYTES bytes, longer only for a single word of that length."""
    data, at = (text or "").encode().translate(_TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE_BYTES)
        yield data[at : end if end >= 0 else len(data)].split()
        at = end if end >= 0 else len(data)


def bucket_counts(text: str | None, max_n: int = MAX_N, buckets: int = BUCKETS) -> tuple[int, Counter[int]]:
    """(words, features by bucket) of a whole text."""
    n_words, found, tail = 0, Counter(), []
    for words in word_slices(text):
        n_words += len(words)
        for word, n in Counter(words).items():
            found[zlib.crc32(word) % buckets] += n
        if max_n > 1:
            run = tail + words  # the last words of the slice before begin runs that end in this one
            for i, word in enumerate(run):
                crc = zlib.crc32(word)
                for j in range(i + 1, min(i + max_n, len(run))):
                    crc = zlib.crc32(run[j], zlib.crc32(b" ", crc))
                    if j >= len(tail):
                        found[crc % buckets] += 1
            tail = run[max(0, len(run) - max_n + 1) :]
    return n_words, found


def _histogram(texts: DataFrame, max_n: int, buckets: int) -> DataFrame:
    """(bucket, n) of a table (text); every task sends one row for each bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            for text in batch.column("text"):
                total.update(bucket_counts(text.as_py(), max_n, buckets)[1])
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.int64()), pa.array(total.values(), pa.int64())], ["bucket", "n"])

    return texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain), one row for each bucket that the corpus (text) or the target (text) uses.

    Null texts hold no features.  A bucket without a row has the counts 0 and 0,
    which no feature of either table asks for.
    """
    both = _histogram(corpus, max_n, buckets).select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(_histogram(target, max_n, buckets).select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    counts = write_table(both.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")), "resampling-buckets")
    totals = counts.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t")).first()
    up = (F.col("t").cast("double") + 1) * F.lit(float(totals["all_s"] + buckets))
    down = (F.col("s").cast("double") + 1) * F.lit(float(totals["all_t"] + buckets))
    return counts.select("bucket", F.floor(F.lit(1000.0) * F.log(up / down)).cast("long").alias("gain"))


def gumbel(key: Column, seed: int = SEED) -> Column:
    """floor(-1000 ln(-ln u)), u from the first 32 bits of sha256("seed:key"); a null key counts as the empty string."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256)
    u = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(u))).cast("long")


def importance_weights(df: DataFrame, target: DataFrame, key: str, text: str, target_text: str, max_n: int = MAX_N, buckets: int = BUCKETS) -> DataFrame:
    """(key, n_words, n_features, weight) for every row of df, weights towards the target table.

    The gains, one number for each bucket, go to the tasks with their code; no text
    is shuffled.  Texts of any length are read whole, a slice at a time.
    """
    corpus, goal = df.select(F.col(text).alias("text")), target.select(F.col(target_text).alias("text"))
    gain = np.zeros(buckets, np.int64)
    for row in bucket_gains(corpus, goal, max_n, buckets).toLocalIterator():  # `buckets` rows at most
        gain[row["bucket"]] = row["gain"]

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, features, weights = [], [], []
            for value in batch.column("text"):
                n, found = bucket_counts(value.as_py(), max_n, buckets)
                words.append(n)
                features.append(found.total())
                weights.append(sum(int(gain[b]) * c for b, c in found.items()))
            numbers = [pa.array(x, pa.int64()) for x in (words, features, weights)]
            yield pa.RecordBatch.from_arrays([batch.column("key"), *numbers], ["key", "n_words", "n_features", "weight"])

    schema = df.select(F.col(key).alias("key")).schema.add("n_words", "long").add("n_features", "long").add("weight", "long")
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(weigh, schema).withColumnRenamed("key", key)


def _ranked(rows: DataFrame, order: list[Column]) -> DataFrame:
    """rows with `place`, their place in the order from 1: range partitions, and prefix sums of their counts."""
    dealt = write_table(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "resampling-ranges")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range partition
    offsets = counts.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("before")
    return dealt.join(F.broadcast(offsets), "part").withColumn("place", place.cast("long")).drop("part", "before")


def resample(
    df: DataFrame, target: DataFrame, key: str, text: str, target_text: str,
    max_n: int = MAX_N, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """(key, n_features, weight, score, rank), one row for every row of df; rank is null where a row isn't drawn.

    Of the N rows with at least min_words words, floor(percent * N / 100) with the
    highest scores are drawn, ties to smaller keys, null keys first.  Null and empty
    texts have no features and weight 0; repeated rows are drawn each for itself, in
    any order, as they are alike.  An empty target gives gains from the smoothing
    alone, an empty df no rows.  Other columns of df, whatever their names, are not
    carried: join on the key.
    """
    weighed = importance_weights(df, target, key, text, target_text, max_n, buckets).withColumnRenamed(key, "key")
    scored = write_table(weighed.withColumn("score", F.col("weight") + gumbel(F.col("key"), seed)).withColumn("arrival", F.monotonically_increasing_id()), "resampling-scores")
    enough = F.col("n_words") >= min_words
    drawn = scored.filter(enough).count() * percent // 100
    order = [F.col("score").desc(), F.col("key").asc_nulls_first(), F.col("arrival").asc()]
    ranked = _ranked(scored.filter(enough), order).withColumn("rank", F.when(F.col("place") <= drawn, F.col("place"))).drop("place")
    rest = scored.filter(~enough).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select(F.col("key").alias(key), "n_features", "weight", "score", "rank")


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, a tenth of them drawn towards the words of the benchmark."""
    docs, goal = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, goal, "doc_id", "text", "text")


OP12_SQL = f"""
WITH crc_table AS (
  SELECT list(c ORDER BY n) AS t FROM (
    SELECT n, list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) AS c FROM (SELECT unnest(range(256)) AS n))
), docs AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents
), doc_words AS (
  SELECT row, word, count(*) AS n FROM (SELECT row, unnest(words) AS word FROM docs) GROUP BY row, word
), goal_words AS (
  SELECT word, count(*) AS n FROM (
    SELECT unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')) AS word FROM benchmark) GROUP BY word
), vocabulary AS (
  SELECT word, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(word)), '..'), lambda h: ('0x' || h)::BIGINT),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT word FROM doc_words UNION SELECT word FROM goal_words), crc_table
), corpus AS (
  SELECT bucket, sum(n) AS s FROM doc_words JOIN vocabulary USING (word) GROUP BY bucket
), goal AS (
  SELECT bucket, sum(n) AS t FROM goal_words JOIN vocabulary USING (word) GROUP BY bucket
), totals AS (
  SELECT (SELECT coalesce(sum(s), 0) FROM corpus)::DOUBLE AS all_s, (SELECT coalesce(sum(t), 0) FROM goal)::DOUBLE AS all_t
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0)::DOUBLE + 1) * (all_s + {BUCKETS}) / ((s::DOUBLE + 1) * (all_t + {BUCKETS}))))::BIGINT AS gain
  FROM corpus LEFT JOIN goal USING (bucket), totals
), weighed AS (
  SELECT row, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM doc_words JOIN vocabulary USING (word) JOIN gains USING (bucket) GROUP BY row
), scored AS (
  SELECT row, doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296::DOUBLE))))::BIGINT AS score
  FROM docs LEFT JOIN weighed USING (row)
), placed AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= {MIN_WORDS}
)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END::BIGINT AS rank FROM scored LEFT JOIN placed USING (row)
"""
