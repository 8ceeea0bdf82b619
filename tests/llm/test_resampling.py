import hashlib
import math
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm.resampling import bucket_counts, resample


def features_by_hand(text, max_n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return words, [" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1)]


def drawn_by_hand(rows, target, max_n, buckets, min_words, percent, seed):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, text in rows for f in features_by_hand(text, max_n)[1])
    t = Counter(bucket(f) for text in target for f in features_by_hand(text, max_n)[1])
    gain = {b: math.floor(1000 * math.log((t[b] + 1.0) * (s.total() + buckets) / ((s[b] + 1.0) * (t.total() + buckets)))) for b in {*s, *t}}
    out, order = [], []
    for i, (key, text) in enumerate(rows):
        words, features = features_by_hand(text, max_n)
        weight = sum(gain[bucket(f)] for f in features)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([key, len(features), weight, score, None])
        if len(words) >= min_words:
            order.append((-score, key is not None, key or 0, i))
    for rank, (*_, i) in enumerate(sorted(order)[: percent * len(order) // 100], 1):
        out[i][4] = rank
    return sorted(map(str, out))


def compare(spark, df, target, **options):
    settings = {"max_n": 1, "buckets": 10_000, "min_words": 20, "percent": 10, "seed": 2024} | options
    goal = spark.createDataFrame([(t,) for t in target], "words string")
    got = resample(df, goal, "doc_id", "text", "words", **settings).collect()
    assert sorted(str(list(r)) for r in got) == drawn_by_hand([(r["doc_id"], r["text"]) for r in df.collect()], target, **settings)
    return got


def test_runs_of_several_words(spark, odd_docs):
    """Nulls, copies, very long texts and clashing columns; runs of one to three words; few buckets."""
    target = ["The QUICK brown fox", None, "", "faulen hund é_é"]
    assert any(r["rank"] for r in compare(spark, odd_docs, target, max_n=3, buckets=61, min_words=3, percent=50))
    compare(spark, odd_docs, [], min_words=0, percent=100)


def test_real_documents(spark, sf_dir):
    docs, goal = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    compare(spark, docs, [r["text"] for r in goal.collect()], max_n=2)


def test_ties_go_to_smaller_keys_and_equal_rows_are_drawn_each(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("doc_id"), F.lit("a b c").alias("text"))
    got = compare(spark, df, ["a"], min_words=1, percent=50)
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 51))


def test_nothing(spark, no_docs):
    assert compare(spark, no_docs, ["a b"]) == []


def test_slices_do_not_change_features(monkeypatch):
    text = "One two, three four\nfive éé six\x7fseven " * 5 + "x" * 90
    for size in (1, 7, 40, 1 << 20):
        monkeypatch.setattr("tessera.llm.resampling.SLICE_BYTES", size)
        n, found = bucket_counts(text, 3, 1 << 32)
        words, features = features_by_hand(text, 3)
        assert n == len(words) and found == Counter(zlib.crc32(f.encode()) for f in features)
