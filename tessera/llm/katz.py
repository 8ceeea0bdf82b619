"""Katz backoff word bigrams with Good-Turing discounts, counted and looked up in packed slices.

The corpus is tokenised once into chunks of a few megabytes, each with its
distinct words.  A chunk asks the holders of word ranges for the counts of its
words, and the holders of context ranges for the counts of its word pairs; what
the training part of the chunk contributes travels with the question.  A holder
adds up all contributions, keeps its part of the model as a table row, and answers
each chunk in the order in which it asked.  So a word or a pair crosses the
network once for each chunk that has it, packed, however often it occurs.

A token is scored recursively: by its pair if training has that, else by the
context's backoff weight times its unigram probability, else, if the context or
the word is unknown, by the unigram model, whose left-over mass goes to the event
of an unknown word.  Probabilities over all known words and that event sum to 1 in
every context.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.wordarrays import mix64, words_of
from tessera.llm.worktables import write_buckets, write_table

CHUNK_BYTES = 4 << 20
BUCKET_ENTRIES = 1 << 20  # what a holder of words or pairs has on average
MAX_GT = 5  # counts up to this have Good-Turing discounts
HOT_SHARE = 4096  # contexts with more than 1/4096 of all tokens are held in several places
TASK_BYTES = 64 << 20  # text whose chunks come back to one task, on average
MAX_PARTS = 100_000  # as many buckets as a table may have

_END = mix64(np.array([0xE0D], np.uint64))[0]  # the token after each document's last word


def pack(x: np.ndarray) -> bytes:
    """Non-negative whole numbers, one byte plane after another, compressed."""
    planes = np.ascontiguousarray(x, dtype="<u8").view(np.uint8).reshape(-1, 8)
    used = 8 if not len(x) else max([1, *[i + 1 for i in range(8) if planes[:, i].any()]])
    return bytes([used]) + zlib.compress(np.ascontiguousarray(planes[:, :used].T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    used = data[0]
    raw = np.frombuffer(zlib.decompress(data[1:]), np.uint8)
    raw = raw.reshape(used, len(raw) // used)
    planes = np.zeros((raw.shape[1], 8), np.uint8)
    planes[:, :used] = raw.T
    return planes.view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    """Rising numbers by their differences."""
    return pack(np.diff(x, prepend=x.dtype.type(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


@dataclass
class Discounts:
    """Factors by which counts are lowered: Good-Turing up to MAX_GT, a constant amount above."""

    factors: np.ndarray  # index: count, 0 to MAX_GT
    amount: float

    @classmethod
    def of(cls, n: np.ndarray) -> Discounts:
        """n[r]: how many words or pairs occur r times, for r from 0 to MAX_GT + 1."""
        r = np.arange(1, MAX_GT + 1)
        factors = np.ones(MAX_GT + 1)
        with np.errstate(all="ignore"):
            common = (MAX_GT + 1) * n[MAX_GT + 1] / n[1]
            factors[1:] = ((r + 1) * n[2:] / (n[1:-1] * r) - common) / (1 - common)
        if not ((factors[1:] > 0) & (factors[1:] < 1)).all():  # too few counts for Good-Turing
            lowered = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            factors[1:] = (r - lowered) / r
        return cls(factors, float(min(max(MAX_GT * (1 - factors[-1]), 0.1), 0.9 * MAX_GT)))

    def lower(self, count: np.ndarray) -> np.ndarray:
        """Discounted counts."""
        count = count.astype(float)
        small = self.factors[np.minimum(count, MAX_GT).astype(int)] * count
        return np.where(count <= MAX_GT, small, count - self.amount)


@dataclass
class Unigrams:
    tokens: int
    types: int
    discounts: Discounts
    unknown: float  # probability of an unknown word

    def probability(self, count: np.ndarray) -> np.ndarray:
        known = count > 0
        return np.where(known, self.discounts.lower(np.where(known, count, 1)) / max(self.tokens, 1), self.unknown)


def _histogram(counts: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(counts, MAX_GT + 2).astype(np.int64), minlength=MAX_GT + 3)[: MAX_GT + 2].tolist()


def _chunks(docs: DataFrame) -> DataFrame:
    """The corpus as chunks: documents, tokens as places in the chunk's sorted distinct words, and these."""
    schema = "chunk long, ids array<long>, held array<boolean>, sizes array<int>, stream binary, words binary, seen binary, n long, tokens long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            held = batch.column("held").to_numpy(zero_copy_only=False)
            for w in words_of(batch.column("text"), lower=True, max_bytes=CHUNK_BYTES):
                part = slice(w.first_row, w.first_row + w.n_rows)
                at = np.cumsum(w.per_row)
                tokens = np.insert(w.hashes, at, _END)
                words, stream = np.unique(tokens, return_inverse=True)
                sizes = w.per_row + 1
                train = ~np.repeat(held[part], sizes)
                seen = np.bincount(stream[train], minlength=len(words))
                yield pa.RecordBatch.from_pydict({
                    "chunk": pa.array([number]), "ids": pa.array([batch.column("id")[part].to_pylist()], pa.list_(pa.int64())), "held": [held[part].tolist()],
                    "sizes": pa.array([sizes.tolist()], pa.list_(pa.int32())), "stream": [pack(stream)], "words": [pack_sorted(words)], "seen": [pack(seen)],
                    "n": pa.array([len(words)]), "tokens": pa.array([len(tokens)]),
                })
                number += 1

    return docs.mapInArrow(read, schema)


def _ask_words(chunks: DataFrame, buckets: int) -> DataFrame:
    """(bucket, chunk, words, seen): a bucket holds a range of word hashes."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for row in pdf.itertuples():
                words, seen = unpack_sorted(row.words), unpack(row.seen)
                bucket = ((words >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
                cuts = np.searchsorted(bucket, np.arange(buckets + 1, dtype=np.uint64))
                some = np.flatnonzero(np.diff(cuts))
                yield pd.DataFrame({"bucket": some, "chunk": row.chunk, "words": [pack_sorted(words[cuts[b] : cuts[b + 1]]) for b in some], "seen": [pack(seen[cuts[b] : cuts[b + 1]]) for b in some]})

    return chunks.select("chunk", "words", "seen").mapInPandas(ask, "bucket long, chunk long, words binary, seen binary")


ANSWER = "kind int, chunk long, bucket long, a binary, b binary, stats array<long>"


def _to_holders(rows: DataFrame, buckets: int) -> DataFrame:
    """rows by bucket, in as many tasks as it takes for hardly any to have several large holders."""
    return rows.repartition(min(2 * buckets, MAX_PARTS), "bucket").groupBy("bucket")


def _hold_words(asked: DataFrame, buckets: int) -> DataFrame:
    """Answers (kind 0: word numbers, counts) and the model (kind 1: words, counts, histogram of counts)."""

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        parts = [unpack_sorted(x) for x in pdf["words"]]
        words, inverse = np.unique(np.concatenate(parts), return_inverse=True)
        totals = np.bincount(inverse, weights=np.concatenate([unpack(x) for x in pdf["seen"]]).astype(float), minlength=len(words)).astype(np.int64)
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(-totals, kind="stable")] = np.arange(len(words))
        number = rank * buckets + bucket  # frequent words have small numbers
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        rows = [(0, c, bucket, pack(number[i]), pack(totals[i]), None) for c, i in zip(pdf["chunk"], np.split(inverse, cuts), strict=True)]
        known = totals > 0
        rows.append((1, None, bucket, pack_sorted(words[known]), pack(totals[known]), [int(known.sum()), int(totals.sum()), *_histogram(totals[known])]))
        return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "a", "b", "stats"]).astype({"chunk": "Int64"})

    return _to_holders(asked, buckets).applyInPandas(hold, ANSWER)


@dataclass
class ChunkPairs:
    """The distinct pairs of a chunk whose context is known, in the order of the questions."""

    bucket: np.ndarray
    v: np.ndarray
    w: np.ndarray
    seen: np.ndarray
    v_count: np.ndarray
    w_count: np.ndarray
    place: np.ndarray  # of each token's pair in that order, or -1 if its context is unknown


def _pairs(row, numbers: np.ndarray, counts: np.ndarray, buckets: int, total: int) -> ChunkPairs:
    stream, words = unpack(row.stream).astype(np.int64), unpack_sorted(row.words)
    sizes = np.asarray(row.sizes, np.int64)
    context = np.empty_like(stream)
    context[1:] = stream[:-1]  # a document begins after the end of another
    if len(context):
        context[0] = np.searchsorted(words, _END)
    known = counts[context] > 0
    key, inverse = np.unique(context[known] * len(words) + stream[known], return_inverse=True)
    train = ~np.repeat(np.asarray(row.held, bool), sizes)[known]
    seen = np.bincount(inverse[train], minlength=len(key))
    vi, wi = key // max(len(words), 1), key % max(len(words), 1)
    v, w = numbers[vi].astype(np.uint64), numbers[wi].astype(np.uint64)
    hot = counts[vi] * HOT_SHARE > total
    spread = np.where(hot, mix64(v * np.uint64(0x9E3779B1) + w), mix64(v))
    bucket = (spread % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((w, v, bucket))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    place = np.full(len(stream), -1)
    place[known] = rank[inverse]
    return ChunkPairs(bucket[order], v[order], w[order], seen[order], counts[vi][order], counts[wi][order], place)


def _word_answers(answers: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and counts of a chunk's words: buckets are ranges, so their answers follow one another."""
    rows = answers[answers["kind"] == 0].sort_values("bucket")
    return np.concatenate([unpack(x) for x in rows["a"]]).astype(np.int64), np.concatenate([unpack(x) for x in rows["b"]]).astype(np.int64)


def _ask_pairs(chunks: DataFrame, word_answers: DataFrame, buckets: int, total: int) -> DataFrame:
    schema = "bucket long, chunk long, v binary, w binary, seen binary, v_count binary, w_count binary"

    def ask(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        for row in left.itertuples():
            p = _pairs(row, *_word_answers(right), buckets, total)
            cuts = np.searchsorted(p.bucket, np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(cuts)):
                s = slice(cuts[b], cuts[b + 1])
                out.append((b, row.chunk, pack_sorted(p.v[s]), *(pack(x[s]) for x in (p.w, p.seen, p.v_count, p.w_count))))
        return pd.DataFrame(out, columns=["bucket", "chunk", "v", "w", "seen", "v_count", "w_count"])

    return chunks.groupBy("chunk").cogroup(word_answers.groupBy("chunk")).applyInPandas(ask, schema)


PAIRS = "kind int, chunk long, bucket long, a binary, b binary, v binary, v_count binary, w_count binary, stats array<long>"


def _hold_pairs(asked: DataFrame, buckets: int) -> DataFrame:
    """Answers (kind 2: counts), open questions (kind 3: places and contexts without a count) and the model (kind 4)."""

    def hold(pdf: pd.DataFrame) -> pd.DataFrame:
        bucket = int(pdf["bucket"].iloc[0])
        parts = [unpack_sorted(x) for x in pdf["v"]]
        cuts = np.cumsum([len(p) for p in parts])[:-1]
        v, w = np.concatenate(parts), np.concatenate([unpack(x) for x in pdf["w"]])
        seen = np.concatenate([unpack(x) for x in pdf["seen"]]).astype(np.int64)
        order = np.lexsort((w, v))
        first = np.ones(len(v), bool)
        first[1:] = (v[order][1:] != v[order][:-1]) | (w[order][1:] != w[order][:-1])
        group = np.empty(len(v), np.int64)
        group[order] = np.cumsum(first) - 1
        totals = np.bincount(group, weights=seen).astype(np.int64)
        at = order[first]
        rows = []
        for chunk, i, own in zip(pdf["chunk"], np.split(group, cuts), parts, strict=True):
            rows.append((2, chunk, bucket, pack(totals[i]), None, None, None, None, None))
            none = np.flatnonzero(totals[i] == 0)
            if len(none):
                rows.append((3, chunk, bucket, pack_sorted(none.astype(np.uint64)), None, pack_sorted(own[none]), None, None, None))
        known = totals > 0
        k = at[known]
        v_count, w_count = (np.concatenate([unpack(x) for x in pdf[c]]) for c in ("v_count", "w_count"))
        rows.append((4, None, bucket, pack(totals[known]), pack(w[k]), pack_sorted(v[k]), pack(v_count[k]), pack(w_count[k]), _histogram(totals[known])))
        return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "a", "b", "v", "v_count", "w_count", "stats"]).astype({"chunk": "Int64"})

    return _to_holders(asked, buckets).applyInPandas(hold, PAIRS)


def _context_sums(model: pd.Series, unigrams: Unigrams, discounts: Discounts) -> tuple[np.ndarray, ...]:
    """Of a holder's contexts: numbers, counts, discounted mass and unigram mass of what was seen after them."""
    v, count = unpack_sorted(model["v"]), unpack(model["a"])
    v_count, p = unpack(model["v_count"]).astype(float), unigrams.probability(unpack(model["w_count"]).astype(np.int64))
    contexts, at = np.unique(v, return_index=True)
    if not len(v):
        return contexts, v_count, v_count, v_count
    return contexts, v_count[at], np.add.reduceat(discounts.lower(count) / v_count, at), np.add.reduceat(p, at)


def _hot_sums(model: DataFrame, unigrams: Unigrams, discounts: Discounts) -> dict[int, tuple[float, float]]:
    """Sums of the contexts that are held in several places; there are at most HOT_SHARE."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for _, row in pdf.iterrows():
                v, n, d, p = _context_sums(row, unigrams, discounts)
                hot = n * HOT_SHARE > unigrams.tokens
                yield pd.DataFrame({"v": v[hot].astype(np.int64), "d": d[hot], "p": p[hot]})

    rows = model.select("a", "v", "v_count", "w_count").mapInPandas(sums, "v long, d double, p double").groupBy("v").agg(F.sum("d"), F.sum("p")).collect()
    return {r[0]: (r[1], r[2]) for r in rows}


def _backoff(held: DataFrame, buckets: int, unigrams: Unigrams, discounts: Discounts, hot: dict) -> DataFrame:
    """Answers (kind 5: places, backoff weights) to the open questions."""
    hot_v = np.array(sorted(hot), np.uint64)
    hot_sums = np.array([hot[int(v)] for v in hot_v]).reshape(-1, 2)

    def weigh(pdf: pd.DataFrame) -> pd.DataFrame:
        model = pdf[pdf["kind"] == 4]
        v, _, d, p = _context_sums(model.iloc[0], unigrams, discounts)
        at = np.searchsorted(hot_v, v)
        split = np.zeros(len(v), bool) if not len(hot_v) else hot_v[np.minimum(at, len(hot_v) - 1)] == v
        d[split], p[split] = hot_sums[at[split]].T
        # A hot context may have been asked for here without a pair of its own here.
        v, d, p = np.append(v, hot_v), np.append(d, hot_sums[:, 0]), np.append(p, hot_sums[:, 1])
        order = np.argsort(v, kind="stable")
        v, weight = v[order], ((1 - d) / (1 - p))[order]
        rows = []
        for row in pdf[pdf["kind"] == 3].itertuples():
            asked = unpack_sorted(row.v)
            rows.append((5, row.chunk, row.bucket, row.a, weight[np.searchsorted(v, asked)].astype("<f8").tobytes(), None))
        return pd.DataFrame(rows, columns=["kind", "chunk", "bucket", "a", "b", "stats"])

    return _to_holders(held.filter("kind in (3, 4)"), buckets).applyInPandas(weigh, ANSWER)


def _score(chunks: DataFrame, answers: DataFrame, buckets: int, unigrams: Unigrams, discounts: Discounts) -> DataFrame:
    schema = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c.split()[0]: [] for c in schema.split(", ")})]
        for row in left.itertuples():
            numbers, counts = _word_answers(right)
            pairs = _pairs(row, numbers, counts, buckets, unigrams.tokens)
            count = np.zeros(len(pairs.v), np.int64)
            weight = np.ones(len(pairs.v))
            first = dict(zip(*np.unique(pairs.bucket, return_index=True), strict=True))
            for a in right[right["kind"] == 2].itertuples():
                got = unpack(a.a)
                count[first[a.bucket] : first[a.bucket] + len(got)] = got
            for a in right[right["kind"] == 5].itertuples():
                weight[first[a.bucket] + unpack_sorted(a.a).astype(np.int64)] = np.frombuffer(a.b, "<f8")
            p_word = unigrams.probability(counts)
            stream = unpack(row.stream).astype(np.int64)
            with np.errstate(divide="ignore", invalid="ignore"):
                by_pair = np.log10(discounts.lower(count) / pairs.v_count)
                backed = np.log10(weight)
            log_word = np.log10(p_word)[stream]
            has = pairs.place >= 0
            seen = has.copy()
            seen[has] = count[pairs.place[has]] > 0
            logs = log_word.copy()
            logs[seen] = by_pair[pairs.place[seen]]
            logs[has & ~seen] += backed[pairs.place[has & ~seen]]
            base = np.log10((counts + 1) / (unigrams.tokens + unigrams.types + 1))[stream]
            sizes = np.asarray(row.sizes, np.int64)
            at = np.cumsum(sizes) - sizes
            out.append(pd.DataFrame({
                "id": pd.array([None if x is None or x != x else int(x) for x in row.ids], "Int64"), "held_out": np.asarray(row.held, bool), "n_tokens": sizes, "n_known": np.add.reduceat((counts > 0)[stream].astype(np.int64), at),
                "train_tokens": unigrams.tokens, "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(logs, at),
            }))
        return pd.concat(out[1:] or out)

    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(score, schema)


def score_documents(df: DataFrame, key: str, text: str, held_out: Column) -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of df.

    Texts are in lower case (A-Z only), their words and one end are the tokens; the
    rows where held_out is not true train the model.  Null texts count as empty,
    null keys stay null, repeated rows count and are scored each time.  Without
    training tokens all probability lies on the unknown word, so that score is 0.
    An empty table gives no rows.  Other columns are not carried.
    """
    spark = df.sparkSession
    docs = df.select(F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)), MAX_PARTS)
    # Stored in buckets by chunk, the corpus is not shuffled when answers come back.
    chunks = write_buckets(_chunks(docs), "katz_chunks", parts, "chunk")
    size = chunks.agg(F.sum("n").alias("n"), F.sum("tokens").alias("tokens")).first()
    word_buckets, pair_buckets = (max(1, -(-(x or 0) // BUCKET_ENTRIES)) for x in (size["n"], size["tokens"]))

    words = write_table(_hold_words(_ask_words(chunks, word_buckets), word_buckets), "katz-words", "kind")
    unigrams = _unigrams(words.filter("kind = 1"))
    word_answers = words.filter("kind = 0").select(*[c.split()[0] for c in ANSWER.split(", ")])
    held = write_table(_hold_pairs(_ask_pairs(chunks, word_answers, pair_buckets, unigrams.tokens), pair_buckets), "katz-pairs", "kind")
    discounts = Discounts.of(_summed(held.filter("kind = 4"), MAX_GT + 2))
    hot = _hot_sums(held.filter("kind = 4"), unigrams, discounts)
    weights = write_table(_backoff(held, pair_buckets, unigrams, discounts, hot), "katz-weights")
    columns = word_answers.columns
    answers = word_answers.unionByName(held.filter("kind = 2").select(*columns)).unionByName(weights.select(*columns))
    return _score(chunks, answers, pair_buckets, unigrams, discounts).withColumnRenamed("id", key)


def _summed(model: DataFrame, n: int) -> np.ndarray:
    """The holders' statistics, added up."""
    row = model.agg(*[F.sum(F.col("stats")[i]) for i in range(n)]).first()
    return np.array([float(x or 0) for x in row])


def _unigrams(model: DataFrame) -> Unigrams:
    stats = _summed(model, MAX_GT + 4)
    types, tokens, n = int(stats[0]), int(stats[1]), stats[2:]
    if not tokens:
        return Unigrams(0, 0, Discounts.of(n), 1.0)
    discounts = Discounts.of(n)
    # What lowering takes away: by count up to MAX_GT, and a constant amount from each word above.
    r = np.arange(1, MAX_GT + 1)
    taken = float((n[1 : MAX_GT + 1] * (r - discounts.lower(r))).sum() + (types - n[1 : MAX_GT + 1].sum()) * discounts.amount)
    return Unigrams(tokens, types, discounts, taken / tokens)


def op2_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those whose id's checksum modulo 7 is not 2."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2
    return score_documents(docs, "doc_id", "text", held_out)
