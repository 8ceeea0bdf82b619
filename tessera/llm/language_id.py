"""Language identification: known words first, shorter and shorter character n-grams for the rest.

The classifier is fitted on a bounded sample of labelled documents (SAMPLE_DOCS and
SAMPLE_BYTES a language in expectation, taken by a hash of id and text) and keeps
every word and n-gram of that sample, so it can be sent to every task.  Every text
is then scored whole: a word in the model adds its log frequency in each language;
another word adds the mean log frequency of its 4-grams that are known or, if none
is, of its 3-grams, and so on.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.wordarrays import mix64, span_hashes, text_chunks
from tessera.llm.worktables import write_table

#: Parameters of the fit.
SAMPLE_DOCS = 2_000  # labelled documents for each language, in expectation
SAMPLE_BYTES = 16 << 20  # of their texts, in expectation
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"

_EDGE = 0x20  # stands for everything that is no letter


@cache
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def _char_values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(1))


def _string_hashes(strings: list[str]) -> np.ndarray:
    """span_hashes of whole strings, over code points."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le"), np.uint32)
    ends = np.cumsum([len(s) for s in strings])
    return span_hashes(_char_values(codes), ends - [len(s) for s in strings], ends)


class Table:
    """Log frequencies by language of hashed strings."""

    def __init__(self, strings: list[str], counts: np.ndarray, totals: np.ndarray):
        hashes = _string_hashes(strings) if strings else np.zeros(0, np.uint64)
        order = np.argsort(hashes)
        self.keys, self.seen = hashes[order], counts[order] > 0
        self.logs = np.log((counts[order] + SMOOTHING) / (totals + SMOOTHING * (len(strings) + 1))).astype(np.float32)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions in the table and whether each hash is there."""
        if not len(self.keys):
            return np.zeros(len(hashes), int), np.zeros(len(hashes), bool)
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return at, self.keys[at] == hashes


class Model:
    def __init__(self, langs: list[str], words: Table, grams: dict[int, Table]):
        self.langs, self.words, self.grams = langs, words, grams

    def scores(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text the log score by language, the words, and by language those that its sample has."""
        total, known = np.zeros((2, len(texts), len(self.langs)))
        words = np.zeros(len(texts), np.int64)
        for first, data, offsets in text_chunks(pc.utf8_lower(texts)):
            n = len(offsets) - 1
            codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            # One edge before each document and one at the end.
            row = np.repeat(np.arange(n), np.diff(at))
            padded = np.full(len(codes) + n + 1, _EDGE, np.uint32)
            padded[np.arange(len(codes)) + row + 1] = np.where(_letters()[codes], codes, _EDGE)
            inside = padded != _EDGE
            starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
            ends = np.flatnonzero(inside[:-1] & ~inside[1:]) + 1
            rows = np.searchsorted(at + np.arange(n + 1), starts, "left") - 1
            words[first : first + n] = np.bincount(rows, minlength=n)
            part = slice(first, first + n)
            total[part], known[part] = self._score_words(_char_values(padded), starts, ends, rows, n)
        return total, words, known

    def _score_words(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        at, known = self.words.find(span_hashes(values, starts, ends))
        total, seen = np.zeros((2, n, len(self.langs)))
        self._add(total, rows[known], self.words.logs[at[known]])
        self._add(seen, rows[known], self.words.seen[at[known]])
        starts, ends, rows = starts[~known] - 1, ends[~known] + 1, rows[~known]
        for order in ORDERS:
            if not len(rows) or order not in self.grams:
                continue
            count = np.maximum(ends - starts - order + 1, 0)
            word = np.repeat(np.arange(len(rows)), count)
            pos = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + starts[word]
            at, found = self.grams[order].find(span_hashes(values, pos, pos + order))
            word, at = word[found], at[found]
            hits = np.bincount(word, minlength=len(rows))
            sums = np.zeros((len(rows), len(self.langs)))
            self._add(sums, word, self.grams[order].logs[at])
            hit = hits > 0
            self._add(total, rows[hit], sums[hit] / hits[hit, None])
            starts, ends, rows = starts[~hit], ends[~hit], rows[~hit]
        return total, seen

    @staticmethod
    def _add(total: np.ndarray, rows: np.ndarray, logs: np.ndarray) -> None:
        for k in range(total.shape[1]):
            total[:, k] += np.bincount(rows, weights=logs[:, k], minlength=len(total))

    def predict(self, texts: pa.Array) -> pa.Array:
        total, words, known = self.scores(texts)
        has_letter = words > 0
        if not self.langs:
            has_letter[:] = False
            total, known = np.zeros((2, len(texts), 1))
        best = total.argmax(1)
        share = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
        lang = [self.langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), has_letter.tolist(), strict=True)]
        known_share = known[np.arange(len(best)), best] / np.maximum(words, 1)
        return pa.StructArray.from_arrays([pa.array(lang, pa.string()), *(pa.array(np.where(has_letter, x, 0.0)) for x in (share, known_share)), pa.array(words)], ["lang_pred", "score", "known_share", "words"])


def fit(labelled: DataFrame, key: str, text: str, lang: str, sample_docs: int = SAMPLE_DOCS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model from a sample of the rows with a language, in expectation at most so many rows and bytes of each.

    Rows without a language or text are left out.  If nothing is left, the model
    has no language and predicts `und` for every text.  A row that is there several
    times is in the sample with all its copies or with none.
    """
    rows = labelled.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).collect()  # one row a language
    rates = {r["lang"]: min(1.0, sample_docs / r["n"], sample_bytes / max(r["bytes"], 1)) for r in sizes}
    langs = sorted(rates)
    if not langs:
        return Model([], Table([], np.zeros((0, 0)), np.zeros(0)), {})
    spread = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    rate = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(rates[k]))])
    words = rows.filter(spread < F.element_at(rate, F.col("lang"))).select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), 0)).alias("string"))
    per_word = write_table(words.groupBy("string").agg(*[F.count_if(F.col("lang") == k).alias(f"n{i}") for i, k in enumerate(langs)]), "language-words")

    padded = F.concat(F.lit(" "), F.col("string"), F.lit(" "))

    def parts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(padded) - n + 1), lambda i: F.struct(F.lit(n).alias("order"), F.substr(padded, i, F.lit(n)).alias("string")))

    none = F.array().cast("array<struct<order:int,string:string>>")
    grams = per_word.select(F.explode(F.concat(*[F.when(F.length(padded) >= n, parts(n)).otherwise(none) for n in ORDERS])).alias("g"), *[f"n{i}" for i in range(len(langs))])
    summed = grams.groupBy(F.col("g.order").alias("order"), F.col("g.string").alias("string")).agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(langs))])
    whole = per_word.withColumn("order", F.lit(0)).unionByName(summed).toArrow()  # bounded by the sample
    order = whole.column("order").to_numpy()
    counts = np.stack([whole.column(f"n{i}").to_numpy() for i in range(len(langs))], 1).astype(float)
    strings = whole.column("string")

    def table(n: int) -> Table:
        at = np.flatnonzero(order == n)
        return Table(strings.take(pa.array(at)).to_pylist(), counts[at], counts[at].sum(0))

    return Model(langs, table(0), {n: table(n) for n in ORDERS})


def language_of(spark: SparkSession, model: Model, text: Column) -> Column:
    """struct<lang_pred,score,known_share,words> of a text; `und` with 0 and 0 where it is null or has no letter.

    score is the winner's share of the likelihood among the model's languages,
    known_share the share of the text's words that the winner's sample has, which
    does not grow with the text's length, words their number.  Ties go to the first language in code
    point order.  Equal texts get equal results wherever they stand, a text of any
    length is read whole, and other columns play no part.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, known_share: double, words: bigint>")
    def predict(texts: pa.Array) -> pa.Array:
        return sent.value.predict(texts)

    return predict.asNondeterministic()(text)  # keeps the optimiser from repeating it in filters


def held_out(key: str) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    """The model of the training part of documents: crc32 of the id modulo 5 is not 0."""
    return fit(docs.filter(~held_out("doc_id")), "doc_id", "text", "lang")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from four fifths of them."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("doc_id", held_out("doc_id").alias("held_out"), language_of(spark, fit_documents(docs), F.col("text")).alias("p"))
    return found.select("doc_id", "held_out", "p.lang_pred", "p.score", "p.known_share")
