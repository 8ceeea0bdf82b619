"""SentencePiece encoding and decoding, batched in numpy.

A text gets the model's dummy prefix, spaces become the space mark, and it is cut
into words that no piece of the model can cross.  Distinct words of one length
advance together, substring hashes probing the sorted hashes of the pieces:

* in a unigram model by a Viterbi search: at every position the maximum over the
  pieces that end there gives the best score and a backpointer;
* in a BPE model, whose ids are defined by the order of merges and not by the
  best sum of scores, by merging in each round each word's best adjacent pair.
  All words of one length that still merge have equally many symbols.

Characters that no piece covers become byte pieces, and so does a space mark in
the text itself, so decoding gives every text back exactly.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.wordarrays import mix64, span_hashes, text_chunks
from tessera.llm.worktables import free_name

MODEL_PATH = os.environ.get("PIECE_MODEL_PATH", "/opt/tokenizers/piece_bpe_32k.model")
CACHE_WORDS = 400_000  # words that a worker remembers; older ones go all at once
SLICE_ROWS = 500  # rows of an Arrow batch that are encoded and decoded at a time
SLICE_BYTES = 4 << 20  # of text encoded at once
BATCH_CELLS = 1 << 19  # (word, position, length) cells examined at a time

_MARK = 0x2581  # stands for a space in pieces
_LITERAL = 0x110000  # a space mark in the text: no piece has it


def _values(codes: np.ndarray) -> np.ndarray:
    return mix64(codes.astype(np.uint64) + np.uint64(1))


def _ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The indices starts[i], starts[i]+1, ... (counts[i] of them), one run after another."""
    before = np.cumsum(counts) - counts
    return np.arange(counts.sum()) + np.repeat(starts - before, counts)


def _is_bpe(model) -> bool:
    """Whether the ids follow from merges; raises for a model that changes texts before it cuts them."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model.serialized_model_proto())
    rules = proto.normalizer_spec
    if rules.precompiled_charsmap or rules.remove_extra_whitespaces or not rules.add_dummy_prefix or not rules.escape_whitespaces:
        raise ValueError("only models that leave texts as they are, but for a leading space and marks for spaces, are supported")
    return proto.trainer_spec.model_type == sentencepiece_model_pb2.TrainerSpec.BPE


class PieceModel:
    """Pieces, scores and byte pieces of a model file, as arrays; encodes and decodes Arrow arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.merges_pairs = _is_bpe(model)
        n = model.get_piece_size()
        plain, text = [], []
        self.byte_ids = np.zeros(256, np.int32)
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[1:-1], 16)] = i
                text.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i):
                text.append(b"")
            elif model.is_unknown(i):
                text.append(" ⁇ ".encode())
            else:
                text.append(piece.replace("▁", " ").encode())
                if not model.is_unused(i):
                    plain.append(i)
        pieces = [model.id_to_piece(i) for i in plain]
        codes = np.frombuffer("".join(pieces).encode("utf-32-le"), np.uint32)
        lengths = np.array([len(p) for p in pieces])
        ends = np.cumsum(lengths)
        hashes = span_hashes(_values(codes), ends - lengths, ends)
        order = np.argsort(hashes)
        self.keys, self.ids = hashes[order], np.array(plain, np.int32)[order]
        self.scores = np.array([model.get_score(i) for i in plain])[order]
        self.unknown_score = self.scores.min() - 10.0
        self.longest = int(lengths.max())
        # A character that is in no piece of several characters ends a word on both sides.
        self.joins = np.zeros(_LITERAL + 1, bool)
        self.joins[codes[np.repeat(lengths, lengths) > 1]] = True
        crossing = [p for p in pieces if "▁" in p.lstrip("▁")]
        if crossing:
            raise ValueError(f"pieces hold spaces inside, so words can't be cut at spaces: {crossing[:3]}")
        self.piece_bytes = np.frombuffer(b"".join(text), np.uint8)
        self.piece_sizes = np.array([len(t) for t in text])
        self.piece_starts = np.cumsum(self.piece_sizes) - self.piece_sizes
        self.forget()

    def forget(self) -> None:
        self._seen = np.zeros(0, np.uint64)
        self._seen_at = np.zeros(0, np.int64)
        self._seen_n = np.zeros(0, np.int64)
        self._seen_ids = np.zeros(0, np.int32)

    def _probe(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Score (minus infinity if there is no such piece) and id of hashed substrings."""
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.scores[at], -np.inf), self.ids[at]

    def merge(self, codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """As viterbi, but by merges: the best pair of each word, the leftmost of equals, until none is a piece."""
        n = len(starts)
        values = _values(codes[starts[:, None] + np.arange(length)]).ravel()
        bounds = np.arange(n)[:, None] * length + np.arange(length + 1)  # of the words that still merge
        score, _ = self._probe(span_hashes(values, bounds[:, :-2].ravel(), bounds[:, 2:].ravel()))
        score = score.reshape(n, length - 1)
        begin, end = [], []
        while True:
            pick = score.argmax(1) if score.shape[1] else np.zeros(len(score), int)
            going = score[np.arange(len(score)), pick] > -np.inf if score.shape[1] else np.zeros(len(score), bool)
            begin.append(bounds[~going, :-1].ravel())
            end.append(bounds[~going, 1:].ravel())
            if not going.any():
                break
            bounds, score, pick = bounds[going], score[going], pick[going]
            row, k = np.arange(len(bounds)), bounds.shape[1] - 2
            keep = np.ones(bounds.shape, bool)
            keep[row, pick + 1] = False
            bounds = bounds[keep].reshape(len(row), k + 1)
            keep = np.ones(score.shape, bool)
            keep[row, pick] = False
            score = score[keep].reshape(len(row), k - 1)
            for left in (pick - 1, pick):  # the pairs on both sides of the new symbol
                at = row[(left >= 0) & (left < k - 1)]
                pair = left[at]
                score[at, pair] = self._probe(span_hashes(values, bounds[at, pair], bounds[at, pair + 2]))[0]
        begin, end = np.concatenate(begin), np.concatenate(end)
        order = np.argsort(begin)
        begin, end = begin[order], end[order]
        found, ids = self._probe(span_hashes(values, begin, end))
        flat = codes[starts[:, None] + np.arange(length)].ravel()
        return np.where(np.isfinite(found), ids, -1 - flat[begin].astype(np.int32)), begin // length

    def viterbi(self, codes: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of words of one length: (flat ids, in order; the word of each). Unknown characters are -1 - code.

        The largest sum of scores wins, and of equal sums the longer last piece.
        """
        n, most = len(starts), min(length, self.longest)
        values = _values(codes[starts[:, None] + np.arange(length)]).ravel()
        rows = np.arange(n) * length
        best = np.full((n, length + 1), -np.inf)
        best[:, 0] = 0
        back = np.zeros((n, length + 1), np.int32)
        piece = np.zeros((n, length + 1), np.int32)
        for end in range(1, length + 1):
            sizes = np.arange(min(end, most), 0, -1)  # the longest first, so that it wins ties
            begin = (rows[:, None] + (end - sizes)[None, :]).ravel()
            stop = np.repeat(rows + end, len(sizes))
            hashes = span_hashes(values, begin, stop)
            score, ids = (x.reshape(n, -1) for x in self._probe(hashes))
            alone = np.isinf(score[:, -1])
            score[alone, -1] = self.unknown_score
            ids[alone, -1] = -1 - codes[starts[alone] + end - 1].astype(np.int32)
            total = best[:, end - sizes] + score
            pick = total.argmax(1)
            best[:, end] = total[np.arange(n), pick]
            back[:, end] = sizes[pick]
            piece[:, end] = ids[np.arange(n), pick]
        used = np.zeros((n, length + 1), bool)
        pos, live = np.full(n, length), np.arange(n)
        while len(live):
            used[live, pos[live]] = True
            pos[live] -= back[live, pos[live]]
            live = live[pos[live] > 0]
        return piece[used], np.nonzero(used)[0]

    def _encode_words(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words, with bytes for what is unknown: (flat ids, number of each word)."""
        flat, owner = [], []
        for length in np.unique(lengths):
            words = np.flatnonzero(lengths == length)
            step = max(1, BATCH_CELLS // int(length * min(length, self.longest)))
            for at in range(0, len(words), step):
                part = words[at : at + step]
                ids, own = (self.merge if self.merges_pairs else self.viterbi)(codes, starts[part], int(length))
                flat.append(ids)
                owner.append(part[own])
        ids, own = np.concatenate(flat), np.concatenate(owner)
        order = np.argsort(own, kind="stable")
        ids, own = ids[order], own[order]
        for at in np.flatnonzero(ids < 0)[::-1] if (ids < 0).sum() <= 64 else []:
            new = self._bytes_of(-1 - int(ids[at]))
            ids = np.concatenate([ids[:at], new, ids[at + 1 :]])
            own = np.concatenate([own[:at], np.full(len(new), own[at]), own[at + 1 :]])
        if (ids < 0).any():
            parts = [self._bytes_of(-1 - i) if i < 0 else np.array([i], np.int32) for i in ids.tolist()]
            own = np.repeat(own, [len(p) for p in parts])
            ids = np.concatenate(parts)
        return ids, np.bincount(own, minlength=len(lengths))

    def _bytes_of(self, code: int) -> np.ndarray:
        return self.byte_ids[list(chr(_MARK if code == _LITERAL else code).encode())]

    def encode(self, texts: pa.Array) -> pa.Array:
        """list<int32>; null for null texts, no pieces for empty ones."""
        flat, counts = [], []
        for _, data, offsets in text_chunks(texts):
            n = len(offsets) - 1
            codes = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
            at = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
            sizes = np.diff(at)
            codes = np.where(codes == _MARK, _LITERAL, np.where(codes == 0x20, _MARK, codes)).astype(np.uint32)
            full = np.flatnonzero(sizes > 0)
            padded = np.full(len(codes) + len(full), _MARK, np.uint32)  # the dummy prefix of each text
            rank = np.zeros(n, np.int64)
            rank[full] = np.arange(1, len(full) + 1)
            padded[np.arange(len(codes)) + np.repeat(rank, sizes)] = codes
            opens = np.zeros(len(padded), bool)
            firsts = at[full] + np.arange(len(full))
            opens[firsts] = True
            if len(padded):
                mark, single = padded == _MARK, ~self.joins[padded]
                opens[1:] |= (mark[1:] & ~mark[:-1]) | single[1:] | single[:-1]
            starts = np.flatnonzero(opens)
            ends = np.append(starts[1:], len(padded)).astype(np.int64) if len(starts) else starts
            ids, word_sizes = self._encode_all(padded, starts, ends)
            sums = np.concatenate([[0], np.cumsum(word_sizes)])
            per_text = np.zeros(n, np.int64)
            cuts = np.searchsorted(starts, np.append(firsts, len(padded)))
            per_text[full] = np.diff(sums[cuts])
            flat.append(ids)
            counts.append(per_text)
        ids = np.concatenate(flat) if flat else np.zeros(0, np.int32)
        offsets = np.concatenate([[0], np.cumsum(np.concatenate(counts))]) if counts else np.zeros(1)
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids), mask=texts.is_null())

    def _encode_all(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words of a slice, repeats included, through the words already seen."""
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        hashes = span_hashes(_values(codes), starts, ends)
        distinct, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self._seen) > CACHE_WORDS:
            self.forget()
        at = np.minimum(np.searchsorted(self._seen, distinct), max(len(self._seen) - 1, 0))
        known = self._seen[at] == distinct if len(self._seen) else np.zeros(len(distinct), bool)
        if not known.all():
            new = first[~known]
            ids, sizes = self._encode_words(codes, starts[new], ends[new] - starts[new])
            seen_at = np.concatenate([self._seen_at, len(self._seen_ids) + np.cumsum(sizes) - sizes])
            seen_n = np.concatenate([self._seen_n, sizes])
            seen = np.concatenate([self._seen, distinct[~known]])
            order = np.argsort(seen, kind="stable")
            self._seen, self._seen_at, self._seen_n = seen[order], seen_at[order], seen_n[order]
            self._seen_ids = np.concatenate([self._seen_ids, ids])
            at = np.searchsorted(self._seen, distinct)
        word = at[inverse]
        sizes = self._seen_n[word]
        return self._seen_ids[_ragged(self._seen_at[word], sizes)], sizes

    def decode(self, ids: pa.Array) -> pa.Array:
        """The text of each id list; null for null. Broken UTF-8 and ids outside the model give U+FFFD."""
        flat = ids.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        counts = np.nan_to_num(np.asarray(pc.list_value_length(ids).fill_null(0)), nan=0).astype(np.int64)
        ok = (flat >= 0) & (flat < len(self.piece_sizes))
        known = np.where(ok, flat, 0)
        texts = []
        cuts = np.concatenate([[0], np.cumsum(counts)])
        for row, valid in enumerate(ids.is_valid().to_pylist()):
            part = slice(cuts[row], cuts[row + 1])
            if not valid:
                texts.append(None)
                continue
            good = known[part]
            data = self.piece_bytes[_ragged(self.piece_starts[good], self.piece_sizes[good])].tobytes() if ok[part].all() else b"".join(
                self.piece_bytes[self.piece_starts[i] : self.piece_starts[i] + self.piece_sizes[i]].tobytes() if k else "�".encode() for i, k in zip(good, ok[part], strict=True)
            )
            texts.append(data.decode(errors="replace").removeprefix(" "))
        return pa.array(texts, pa.string())


def encode_column(spark: SparkSession, model: PieceModel, text: Column) -> Column:
    """array<int> of a text's piece ids; null for null, empty for the empty text."""
    sent = spark.sparkContext.broadcast(model)  # as large as the model file

    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        return sent.value.encode(texts)

    return encode.asNondeterministic()(text)  # keeps the optimiser from repeating it


def decode_column(spark: SparkSession, model: PieceModel, ids: Column) -> Column:
    """The text of an array<int> of piece ids."""
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    def decode(values: pa.Array) -> pa.Array:
        return sent.value.decode(values)

    return decode.asNondeterministic()(ids)


def _slices(texts: pa.Array) -> Iterator[pa.Array]:
    """The texts in slices of at most SLICE_ROWS rows and SLICE_BYTES bytes, one text at least."""
    upto = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(upto[at - 1]) if at else 0
        end = min(at + SLICE_ROWS, max(at + 1, int(np.searchsorted(upto, before + SLICE_BYTES, "right"))))
        yield texts.slice(at, end - at)
        at = end


def encode_decode(df: DataFrame, text: str, model_path: str = MODEL_PATH) -> DataFrame:
    """df with piece_ids, n_pieces and round_trip (the ids decode to exactly the text).

    All columns of df stay; if one has a new column's name, the new one gets an
    underscore more.  Null texts have null ids and a null round_trip, repeated rows
    equal results.  Texts of any length are encoded and decoded whole, in one pass,
    at most SLICE_ROWS of them and SLICE_BYTES of text at a time; only a text that is
    longer by itself makes a larger slice.
    Of pairs with equal scores the leftmost merges first.
    """
    sent = df.sparkSession.sparkContext.broadcast(PieceModel(model_path))

    @F.arrow_udf("struct<ids: array<int>, same: boolean>")
    def both(texts: pa.Array) -> pa.Array:
        found = []
        for part in _slices(texts):
            ids = sent.value.encode(part)
            found.append(pa.StructArray.from_arrays([ids, pc.equal(sent.value.decode(ids), part.cast(pa.string()))], ["ids", "same"]))
        return pa.concat_arrays(found) if found else pa.array([], pa.struct([("ids", pa.list_(pa.int32())), ("same", pa.bool_())]))

    done = df.select(F.struct("*").alias("row"), both.asNondeterministic()(F.col(text)).alias("found"))
    new = {"piece_ids": F.col("found.ids"), "n_pieces": F.size("found.ids").cast("long"), "round_trip": F.col("found.same")}
    return done.select("row.*", *[c.alias(free_name(df, n)) for n, c in new.items()])


def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The piece ids of every document, and whether they decode to its text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_decode(docs, "text").select("doc_id", "n_pieces", "round_trip", "piece_ids")
