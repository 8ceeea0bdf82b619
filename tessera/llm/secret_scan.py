"""Secrets in texts: fixed patterns, and a linear-chain conditional random field that adds to them.

The patterns' spans always stay.  The field tags every token of a text as the
beginning or the inside of a secret or as outside of one.  Tokens are runs of
letters and digits, and single signs; a token is seen by its shape (length, kinds of
characters, changes between them, vowels), by its neighbouring words and their
shapes, and by what the whole text is like (digits, lines, words such as
"password").  Each of these is one entry of a table of weights, so that scores of
all tokens of a batch are a few numpy look-ups.

The best tags are those of the Viterbi search.  A token that lies in no run of tags
other than outside which could be worth as much as outside throughout is outside on
every best path; such tokens, nearly all, part a text into short open segments, and
the search runs over all segments at once.  This changes no result.

The field is trained here on a bounded sample of documents, labelled by the patterns.
As it shall find what the patterns miss, each secret of the sample is also shown with
other values of other alphabets after other words, and with plain words in its place.
"""

from __future__ import annotations

import random
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.wordarrays import BYTE_VALUE, LOWER, span_hashes, text_chunks

# The kinds of patterns in their order, and their least lengths.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 12, 18, 16
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")

FIELD = "crf"
LEAST_FIELD = 12  # code points of a span that the field adds
#: The sample: of about FIT_SCAN documents, chosen by hash, at most FIT_DOCS with secrets and as many without, each of at most FIT_BYTES.
FIT_SCAN, FIT_DOCS, FIT_BYTES = 20_000, 100, 6_144
ROUNDS, PENALTY = 60, 0.3  # of the training, at most; on the squares of the weights
WINDOW = 64  # tokens of a training sequence
MADE = 300  # examples made of the sample's secrets, about; 2 to 8 of each
AROUND = 160  # bytes around a secret in the examples made of it
TOKENS = 1 << 18  # scored at once

O, B, I = range(3)
_HASHED = 2048


@dataclass
class Field:
    """Weights of features by tag, and of tags by the tag before."""

    weights: np.ndarray  # float32 [features, 3]
    moves: np.ndarray  # float32 [3, 3]


def base_spans(data: bytes) -> list[tuple[int, int, str, int]]:
    """(start, end, kind, start of the secret itself) in bytes, leftmost and non-overlapping for each kind."""
    found = [(m.start(), m.end(), "assign", m.start(2)) for m in ASSIGN.finditer(data) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [(m.start(), m.end(), "access", m.start()) for m in ACCESS.finditer(data) if m.end() - m.start() >= LEAST_ACCESS]
    found += [(m.start(), m.end(), "hex", m.start()) for m in re.finditer(rb"[0-9a-f]{%d,}" % LEAST_HEX, data)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True


def _rows_with_secrets(data: np.ndarray, offsets: np.ndarray) -> set[int]:
    """Texts of a slice that may hold a pattern: those with a long run of hex digits or one of the patterns' words."""
    hexes = np.flatnonzero(np.diff(np.concatenate([[False], _HEX[data], [False]]).astype(np.int8)))
    starts, ends = hexes[::2], hexes[1::2]
    places = [starts[ends - starts >= LEAST_HEX]]
    for low, words in ((LOWER[data].tobytes(), KEYWORDS), (data.tobytes(), (b"AKIA",))):
        for word in words:
            at, hits = low.find(word), []
            while at >= 0:
                hits.append(at)
                nearest = int(np.searchsorted(offsets, at, "right"))
                at = low.find(word, int(offsets[nearest])) if nearest < len(offsets) else -1
            places.append(np.array(hits, np.int64))
    rows = np.searchsorted(offsets, np.concatenate(places), "right") - 1
    # A run of digits may belong to two texts.
    first = {*rows.tolist(), *(np.searchsorted(offsets, ends[ends - starts >= LEAST_HEX] - 1, "right") - 1).tolist()}
    return {r + d for r in first for d in (0, 1) if r + d < len(offsets) - 1}


# Kinds of bytes: separators, letters and digits (all bytes of non-ASCII characters too), signs.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*range(0x21), 0x7F]] = 0
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1
_SORT = np.zeros(256, np.uint8)  # digits, lower case, upper case, beyond ASCII
for _value, _span in ((1, range(0x30, 0x3A)), (2, range(0x61, 0x7B)), (3, range(0x41, 0x5B)), (4, range(0x80, 0x100))):
    _SORT[[*_span]] = _value
_FIELD_BITS = 10
_GIANT = (1 << _FIELD_BITS) - 1  # bytes of a token beyond which its characters are not counted
_COUNTED = np.zeros(256, np.uint64)  # counts of digits, lower case, upper case, beyond ASCII, vowels, ten bits each
for _sort in (1, 2, 3, 4):
    _COUNTED[_SORT == _sort] += np.uint64(1 << (_FIELD_BITS * (_sort - 1)))
_COUNTED[[*b"aeiouAEIOU"]] += np.uint64(1 << (_FIELD_BITS * 4))
_LENGTHS = np.array([2, 3, 4, 5, 7, 9, 12, 16, 20, 24, 32, 40, 48])
_N_LENGTHS = len(_LENGTHS) + 1

#: Sizes of the feature groups, in the order of features().
GROUPS = (16 * _N_LENGTHS, 6 * _N_LENGTHS, 8 * _N_LENGTHS, 6 * _N_LENGTHS, 256 * 4, 64, _HASHED, _HASHED, _HASHED, _HASHED, _HASHED, 256 * 2, 256 * 2, 64 * 16)
_OFFSETS = np.cumsum([0, *GROUPS])


@dataclass
class Tokens:
    """Tokens of a slice of texts, with what features are made of."""

    starts: np.ndarray
    ends: np.ndarray
    rows: np.ndarray
    words: np.ndarray  # hash below _HASHED, from 1
    shapes: np.ndarray  # characters' sorts and length, below 256
    counts: list[np.ndarray]  # digits, lower, upper, beyond ASCII, vowels, changes
    signs: np.ndarray  # the byte of a sign, else 0
    file: np.ndarray  # of each text, below 64


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    kind = _KIND[data]
    word, sign = kind == 1, kind == 2
    opens = np.zeros(len(data) + 1, bool)
    opens[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = word[:-1]
    begins = sign | (word & (~before | opens[:-1]))
    after = np.zeros(len(data), bool)
    after[:-1] = word[1:]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(sign | (word & (~after | opens[1:]))) + 1
    sort = _SORT[data]
    changes = np.zeros(len(data), bool)
    changes[1:] = sort[1:] != sort[:-1]
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_COUNTED[data] + (changes & ~begins).astype(np.uint64) * np.uint64(1 << (_FIELD_BITS * 5)), out=sums[1:])
    packed, size = sums[ends] - sums[starts], ends - starts
    packed[size > _GIANT] = 0
    counts = [((packed >> np.uint64(_FIELD_BITS * i)) & np.uint64(_GIANT)).astype(np.int32) for i in range(6)]
    form = sum((counts[i] > 0).astype(np.int16) << i for i in range(4)) if len(starts) else np.zeros(0, np.int16)
    shapes = form * 16 + np.searchsorted(_LENGTHS, size, "right").astype(np.int16)
    words = (span_hashes(BYTE_VALUE[LOWER[data]], starts, ends) % np.uint64(_HASHED - 1)).astype(np.int32) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    signs = np.where(sign[starts], data[starts], 0)

    sizes = np.maximum(np.diff(offsets), 1)
    per_text = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    digits = np.minimum(per_text(sort == 1) * 20 // sizes, 3)
    lines = np.searchsorted([40, 120, 400], sizes // (per_text(data == 10) + 1), "right")
    asks = np.zeros(len(offsets) - 1, np.int64)
    low = LOWER[data].tobytes()
    for w in KEYWORDS:
        at = low.find(w)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            asks[row] = 1
            at = low.find(w, int(offsets[row + 1])) if row + 1 < len(offsets) else -1
    many = np.minimum(per_text(sign) * 10 // sizes, 1)
    return Tokens(starts, ends, rows, words, shapes, counts, signs, digits * 16 + lines * 4 + asks * 2 + many)


def features(t: Tokens, low: int, high: int) -> np.ndarray:
    """Entries of the weights' table for tokens low to high, [high - low, groups]."""
    n = len(t.starts)
    here = np.arange(low, high)
    size = t.ends[low:high] - t.starts[low:high]
    length, form = t.shapes[low:high] % 16, t.shapes[low:high] // 16
    digits, _, _, _, vowels, changes = (c[low:high] for c in t.counts)

    def near(step: int, values: np.ndarray) -> np.ndarray:
        """Values of the tokens so many places on, 0 beyond the text."""
        at = np.clip(here + step, 0, n - 1)
        inside = (here + step >= 0) & (here + step < n) & (t.rows[at] == t.rows[low:high])
        return np.where(inside, values[at], 0)

    glued_before = (near(-1, t.ends) == t.starts[low:high]) & (here > 0)
    glued_after = near(1, t.starts) == t.ends[low:high]
    glued = glued_before * 2 + glued_after
    own = np.where(size < LEAST_VALUE, t.words[low:high], 0)
    groups = [
        form * _N_LENGTHS + length,
        np.minimum(digits * 5 // size, 5) * _N_LENGTHS + length,
        np.minimum(changes, 7) * _N_LENGTHS + length,
        np.minimum(vowels * 8 // size, 5) * _N_LENGTHS + length,
        t.signs[low:high].astype(np.int32) * 4 + glued,
        glued * 16 + form,
        *(near(step, t.words) for step in (-1, -2, -3, 1)),
        own,
        near(-1, t.shapes) * 2 + glued_before,
        near(1, t.shapes) * 2 + glued_after,
        t.file[t.rows[low:high]] * 16 + form,
    ]
    return np.stack([g + o for g, o in zip(groups, _OFFSETS, strict=False)], 1).astype(np.int32)


def _scores(entries: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros((len(entries), 3), np.float32)
    for k in range(entries.shape[1]):
        out += weights[entries[:, k]]
    return out


def viterbi(scores: np.ndarray, moves: np.ndarray, firsts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Best tags of the sequences that begin at firsts in scores, [tokens, 3]; outside stands before and after each.

    All sequences advance together, and the shorter ones end on the way.
    """
    order = np.argsort(-lengths, kind="stable")
    firsts, lengths = firsts[order], lengths[order]
    live = np.searchsorted(-lengths, -np.arange(lengths[0]), "left") if len(lengths) else []  # sequences with more than k tokens
    back, tags = np.zeros(scores.shape, np.int8), np.zeros(len(scores), np.int8)
    best = moves[O] + scores[firsts]
    for k in range(1, len(live)):
        n = live[k]
        ways = best[:n, :, None] + moves[None]
        back[firsts[:n] + k] = ways.argmax(1)
        best[:n] = ways.max(1) + scores[firsts[:n] + k]
    tags[firsts + lengths - 1] = (best + moves[:, O]).argmax(1)
    for k in range(len(live) - 1, 0, -1):
        at = firsts[: live[k]] + k
        tags[at - 1] = back[at, tags[at]]
    return tags


def _may_gain(scores: np.ndarray, moves: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which tokens lie in a run of tags other than outside that may be worth as much as outside throughout.

    A run is worth at most the sum of its tokens' best scores against outside, with
    the best move between any two of them, and the best moves into and out of it.
    The best sums up to a token and from it on are running minima of prefix sums.
    """
    inner = moves[1:, 1:].max() - moves[O, O]
    edges = moves[O, 1:].max() + moves[1:, O].max() - 2 * moves[O, O] - inner
    worth = np.maximum(scores[:, B], scores[:, I]) - scores[:, O] + inner
    step = worth.astype(np.float64)
    first = np.append(True, rows[1:] != rows[:-1])
    runs = []
    for way, new in ((slice(None), first), (slice(None, None, -1), np.append(rows[:-1] != rows[1:], True)[::-1])):
        values = step[way]
        at = np.flatnonzero(new)
        best = np.empty_like(values)
        for low, high in zip(at, np.append(at[1:], len(values)), strict=True):
            sums = np.cumsum(values[low:high])
            best[low:high] = sums - np.minimum.accumulate(np.append(0.0, sums[:-1]))
        runs.append(best[way])
    return runs[0] + runs[1] - step + edges >= -1e-3


def tag(t: Tokens, field: Field) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, their tags) of all tokens that may not be outside; all others are."""
    scores = np.concatenate([_scores(features(t, low, min(low + TOKENS, len(t.starts))), field.weights) for low in range(0, len(t.starts), TOKENS)] or [np.zeros((0, 3), np.float32)])
    at = np.flatnonzero(_may_gain(scores, field.moves, t.rows)) if len(scores) else np.zeros(0, np.int64)
    parts = np.flatnonzero(np.append(True, (np.diff(at) != 1) | (np.diff(t.rows[at]) != 0))) if len(at) else at
    return at, viterbi(scores[at], field.moves, parts, np.diff(np.append(parts, len(at))))


def field_spans(t: Tokens, field: Field) -> list[tuple[int, int, int]]:
    """(text, start, end) in the slice's bytes; a secret's tokens stand without space between."""
    at, tags = tag(t, field)
    at, tags = at[tags != O], tags[tags != O]
    if not len(at):
        return []
    goes_on = np.zeros(len(at), bool)
    goes_on[1:] = (tags[1:] == I) & (np.diff(at) == 1) & (t.starts[at[1:]] == t.ends[at[:-1]]) & (t.rows[at[1:]] == t.rows[at[:-1]])
    first = np.flatnonzero(~goes_on)
    last = np.append(first[1:], len(at)) - 1
    return list(zip(t.rows[at[first]].tolist(), t.starts[at[first]].tolist(), t.ends[at[last]].tolist(), strict=True))


def _points(data: bytes) -> np.ndarray:
    """The number of code points before each byte."""
    return np.append(0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80))


def scan(texts: pa.Array, field: Field | None) -> Iterator[list[tuple[str, int, int]]]:
    """(kind, start, end) in code points for each text, by start, then kind, those of the field last."""
    for _, data, offsets in text_chunks(texts):
        n = len(offsets) - 1
        found: list[list[tuple[int, int, str]]] = [[] for _ in range(n)]
        for row in _rows_with_secrets(data, offsets):
            found[row] = [x[:3] for x in base_spans(data[offsets[row] : offsets[row + 1]].tobytes())]
        if field is not None:
            for row, start, end in field_spans(tokens_of(data, offsets), field):
                found[row].append((start - int(offsets[row]), end - int(offsets[row]), FIELD))
        for row, spans in enumerate(found):
            if not spans:
                yield []
                continue
            points = _points(data[offsets[row] : offsets[row + 1]].tobytes())
            fixed = [(k, int(points[s]), int(points[e])) for s, e, k in spans if k != FIELD]
            more = [(k, int(points[s]), int(points[e])) for s, e, k in spans if k == FIELD]
            more = [x for x in more if x[2] - x[1] >= LEAST_FIELD]
            yield sorted(fixed + more, key=lambda x: (x[1], (*KINDS, FIELD).index(x[0]), x[2]))


# ---- training

_ALPHABETS = ("abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/-_.", "0123456789abcdef", "0123456789ABCDEF", "0123456789")
_NAMES = ("password", "passwd", "secret", "token", "api_key", "apikey", "auth", "authorization", "bearer", "credential", "private_key", "access_key", "pwd", "signature", "session", "client_secret")
_JOINTS = (' = "', "=", ": ", ": '", ' := "', '="', " ", "\n", ' => "')


def _examples(texts: list[bytes]) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """(text, secrets) to learn from: the texts, and what else is made of their secrets."""
    pick, out = random.Random(7), []
    copies = min(max(MADE // max(1, sum(bool(base_spans(x)) for x in texts)), 2), 8)
    for text in texts:
        spans: list[tuple[int, int]] = []
        for _, end, _, start in sorted(base_spans(text), key=lambda x: (x[3], -x[1])):
            if spans and start < spans[-1][1]:
                spans[-1] = (spans[-1][0], max(spans[-1][1], end))
            else:
                spans.append((start, end))
        out.append((text, spans))
        words = text.split() or [b"word"]
        for (_, low), (start, end), (high, _) in zip([(0, 0), *spans], spans, [*spans[1:], (len(text), 0)], strict=False):  # up to the secrets before and after
            left, right = text[max(low, start - AROUND) : start], text[end : min(high, end + AROUND)]
            left = left[left.find(b" ") + 1 :]
            for _ in range(copies):
                value = "".join(pick.choices(pick.choice(_ALPHABETS), k=pick.randint(16, 64))).strip("+/-_.").encode()
                lead = left if pick.random() < 0.3 else b" ".join(pick.choices(words, k=6)) + f" {pick.choice(_NAMES)}{pick.choice(_JOINTS)}".encode()
                out.append((lead + value + right, [(len(lead), len(lead) + len(value))]))
                plain = pick.choice((b" ", b" ", b"/", b"_", b"-", b".")).join(pick.choices(words, k=pick.randint(1, 3)))
                if not base_spans(lead + plain + right):
                    out.append((lead + plain + right, []))
    return out


def fit(texts: list[bytes]) -> Field | None:
    """The field trained on these texts to the greatest likelihood of all tags, less a penalty; None if they hold no secret."""
    examples = _examples(texts)
    if not any(spans for _, spans in examples):
        return None
    data = np.frombuffer(b"".join(x for x, _ in examples), np.uint8)
    offsets = np.cumsum([0, *(len(x) for x, _ in examples)])
    t = tokens_of(data, offsets)
    entries = features(t, 0, len(t.starts))
    tags = np.zeros(len(t.starts), np.int8)
    for row, (_, spans) in enumerate(examples):
        for start, end in spans:
            low, high = np.searchsorted(t.starts, offsets[row] + np.array([start, end]))
            tags[low:high] = I
            tags[low : low + 1] = B
    # Windows of WINDOW tokens of one text each; what is missing in the last is left out of the sums.
    begins = np.flatnonzero(np.append(True, np.diff(t.rows) != 0))
    ends = np.append(begins[1:], len(t.rows))
    firsts = np.concatenate([np.arange(b, e, WINDOW) for b, e in zip(begins, ends, strict=True)])
    limits = np.minimum(firsts + WINDOW, np.repeat(ends, -(-(ends - begins) // WINDOW)))
    order = np.argsort(firsts - limits, kind="stable")  # long windows first
    firsts, sizes = firsts[order], (limits - firsts)[order]
    n = 3 * int(_OFFSETS[-1])
    real = np.zeros((len(tags), 3))
    real[np.arange(len(tags)), tags] = 1
    real_moves = _moves_made(tags, firsts, sizes)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        weights, moves = x[:n].reshape(-1, 3), x[n:].reshape(3, 3)
        score = np.zeros((len(tags), 3))
        for k in range(entries.shape[1]):
            score += weights[entries[:, k]]
        total, wrong, wrong_moves = _expected(score, moves, firsts, sizes)
        likely = (score * real).sum() + (moves * real_moves).sum() - total
        slope = np.append(np.stack([*_by_entry(entries, wrong - real)], 1).ravel(), (wrong_moves - real_moves).ravel())
        return PENALTY / 2 * (x @ x) - likely, slope + PENALTY * x

    x = _least(loss, np.zeros(n + 9), ROUNDS)
    return Field(x[:n].reshape(-1, 3).astype(np.float32), x[n:].reshape(3, 3).astype(np.float32))


def _least(loss: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """A minimum of a convex function by limited-memory quasi-Newton steps, each halved until the function falls enough."""
    value, slope = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, parts = -slope, []
        for s, y in reversed(past):
            part = (s @ way) / (s @ y)
            way -= part * y
            parts.append(part)
        if past:
            s, y = past[-1]
            way *= (s @ y) / (y @ y)
        else:
            way /= max(1.0, np.sqrt(slope @ slope))
        for (s, y), part in zip(past, reversed(parts), strict=True):
            way += (part - (y @ way) / (s @ y)) * s
        size, fall = 1.0, slope @ way
        while True:
            then, there = loss(x + size * way)
            if then <= value + 1e-4 * size * fall:
                break
            size /= 2
            if size < 1e-6:
                return x
        moved, turned = size * way, there - slope
        x, slope, gain, value = x + moved, there, value - then, then
        if moved @ turned > 1e-12:
            past = [*past[1 - memory :], (moved, turned)]
        if gain < 1e-4 * max(1.0, abs(value)):
            break
    return x


def _by_entry(entries: np.ndarray, values: np.ndarray) -> Iterator[np.ndarray]:
    flat = entries.ravel()
    for y in range(3):
        yield np.bincount(flat, np.repeat(values[:, y], entries.shape[1]), _OFFSETS[-1])


def _moves_made(tags: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """How often each tag follows each, outside standing before and after every window."""
    out = np.zeros((3, 3))
    starts = np.zeros(len(tags), bool)
    starts[firsts] = True
    inner = np.flatnonzero(~starts)
    np.add.at(out, (tags[inner - 1], tags[inner]), 1)
    np.add.at(out, (O, tags[firsts]), 1)
    np.add.at(out, (tags[firsts + sizes - 1], O), 1)
    return out


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def _expected(score: np.ndarray, moves: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """(log of all ways' weights, probability of each tag of each token, expected moves) by forward and backward sums; sizes fall."""
    longest = int(sizes[0])
    live = [int(np.searchsorted(-sizes, -k, "left")) for k in range(longest)]  # windows with more than k tokens
    ahead = [moves[O] + score[firsts]]
    for k in range(1, longest):
        ahead.append(_log_sum(ahead[-1][: live[k], :, None] + moves[None], 1) + score[firsts[: live[k]] + k])
    tags, made = np.zeros_like(score), np.zeros((3, 3))
    behind = np.zeros((0, 3))
    total = np.zeros(len(firsts))
    for k in range(longest - 1, -1, -1):
        n = live[k]
        full = np.tile(moves[:, O], (n, 1))
        m = live[k + 1] if k + 1 < longest else 0
        if m:
            onward = behind + score[firsts[:m] + k + 1]
            full[:m] = _log_sum(moves[None] + onward[:, None, :], 2)
        total[m:n] = _log_sum(ahead[k][m:n] + full[m:n], 1)
        if m:
            pairs = np.exp(ahead[k][:m, :, None] + moves[None] + onward[:, None, :] - total[:m, None, None])
            made += pairs.sum(0)
        share = np.exp(ahead[k][:n] + full - total[:n, None])
        tags[firsts[:n] + k] = share
        made[:, O] += share[m:n].sum(0)
        if k == 0:
            made[O] += share.sum(0)
        behind = full
    return float(total.sum()), tags, made


def fit_documents(df: DataFrame, text: str, scan_docs: int = FIT_SCAN, docs: int = FIT_DOCS, most_bytes: int = FIT_BYTES) -> Field | None:
    """The field trained on a bounded sample of df, chosen by the texts' hashes alone.

    About scan_docs texts of at most most_bytes bytes are looked at; of these, `docs`
    with a pattern's secret and as many without come to the driver.
    """
    texts = df.select(F.col(text).alias("text")).filter(F.octet_length("text").between(1, most_bytes))
    share = min(1.0, scan_docs / max(texts.count(), 1))
    order = F.xxhash64("text", F.lit(11))
    texts = texts.withColumn("order", F.shiftrightunsigned(order, 1)).filter(F.col("order") <= F.lit(min(int(share * 2**63), 2**63 - 1)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            has = [bool(base_spans(x.encode())) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(has)], [*batch.schema.names, "has"])

    seen = texts.select("text", "order").mapInArrow(look, "text string, order long, has boolean").distinct()
    picked = [r["text"].encode() for has in (True, False) for r in seen.filter(F.col("has") == has).orderBy("order", "text").limit(docs).collect()]  # at most docs * most_bytes bytes each
    return fit(picked)


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def find_secrets(df: DataFrame, key: str, text: str, field: Field | None) -> DataFrame:
    """(key, spans, n_field) for every row of df: spans of kind, start and end in code points, the end outside.

    The patterns' spans are all there; of the field's, kind `crf`, those that meet
    none of them.  n_field counts all spans of at least LEAST_FIELD code points that
    the field tags.  Null and empty texts have none; texts of any length are read
    whole, one at a time where they are long.  Null and repeated keys and repeated
    rows come back as they are, an empty table gives none, and without a field (no
    secret in its sample) the patterns stand alone.  Other columns, whatever their
    names, are not carried.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, tagged = [], []
            for all_ in scan(batch.column("text"), field):
                fixed = [x for x in all_ if x[0] != FIELD]
                kept = [x for x in all_ if x[0] != FIELD or all(x[2] <= s or e <= x[1] for _, s, e in fixed)]
                spans.append([dict(zip(("kind", "start", "end"), x, strict=True)) for x in kept])
                tagged.append(sum(x[0] == FIELD for x in all_))
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(spans, kind), pa.array(tagged, pa.int64())], ["key", "spans", "n_field"])

    schema = df.select(F.col(key).alias("key")).schema.add("spans", SPANS).add("n_field", "long")
    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(look, schema).withColumnRenamed("key", key)


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span of find_secrets replaced by its kind in angle brackets; overlapping spans go together."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("at"))

    def put(done: Column, span: Column) -> Column:
        fresh = F.concat(done["text"], F.substr(text, done["at"] + 1, F.greatest(span["start"] - done["at"], F.lit(0))), F.lit("<"), span["kind"], F.lit(">"))
        return F.struct(F.when(span["start"] >= done["at"], fresh).otherwise(done["text"]).alias("text"), F.greatest(done["at"], span["end"]).alias("at"))

    return F.aggregate(spans, start, put, lambda done: F.concat(done["text"], F.substr(text, done["at"] + 1)))


def span_list(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_secrets(docs, "doc_id", "text", fit_documents(docs, "text"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != FIELD)
    return found.select("doc_id", *map(count, (*KINDS, FIELD)), F.sha2(span_list(base).cast("binary"), 256).alias("base_sha256"), span_list(F.col("spans")).alias("spans"), "n_field")
