import math
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

from tessera.llm.chat_format import format_chats, read_back
from tessera.llm.katz import MAX_GT, score_documents
from tessera.llm.language_id import ORDERS, SMOOTHING, fit, fit_documents, held_out, language_of
from tessera.llm.pieces import MODEL_PATH, PieceModel, encode_decode
from tessera.llm.wordarrays import words_of


def test_words_of_splits_like_the_pattern():
    texts = [" a b\tc\x0bd\x1ce", None, "", "é x y", "end", "start  "]
    found = list(words_of(pa.array(texts), max_bytes=4))
    assert sum((w.per_row.tolist() for w in found), []) == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts]
    one, two = (next(words_of(pa.array([t]), lower=True)).hashes for t in ("The É", "tHE é"))
    assert one[0] == two[0] and one[1] != two[1]


def turns_by_hand(rows):
    chats = defaultdict(list)
    for c, turn, role, text in rows:
        chats[c].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in chats.items()}


def test_a_long_chat_and_clashing_columns(spark):
    """One conversation of 20,000 turns, beside columns named like the operator's own."""
    df = spark.range(20_000).select(F.lit(5).cast("long").alias("conv_id"), (F.col("id") % 9_000).alias("turn"), F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"), F.concat(F.lit("<t>"), F.col("id").cast("string")).alias("text"))
    df = df.withColumns({c: F.lit("x") for c in ("n", "opens", "parts", "span", "body", "before", "after", "loss", "formatted")})
    back = read_back(format_chats(df)).first()
    expected = turns_by_hand([(r["conv_id"], r["turn"], r["role"], r["text"]) for r in df.collect()])[5]
    assert [(t["role"], t["text"]) for t in back["turns"]] == expected
    assert back["loss_texts"] == [t for r, t in expected if r == "assistant"]


def test_chats_come_back(spark):
    nasty = ["</turn>\n", "<part>", "\\1", "\\", "<turn:assistant>x</turn>\n<turn:user>", "\\\\0", "", None, "\U0001f600\n"]
    rows = [(i % 4 or None, t % 5 if t % 7 else None, ["user", "assistant", "assistant", None, "a>b<c\\"][t % 5], x) for i in range(8) for t, x in enumerate(nasty)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in read_back(format_chats(df)).collect()}
    expected = turns_by_hand(rows)
    assert set(got) == set(expected)
    for c, turns in expected.items():
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == turns
        assert got[c]["loss_texts"] == [t for r, t in turns if r == "assistant"]
    assert format_chats(df.filter("false")).count() == 0


def katz_by_hand(rows, held):
    low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))
    texts = [[*re.findall(r"[^\x20\x09-\x0D]+", low(t)), "</s>"] for _, t in rows]
    words, pairs, after = Counter(), Counter(), defaultdict(set)
    for ts, h in zip(texts, held, strict=True):
        if not h:
            words.update(ts)
            pairs.update(zip(["</s>", *ts[:-1]], ts, strict=True))
    for v, w in pairs:
        after[v].add(w)
    n, types = sum(words.values()), len(words)

    def lowered(counts):
        of = Counter(counts.values())
        try:
            common = (MAX_GT + 1) * of[MAX_GT + 1] / of[1]
            f = {r: ((r + 1) * of[r + 1] / (of[r] * r) - common) / (1 - common) for r in range(1, MAX_GT + 1)}
        except ZeroDivisionError:
            f = {}
        if not f or not all(0 < x < 1 for x in f.values()):
            d = of[1] / (of[1] + 2 * of[2]) if of[1] and of[2] else 0.5
            f = {r: (r - d) / r for r in range(1, MAX_GT + 1)}
        amount = min(max(MAX_GT * (1 - f[MAX_GT]), 0.1), 0.9 * MAX_GT)
        return lambda c: f[c] * c if c <= MAX_GT else c - amount

    lw, lp = lowered(words), lowered(pairs)
    unknown = sum(c - lw(c) for c in words.values()) / n if n else 1.0
    p_word = lambda w: lw(words[w]) / n if w in words else unknown
    weight = {v: (1 - sum(lp(pairs[v, w]) / words[v] for w in ws)) / (1 - sum(p_word(w) for w in ws)) for v, ws in after.items()}
    every = math.fsum([*map(p_word, words), unknown])
    for v, ws in after.items():  # probabilities over all words and the unknown one add up
        rest = every - math.fsum(map(p_word, ws))
        assert math.isclose(sum(lp(pairs[v, w]) / words[v] for w in ws) + weight[v] * rest, 1, rel_tol=1e-9)
    out = []
    for (i, _), ts, h in zip(rows, texts, held, strict=True):
        score = sum(math.log10(lp(pairs[v, w]) / words[v] if (v, w) in pairs else weight.get(v, 1) * p_word(w)) for v, w in zip(["</s>", *ts[:-1]], ts, strict=True))
        base = sum(math.log10((words[w] + 1) / (n + types + 1)) for w in ts)
        out.append((i, h, len(ts), sum(w in words for w in ts), n, base, score))
    return out


def test_katz(odd_docs, spark, sf_dir):
    for df in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r["doc_id"], r["text"]) for r in df.collect()]
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
        got = score_documents(df, "doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2).collect()
        order = lambda r: (str(r[0]), r[2], round(r[6], 6))
        for a, b in zip(sorted(map(tuple, got), key=order), sorted(katz_by_hand(rows, held), key=order), strict=True):
            assert a[:5] == b[:5]
            assert a[5:] == pytest.approx(b[5:], rel=1e-9)


def test_katz_of_nothing(no_docs, odd_docs):
    assert score_documents(no_docs, "doc_id", "text", F.lit(False)).count() == 0
    untrained = score_documents(odd_docs, "doc_id", "text", F.lit(True)).collect()
    assert len(untrained) == odd_docs.count() and all(r["score"] == 0 and r["n_known"] == 0 for r in untrained)


def test_language_on_held_out(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = docs.select("lang", held_out("doc_id").alias("h"), language_of(spark, fit_documents(docs), F.col("text")).alias("p")).filter("h").collect()
    assert len(found) > 20
    assert sum(r["lang"] == r["p"]["lang_pred"] for r in found) >= 0.97 * len(found)
    assert all(0 <= r["p"]["score"] <= 1 for r in found)


def language_by_hand(rows, texts, langs):
    """(lang_pred, score, known share, words) of the texts by a model of the training part of all rows."""
    words_of_text = lambda t: re.findall(r"[^\W\d_]+", (t or "").lower())
    words = defaultdict(Counter)
    for r in rows:
        if r["text"] is not None and r["lang"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            words[r["lang"]].update(words_of_text(r["text"]))
    grams = {n: {k: Counter() for k in langs} for n in ORDERS}
    for k in langs:
        for w, c in words[k].items():
            p = f" {w} "
            for n in ORDERS:
                for i in range(len(p) - n + 1):
                    grams[n][k][p[i : i + n]] += c
    tables = {n: (grams[n], set().union(*grams[n].values())) for n in ORDERS} | {0: (words, set().union(*(words[k] for k in langs)))}
    total = {n: {k: sum(t[k].values()) for k in langs} for n, (t, _) in tables.items()}
    log = lambda n, k, s: math.log((tables[n][0][k][s] + SMOOTHING) / (total[n][k] + SMOOTHING * (len(tables[n][1]) + 1)))
    out = []
    for text in texts:
        found, score = words_of_text(text), dict.fromkeys(langs, 0.0)
        for w in found:
            for n in (0, *ORDERS):
                p = w if n == 0 else f" {w} "
                parts = [x for x in ([p] if n == 0 else [p[i : i + n] for i in range(len(p) - n + 1)]) if x in tables[n][1]]
                if parts:
                    for k in langs:
                        score[k] += sum(log(n, k, x) for x in parts) / len(parts)
                    break
        best = max(langs, key=lambda k: score[k])
        share = 1 / sum(math.exp(max(score[k] - score[best], -700)) for k in langs)
        out.append((best, share, sum(words[best][w] > 0 for w in found) / len(found), len(found)) if found else ("und", 0.0, 0.0, 0))
    return out


def test_language_by_hand(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.collect()
    model = fit_documents(docs)
    texts = [r["text"] for r in rows] + ["zzzqx", "", None, "der xqz la", "x" * 5000]
    got = model.predict(pa.array(texts, pa.string())).to_pylist()
    for a, (lang, score, known, words) in zip(got, language_by_hand(rows, texts, model.langs), strict=True):
        assert (a["lang_pred"], a["words"]) == (lang, words)
        assert (a["score"], a["known_share"]) == (pytest.approx(score, rel=1e-3, abs=1e-6), pytest.approx(known))


def test_language_edges(spark, odd_docs, no_docs):
    model = fit(odd_docs.filter("doc_id <> 5"), "doc_id", "text", "lang")  # 5 repeats one word 40,000 times
    got = {r["doc_id"]: r["p"] for r in odd_docs.select("doc_id", language_of(spark, model, F.col("text")).alias("p")).collect()}
    assert all(tuple(got[i]) == ("und", 0.0, 0.0, 0) for i in (2, 3, 6, 7, 9))
    assert got[1]["lang_pred"] == "en" and got[11]["lang_pred"] == "de"
    empty = fit(no_docs, "doc_id", "text", "lang")
    assert {r["p"]["lang_pred"] for r in odd_docs.select(language_of(spark, empty, F.col("text")).alias("p")).collect()} == {"und"}


def test_unseen_words_back_off_to_shorter_ngrams(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("zzaqu", "a"), ("zzapo", "a"), ("kkimo", "b"), ("kkine", "b")] * 3)]
    model = fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang")
    texts = pa.array(["zzaxx", "kkiii", "kzz", "?"])
    assert [x["lang_pred"] for x in model.predict(texts).to_pylist()] == ["a", "b", "a", "und"]


@pytest.fixture(scope="module")
def model():
    return PieceModel(MODEL_PATH)


NASTY = ["Hello  world\nfoo", " a", "", None, "a  ", "日本語ẞﬁ\t\U0001f600", "x" * 700 + " " + "ab" * 400, "   ", "\n", "áe", "word " * 5000]


def test_pieces_equal_the_library(model, spark, sf_dir):
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    texts = NASTY + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = model.encode(pa.array(texts)).to_pylist()
    assert ids == [None if t is None else own.encode(t) for t in texts]
    assert model.decode(pa.array(ids, pa.list_(pa.int32()))).to_pylist() == texts


def test_viterbi_finds_the_best_score(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL_PATH, "rb").read())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    path = tmp_path / "unigram.model"
    path.write_bytes(proto.SerializeToString())
    unigram, own = PieceModel(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = ["The quick brown fox jumps over the lazy dog", "antidisestablishmentarianism", "aaaaaaa bbbb", "Straße über Öl"]
    total = lambda ids: sum(own.get_score(i) for i in ids)
    for text, ids in zip(texts, unigram.encode(pa.array(texts)).to_pylist(), strict=True):
        assert own.decode(ids) == text
        assert total(ids) >= total(own.encode(text)) - 1e-3


def test_decode_of_odd_ids(model):
    assert model.decode(pa.array([[0], [1, 2], [99999], [-1], [None], []], pa.list_(pa.int32()))).to_pylist() == ["⁇ ", "", "�", "�", "�", ""]


def test_round_trip(odd_docs, no_docs):
    out = encode_decode(odd_docs, "text")
    assert set(odd_docs.columns) < set(out.columns)
    for r in out.collect():
        assert r["round_trip"] is (None if r["text"] is None else True)
        assert (r["piece_ids"] is None) == (r["text"] is None)
    assert encode_decode(no_docs, "text").count() == 0
    own = odd_docs.select("doc_id", "text", F.lit(1).alias("n_pieces"), F.lit(2).alias("Found"))
    assert encode_decode(own, "text").columns == [*own.columns, "piece_ids", "n_pieces_", "round_trip"]
    twice = own.union(own).filter("doc_id = 1")
    assert len({tuple(r["piece_ids"]) for r in encode_decode(twice, "text").collect()}) == 1


def test_slices_by_rows_and_bytes(monkeypatch):
    """No slice holds more bytes than allowed unless it is one text; all texts come, in order."""
    from tessera.llm import pieces

    texts = ["é" * 30, None, "", "x" * 500, *["word"] * 40, "y" * 99, "z"] * 3
    for rows, size in ((7, 1 << 20), (1000, 100), (3, 1)):
        monkeypatch.setattr(pieces, "SLICE_ROWS", rows)
        monkeypatch.setattr(pieces, "SLICE_BYTES", size)
        parts = [p.to_pylist() for p in pieces._slices(pa.array(texts))]
        assert [t for p in parts for t in p] == texts
        assert all(len(p) == 1 or (len(p) <= rows and sum(len((t or "").encode()) for t in p) <= size) for p in parts)
    assert list(pieces._slices(pa.array([], pa.string()))) == []


def test_models_that_change_texts_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    proto.ParseFromString(open(MODEL_PATH, "rb").read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    path = tmp_path / "strict.model"
    path.write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        PieceModel(str(path))

