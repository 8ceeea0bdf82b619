import random
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_near_duplicates import groups_by_hand
from test_sharding_mixing_lines import mix_by_hand
from test_texts import language_by_hand

from tessera.llm.language_id import fit_documents
from tessera.llm.line_dedup import MAX_SHARE, MIN_PAGES
from tessera.llm.pieces import MODEL_PATH


def test_stages(spark, odd_docs, sf_dir):
    docs = odd_docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert docs.columns == odd_docs.columns, name
    assert {r["doc_id"] for r in docs.collect()} <= {1, 5, 8, 10, 11, None}
    done = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    assert all(r["round_trip"] for r in done.collect())


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stage_of_nothing(spark, no_docs, sf_dir, stage):
    assert stage(spark, no_docs, sf_dir).count() == 0


def test_unknown_languages_go(spark, sf_dir):
    """Long gibberish and a language that the fit has not seen are rejected, however long they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumns({"row": F.lit(1), "found": F.lit(2), "_language": F.lit(3)})
    rng = random.Random(4)
    nonsense = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 11))) for _ in range(n)) for n in (40, 400, 20_000)]
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate(nonsense)], "doc_id long, text string, lang string")
    german = F.when(F.col("lang") != "de", F.col("lang"))
    both = docs.withColumn("lang", german).unionByName(more, allowMissingColumns=True)
    kept = corpus_pipeline.known_language(spark, both, sf_dir)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    letters = docs.filter(F.col("text").rlike(r"\p{L}") & (F.size(F.split("text", " ")) > 3))
    assert ids == {r["doc_id"] for r in docs.filter("lang <> 'de' and text rlike '\\\\p{L}'").collect()} | (ids & {r["doc_id"] for r in docs.filter("lang = 'de'").collect()})
    assert len(ids & {r["doc_id"] for r in letters.filter("lang = 'de'").collect()}) <= 1


def without_boilerplate_by_hand(rows):
    pages, found = Counter(r["source"] for r in rows), defaultdict(Counter)
    for r in rows:
        found[r["source"]].update({x.strip(" ") for x in (r["text"] or "").split("\n")} - {""})
    bad = {h: {x for x, n in c.items() if n >= MIN_PAGES and n > MAX_SHARE * pages[h]} for h, c in found.items()}
    return [r | {"text": None if r["text"] is None else "\n".join(x for x in r["text"].split("\n") if x.strip(" ") not in bad[r["source"]])} for r in rows]


def test_run_equals_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r.asDict() for r in docs.collect()]
    model = fit_documents(docs)
    found = language_by_hand(rows, [r["text"] for r in rows], model.langs)
    half = corpus_pipeline.PRIOR_WORDS / 2
    rows = [r for r, (lang, _, known, words) in zip(rows, found, strict=True) if lang != "und" and (known * words + half) / (words + 2 * half) >= corpus_pipeline.MIN_KNOWN]
    assert len(rows) == docs.filter(r"text rlike '\\p{L}'").count()  # all clean documents stay
    rows = without_boilerplate_by_hand(rows)
    group = groups_by_hand([(r["doc_id"], r["text"]) for r in rows])
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    taken = {i: n // size if size else 0 for i, _, size, _, n in mix_by_hand([(r["doc_id"], r["text"], r["source"]) for r in rows])}
    own = sentencepiece.SentencePieceProcessor(model_file=MODEL_PATH)
    expected = sorted((r["doc_id"], r["text"], tuple(own.encode(r["text"])), True) for r in rows for _ in range(taken[r["doc_id"]]))
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [*docs.columns, "piece_ids", "n_pieces", "round_trip"]
    assert sorted((r["doc_id"], r["text"], tuple(r["piece_ids"]), r["round_trip"]) for r in got.collect()) == expected
