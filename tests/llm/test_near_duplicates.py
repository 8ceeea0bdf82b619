import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import minhash
from tessera.llm.components import components
from tessera.llm.minhash import drop_near_duplicates, near_duplicates, probability_jaccard, shingles, signatures
from tessera.llm.mtree import top_products
from tessera.llm.nn_descent import near_duplicate_vectors


class Sets:
    def __init__(self, ids):
        self.up = {i: i for i in ids}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(i, 0) for i in range(1, 50)], [(1, 1), (2, None), (5, 3), (3, 5), (9, 5)], [(i, (i * 7) % 31) for i in range(31)]])
def test_components(spark, links):
    df = spark.createDataFrame(links or [(None, None)], "a long, b long")
    got = {r["id"]: r["component_id"] for r in components(df, "a", "b").collect()}
    real = [(a, b) for a, b in links if a is not None and b is not None and a != b]
    sets = Sets({x for e in real for x in e})
    for a, b in real:
        sets.join(a, b)
    assert got == {x: sets.find(x) for x in sets.up}


def weighted(words, k=5):
    return Counter(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))) if words else Counter()


def similarity_by_hand(a, b):
    return sum(1 / sum(max(a[e] / a[d], b[e] / b[d]) for e in a.keys() | b.keys()) for d in a.keys() & b.keys())


def test_probability_jaccard_is_exact():
    rng = random.Random(5)
    for _ in range(20):
        a, b = ([rng.choice("abcdefg") for _ in range(rng.randrange(1, 60))] for _ in range(2))
        got = []
        for _, n, row, value, count in shingles(pa.array([" ".join(a), " ".join(b)])):
            got = [(value[row == r], count[row == r]) for r in range(n)]
        assert probability_jaccard(*got) == pytest.approx(similarity_by_hand(weighted(a), weighted(b)))


def test_signatures_estimate_similarity():
    rng = random.Random(3)
    a = [rng.choice("abcdefghijklmnop") * 3 for _ in range(400)]
    b = a[:350] + [rng.choice("qrstuv") for _ in range(50)]
    _, n, row, value, count = next(shingles(pa.array([" ".join(a), " ".join(b), "", "one"])))
    s = signatures(n, row, value, count, 4000)
    true = similarity_by_hand(weighted(a), weighted(b))
    assert (s[0] == s[1]).mean() == pytest.approx(true, abs=4 * math.sqrt(true * (1 - true) / 4000))
    assert not s[2].any() and len(set(s[3].tolist())) == 1


def groups_by_hand(rows, threshold=0.8):
    texts = {}
    for i, t in rows:
        if i is not None and t is not None:
            texts[i] = t
    sets = Sets(texts)
    bags = {i: weighted(t.split()) for i, t in texts.items()}
    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            near = bags[a] and bags[b] and min(len(bags[a]), len(bags[b])) >= 0.3 * max(len(bags[a]), len(bags[b])) and bags[a].keys() & bags[b].keys() and similarity_by_hand(bags[a], bags[b]) >= threshold
            if texts[a] == texts[b] or near:
                sets.join(a, b)
    return {i: sets.find(i) for i in texts}


@pytest.fixture(scope="module")
def copies(spark):
    """Groups of near copies around the threshold, one of them large, and texts apart from all."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for group, n in enumerate([2, 3, 5, 60, 1, 1, 1]):
        base = [rng.choice(words) for _ in range(60)]
        for k in range(n):
            text = list(base)
            for _ in range(k % 4):
                text[rng.randrange(60)] = f"x{group}{k}"
            rows.append((group * 1000 + k, " ".join(text)))
    rows += [(9000, rows[0][1]), (9001, "few words"), (9002, "few  words"), (9003, "few"), (9004, ""), (9005, ""), (9006, None), (9007, None), (None, rows[0][1]), (9008, "a " * 300), (9009, "a " * 290)]
    return spark.createDataFrame(rows, "doc_id long, text string"), rows


def test_near_duplicates(copies):
    df, rows = copies
    got = near_duplicates(df, "doc_id", "text").collect()
    assert len(got) == len(rows)
    found = {r["doc_id"]: r["component_id"] for r in got if r["doc_id"] is not None}
    assert {i: found[i] for i in groups_by_hand(rows)} == groups_by_hand(rows)
    assert found[9006] == 9006 and found[9007] == 9007
    assert next(r for r in got if r["doc_id"] is None)["kept"]


def bucket_mates(n, rng, words=400, size=60, shared=0.87):
    """Texts that share a passage and little else: near in the passage's bands, below the threshold as a whole."""
    passage = [f"p{i}" for i in range(int(size * shared))]
    return [" ".join(passage + [f"w{rng.randrange(words)}" for _ in range(size - len(passage))]) for _ in range(n)]


@pytest.mark.parametrize(("block", "size"), [(1024, 1), (2, 1 << 40)])
def test_blocks_without_members(spark, copies, monkeypatch, block, size):
    """Buckets cut into as many blocks as members, by count or by bytes, so that some blocks stay empty."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "BLOCK_BYTES", size)
    rows = copies[1] + [(20_000 + i, t) for i, t in enumerate(bucket_mates(40, random.Random(8)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, "doc_id", "text").collect() if r["doc_id"] is not None}
    expected = groups_by_hand(rows)
    assert {i: found[i] for i in expected} == expected


def test_few_long_texts(spark):
    """Four texts of 12.5 MB, all below the threshold to each other, and one near copy."""
    n = 1_560_000
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.when(i < int(0.87 * n), F.substring(F.hex(F.xxhash64(i)), 1, 7)).otherwise(F.substring(F.hex(F.xxhash64(i, F.col("salt"))), 1, 7))))
    df = spark.range(5).select("id", F.least("id", F.lit(3)).alias("salt")).select("id", text.alias("text")).withColumn("text", F.when(F.col("id") == 4, F.concat("text", F.lit(" more"))).otherwise(F.col("text")))
    assert df.agg(F.min(F.length("text"))).first()[0] > 12_000_000
    found = {r["id"]: r["component_id"] for r in near_duplicates(df, "id", "text").collect()}
    assert found == {0: 0, 1: 1, 2: 2, 3: 3, 4: 3}


def test_near_duplicates_on_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, "doc_id", "text").collect()}
    assert got == groups_by_hand([(r["doc_id"], r["text"]) for r in df.collect()])


def test_one_of_each_group_stays(odd_docs, no_docs):
    out = drop_near_duplicates(odd_docs, "doc_id", "text")
    assert out.columns == odd_docs.columns
    assert sorted((r["doc_id"] for r in out.collect()), key=lambda x: (x is None, x)) == [1, 2, 3, 5, 6, 7, 8, 9, 10, 11, None]
    only = drop_near_duplicates(odd_docs.filter("doc_id = 4"), "doc_id", "text")
    assert only.count() == 1
    assert near_duplicates(no_docs, "doc_id", "text").count() == 0
    assert drop_near_duplicates(no_docs, "doc_id", "text").count() == 0


def test_keys_with_several_texts(spark):
    """A text goes or stays by itself, whatever else stands under its key."""
    a, b, c = (" ".join(f"{w}{i}" for i in range(40)) for w in "abc")
    near = b.replace("b39", "b40")
    rows = [(1, a), (4, a), (4, b), (1, c), (4, near), (4, near), (7, None), (7, None), (9, b)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "at": F.lit(2), "uid": F.lit(3), "has_text": F.lit(4)})
    out = drop_near_duplicates(df, "doc_id", "text")
    assert out.columns == df.columns
    kept = sorted((r["doc_id"], r["text"] or "") for r in out.collect())
    assert kept[0] == (1, a) and kept[1] == (1, c) and kept[3:] == [(7, ""), (7, "")] and kept[2] in ((4, b), (4, near)) and len(kept) == 5
    found = near_duplicates(df, "doc_id", "text").collect()
    assert len(found) == len(rows) and sum(r["kept"] for r in found if r["doc_id"] != 7) in (3, 4)
    assert {r["component_id"] for r in found} == {1, 4, 7}


def test_texts_that_share_a_passage(spark, monkeypatch):
    """Many unlike texts meet in the buckets of a passage; the few that are alike are found among them."""
    from tessera.llm import minhash

    monkeypatch.setattr(minhash, "BLOCK", 16)
    rng = random.Random(21)
    passage = [f"p{i}" for i in range(60)]
    bodies = [[f"x{n}_{i}" for i in range(40)] for n in range(90)]
    texts = [passage + b for b in bodies] + [passage + b[:-2] + ["y", "z"] for b in bodies[::9]]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in near_duplicates(df, "doc_id", "text").collect()}
    assert got == groups_by_hand(rows) and len(set(got.values())) == 90


VECTORS = "vec_id long, embedding array<float>, label int, id string, vec string, k string, grp string"


def odd_vectors():
    nan, inf = float("nan"), float("inf")
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist(), i % 3) for i in range(60)]
    close = [(100 + i, (rng.standard_normal(8) * 0.03 + 1).tolist(), 1) for i in range(40)]
    rest = [
        (200, [1.0] * 8, 1), (201, [1.0] * 8, 1), (201, [1.0] * 8, 1), (202, [2.0] * 8, None), (203, [2.0] * 8, None), (204, None, 1), (205, [0.0] * 8, 1), (206, [0.0] * 8, 1), (207, [nan] * 8, 1),
        (208, [inf] + [1.0] * 7, 1), (209, [None] + [1.0] * 7, 1), (210, [1.0] * 3, 1), (211, [3.0] * 3, 1), (None, [1.0] * 8, 1), (212, [], 1), (50 * 9, [5.0] * 8, 0), (50 * 9, [5.0] * 8, 0),
    ]
    return [(*r, "x", "x", "x", "x") for r in rows + close + rest]


def test_vectors_near(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS)
    good = [(n, i, np.array(e, np.float32).astype(float), x) for n, (i, e, x, *_) in enumerate(rows) if i is not None and x is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    links, sets = Counter(), Sets({r[0] for r in rows if r[0] is not None})
    for n, i, e, x in good:
        for m, j, f, y in good:
            if n < m and x == y and len(e) == len(f) and e @ f / np.linalg.norm(e) / np.linalg.norm(f) >= 0.98:
                links[n] += 1
                links[m] += 1
                sets.join(i, j)
    got = near_duplicate_vectors(df, "vec_id", "embedding", "label", neighbours=4).collect()
    expected = [(r[0], links[n], sets.find(r[0]) if r[0] is not None else None) for n, r in enumerate(rows)]
    key = lambda r: (r[0] is None, r)
    assert sorted([(r["vec_id"], r["n_links"], r["component_id"]) for r in got], key=key) == sorted(expected, key=key)
    assert near_duplicate_vectors(df.filter("false"), "vec_id", "embedding", "label").count() == 0


def by_brute_force(x, labels, threshold=0.98):
    x = x.astype(np.float32).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = (x @ x.T >= threshold) & (labels[:, None] == labels[None, :])
    np.fill_diagonal(near, False)
    sets = Sets(range(len(x)))
    for a, b in zip(*np.nonzero(near)):
        sets.join(int(a), int(b))
    return [(i, int(near[i].sum()), sets.find(i)) for i in range(len(x))]


def near_of(spark, x, labels, **options):
    df = spark.createDataFrame([(i, v.tolist(), int(k)) for i, (v, k) in enumerate(zip(x.astype(np.float32), labels))], "vec_id long, embedding array<float>, label int")
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df, "vec_id", "embedding", "label", **options).collect())


def test_descent_finds_links_from_random_lists(spark, monkeypatch):
    """Without blocks to start from, the rounds alone bring the links together."""
    from tessera.llm import nn_descent

    rng = np.random.default_rng(12)
    curve = np.linspace(0, 40, 700)
    x = np.stack([np.cos(curve), np.sin(curve), curve / 10, np.ones_like(curve)], 1) + rng.standard_normal((700, 4)) * 0.005
    labels = np.zeros(700, int)
    expected = {(i, c): n for i, n, c in by_brute_force(x, labels)}
    links = sum(expected.values())
    found = {}
    for rounds in (0, 8):
        monkeypatch.setattr(nn_descent, "ROUNDS", rounds)
        monkeypatch.setattr(nn_descent, "TARGET_RECALL", -1.0)
        monkeypatch.setattr(nn_descent, "_complete", lambda vectors, threshold: spark.createDataFrame([], "id long, links long, a long, b long"))
        listed = []
        monkeypatch.setattr(nn_descent, "components", lambda l, a, b: listed.append(l.count()) or components(l, a, b))
        near_of(spark, x, labels, at_random=True, neighbours=20)
        found[rounds] = 2 * listed[0]
    assert links > 5_000 and found[0] < 0.5 * min(links, 700 * 20) and found[8] > 0.9 * min(links, 700 * 20)


def test_a_large_label_goes_through_the_descent(spark):
    """1,500 vectors of one label, four blocks of them, with clusters of 2 to 300, equal brute force; nothing is patched."""
    from tessera.llm import nn_descent

    rng = np.random.default_rng(31)
    sizes = [300, 120, 40, 20, *[5] * 40, *[2] * 60]
    centres = rng.standard_normal((len(sizes), 24))
    close = np.concatenate([c + rng.standard_normal((n, 24)) * 0.06 for c, n in zip(centres, sizes, strict=True)])
    x = np.concatenate([close, rng.standard_normal((1_500 - len(close), 24))])[rng.permutation(1_500)]
    assert len(x) > 3 * nn_descent.BLOCK
    expected = by_brute_force(x, np.zeros(1_500, int))
    assert sum(n for _, n, _ in expected) > 50_000
    assert near_of(spark, x, np.zeros(1_500, int)) == expected


def test_double_precision_and_multiples(spark):
    """Double input is not rounded; multiples of a vector are other vectors that link."""
    base = np.array([1.0, 2.0, 3.0])
    angle = math.acos(0.98)
    at = lambda t: (math.cos(t), math.sin(t), 0.0)
    rows = [(i, (base * (i + 1)).tolist(), "m") for i in range(30)] + [(100, at(0), "d"), (101, at(angle - 1e-9), "d"), (102, at(2 * angle + 1e-9), "d")]
    df = spark.createDataFrame([(i, list(v), x) for i, v, x in rows], "vec_id long, embedding array<double>, label string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in near_duplicate_vectors(df, "vec_id", "embedding", "label").collect()}
    assert all(got[i] == (29, 0) for i in range(30))
    assert got[100] == (1, 100) and got[101] == (1, 100) and got[102] == (0, 102)


def test_links_between_tight_groups(spark):
    """Lists that are full of their own group's members still give the links to the next group."""
    rng = np.random.default_rng(8)
    axes = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    angle = math.acos(0.985)
    groups = [axes[0], math.cos(angle) * axes[0] + math.sin(angle) * axes[1], axes[2]]
    x = np.concatenate([c + rng.standard_normal((60, 16)) * 0.003 for c in groups] + [axes[3:6]])
    labels = np.zeros(len(x), int)
    expected = by_brute_force(x, labels)
    assert expected[0][1] > 80
    assert near_of(spark, x, labels) == expected


@pytest.mark.parametrize(("unit", "centres", "part"), [(1024, 4096, 512), (16, 24, 7)])
def test_vectors_that_link_to_whole_units(spark, monkeypatch, unit, centres, part):
    """Dense groups, with copies, near others and with vectors of full and not full lists about them, are counted as by brute force, most without a row for each."""
    from tessera.llm import nn_descent

    monkeypatch.setattr(nn_descent, "UNIT", unit)
    monkeypatch.setattr(nn_descent, "CENTRES", centres)
    monkeypatch.setattr(nn_descent, "SLICE", part)
    written = {}
    write = nn_descent.write_table
    monkeypatch.setattr(nn_descent, "write_table", lambda df, name: written.setdefault(name, write(df, name)) if name == "descent-reached" else write(df, name))
    rng = np.random.default_rng(12)
    axes = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    tilted = lambda cosine, to: cosine * axes[0] + math.sqrt(1 - cosine**2) * axes[to]
    groups = [(axes[0], 150, 1e-4), (tilted(0.99, 1), 60, 1e-3), (tilted(0.9803, 2), 4, 1e-4), (tilted(0.981, 3), 1, 0), (tilted(0.9795, 4), 30, 4e-4), (axes[5], 40, 0.02)]
    x = np.concatenate([c + rng.standard_normal((n, 16)) * spread for c, n, spread in groups])
    x = np.concatenate([x, x[:40], x[150:155], axes[6:9]])
    labels = np.zeros(len(x), int)
    assert near_of(spark, x, labels) == by_brute_force(x, labels)
    kinds = {r["kind"]: r["count"] for r in written["descent-reached"].groupBy("kind").count().collect()}
    assert kinds[nn_descent.UNIT_GETS] and kinds[nn_descent.VECTOR_GETS] and kinds[nn_descent.JOINED]
    if unit == 16:  # if each vector and unit were a row, it would be more than this for the first group alone
        assert kinds[nn_descent.MAYBE] < 150 * 150 / unit


def test_everything_is_compared_when_no_try_finds_enough(spark, monkeypatch):
    from tessera.llm import nn_descent

    monkeypatch.setattr(nn_descent, "TARGET_RECALL", 2.0)
    monkeypatch.setattr(nn_descent, "TRIES", 1)
    monkeypatch.setattr(nn_descent, "BLOCK", 8)
    monkeypatch.setattr(nn_descent, "UNIT", 8)
    monkeypatch.setattr(nn_descent, "MEET", 8)
    monkeypatch.setattr(nn_descent, "CENTRES", 8)
    monkeypatch.setattr(nn_descent, "ROUNDS", 0)
    rng = np.random.default_rng(3)
    lone = rng.standard_normal((60, 8)) * 0.3 + 1
    x = np.concatenate([lone, lone[:20] + rng.standard_normal((20, 8)) * 0.01])
    labels = np.arange(len(x)) % 2
    assert near_of(spark, x, labels) == by_brute_force(x, labels)


def test_products_of_large_components(spark):
    """Exact up to the stated range, a named error beyond it."""
    rows = [(i, [float((i * 7919) % 1000 - 500) * 12_000.0, 1e6 + i, -3.0]) for i in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    assert max(sum(x * x for x in v) for v in whole.values()) > 2**60
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_products(df, "vec_id", "embedding", F.col("vec_id") % 5 == 0).collect()}
    for q in range(0, 40, 5):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)[:5]
        assert [got[q, n] for n in range(1, 6)] == [(i, -s) for s, i in best]
    for large in (1e7, 1e300):
        with pytest.raises(ValueError, match="too large"):
            top_products(spark.createDataFrame([(1, [large]), (2, [2 * large])], "vec_id long, embedding array<double>"), "vec_id", "embedding", F.lit(True))


def test_products(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, VECTORS)
    good = [(n, i, np.array([math.floor(256 * float(np.float32(v))) for v in e] + [0] * (8 - len(e)))) for n, (i, e, *_) in enumerate(rows) if i is not None and e is not None and None not in e and np.isfinite(e).all()]
    expected = []
    for n, i, e in good:
        if i % 50 == 0:
            ranked = sorted((-int(e @ f), j) for m, j, f in good if m != n)[:5]
            expected += [(i, r + 1, j, -s) for r, (s, j) in enumerate(ranked)]
    got = top_products(df, "vec_id", "embedding", F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert top_products(df.filter("false"), "vec_id", "embedding", F.lit(True)).count() == 0
    assert top_products(df.filter("vec_id in (0, 1)"), "vec_id", "embedding", F.col("vec_id") == 0).count() == 1


def test_products_through_several_levels(spark, monkeypatch):
    from tessera.llm import mtree

    monkeypatch.setattr(mtree, "PAGE", 20)
    monkeypatch.setattr(mtree, "FANOUT", 4)
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((300, 4)), np.tile(rng.standard_normal(4), (70, 1))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = np.floor(256 * x.astype(float)).astype(int)
    expected = []
    for i in range(0, 370, 37):
        score = whole @ whole[i]
        order = [j for j in np.lexsort((np.arange(370), -score)) if j != i][:5]
        expected += [(i, r + 1, int(j), int(score[j])) for r, j in enumerate(order)]
    got = mtree.top_products(df, "vec_id", "embedding", F.col("vec_id") % 37 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_products_among_many_copies(spark):
    """More copies of one vector than a node deals at random, beside a few others."""
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((50, 4)), np.tile(rng.standard_normal(4), (10_000, 1))]).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = np.floor(256 * x.astype(float)).astype(int)
    asked = [0, 7, 49, 50, 5000]
    expected = []
    for i in asked:
        score = whole @ whole[i]
        order = [j for j in np.lexsort((np.arange(len(x)), -score)) if j != i][:5]
        expected += [(i, r + 1, int(j), int(score[j])) for r, j in enumerate(order)]
    got = top_products(df, "vec_id", "embedding", F.col("vec_id").isin(asked)).collect()
    assert sorted(map(tuple, got)) == sorted(expected)


def test_products_of_three_vectors_many_times(spark):
    base = np.array([[0.5, 0.25], [-0.5, 0.25], [0.25, 1.0]])
    df = spark.range(6000).select(F.col("id").alias("vec_id"), *[F.element_at(F.array(*[F.lit(float(v)) for v in base[:, c]]), (F.col("id") % 3 + 1).cast("int")).alias(f"x{c}") for c in range(2)])
    df = df.select("vec_id", F.array("x0", "x1").alias("embedding"))
    got = top_products(df, "vec_id", "embedding", F.col("vec_id") % 10 == 0).collect()
    whole = np.floor(256 * base).astype(int)[np.arange(6000) % 3]
    expected = []
    for i in range(0, 6000, 10):
        score = whole @ whole[i]
        score[i] = -(1 << 40)
        best = np.flatnonzero(score == score.max())[:5]  # each vector has 2,000 copies
        expected += [(i, r + 1, int(j), int(score[j])) for r, j in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)


@pytest.mark.parametrize("level_count", [1, 2])
def test_products_when_levels_run_out(spark, monkeypatch, level_count):
    """Nodes that are still large after the last level are leaves."""
    from tessera.llm import mtree

    monkeypatch.setattr(mtree, "PAGE", 20)
    monkeypatch.setattr(mtree, "FANOUT", 2)
    monkeypatch.setattr(mtree, "LEVELS", level_count)
    x = np.random.default_rng(6).standard_normal((200, 3)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    whole = np.floor(256 * x.astype(float)).astype(int)
    expected = []
    for i in (0, 100):
        score = whole @ whole[i]
        order = [j for j in np.lexsort((np.arange(200), -score)) if j != i][:5]
        expected += [(i, r + 1, int(j), int(score[j])) for r, j in enumerate(order)]
    got = mtree.top_products(df, "vec_id", "embedding", F.col("vec_id") % 100 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
