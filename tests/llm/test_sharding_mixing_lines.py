import hashlib
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tessera.llm.line_dedup import drop_boilerplate
from tessera.llm.mixing import mix_sources, source_targets, take_mix
from tessera.llm.sharding import assign_shards


def shards_by_hand(rows, n):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode())))
    sizes = [len((t or "").encode()) + 1 for _, t in rows]
    total, before, out, slots = sum(sizes), 0, [], defaultdict(int)
    for (i, t), s in zip(rows, sizes, strict=True):
        k = min((2 * before + s) * n // (2 * total), n - 1)
        out.append((i, s, zlib.crc32((t or "").encode()), k, slots[k], before))
        slots[k] += 1
        before += s
    return out


def test_shards(odd_docs, spark, sf_dir):
    for df in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        got = [tuple(r) for r in assign_shards(df, "doc_id", "text", 8).collect()]
        assert sorted(got, key=lambda r: r[5]) == shards_by_hand([(r["doc_id"], r["text"]) for r in df.collect()], 8)


def test_shards_of_nothing(no_docs):
    assert assign_shards(no_docs, "doc_id", "text", 8).count() == 0


def targets_by_hand(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        unit = budget / sum(w[s] for s in free)
        over = {s for s in free if w[s] * unit >= cap * sizes[s]}
        if not over:
            return out | {s: w[s] * unit for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            budget -= out[s]
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 10, "c": 1000, "d": 5, None: 50}, {"a": 0, "b": 7}, {"a": 1}, {"a": 10, "b": 10, "c": 10}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(targets_by_hand(sizes))


def mix_by_hand(rows):
    sized = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, s in rows]
    sums = defaultdict(int)
    for _, s, n in sized:
        sums[s] += n
    targets, out = targets_by_hand(dict(sums)), []
    groups, seen = defaultdict(list), defaultdict(int)
    for (i, s, n), (_, t, _) in zip(sized, rows, strict=True):
        whole = "".join("-:" if x is None else f"{len(str(x))}:{x}" for x in (i, s, t))
        digest = hashlib.md5(whole.encode()).hexdigest()
        groups[s].append((hashlib.md5(f"{digest}:{seen[digest]}".encode()).hexdigest()[:15], i, n))
        seen[digest] += 1
    for s, docs in groups.items():
        passes = round(targets[s] / sums[s]) if sums[s] and targets[s] >= 2 * sums[s] else int(targets[s] / sums[s]) if sums[s] else 0
        left, stopped = targets[s] - passes * sums[s], None
        upto = 0
        for h in sorted({h for h, _, n in docs if n}):
            upto += sum(n for g, _, n in docs if g == h)
            if upto > left:
                stopped = h
                break
        for h, i, n in docs:
            out.append((i, s, n, sums[s], n * (passes + (left > 0 and (stopped is None or h < stopped))) if n else 0))
    return out


def test_mix(odd_docs, spark, sf_dir):
    order = lambda r: tuple(str(x) for x in r)
    for df in (odd_docs, spark.read.parquet(f"{sf_dir}/documents.parquet")):
        rows = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
        got = mix_sources(df, "doc_id", "source", "text").collect()
        assert sorted([(r["doc_id"], r["source"], r["size"], r["source_size"], r["taken"]) for r in got], key=order) == sorted(mix_by_hand(rows), key=order)
        assert all(r["copies"] <= 2 for r in got)
        taken = take_mix(df, "doc_id", "source", "text")
        assert taken.columns == df.columns
        assert taken.count() == sum(r["copies"] for r in got)


def test_mix_of_null_and_repeated_keys(spark):
    """A source of rows without keys, one of equal rows and one of one key: each comes within one document of its target."""
    rows = [(None, f"w{i} " * 20, "a") for i in range(300)] + [(7, "same words " * 5, "b")] * 200 + [(9, f"x{i} " * 15, "c") for i in range(150)] + [(None, None, "a"), (None, None, None)] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({c: F.lit("x") for c in ("digest", "copy", "part", "n")}).repartition(5)
    got = mix_sources(df, "doc_id", "source", "text", weights=(3.0, 1.0, 2.0), share=1.1).collect()
    assert len(got) == len(rows)
    for source, most in (("a", 20), ("b", 10), ("c", 15)):
        own = [r for r in got if r["source"] == source]
        assert 0 <= own[0]["target"] - sum(r["taken"] for r in own) < most
        assert len({r["copies"] for r in own if r["size"]}) == 2
    taken = take_mix(df, "doc_id", "source", "text", weights=(3.0, 1.0, 2.0), share=1.1)
    assert taken.columns == df.columns and taken.count() == sum(r["copies"] for r in got)
    again = mix_sources(df.repartition(3, "text"), "doc_id", "source", "text", weights=(3.0, 1.0, 2.0), share=1.1).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_of_nothing(no_docs):
    assert mix_sources(no_docs, "doc_id", "source", "text").count() == 0
    assert take_mix(no_docs, "doc_id", "source", "text").count() == 0


def test_boilerplate(spark):
    rows = [("h", f"menu\nown {i}\n\n menu ") for i in range(5)] + [("h", None), (None, "menu\nx"), (None, "x"), (None, "x\r"), ("g", "menu"), ("g", "")]
    df = spark.createDataFrame([(i, h, t) for i, (h, t) in enumerate(rows)], "doc_id long, host string, text string")
    got = {r["doc_id"]: (r["text"], r["n_lines_dropped"]) for r in drop_boilerplate(df, "host", "text", 0.3, 3).collect()}
    assert got[0] == ("own 0\n", 2)
    assert got[5] == (None, 0)
    assert got[6] == ("menu\nx", 0)
    assert got[9] == ("menu", 0) and got[10] == ("", 0)


def test_boilerplate_share_ties_long_lines_and_large_tables(spark, monkeypatch):
    from tessera.llm import line_dedup

    long = "x" * 300_000
    rows = [(i, "h", f"tie\n{long}\nown {i}" if i < 5 else f"own {i}\n{long}", "mine") for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, host string, text string, n_lines_dropped string").withColumns({"row": F.lit(1), "at": F.lit(2), "bad": F.lit(3), "line": F.lit(4)})
    for most in (line_dedup.BROADCAST_BYTES, 0):  # lines sent to all tasks, or to each part of a host
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", most)
        out = drop_boilerplate(df, "host", "text", 0.5, 3)
        assert out.columns == [*df.columns, "n_lines_dropped_"]
        for r in out.collect():
            assert r["text"] == (f"tie\nown {r['doc_id']}" if r["doc_id"] < 5 else f"own {r['doc_id']}")
            assert r["n_lines_dropped"] == "mine" and r["n_lines_dropped_"] == 1


def test_boilerplate_edges(odd_docs, no_docs):
    out = drop_boilerplate(odd_docs, "source", "text")
    assert out.columns == [*odd_docs.columns, "n_lines_dropped"]
    assert out.count() == odd_docs.count()
    assert {r["doc_id"]: r["text"] for r in out.collect()} == {r["doc_id"]: r["text"] for r in odd_docs.collect()}
    assert drop_boilerplate(no_docs, "source", "text").count() == 0
