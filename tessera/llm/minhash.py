"""Near-duplicate documents by ProbMinHash signatures, banding and exact verification.

A text's five-word shingles, weighted by their counts, are points at which Poisson
processes with those rates send arrivals to random registers; a register keeps
the shingle that arrives first.  Two texts agree in a register with a probability
that equals their probability Jaccard similarity.  Arrivals later than a bound
that depends on the total weight cannot matter once all registers are filled, so
almost every shingle stops after its first.

Equal texts form a class first, and only classes are compared.  Classes that
agree in a band are candidates.  Their sketches, 16 bits of each register, are
compared before any text is fetched: a pair whose sketches agree in fewer
registers than PLAUSIBLE standard deviations below the threshold is left out,
which at the threshold happens to one pair in a million.  In each band's bucket a
leader, the member that shares the most buckets with others, is compared with all
others there, then a leader of those that were not like the first, so that work
stays linear in a group of copies; members whose components still differ after
that are compared sketch block against sketch block, each pair in the first bucket
that it shares.  The plausible pairs are then verified on the whole texts, and only
verified pairs are links.  Texts are always fetched by the same join, so that a
small corpus shows what a large one costs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.wordarrays import mix64, words_of
from tessera.llm.worktables import write_table

SHINGLE = 5
BANDS = 20
BAND_ROWS = 5
THRESHOLD = 0.8
STAR_ROUNDS = 2
PLAUSIBLE = 5.0  # standard deviations of a sketch's agreement below the threshold
BLOCK = 1024  # members in one block of a bucket, at most
BLOCK_BYTES = 16 << 20  # of their texts in one block, on average at most
TASK_PAIRS = 100_000_000  # pairs of sketches that a task of the last round compares, on average
_SURE = 5.0  # e**-5 of the texts need a second look with a later bound

_STEP = np.uint64(0x9FB21C651E98DF25)


def _powers(n: int) -> np.ndarray:
    return np.multiply.accumulate(np.full(n, _STEP))


def _unit(x: np.ndarray) -> np.ndarray:
    """Uniform values in (0, 1] from 64-bit hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def shingles(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For slices of the texts: (first row, rows, row, shingle hash, count), distinct by row, in order.

    A text of fewer than k words, but at least one, has one shingle, all its words.
    """
    up = _powers(k)
    for w in words_of(texts):
        n = len(w.hashes)
        ends = np.cumsum(w.per_row)
        starts = ends - w.per_row
        rolled = np.zeros(max(n - k + 1, 0), np.uint64)
        for i in range(k):
            rolled += w.hashes[i : i + len(rolled)] * up[i]
        left = ends[w.rows] - np.arange(n)  # words from here to the text's end
        full = np.flatnonzero(left >= k)
        short = np.flatnonzero((w.per_row > 0) & (w.per_row < k))
        few = np.array([(w.hashes[starts[r] : ends[r]] * up[: w.per_row[r]]).sum(dtype=np.uint64) for r in short], np.uint64)
        row = np.concatenate([w.rows[full], short])
        value = mix64(np.concatenate([rolled[full], few]) if len(rolled) else few)
        order = np.lexsort((value, row))
        row, value = row[order], value[order]
        first = np.ones(len(row), bool)
        first[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
        at = np.flatnonzero(first)
        yield w.first_row, w.n_rows, row[at], value[at], np.diff(np.append(at, len(row)))


def signatures(n_rows: int, row: np.ndarray, value: np.ndarray, count: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash signatures, [n_rows, registers]; rows without shingles hold zeros."""
    out = np.zeros(n_rows * registers, np.uint64)
    weight = np.bincount(row, weights=count, minlength=n_rows)
    todo, sure = weight > 0, _SURE
    while todo.any():
        pick = todo[row]
        r, v, c = row[pick], value[pick], count[pick]
        bound = registers / np.maximum(weight, 1) * (np.log(registers) + sure)
        time, arrival = np.zeros(len(r)), 0
        slots, times, values = [], [], []
        while len(r):
            arrival += 1
            draw = mix64(v + np.uint64((arrival * 0x9E3779B97F4A7C15) & (2**64 - 1)))
            time = time - np.log(_unit(draw)) / c
            early = time <= bound[r]
            r, v, c, time, draw = r[early], v[early], c[early], time[early], draw[early]
            slots.append(r * registers + (mix64(draw) % np.uint64(registers)).astype(np.int64))
            times.append(time)
            values.append(v)
        slot, time, v = np.concatenate(slots), np.concatenate(times), np.concatenate(values)
        best = np.full(n_rows * registers, np.inf)
        np.minimum.at(best, slot, time)
        first = time == best[slot]
        out[slot[first]] = v[first]
        todo &= np.isinf(best.reshape(n_rows, registers)).any(1)
        sure *= 2
    return out.reshape(n_rows, registers)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    return mix64((parts * _powers(rows)).sum(2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64)).view(np.int64)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact probability Jaccard of two weighted sets (sorted hashes, weights).

    The sum over shared d of 1 / sum over e of max(a_e/a_d, b_e/b_d).  With the
    shared elements in the order of a/b, the maxima split into a prefix and a
    suffix, so that running sums give every denominator.
    """
    (ha, wa), (hb, wb) = a, b
    _, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(ia):
        return 0.0
    x, y = wa[ia].astype(float), wb[ib].astype(float)
    order = np.argsort(x / y, kind="stable")
    x, y = x[order], y[order]
    # max(x_e/x_d, y_e/y_d) = x_e/x_d where x_e/y_e >= x_d/y_d.
    x_from = np.cumsum(x[::-1])[::-1] + (wa.sum() - x.sum())
    y_before = np.cumsum(y) - y + (wb.sum() - y.sum())
    return float((1.0 / (x_from / x + y_before / y)).sum())


def _text_key(text: Column) -> tuple[Column, Column]:
    """Two independent hashes of a text, 96 bits in all."""
    return F.xxhash64(text), F.crc32(text.cast("binary"))


def _signed(docs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(id, k1, k2, size, bands, sketch): the text's hashes, bytes, band keys and sketch; the last two are null where the text has no word."""
    registers = bands * rows

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[pa.Array] = []
            sketches: list[pa.Array] = []
            for _, n, row, value, count in shingles(batch.column("text")):
                signed = signatures(n, row, value, count, registers)
                has = np.bincount(row, minlength=n) > 0
                keys.append(pa.ListArray.from_arrays(np.append(0, np.cumsum(has * bands)).astype(np.int32), pa.array(band_keys(signed, bands, rows)[has].ravel()), mask=pa.array(~has)))
                low = mix64(signed).astype(np.uint16)
                sketches.append(pa.array([x.tobytes() if h else None for x, h in zip(low, has, strict=True)], pa.binary()))
            found = [pa.concat_arrays(x) if x else pa.array([], t) for x, t in ((keys, pa.list_(pa.int64())), (sketches, pa.binary()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "k1", "k2", "size")), *found], ["id", "k1", "k2", "size", "bands", "sketch"])

    k1, k2 = _text_key(F.col("text"))
    keyed = docs.select("id", k1.alias("k1"), k2.alias("k2"), F.octet_length("text").cast("long").alias("size"), "text")
    return keyed.mapInArrow(sign, "id long, k1 long, k2 long, size long, bands array<long>, sketch binary")


def _registers(sketches: pa.Array | pd.Series) -> np.ndarray:
    """[sketches, registers]; without sketches there are no registers either."""
    data = sketches.to_pylist() if isinstance(sketches, pa.Array) else list(sketches)
    return np.frombuffer(b"".join(data), np.uint16).reshape(len(data), len(data[0]) // 2 if data else 0)


def _plausible(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The pairs (a, b) whose sketches agree in at least so many registers."""
    both = pairs
    for side in ("a", "b"):
        both = both.join(classes.select(F.col("uid").alias(side), F.col("sketch").alias(f"sketch_{side}")), side)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                same = (_registers(batch.column("sketch_a")) == _registers(batch.column("sketch_b"))).sum(1)
                yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(same >= least))

    return both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(compare, "a long, b long")


def _sets(texts: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(sorted shingle hashes, counts) of each text."""
    out: list[tuple[np.ndarray, np.ndarray]] = []
    for _, n, row, value, count in shingles(texts):
        cuts = np.searchsorted(row, np.arange(1, n))
        out += zip(np.split(value, cuts), np.split(count, cuts), strict=True)
    return out


def _texts(asked: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(uid, text) of the classes asked for, each from a document with its smallest key."""
    asked = write_table(asked.distinct().join(classes.select("uid", "class_id", "k1", "k2"), "uid"), "minhash-asked")
    k1, k2 = _text_key(F.col("text"))
    found = docs.join(asked.hint("merge"), (F.col("id") == F.col("class_id")) & (k1 == F.col("k1")) & (k2 == F.col("k2")))
    return write_table(found.select("uid", "text").dropDuplicates(["uid"]), "minhash-texts")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' probability Jaccard is at least the threshold."""
    texts = _texts(pairs.select(F.explode(F.array("a", "b")).alias("uid")), classes, docs)
    both = pairs
    for side in ("b", "a"):
        both = both.join(texts.select(F.col("uid").alias(side), F.col("text").alias(f"text_{side}")).hint("merge"), side)

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                similar = [probability_jaccard(x, y) for x, y in zip(_sets(part.column("text_a")), _sets(part.column("text_b")), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b"), pa.array(similar, pa.float64())], ["a", "b", "similarity"])

    checked = both.select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long, similarity double")
    return write_table(checked.filter(F.col("similarity") >= threshold).select("a", "b"), "minhash-links")


CELL = ("bucket", "i", "j")


def _cells(members: DataFrame, least: int, band_rows: int) -> DataFrame:
    """(bucket, i, j, side, uid, comp, partners): what has to be verified in each cell of two blocks.

    members has (bucket, band, uid, comp, size, sketch).  A member of block i has
    the members of block j that it is plausibly like as partners; these have a row
    on the other side.  Left out are pairs of one component and pairs that share
    an earlier bucket.  The number of tasks follows from the number of pairs.
    """
    sizes = members.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    total = sizes.agg(F.sum(F.col("n") * F.col("n") / 2)).first()[0] or 0
    tasks = max(int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / TASK_PAIRS))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK), F.least("n", F.ceil(F.col("bytes") / BLOCK_BYTES))).cast("int")
    dealt = members.drop("size").join(sizes, "bucket").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    carried = ["bucket", "band", "uid", "comp", "block", "sketch"]
    cells = dealt.select(*carried, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = cells.select(F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), *carried)
    schema = "bucket long, i int, j int, side int, uid long, comp long, partners array<long>"

    def cross(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["block"] == pdf[c].iloc[0]] for c in ("i", "j"))
        if left.empty or right.empty:  # no member was dealt to one of the blocks
            return pd.DataFrame(columns=[c.split()[0] for c in schema.split(", ")], dtype=object)
        ids, comps, y, band = right["uid"].to_numpy(), right["comp"].to_numpy(), _registers(right["sketch"]), pdf["band"].iloc[0]
        out, met, whole = [], np.zeros(len(ids), bool), left["block"].iloc[0] == right["block"].iloc[0]
        for own, comp, x in zip(left["uid"], left["comp"], _registers(left["sketch"]), strict=True):
            same = y == x
            near = np.flatnonzero((same.sum(1) >= least) & (comps != comp) & ((ids > own) | (not whole)))
            near = near[same[near].reshape(len(near), len(x) // band_rows, band_rows).all(2).argmax(1) == band]
            if len(near):
                out.append((0, own, comp, ids[near]))
                met[near] = True
        out += [(1, u, c, None) for u, c in zip(ids[met], comps[met], strict=True)]
        found = pd.DataFrame(out, columns=["side", "uid", "comp", "partners"])
        return found.assign(**{c: pdf[c].iloc[0] for c in CELL})[[c.split()[0] for c in schema.split(", ")]]

    return cells.repartition(tasks, *CELL).groupBy(*CELL).applyInPandas(cross, schema)


def _cell_links(cells: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) among a cell's partners that join components.

    For each text a bound from above of its similarity to all others of the other
    side is computed at once; what is left is verified.  Components that have met
    once in the cell are not compared there again.
    """

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = (pdf[pdf["side"] == s].reset_index(drop=True) for s in (0, 1))
        if left.empty or right.empty:
            return pd.DataFrame({"a": [], "b": []})
        x, y = (_sets(pa.array(p["text"], pa.string())) for p in (left, right))
        known = np.unique(np.concatenate([v for v, _ in x]))
        values, weights = (np.concatenate([s[k] for s in y]) for k in (0, 1))
        starts = np.cumsum([0] + [len(v) for v, _ in y[:-1]])
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        at[known[at] != values] = len(known)  # a place that stays zero
        totals = np.add.reduceat(weights, starts).astype(float)
        owner = np.repeat(np.arange(len(y)), np.diff(np.append(starts, len(values))))
        root = {c: c for c in pdf["comp"].unique()}

        def find(c: int) -> int:
            while root[c] != c:
                c = root[c]
            return c

        own, ids, comps, out = np.zeros(len(known) + 1, np.int64), right["uid"].to_numpy(), right["comp"].to_numpy(), []
        for (v, w), uid, comp, partners in zip(x, left["uid"], left["comp"], left["partners"], strict=True):
            place = np.searchsorted(known, v)
            own[place] = w
            here = np.flatnonzero(own[at])
            of, wx, wy = owner[here], own[at[here]].astype(float), weights[here].astype(float)
            own[place] = 0
            total = float(w.sum())
            only_x = total - np.bincount(of, wx, len(y))
            only_y = totals - np.bincount(of, wy, len(y))
            # Each maximum is at least either of its sides; exact where all counts are equal.
            terms = np.minimum(wx / (total + only_y[of] * wx / wy), wy / (totals[of] + only_x[of] * wy / wx))
            bound = np.bincount(of, terms, len(y))
            for k in np.flatnonzero((bound >= threshold - 1e-9) & np.isin(ids, partners)):
                one, two = find(comp), find(comps[k])
                if one != two and probability_jaccard((v, w), y[k]) >= threshold:
                    root[max(one, two)] = min(one, two)
                    out.append((min(uid, ids[k]), max(uid, ids[k])))
        return pd.DataFrame(out, columns=["a", "b"])

    both = cells.join(texts.hint("merge"), "uid")
    return write_table(both.repartition(*CELL).groupBy(*CELL).applyInPandas(verify, "a long, b long"), "minhash-links")


def _placed(docs: DataFrame, threshold: float, bands: int, band_rows: int) -> DataFrame:
    """(id, k1, k2, class_id, component_id, kept) for every row of docs (id, text) with an id and a text."""
    signed = write_table(_signed(docs, bands, band_rows), "minhash-signed")
    classes = signed.groupBy("k1", "k2").agg(F.min("id").alias("class_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("size").alias("size"))
    # A text's own number: a key may have several texts.
    classes = write_table(classes.withColumn("uid", F.monotonically_increasing_id()), "minhash-classes")
    least = math.ceil(bands * band_rows * (threshold - PLAUSIBLE * math.sqrt(threshold * (1 - threshold) / (bands * band_rows))))

    buckets = classes.filter("bands is not null").select("uid", F.posexplode("bands").alias("band", "value")).select("uid", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    # The text that most others were copied from shares the most buckets.
    central = F.sum("n").over(Window.partitionBy("uid"))  # a row for each band at most
    members = write_table(buckets.join(shared, "bucket").select("bucket", "band", "uid", central.alias("central")), "minhash-members")

    near, compared = None, None
    waiting = members  # (bucket, uid) not like a leader of the bucket so far
    for _ in range(STAR_ROUNDS):
        leaders = write_table(waiting.groupBy("bucket").agg(F.max_by("uid", F.struct("central", -F.col("uid"))).alias("leader")), "minhash-leaders")
        pairs = members.join(leaders, "bucket").filter("uid <> leader").select(F.least("uid", "leader").alias("a"), F.greatest("uid", "leader").alias("b")).distinct()
        if compared is not None:
            pairs = pairs.join(compared, ["a", "b"], "left_anti")
        pairs = write_table(pairs, "minhash-pairs")
        compared = pairs if compared is None else compared.union(pairs)
        found = write_table(_plausible(pairs, classes, least), "minhash-near")
        near = found if near is None else near.union(found)
        led = waiting.join(leaders, "bucket").filter("uid <> leader").withColumns({"a": F.least("uid", "leader"), "b": F.greatest("uid", "leader")})
        waiting = write_table(led.join(near, ["a", "b"], "left_anti").select("bucket", "uid", "central"), "minhash-waiting")
        if waiting.isEmpty():
            break
    links = _verified(near, classes, docs, threshold)
    comps = write_table(components(links, "a", "b"), "minhash-components")

    # Two members of a bucket have been compared; of more, those from different
    # components may still be alike without either being a leader.
    spread = members.join(comps.withColumnRenamed("id", "uid"), "uid", "left").select("bucket", "band", "uid", F.coalesce("component_id", "uid").alias("comp"))
    parted = spread.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("n")).filter("low <> high and n > 2").select("bucket")
    apart = write_table(spread.join(parted, "bucket").join(classes.select("uid", "size", "sketch"), "uid"), "minhash-apart")
    cells = write_table(_cells(apart, least, band_rows), "minhash-cells")
    more = _cell_links(cells, _texts(cells.select("uid"), classes, docs), threshold)
    if not more.isEmpty():
        comps = write_table(components(links.union(more), "a", "b"), "minhash-components")

    # A component is known by its smallest key, and by one text that has this key.
    linked = classes.select("uid", "class_id", "k1", "k2").join(comps.withColumnRenamed("id", "uid"), "uid")
    roots = linked.groupBy("component_id").agg(F.min(F.struct("class_id", "k1", "k2", "uid")).alias("root"))
    linked = linked.join(roots, "component_id").select("uid", F.col("root.class_id").alias("component_id"), (F.col("root.uid") == F.col("uid")).alias("first"))
    known = classes.select("uid", "k1", "k2", "class_id").join(linked, "uid", "left")
    known = known.select("k1", "k2", "class_id", F.coalesce("component_id", "class_id").alias("component_id"), F.coalesce("first", F.lit(True)).alias("first"))
    placed = signed.select("id", "k1", "k2").join(known, ["k1", "k2"])
    return placed.select("id", "k1", "k2", "class_id", "component_id", (F.col("first") & (F.col("id") == F.col("component_id"))).alias("kept"))


def near_duplicates(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """(key, class_id, component_id, kept), one row for each row of df.

    class_id is the smallest key with exactly the same text, component_id the
    smallest key reachable over links of at least the threshold; kept is true for
    one text of each component, where it stands under the component's key.  Null
    texts are like nothing, not even each other; texts without words are like
    exact copies only; texts of one to four words have one shingle.  A text of any
    length is read whole, but must fit into a task.  Several texts under one key
    are texts of their own.  Rows with a null key are kept, with null ids.
    Repeated rows give repeated results, and an empty table gives none.  Other
    columns, whatever their names, are not carried.
    """
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    placed = _placed(docs.filter("text is not null and id is not null"), threshold, bands, band_rows).drop("k1", "k2")
    alone = docs.filter("text is null or id is null").select("id", F.col("id").alias("class_id"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))
    return placed.unionByName(alone).withColumnRenamed("id", key)


def drop_near_duplicates(df: DataFrame, key: str, text: str, threshold: float = THRESHOLD, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """df with one row for each near-duplicate component: one text with its smallest key.

    Rows go by key and text, so that a text of its own stays even if its key also
    has a text that goes.  Rows repeated with the same key and text count once.
    Rows with a null key or a null text stay.  All columns of df stay, whatever
    their names, and no others come.
    """
    docs = df.select(F.col(key).alias("id"), F.col(text).alias("text"))
    placed = write_table(_placed(docs.filter("text is not null and id is not null"), threshold, bands, band_rows).select("id", "k1", "k2", "kept"), "minhash-kept")
    k1, k2 = _text_key(F.col(text))
    rows = df.select(F.struct("*").alias("row"), F.struct(F.col(key).alias("id"), k1.alias("k1"), k2.alias("k2")).alias("at"), F.col(text).isNotNull().alias("has_text"))
    gone = placed.filter("not kept").select(F.struct("id", "k1", "k2").alias("at")).distinct()
    left = rows.join(gone, "at", "left_anti")
    repeated = placed.filter("kept").groupBy(F.struct("id", "k1", "k2").alias("at")).count().filter("count > 1").select("at")
    repeated = write_table(repeated, "minhash-repeated")
    if repeated.isEmpty():
        return left.select("row.*")
    again = left.filter("has_text").join(repeated, "at", "left_semi").dropDuplicates(["at"])
    return left.join(repeated, "at", "left_anti").unionByName(again).select("row.*")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the class of its exact copies and its near-duplicate component."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
