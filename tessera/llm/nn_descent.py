"""Near-duplicate vectors by NN-descent.

Equal vectors of one label form a class first; classes are the vertices.  Every
vertex starts with the nearest others of a few random-projection blocks, or of
small random blocks.  Then each round brings the neighbours of every vertex, in both
directions, together in one cell, compares them with each other, and keeps for
each vertex the best it has seen, until a round hardly improves the lists.  Where
all kept neighbours are links, the list is saturated and may have lost some: the
component of such a vertex is open, and its members are cut into units with a
centre and a radius.  Every vector of the label that the triangle inequality does
not rule out meets a unit's members, but for those so near to its centre that they
link to all members, which are only counted; links are counted without writing pairs out.
At last a sample is compared with all vectors; if too few of its links were found,
the search goes on with other planes and longer lists, and after the last try all
components are open, so that everything is compared.
"""

from __future__ import annotations

import logging
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.worktables import write_table

_log = logging.getLogger(__name__)

THRESHOLD = 0.98
NEIGHBOURS = 10
ROUNDS = 8  # at most
IMPROVED = 0.001  # a round that lowers the lists' distances by a smaller share is the last
BLOCK = 384  # vectors in a starting block
UNIT = 1024  # members of an open component in one unit
MEET = 4096  # vectors that meet a unit in one group
CENTRES = 4096  # centres, and vectors, in one group of the search for units in reach
MISS = 0.01  # share of links at the threshold that may have no starting block in common
CELLS = 64  # cells that one group of a round holds, on average
AUDIT = 200  # vectors, in expectation, that are compared with all
TARGET_RECALL = 0.97
TRIES = 3
SLICE = 512  # vectors that meet the centres of a group at a time
SPLITS = 4  # times that a block that is too large is parted by further planes
SLACK = 1e-6  # of angles, for rounding
MAYBE, UNIT_GETS, VECTOR_GETS, JOINED = range(4)  # kinds of rows, see _reached
CLOSE = 1e-12  # cosines nearer to the threshold than this are computed again, one product after another


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not all zeros."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _raw_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors in double precision; shorter ones are filled up with zeros."""
    sizes = vectors.map(len).to_numpy()
    x = np.zeros((len(vectors), sizes.max()))
    x[np.arange(x.shape[1]) < sizes[:, None]] = np.concatenate(vectors.to_numpy())
    return x / np.abs(x).max(1, keepdims=True)


def unit_rows(vectors: pd.Series) -> np.ndarray:
    """Vectors of length 1; shorter ones are filled up with zeros, which leaves cosines as they are."""
    x = _raw_rows(vectors)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of rows of length 1; those at the threshold don't depend on how rows are put together.

    A matrix product may add in another order for another shape.  Where that
    could decide, the products are added one after another.
    """
    similar = x @ y.T
    i, j = np.nonzero(np.abs(similar - threshold) < CLOSE)
    if len(i):
        a, b = x[i], y[j]
        dot, one, two = np.zeros(len(i)), np.zeros(len(i)), np.zeros(len(i))
        for k in range(x.shape[1]):
            dot, one, two = dot + a[:, k] * b[:, k], one + a[:, k] * a[:, k], two + b[:, k] * b[:, k]
        similar[i, j] = dot / np.sqrt(one * two)
    return similar


def _best(x: np.ndarray, y: np.ndarray, similar: np.ndarray, k: int) -> pd.DataFrame:
    """The k most similar distinct y of each x."""
    order = np.lexsort((y, -similar, x))
    x, y, similar = x[order], y[order], similar[order]
    new = np.ones(len(x), bool)
    new[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1])
    x, y, similar = x[new], y[new], similar[new]
    start = np.searchsorted(x, x)
    top = np.arange(len(x)) - start < k
    return pd.DataFrame({"u": x[top], "v": y[top], "s": similar[top]})


def _top_lists(pairs: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("u").orderBy(F.desc("s"), "v")
    return pairs.groupBy("u", "v").agg(F.max("s").alias("s")).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= k).drop("r")


def _split(blocks: DataFrame, counts: DataFrame, seed: int, kind: str) -> DataFrame:
    """Blocks that are too large, parted by planes through the mean of a sample of each."""
    keys = ["grp", "repeat", "code"]
    inside = blocks.join(counts, keys)

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        at = pdf[keys].head(1).copy()
        at["mean"] = [unit_rows(pdf["vec"]).mean(0)]
        return at

    few = inside.filter(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < F.lit(float(BLOCK << 20)) / F.col("n"))
    means = few.select(*keys, "vec").groupBy(*keys).applyInPandas(mean, "grp long, repeat int, code long, mean array<double>")

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (repeat, n, size), part in pdf.groupby(["repeat", "n", pdf["vec"].map(len)]):
                planes = math.ceil(math.log2(n / BLOCK))
                normal = np.random.default_rng([seed, repeat]).standard_normal((size, planes))
                far = unit_rows(part["vec"]) - np.stack(part["mean"].to_numpy())
                yield pd.DataFrame({"grp": part["grp"], "repeat": part["repeat"], "code": part["code"], "side": ((far @ normal) > 0) @ (1 << np.arange(planes)), "id": part["id"], "vec": part["vec"]})

    parted = inside.join(means, keys).mapInPandas(sides, f"grp long, repeat int, code long, side long, id long, vec array<{kind}>")
    return parted.select("grp", "repeat", F.xxhash64("code", "side", F.lit(seed)).alias("code"), "id", "vec")


def _start(vectors: DataFrame, largest: int, k: int, threshold: float, kind: str, attempt: int = 0, at_random: bool = False) -> DataFrame:
    """Lists from blocks: vectors of a label that lie on the same sides of random planes.

    vectors has (grp, id, vec, size), size being the number of vectors of the
    label.  The number of planes follows from that, the number of repeats from how
    likely a pair at the threshold is to be parted.  A block larger than BLOCK is
    parted by further planes; only what these cannot part is dealt at random.
    Each attempt has other planes, and twice the repeats of the one before.  With
    at_random a vector starts with those of a few small random blocks.
    """
    planes = 0 if at_random else max(0, math.ceil(math.log2(max(1, largest / BLOCK))))

    def repeats(planes: int) -> int:
        if at_random:
            return 4
        together = (1 - math.acos(threshold) / math.pi) ** (planes + 1)
        return 1 if planes == 0 else math.ceil(math.log(MISS) / math.log1p(-together)) << attempt

    def sides(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            x = unit_rows(pdf["vec"])
            # A label's own planes are the first of those of the largest label.
            own = np.minimum(np.ceil(np.log2(np.maximum(pdf["size"].to_numpy() / BLOCK, 1))).astype(int), planes)
            times = np.array([repeats(p) for p in range(planes + 1)])[own]
            for number in range(times.max()):
                normal = np.random.default_rng(1000 * (attempt + 1) + number).standard_normal((x.shape[1], planes))
                bits = ((x @ normal) > 0) & (np.arange(planes) < own[:, None]) if planes else np.zeros((len(x), 0), bool)
                has = times > number
                yield pd.DataFrame({"grp": pdf["grp"], "repeat": np.int32(number), "code": (bits @ (1 << np.arange(planes))).astype(np.int64), "id": pdf["id"], "vec": pdf["vec"]})[has]

    keys = ["grp", "repeat", "code"]
    block = max(4, k // 2) if at_random else BLOCK
    coded = vectors.select("grp", "id", "vec", "size").mapInPandas(sides, f"grp long, repeat int, code long, id long, vec array<{kind}>")
    coded, ready = write_table(coded, "descent-blocks"), None
    for split in range(0 if at_random else SPLITS):
        large = write_table(coded.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > BLOCK), "descent-large")
        small = coded.join(large, keys, "left_anti")
        ready = small if ready is None else ready.unionByName(small)
        if large.isEmpty():
            coded = coded.limit(0)
            break
        coded = write_table(_split(coded, large, 100 * attempt + split, kind), "descent-blocks")
    coded = coded if ready is None else ready.unionByName(coded)
    counts = coded.groupBy(*keys).agg(F.count("*").alias("n"))
    dealt = coded.join(counts, keys).withColumn("part", F.pmod(F.xxhash64("id", "repeat", F.lit(attempt)), F.ceil(F.col("n") / block)))

    def nearest(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = unit_rows(pdf["vec"]), pdf["id"].to_numpy()
        similar = cosines(x, x, threshold)
        np.fill_diagonal(similar, -np.inf)
        most = min(k, len(ids) - 1)
        at = np.argpartition(-similar, max(most - 1, 0), axis=1)[:, :most]
        row = np.repeat(np.arange(len(ids)), most)
        return pd.DataFrame({"u": ids[row], "v": ids[at.ravel()], "s": similar[row, at.ravel()]})

    return _top_lists(dealt.groupBy("grp", "repeat", "code", "part").applyInPandas(nearest, "u long, v long, s double"), k)


def _descend(lists: DataFrame, vectors: DataFrame, n: int, k: int, threshold: float) -> DataFrame:
    """One round: neighbours of a vertex meet in its cell; lists with the better ones among them."""
    both = lists.select("u", "v", "s").union(lists.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"))
    worst = lists.groupBy("u").agg(F.min("s").alias("worst"), F.count("*").alias("has")).select(F.col("u").alias("v"), F.when(F.col("has") >= k, F.col("worst")).otherwise(-2.0).alias("worst"))
    members = _top_lists(both, 2 * k).select("u", "v").join(worst, "v", "left").na.fill(-2.0, ["worst"])
    members = members.join(vectors.select(F.col("id").alias("v"), "vec"), "v")
    groups = max(1, n // CELLS)

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("u", kind="stable")
        ids, worst, x = pdf["v"].to_numpy(), pdf["worst"].to_numpy(), unit_rows(pdf["vec"])
        _, start, count = np.unique(pdf["u"].to_numpy(), return_index=True, return_counts=True)
        size = count.max()
        place = np.minimum(start[:, None] + np.arange(size), len(ids) - 1)
        there = np.arange(size) < count[:, None]
        cells = x[place]
        similar = cells @ cells.transpose(0, 2, 1)
        a, b = ids[place][:, :, None], ids[place][:, None, :]
        good = there[:, :, None] & there[:, None, :] & (a != b) & (similar > worst[place][:, :, None])
        c, i, j = np.nonzero(good)
        s = similar[c, i, j]
        for m in np.flatnonzero(np.abs(s - threshold) < CLOSE):
            s[m] = cosines(x[place[c[m], i[m]]][None], x[place[c[m], j[m]]][None], threshold)[0, 0]
        return _best(ids[place[c, i]], ids[place[c, j]], s, k)

    met = members.withColumn("g", F.pmod(F.xxhash64("u"), F.lit(groups))).groupBy("g").applyInPandas(meet, "u long, v long, s double")
    return _top_lists(lists.select("u", "v", "s").union(met), k)


def _refined(lists: DataFrame, vectors: DataFrame, n: int, k: int, threshold: float) -> DataFrame:
    """Rounds of descent until one hardly improves the lists."""

    def far(now: DataFrame) -> float:
        # A place that is still free counts as far away.
        return 2.0 * n * k - (now.agg(F.sum(F.col("s") + 1)).first()[0] or 0.0)

    before = far(lists)
    for _ in range(ROUNDS):
        lists = write_table(_descend(lists, vectors, n, k, threshold), "descent-lists")
        after = far(lists)
        if before - after <= IMPROVED * before:
            break
        before = after
    return lists


def _reached(vectors: DataFrame, units: DataFrame, threshold: float) -> DataFrame:
    """What the triangle inequality says of vectors and units of their label: (kind, x, y), of four kinds.

    vectors has (grp, id, copies, vec, component_id, open), units (grp, unit,
    component_id, part, parts, weight, centre, radius).  About CENTRES vectors meet
    as many centres in a group; a vector is sent once for every CENTRES units of
    its label.  A vector so near to a centre that it links to every member is
    counted at once, without a row for each unit: UNIT_GETS (unit, total) is what each
    of the unit's members gets, VECTOR_GETS (id, total) what the vector gets, JOINED the
    components that it joins.  A member of the unit is no link of itself, so its own
    copies are taken off it again.  MAYBE (unit, id) are vectors that may link to
    some of the members.
    """
    a = vectors.groupBy("grp").agg(F.ceil(F.count("*") / CENTRES).alias("chunks"))
    b = units.groupBy("grp").agg(F.ceil(F.count("*") / CENTRES).alias("sets"))
    shape = write_table(a.join(b, "grp"), "descent-shape")
    zero = F.lit(0).cast("long")
    rows = vectors.withColumn("h", F.xxhash64("id")).join(shape, "grp").withColumn("chunk", F.pmod("h", "chunks")).withColumn("set", F.explode(F.sequence(zero, F.col("sets") - 1)))
    held = units.join(shape, "grp").withColumn("set", F.pmod(F.xxhash64("unit"), F.col("sets"))).withColumn("chunk", F.explode(F.sequence(zero, F.col("chunks") - 1)))
    angle = math.acos(threshold)

    def meet(x: pd.DataFrame, c: dict[str, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        ids, copies, is_open, own = (x[n].to_numpy() for n in ("id", "copies", "open", "component_id"))
        similar = unit_rows(x["vec"]) @ c["centre"]
        room = angle - SLACK - c["radius"]
        inner = (room > 0) & (similar >= np.cos(np.maximum(room, 0)))
        i, j = np.nonzero((similar >= np.cos(np.minimum(c["radius"] + angle + SLACK, math.pi)) - SLACK) & ~inner)
        yield MAYBE, c["unit"][j], ids[i]
        same = inner & (own[:, None] == c["component_id"])
        member = same & is_open[:, None] & (x["h"].to_numpy()[:, None] % c["parts"] == c["part"])
        yield UNIT_GETS, c["unit"], copies @ inner
        yield VECTOR_GETS, ids, np.where(is_open, -copies * member.any(1), inner @ c["weight"])
        i, j = np.nonzero(inner & ~same)
        joined = np.unique(np.stack([own[i], c["component_id"][j]]), axis=1)
        yield JOINED, joined[0], joined[1]

    def reach(x: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out = [(MAYBE, np.zeros(0, np.int64), np.zeros(0, np.int64))]
        if len(c):
            held = {n: c[n].to_numpy() for n in ("unit", "component_id", "part", "parts", "weight", "radius")} | {"centre": np.stack(c["centre"].to_numpy()).T}
            for at in range(0, len(x), SLICE):  # so that what a slice needs besides its rows is some megabytes
                out += [o for o in meet(x.iloc[at : at + SLICE], held) if o[0] in (MAYBE, JOINED) or o[2].any()]
        kind = np.repeat([k for k, _, _ in out], [len(x) for _, x, _ in out]).astype(np.int32)
        return pd.DataFrame({"kind": kind, "x": np.concatenate([x for _, x, _ in out]), "y": np.concatenate([y for _, _, y in out])})

    keys = ["grp", "chunk", "set"]
    return rows.drop("chunks", "sets").groupBy(*keys).cogroup(held.drop("chunks", "sets").groupBy(*keys)).applyInPandas(reach, "kind int, x long, y long")


def _complete(vectors: DataFrame, threshold: float) -> DataFrame:
    """All links of the members of open components: (id, links) and (a, b) for components that a link joins.

    vectors has (id, grp, copies, vec, component_id, open).  A vector outside the
    open components gets its links with their members only.
    """
    members = vectors.filter("open")
    sizes = members.groupBy("component_id").agg(F.ceil(F.count("*") / UNIT).alias("parts"))
    members = members.join(sizes, "component_id").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).withColumn("unit", F.xxhash64("component_id", "part")).drop("open")
    members = write_table(members, "descent-members")

    def measure(pdf: pd.DataFrame) -> pd.DataFrame:
        x = unit_rows(pdf["vec"])
        centre = x.mean(0)
        centre /= max(np.linalg.norm(centre), 1e-300)
        unit = pdf[["grp", "unit", "component_id", "part", "parts"]].head(1)
        return unit.assign(weight=pdf["copies"].sum(), centre=[centre], radius=np.arccos(np.clip(x @ centre, -1, 1)).max())

    unit_columns = "grp long, unit long, component_id long, part long, parts long, weight long, centre array<double>, radius double"
    units = write_table(members.select("grp", "unit", "component_id", "part", "parts", "copies", "vec").groupBy("grp", "unit").applyInPandas(measure, unit_columns), "descent-units")
    reached = write_table(_reached(vectors, units, threshold), "descent-reached")
    some = reached.filter(F.col("kind") == MAYBE).select(F.col("x").alias("unit"), F.col("y").alias("id"))
    meets = write_table(some.groupBy("unit").agg(F.ceil(F.count("*") / MEET).alias("parts")), "descent-meets")
    x = some.join(meets, "unit").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    x = x.join(vectors.select("id", "copies", "vec", "component_id", "open"), "id")
    y = members.select("unit", "id", "copies", "vec", "component_id").join(meets, "unit").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def compare(near: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"id": [], "links": [], "a": [], "b": []})]
        if len(near) and len(own):
            hit = cosines(unit_rows(near["vec"]), unit_rows(own["vec"]), threshold) >= threshold
            hit &= near["id"].to_numpy()[:, None] != own["id"].to_numpy()[None, :]
            alone = ~near["open"].to_numpy(bool)
            for ids, links in ((own["id"].to_numpy(), near["copies"].to_numpy() @ hit), (near["id"].to_numpy()[alone], hit[alone] @ own["copies"].to_numpy())):
                out.append(pd.DataFrame({"id": ids[links > 0], "links": links[links > 0]}))
            to = near["component_id"].to_numpy()
            joined = np.unique(to[hit.any(1) & (to != own["component_id"].iloc[0])])
            out.append(pd.DataFrame({"a": joined, "b": own["component_id"].iloc[0]}))
        return pd.concat([o for o in out if len(o)] or out).reindex(columns=["id", "links", "a", "b"]).astype("Int64")

    compared = x.groupBy("unit", "part").cogroup(y.groupBy("unit", "part")).applyInPandas(compare, "id long, links long, a long, b long")
    totals = reached.filter(F.col("kind") == UNIT_GETS).groupBy(F.col("x").alias("unit")).agg(F.sum("y").alias("links"))
    counted = members.select("unit", "id").join(totals, "unit").select("id", "links").unionByName(reached.filter(F.col("kind") == VECTOR_GETS).select(F.col("x").alias("id"), F.col("y").alias("links")))
    joined = reached.filter(F.col("kind") == JOINED).select(F.col("x").alias("a"), F.col("y").alias("b"))
    found = compared.unionByName(counted, allowMissingColumns=True).unionByName(joined, allowMissingColumns=True)
    return write_table(found.groupBy("id", "a", "b").agg(F.sum("links").alias("links")), "descent-complete")


def audit_recall(vectors: DataFrame, degrees: DataFrame, n: int, threshold: float) -> float:
    """Share of a sample's links that degrees (id, links) has, against a comparison with all vectors.

    About AUDIT vectors, chosen by hash, go to every task.  The share is the
    smallest of three: of all links, of the mean over the vectors that have any,
    and of the vectors with few links (as many as a list holds at first), so that
    large groups, which are counted exactly, do not hide small ones.
    """
    rate = min(1.0, AUDIT / max(n, 1))
    chosen = vectors.filter(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(1 << 60)) < int(rate * (1 << 60))).select("id", "grp", "vec").toPandas()
    if chosen.empty:
        return 1.0
    ids, grp = chosen["id"].to_numpy(), chosen["grp"].to_numpy()
    sides = {g: (ids[grp == g], unit_rows(chosen["vec"][grp == g])) for g in set(grp.tolist())}

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for g, part in pdf.groupby("grp"):
                if g in sides:
                    own, x = sides[g]
                    near = (cosines(x, unit_rows(part["vec"]), threshold) >= threshold) & (own[:, None] != part["id"].to_numpy()[None, :])
                    yield pd.DataFrame({"id": own, "links": near @ part["copies"].to_numpy()})

    true = vectors.select("id", "grp", "copies", "vec").mapInPandas(compare, "id long, links long").groupBy("id").agg(F.sum("links").alias("true_links"))
    both = true.filter("true_links > 0").join(degrees, "id", "left").withColumn("links", F.coalesce("links", F.lit(0)))
    few = F.col("true_links") <= NEIGHBOURS
    shares = both.agg(F.sum("links") / F.sum("true_links"), F.avg(F.col("links") / F.col("true_links")), F.sum(F.when(few, F.col("links"))) / F.sum(F.when(few, F.col("true_links"))))
    return min((x for x in shares.first() if x is not None), default=1.0)


def near_duplicate_vectors(df: DataFrame, key: str, vector: str, label: str, threshold: float = THRESHOLD, neighbours: int = NEIGHBOURS, at_random: bool = False) -> DataFrame:
    """(key, n_links, component_id, kept), one row for each row of df.

    Rows link if their labels are equal and not null and the cosine of their
    vectors, in double precision, is at least the threshold.  Vectors that are
    null or zero, or hold null or non-finite components, link with nothing, and
    nor do vectors of different lengths, null labels or null keys.  n_links counts
    the other rows linked directly, copies included; component_id is the smallest
    key reachable; kept says that the key is its component's.  Many rows of one
    label, of one vector or of its multiples are compared in groups of bounded
    size.  The audited recall of each try is logged at level INFO.  With at_random the first lists are random and only the descent finds
    neighbours.  An empty table gives an empty result.  Other columns of df,
    whatever their names, are not carried.
    """
    kind = "float" if dict(df.dtypes)[vector] == "array<float>" else "double"
    rows = df.select(F.col(key).alias("id"), F.col(vector).cast(f"array<{kind}>").alias("vec"), F.col(label).alias("label"))
    ok = usable(F.col("vec")) & F.col("label").isNotNull() & F.col("id").isNotNull()
    keyed = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    # Two hashes of different seeds, 128 bits in all, stand for a label's vector.
    known_by = F.struct(F.xxhash64("label", "vec").alias("a"), F.xxhash64(F.lit("second"), "vec", "label").alias("b"))
    keyed = write_table(keyed.withColumn("grp", F.xxhash64("label", F.size("vec"))).withColumn("k", F.when(F.col("ok"), known_by)), "descent-rows")
    classes = keyed.filter("ok").groupBy("grp", "k").agg(F.min("id").alias("key"), F.count("*").alias("copies"), F.first("vec").alias("vec"))
    # A vertex has a number of its own: a key may have several vectors.
    classes = write_table(classes.withColumn("id", F.monotonically_increasing_id()), "descent-classes")
    sizes = classes.groupBy("grp").agg(F.count("*").alias("size"))
    vectors = write_table(classes.join(sizes, "grp"), "descent-vectors")
    n, largest = vectors.agg(F.count("*"), F.max("size")).first()
    if n == 0:
        return keyed.select(F.col("id").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    k, lists = neighbours, None
    for attempt in range(TRIES + 1):
        if attempt < TRIES:
            begun = _start(vectors, largest, k, threshold, kind, attempt, at_random)
            lists = write_table(begun if lists is None else _top_lists(begun.union(lists), k), "descent-lists")
            lists = _refined(lists, vectors, n, k, threshold)
            links = write_table(lists.filter(F.col("s") >= threshold).select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct(), "descent-links")
            comps = write_table(components(links, "a", "b"), "descent-components")
            full = lists.groupBy("u").agg(F.min("s").alias("low"), F.count("*").alias("has")).filter((F.col("has") >= k) & (F.col("low") >= threshold)).select(F.col("u").alias("id"))
            open_comps = comps.join(full, "id").select("component_id").distinct()
        else:  # no try found enough: all are compared with all
            open_comps = vectors.select("id").join(comps, "id", "left").select(F.coalesce("component_id", "id").alias("component_id")).distinct()
        placed = vectors.select("id", "grp", "copies", "vec").join(comps, "id", "left").withColumn("component_id", F.coalesce("component_id", "id"))
        placed = write_table(placed.join(open_comps.withColumn("open", F.lit(True)), "component_id", "left").na.fill(False, ["open"]), "descent-placed")
        ends = links.select(F.col("a").alias("id"), F.col("b").alias("o")).union(links.select(F.col("b"), F.col("a")))
        listed = ends.join(vectors.select(F.col("id").alias("o"), "copies"), "o").groupBy("id").agg(F.sum("copies").alias("links")).join(placed.filter("open").select("id"), "id", "left_anti")
        complete = _complete(placed, threshold)
        counted = listed.unionByName(complete.filter("id is not null").select("id", "links"))
        degrees = write_table(counted.groupBy("id").agg(F.sum("links").alias("links")), "descent-degrees")
        if attempt == TRIES:
            _log.info("everything was compared")
            break
        recall = audit_recall(vectors, degrees, n, threshold)
        _log.info("try %d with lists of %d: audited recall %.4f, target %.2f", attempt + 1, k, recall, TARGET_RECALL)
        if recall >= TARGET_RECALL:
            break
        k *= 2
    joined = components(complete.filter("a is not null").select("a", "b"), "a", "b").select(F.col("id").alias("component_id"), F.col("component_id").alias("whole"))
    whole = placed.select("id", "component_id").join(joined, "component_id", "left").select("id", F.coalesce("whole", "component_id").alias("root"))
    known = vectors.select("grp", "k", "id", "key", "copies").join(degrees, "id", "left").join(whole, "id")
    smallest = known.groupBy("root").agg(F.min("key").alias("component_id"))
    known = write_table(known.select("grp", "k", "root", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")).join(smallest, "root"), "descent-known")
    found = keyed.filter("ok").select("id", "grp", "k").join(known, ["grp", "k"]).select("id", "n_links", "component_id")
    alone = keyed.filter("not ok").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return found.unionByName(alone).select(F.col("id").alias(key), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op6_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings within their labels."""
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", "label")


OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT a.vec_id AS x, b.vec_id AS y
  FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS x, vec_id AS y FROM embeddings
  UNION
  SELECT r.x, p.y FROM reach r JOIN pairs p ON r.y = p.x
), components AS (SELECT x, min(y) AS component_id FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM pairs GROUP BY x)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN degrees d ON e.vec_id = d.x LEFT JOIN components c ON e.vec_id = c.x
"""
