"""Exact top-k inner products by best-first search in an M-tree.

Inner products become distances: with M the largest norm, a vector x gets the
extra coordinate sqrt(M**2 - |x|**2), a query q gets 0, and then
|q - x|**2 = |q|**2 + M**2 - 2 q.x, so the nearest vectors have the largest
products.  The tree is grown level by level: the vectors of a node that is too
large are dealt to the nearest of a few of its own vectors, which become the
centres of its children.  A node keeps its centre, its covering radius and its
distance from its parent's centre, a vector its distance from its leaf's centre.

Queries go through the tree in blocks, so that a frontier has a row for each block
and node with the queries that still hope for something there, not one for each
query.  A query first searches the leaf it lies in itself, which gives it a score
to beat.  Children whose stored distance from the parent's centre already rules
them out cost no distance computation; those whose ball cannot reach the score are
left out with all below them.  The leaves that remain are read most promising
first, in waves that grow; after each wave the scores to beat are higher, and
leaves that cannot reach them any more are not read.  In a leaf the stored
distances rule vectors out before any product is computed.  Bounds carry a slack
for rounding; scores are whole numbers.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.worktables import write_table

SCALE = 256
TOP = 5
QUERY_EVERY = 50
PAGE = 512  # vectors of a leaf
FANOUT = 24  # children of a node
LEVELS = 12  # of nodes that are dealt to children; node numbers stay below 2**63
DEALT = 8192  # vectors that are dealt in one group
QUERY_BLOCK = 1024  # queries that go through the tree together, on average
NODES = 64  # nodes that a block opens in one group, on average
PAGES = 16  # pages that a block reads in one group, on average
WAVES = (4, 32)  # leaves that a block has read after each wave but the last
SLACK = 1e-6  # relative to M
MOST = 2.0**62  # of a squared norm; products then fit a long

_CHILD = 1 << 5  # child numbers fit below this


def whole_components(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component, x as double; null if any is null or not finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(vector.isNotNull() & finite, F.transform(vector, lambda x: F.floor(x.cast("double") * scale)))


def _matrix(vectors: pd.Series, dim: int) -> np.ndarray:
    """Rows of whole numbers, filled up with zeros."""
    out = np.zeros((len(vectors), dim), np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _lifted(x: np.ndarray, top: float) -> np.ndarray:
    """With the extra coordinate."""
    rest = np.sqrt(np.maximum(top - (x * x).sum(1), 0).astype(float))
    return np.concatenate([x.astype(float), rest[:, None]], 1)


def _flat(q: np.ndarray) -> np.ndarray:
    """Queries, whose extra coordinate is 0."""
    return np.concatenate([q.astype(float), np.zeros((len(q), 1))], 1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T
    return np.sqrt(np.maximum(square, 0))


def _promise(q: np.ndarray, least: np.ndarray, top: float) -> np.ndarray:
    """A bound of the products of each query with vectors at least that far away."""
    near = np.maximum(least - SLACK * np.sqrt(top), 0)
    return ((q * q).sum(1)[:, None] + top - near * near) / 2 + SLACK * top


def _grow(points: DataFrame, dim: int, top: float) -> tuple[DataFrame, DataFrame | None, int]:
    """Leaves (node, depth, uid, id, vec, asks, away), nodes (node, parent, centre, radius, apart, leaf) and the depth.

    A node's number is its parent's times 32 plus its own place; the root is 1 and
    is no row of the nodes.  Vectors that are all alike cannot be parted by
    distance; they stay one node, and a leaf of any size is read in pages.
    """
    now, done, levels, above = points, None, [], None
    for level in range(LEVELS):
        drawn = F.xxhash64("vec", F.lit(level))
        sizes = now.groupBy("node").agg(F.count("*").alias("n"), F.countDistinct(drawn).alias("kinds"))
        large = write_table(sizes.filter((F.col("n") > PAGE) & (F.col("kinds") > 1)), "mtree-large")
        # The children's centres: the node's vectors with the smallest hashes, all different.
        # Copies share a hash, so the rate is of the different vectors, not of the rows.
        inside = now.join(large, "node")
        likely = F.pmod(drawn, F.lit(1 << 30)) < F.lit(8.0 * FANOUT) / F.col("kinds") * F.lit(1 << 30)
        order = Window.partitionBy("node").orderBy("h", "vec")
        few = inside.filter(likely | (F.col("kinds") <= 8 * PAGE)).select("node", "n", "vec", drawn.alias("h")).distinct()
        first = few.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= FANOUT)
        centres = first.groupBy("node").agg(F.collect_list("vec").alias("centres"), F.ceil(F.max("n") / DEALT).alias("pieces"))
        centres = write_table(centres.filter(F.size("centres") > 1), "mtree-centres")
        # A node without two centres is a leaf, whatever its size.
        small = now.join(centres, "node", "left_anti")
        done = small if done is None else done.unionByName(small)
        if centres.isEmpty():
            now = now.limit(0)
            break

        def deal(rows: pd.DataFrame, at: pd.DataFrame) -> pd.DataFrame:
            if rows.empty:
                return pd.DataFrame({c.split()[0]: [] for c in dealt_schema.split(", ")})
            far = _distances(_lifted(_matrix(rows["vec"], dim), top), _lifted(_matrix(pd.Series(list(at["centres"].iloc[0])), dim), top))
            pick = far.argmin(1)
            return rows.assign(node=rows["node"] * _CHILD + pick, depth=rows["depth"] + 1, away=far[np.arange(len(pick)), pick])[[c.split()[0] for c in dealt_schema.split(", ")]]

        dealt_schema = "uid long, id long, vec array<long>, asks boolean, node long, depth int, away double"
        pieces = now.join(centres.select("node", "pieces"), "node").withColumn("piece", F.pmod(F.xxhash64("uid"), F.col("pieces"))).drop("pieces")
        held = centres.select("node", "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)).alias("piece"))
        now = write_table(pieces.groupBy("node", "piece").cogroup(held.groupBy("node", "piece")).applyInPandas(deal, dealt_schema), "mtree-level")
        reach = now.groupBy("node").agg(F.max("away").alias("radius"))
        centre = centres.select(F.col("node").alias("parent"), F.posexplode("centres").alias("place", "centre")).withColumn("node", F.col("parent") * _CHILD + F.col("place"))
        below = reach.join(centre, "node").select("node", "parent", "centre", "radius")
        below = below.withColumn("parent_centre", F.lit(None).cast("array<long>")) if above is None else below.join(above.select(F.col("node").alias("parent"), F.col("centre").alias("parent_centre")), "parent")
        above = write_table(below.mapInPandas(_apart(dim, top), "node long, parent long, centre array<long>, radius double, apart double"), "mtree-nodes")
        levels.append(above)
    # What is still large after the last level stays as it is.
    leaves = write_table(done.unionByName(now), "mtree-leaves")
    held, given = leaves.count(), points.count()
    if held != given:
        raise AssertionError(f"leaves hold {held} of {given} vectors")
    if not levels:
        return leaves, None, 0
    nodes = levels[0]
    for level_nodes in levels[1:]:
        nodes = nodes.unionByName(level_nodes)
    parents = nodes.select(F.col("parent").alias("node")).distinct().withColumn("inner", F.lit(True))
    nodes = nodes.join(parents, "node", "left").withColumn("leaf", F.col("inner").isNull()).drop("inner")
    return leaves, write_table(nodes, "mtree-tree"), len(levels)


def _apart(dim: int, top: float):
    """Adds the distance between a node's centre and its parent's; null below the root, which has no centre."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            apart = np.full(len(pdf), np.nan)
            has = pdf["parent_centre"].notna().to_numpy()
            if has.any():
                one, two = (_lifted(_matrix(pdf[c][has], dim), top) for c in ("centre", "parent_centre"))
                apart[has] = np.linalg.norm(one - two, axis=1)
            yield pdf.drop(columns="parent_centre").assign(apart=apart)[["node", "parent", "centre", "radius", "apart"]]

    return measure


FRONTIER = "block long, node long, leaf boolean, asks array<long>, to array<double>, hope array<double>"


def _batched(rows: DataFrame, size: int, *keys: str) -> DataFrame:
    """rows with a batch number such that a block has about size rows in each batch."""
    counts = rows.groupBy("block").agg(F.ceil(F.count("*") / size).alias("batches"))
    return rows.join(counts, "block").withColumn("batch", F.pmod(F.xxhash64(*keys), F.col("batches"))).drop("batches")


def _with_batches(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """The queries of each block, once for each of its batches."""
    found = queries.join(rows.select("block", "batch").distinct(), "block")
    return found.select([F.col(c).alias(c) for c in found.columns])  # as columns of their own, for the cogroup


def _open(frontier: DataFrame, nodes: DataFrame, queries: DataFrame, dim: int, top: float) -> DataFrame:
    """The children of a frontier's nodes that can still hold something for a query."""
    asked = _batched(frontier.select("block", "node", "asks", "to"), NODES, "node")
    children = asked.select("block", "batch", F.col("node").alias("parent")).join(nodes, "parent")
    both = children.unionByName(asked, allowMissingColumns=True)

    def open_nodes(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        place = pd.Series(np.arange(len(own)), index=own["uid"].to_numpy())
        q, beat = _matrix(own["q"], dim), own["beat"].to_numpy()
        here = rows[rows["asks"].notna()].set_index("node")
        for parent, below in rows[rows["asks"].isna()].groupby("parent"):
            asks, to = (np.asarray(here.at[parent, c]) for c in ("asks", "to"))
            at = place[asks].to_numpy()
            radius, apart = below["radius"].to_numpy(), below["apart"].to_numpy()
            # The parent distance bounds a child's from below without computing it.
            least = np.nan_to_num(np.abs(to[:, None] - apart[None, :]) - radius[None, :], nan=0.0)
            may = _promise(q[at], least, top) >= beat[at, None]
            some = np.flatnonzero(may.any(0))
            if not len(some):
                continue
            far = _distances(_flat(q[at]), _lifted(_matrix(below["centre"].iloc[some], dim), top))
            hope = _promise(q[at], far - radius[None, some], top)
            good = may[:, some] & (hope >= beat[at, None])
            for k, c in enumerate(some):
                g = good[:, k]
                if g.any():
                    out.append((own["block"].iloc[0], below["node"].iloc[c], below["leaf"].iloc[c], asks[g], far[g, k], hope[g, k]))
        return pd.DataFrame(out, columns=[c.split()[0] for c in FRONTIER.split(", ")])

    opened = both.groupBy("block", "batch").cogroup(_with_batches(queries, asked).groupBy("block", "batch"))
    return opened.applyInPandas(open_nodes, FRONTIER)


def _read_leaves(visits: DataFrame, leaves: DataFrame, queries: DataFrame, dim: int, top: float, k: int, home: bool) -> DataFrame:
    """The k best (uid, id, other, score) of each query in the leaves it visits, a batch of pages at a time.

    Unless home is true, a query's own leaf, which it has searched, is left out.
    """
    pages = leaves.join(visits.select("node").distinct(), "node").groupBy("node").agg(F.ceil(F.count("*") / PAGE).alias("pages"))
    paged = visits.select("block", "node", "asks", "to").join(pages, "node").withColumn("page", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)))
    asked = _batched(paged, PAGES, "node", "page")
    vectors = leaves.select("node", "uid", "id", "vec", "away").join(pages, "node").withColumn("page", F.pmod(F.xxhash64("uid"), F.col("pages"))).drop("pages")
    read = asked.select("block", "batch", "node", "page").join(vectors, ["node", "page"])
    both = read.unionByName(asked.drop("pages"), allowMissingColumns=True)

    def search(rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"uid": [], "other": [], "id": [], "score": []}, dtype=np.int64)]
        place = pd.Series(np.arange(len(own)), index=own["uid"].to_numpy())
        all_q, all_beat, all_home = _matrix(own["q"], dim), own["beat"].to_numpy(), own["home"].to_numpy()
        uids = own["uid"].to_numpy()
        here = rows[rows["asks"].notna()].set_index(["node", "page"])
        for at_page, part in rows[rows["asks"].isna()].groupby(["node", "page"]):
            asks, to = (np.asarray(here.at[at_page, c]) for c in ("asks", "to"))
            at = place[asks].to_numpy()
            if not home:
                away = all_home[at] != at_page[0]
                at, to = at[away], to[away]
            if not len(at):
                continue
            x, q, beat, me = _matrix(part["vec"], dim), all_q[at], all_beat[at], uids[at]
            # |distance to the centre - stored distance| bounds the distance from below.
            hope = _promise(q, np.nan_to_num(np.abs(to[:, None] - part["away"].to_numpy()[None, :]), nan=0.0), top) >= beat[:, None]
            hope &= me[:, None] != part["uid"].to_numpy()[None, :]
            rs, cs = np.flatnonzero(hope.any(1)), np.flatnonzero(hope.any(0))
            if not len(rs):
                continue
            # Products of whole numbers below 2**53 are exact in floating point, and fast.
            exact = float(np.abs(x).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim < 2**53
            kind = np.float64 if exact else np.int64
            score = (q[rs].astype(kind) @ x[cs].astype(kind).T).astype(np.int64)
            r, c = np.nonzero(hope[np.ix_(rs, cs)] & (score >= beat[rs, None]))
            found = pd.DataFrame({"uid": me[rs[r]], "other": part["uid"].to_numpy()[cs[c]], "id": part["id"].to_numpy()[cs[c]], "score": score[r, c]})
            out.append(_best(found, k))
        return _best(pd.concat(out), k)

    found = both.groupBy("block", "batch").cogroup(_with_batches(queries, asked).groupBy("block", "batch"))
    return found.applyInPandas(search, "uid long, other long, id long, score long")


def _best(found: pd.DataFrame, k: int) -> pd.DataFrame:
    found = found.sort_values(["uid", "score", "id", "other"], ascending=[True, False, True, True])
    return found[found.groupby("uid").cumcount() < k]


def _top(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("uid").orderBy(F.desc("score"), "id", "other")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def _asked(queries: DataFrame) -> DataFrame:
    """(block, asks): each block's queries in one row of at most a few thousand numbers."""
    return queries.groupBy("block").agg(F.sort_array(F.collect_list("uid")).alias("asks"))


def _raised(queries: DataFrame, known: DataFrame, k: int) -> DataFrame:
    """queries with the score that each has to beat."""
    beat = known.groupBy("uid").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).otherwise(float("-inf")).alias("beat"))
    return write_table(queries.drop("beat").join(beat, "uid", "left").na.fill(float("-inf"), ["beat"]), "mtree-queries")


def _hopeful(visits: DataFrame, queries: DataFrame) -> DataFrame:
    """visits without the queries, and then the leaves, that can't reach the scores to beat any more."""
    flat = visits.select("block", "node", F.explode(F.arrays_zip("asks", "to", "hope")).alias("z")).select("block", "node", F.col("z.asks").alias("uid"), "z.to", "z.hope")
    left = flat.join(queries.select("uid", "beat"), "uid").filter("hope >= beat")
    return left.groupBy("block", "node").agg(F.collect_list(F.struct("uid", "to", "hope")).alias("z")).select("block", "node", F.col("z.uid").alias("asks"), F.col("z.to").alias("to"), F.col("z.hope").alias("hope"))


def _blocks(leaves: DataFrame) -> DataFrame:
    """(uid, q, home, block): queries that lie in the same part of the tree share a block."""
    queries = leaves.filter("asks").select("uid", F.col("vec").alias("q"), F.col("node").alias("home"), "depth")
    wanted = max(1, math.ceil(queries.count() / QUERY_BLOCK))
    level = int(math.log(wanted, FANOUT))
    region = F.expr(f"shiftright(home, {int(math.log2(_CHILD))} * greatest(depth - {level}, 0))")
    queries = queries.withColumn("region", region).drop("depth")
    parts = queries.groupBy("region").agg(F.ceil(F.count("*") / QUERY_BLOCK).alias("parts"))
    return queries.join(parts, "region").withColumn("block", F.xxhash64("region", F.pmod(F.xxhash64("uid"), F.col("parts")))).select("uid", "q", "home", "block")


def top_products(df: DataFrame, key: str, vector: str, is_query: Column, k: int = TOP, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, key, score): the k largest inner products of every query with all other rows.

    Vectors are taken as floor(scale * x).  Ties go to the smaller key.  Rows
    whose vector is null or holds null or non-finite components, and rows with a
    null key, take no part; shorter vectors count as filled up with zeros.  A row
    is no candidate for itself, but another row with the same key and vector is.
    If there are fewer than k candidates, all come.  An empty table gives no rows.
    Scores are longs: if a vector's product with itself would reach 2**62 (64
    components of about one million at scale 256), a ValueError says so.  Other
    columns, whatever their names, are not read.
    """
    rows = df.select(F.col(key).alias("id"), whole_components(F.col(vector), scale).alias("vec"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.filter("vec is not null and id is not null").withColumn("uid", F.monotonically_increasing_id())
    # All lie in the root; as columns of the table, for a join on a literal would be a cross join.
    points = write_table(rows.withColumns({"node": F.lit(1).cast("long"), "depth": F.lit(0), "away": F.lit(0.0)}), "mtree-points")
    norm = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    whole = points.agg(F.max(norm).alias("top"), F.max(F.size("vec")).alias("dim")).first()
    spark = df.sparkSession
    if whole["top"] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long").withColumnRenamed("vec_id", key)
    top, dim = float(whole["top"]), int(whole["dim"])
    if top >= MOST:
        raise ValueError(f"components are too large for products that fit a long: a squared norm is {top:.3g}, at most {MOST:.3g} is allowed")
    leaves, nodes, depth = _grow(points, dim, top)
    queries = write_table(_blocks(leaves).withColumn("beat", F.lit(float("-inf"))), "mtree-queries")

    # Every query's own leaf gives it a first score to beat.
    unknown = F.transform("asks", lambda x: F.lit(float("nan")))
    own = queries.groupBy("block", F.col("home").alias("node")).agg(F.sort_array(F.collect_list("uid")).alias("asks")).withColumn("to", unknown)
    known = write_table(_top(_read_leaves(own, leaves, queries, dim, top, k, home=True), k).drop("rank"), "mtree-known")
    if depth:
        queries = _raised(queries, known, k)
        frontier = _asked(queries).select("block", F.lit(1).cast("long").alias("node"), F.lit(False).alias("leaf"), "asks", unknown.alias("to"))
        visits = None
        for _ in range(depth):
            opened = write_table(_open(write_table(frontier, "mtree-frontier"), nodes, queries, dim, top), "mtree-opened")
            frontier = opened.filter("not leaf")
            visits = opened.filter("leaf") if visits is None else visits.unionByName(opened.filter("leaf"))
        best_first = F.row_number().over(Window.partitionBy("block").orderBy(F.desc(F.array_max("hope")), "node"))
        visits = write_table(visits.withColumn("turn", best_first), "mtree-visits")
        for after, upto in zip((0, *WAVES), (*WAVES, None)):
            wave = visits.filter((F.col("turn") > after) & (F.lit(True) if upto is None else F.col("turn") <= upto))
            wave = write_table(_hopeful(wave, queries), "mtree-wave")
            found = _read_leaves(wave, leaves, queries, dim, top, k, home=False)
            known = write_table(_top(found.unionByName(known), k).drop("rank"), "mtree-known")
            queries = _raised(queries, known, k)
    return _top(known, k).join(points.select("uid", F.col("id").alias("query_id")), "uid").select("query_id", "rank", F.col("id").alias(key), "score")


def op7_mtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five largest products of every fiftieth embedding with all others."""
    return top_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding", F.col("vec_id") % QUERY_EVERY == 0)


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
) WHERE rank <= 5
"""
