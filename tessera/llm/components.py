"""Connected components by alternating large-star and small-star steps.

Each step is a join and an aggregation over the links, written to the shared
folder.  The number of rounds grows with the logarithm of a component's size, and
no component, however large, is brought together in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.worktables import write_table


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Links of every neighbour to the smallest vertex of its neighbourhood."""
    down = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
    pairs = down.union(links.select(F.col("b").alias("u"), F.col("a").alias("v"))) if large else down
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    joined = pairs.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % F.lit(1 << 40))).first())


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(id, component_id) for every id that is linked; component_id is the smallest id reachable.

    links has a row for each link, in either direction and repeated or not; null
    ends and links of an id to itself are left out.  No links give no rows.
    """
    now = links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).filter(f"`{a}` is not null and `{b}` is not null and `{a}` <> `{b}`").distinct()
    now = write_table(now, "links")
    before = _digest(now)
    while before[0]:
        now = write_table(_star(_star(now, large=True), large=False).distinct(), "links")
        after = _digest(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).union(now.select("b", "b").distinct())
