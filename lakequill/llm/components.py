"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakequill.llm import common
from lakequill.llm.common import discard, spread_join, stored


def _joined(edges: DataFrame, low: DataFrame, n: int) -> DataFrame:
    """Edges with the m of their u. n: rows of edges at most; so few need no look for hot nodes."""
    lowest = low.select("u", "m")
    return edges.join(lowest, "u") if n <= common.HOT else spread_join(edges, lowest, "u", low.select("u", "rows"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("rows"))
    return _joined(both, low, 2 * n).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("rows"))
    moved = _joined(down, low, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(low.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, component) for every node of an edge, component being the smallest node reachable.

    edges: two long columns; loops, repeats and both directions are allowed, null ends are ignored; an empty
    table gives an empty result. Every round reads and writes the edge table once in the shared folder and
    counts only a checksum on the driver; the number of rounds grows with the logarithm of the longest path.
    """
    now = edges.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    now = stored(now.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(now)
    while state[0]:
        large = _large_star(now, state[0])
        large = stored(large, "edges") if state[0] > common.HOT else large
        new = stored(_small_star(large, state[0]), "edges")
        discard(now, large)
        now, before = new, state
        state = _state(now)
        if state == before:
            break
    pairs = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return pairs.unionAll(pairs.select(F.col("component").alias("node"), "component").distinct())
