"""Connected components by alternating large-star and small-star steps.

Every step is two shuffles over the edges; minima are pre-aggregated before the shuffle, and a node's edges are
joined with its minimum, never gathered. Nodes with very many edges (hubs) are so few that their minima are
broadcast: their edges stay where they lie. Each round cuts the lineage with ``checkpoint()``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.llm.common import cut

MAX_ROUNDS = 100
#: A hub has more edges than this, and more than this share of all edges; so there are at most 2 / HUB_SHARE hubs (16 bytes each).
HUB_EDGES, HUB_SHARE = 1000, 1e-5


def _with_least(edges: DataFrame, rows: DataFrame, least: Column, hub: int) -> DataFrame:
    """``rows`` with ``m``, the ``least`` of the edges that share their ``a``."""
    found = edges.groupBy("a").agg(least.alias("m"), F.count(F.lit(1)).alias("n"))
    hubs = F.broadcast(found.where(F.col("n") > hub).select("a", "m"))
    rest = rows.join(hubs.select("a"), "a", "left_anti").join(found.where(F.col("n") <= hub).select("a", "m"), "a")
    return rows.join(hubs, "a").select("a", "b", "m").union(rest.select("a", "b", "m"))


def _large_star(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = _with_least(both, both.where("b > a"), F.least(F.min("b"), F.min("a")), hub)
    return found.select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame, hub: int) -> DataFrame:
    found = _with_least(edges, edges, F.min("b"), hub)
    others = found.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.union(edges.groupBy("a").agg(F.min("b").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    mixed = F.xxhash64("a", "b")
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(mixed), F.sum(mixed.cast("decimal(20,0)"))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """Smallest reachable node of every node that has a link to another.

    ``links`` has the integer columns ``a`` and ``b`` in either order; repeats, loops and nulls have no
    effect. Returns ``node`` and ``root``, roots included; no links give no rows.
    """
    edges = cut(
        links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = _state(edges)
    for _ in range(MAX_ROUNDS):
        if before[0] == 0:
            break
        hub = max(HUB_EDGES, int(before[0] * HUB_SHARE))
        edges = cut(_small_star(_large_star(edges, hub), hub))
        after = _state(edges)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    members = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return members.union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
