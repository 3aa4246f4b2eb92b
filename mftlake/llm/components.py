"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, hot_from, spread_join


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())


def _met(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges``, ``total`` of them, beside the minimum of ``a``. Both are tables of the shared folder, so a plan holds nothing of the rounds before.

    Nodes with too many edges for one task are shipped to them (see :func:`~.common.spread_join`) where there are any; where there are none, a plain join
    spares the driver the broadcasts and the larger plan.
    """
    most = least.agg(F.max("_rows")).first()[0] or 0
    return edges.join(least, "a") if most < hot_from(total) else spread_join(edges, least, "a", "_rows", total)


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node points its larger neighbours at its smallest one. A table of the shared folder, as ``edges`` is."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = cut(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count("*").alias("_rows")))
    found = cut(_met(both, least, 2 * total).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    discard(least)
    return found


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """Each node points its smaller neighbours and itself at the smallest of them. A table of the shared folder, as ``edges`` is."""
    least = cut(edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("_rows")))
    joined = _met(edges, least, total)
    found = cut(joined.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    discard(least)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a, b; any order, repeats allowed); root: the smallest node reachable.

    Large-star and small-star rounds alternate until nothing changes, which takes a number of rounds that
    grows with the logarithm of the longest chain. Every step of a round is written to the shared folder, so that its plan stays small, and the driver sees four
    numbers a round. Minima are aggregated before they shuffle, and those of nodes with many edges are shipped to the
    edges (see :func:`~.common.spread_join`), so no task holds all edges of a node. No edges: no rows.
    The result is a table of the shared folder, which :func:`~.common.discard` deletes.
    """
    now = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _state(now)
    while state[0]:
        # a large star leaves no more edges than there were, both ways
        large = _large_star(now, state[0])
        following = _small_star(large, 2 * state[0])
        discard(now, large)
        now, before, state = following, state, _state(following)
        if state == before:
            break
    found = cut(now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()))
    discard(now)
    return found
