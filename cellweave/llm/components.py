"""Connected components of a graph given as pairs of longs.

Alternating large-star and small-star steps (Kiveris et al., 2014), which need
O(log^2 n) rounds and never gather a node's neighbours: the minimum of a
neighbourhood is a pre-aggregated sum-like aggregate, and it is joined back to the
pairs from a written table, so that adaptive execution can split a hub's pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.llm.common import discard, materialise


def _state(pairs: DataFrame) -> tuple:
    return tuple(pairs.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.xxhash64("b", "a").cast("decimal(20,0)"))).first())


def _large_star(pairs: DataFrame) -> DataFrame:
    """A table of the moved pairs."""
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = materialise(both.groupBy("a").agg(F.least("a", F.min("b")).alias("m")))
    out = materialise(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
    discard(least, pairs)
    return out


def _small_star(pairs: DataFrame) -> DataFrame:
    """A table of the moved pairs."""
    least = materialise(pairs.groupBy("a").agg(F.min("b").alias("m")))
    moved = pairs.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    out = materialise(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
    discard(least, pairs)
    return out


def connected_components(pairs: DataFrame) -> DataFrame:
    """A table of node, root (the smallest node reachable) for each node of pairs a, b that isn't itself a root."""
    pairs = materialise(pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before, state = None, _state(pairs)
    while state[0] and state != before:
        pairs = _small_star(_large_star(pairs))
        before, state = state, _state(pairs)
    out = pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out._cellweave_path = pairs._cellweave_path
    return out
