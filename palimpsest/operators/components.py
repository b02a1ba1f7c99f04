"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.sources.scratch import cut


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the smallest node of its neighbourhood."""
    both = edges.union(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.min("dst").alias("low")).select("src", F.least("src", "low").alias("low"))
    return both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours (src > dst holds for every edge) move to the smallest of them."""
    least = edges.groupBy("src").agg(F.min("dst").alias("low"))
    moved = edges.join(least, "src").filter("dst <> low").select(F.col("dst").alias("src"), F.col("low").alias("dst"))
    return moved.union(least.select("src", F.col("low").alias("dst"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    `edges` has columns src and dst, in any direction, repeated or not. Each round
    writes its edges to the checkpoint folder, so lineage stays short; the number
    of rounds grows with the logarithm of the longest chain, and no round has more
    rows than twice the edges. The minima are taken on the map side first; a hub's
    edges are a skewed join side, which adaptive execution splits. Self-loops are
    dropped; an empty table gives an empty result. Nothing but a count and a
    checksum of the edges reaches the driver.
    """
    state = cut(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
    before = None
    while True:
        state = cut(_small_star(_large_star(state)))
        now = state.agg(F.count(F.lit(1)), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            break
        before = now
    roots = state.select(F.col("dst").alias("node")).distinct()
    return state.select(F.col("src").alias("node"), F.col("dst").alias("component")).union(roots.select("node", F.col("node").alias("component")))
