"""Connected components of a link table, by alternating big and small stars on DataFrames.

Each round is two grouped minimums with map-side combine; the edge list never grows, nothing is
gathered on the driver but one row count per round, and lineage is cut by reliable checkpoints.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import heavy_split_join, pin


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (u, v): neighbours link to the smallest node of the neighbourhood.

    The large star links each node's larger neighbours to its minimum, the small star its smaller
    ones.  The join brings the minimum of a node back to its edges; a node with very many
    neighbours is handled by the heavy-key join.
    """
    if large:
        near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        near = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    near = pin(near.distinct())
    least = pin(near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n")))
    met = heavy_split_join(near, least, ["u"], "n")
    if large:
        out = met.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = met.select("v", "m", "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("u").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
    return out.filter(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (u, v): root is the smallest node reachable.

    Runs until a round changes nothing, which takes a number of rounds that grows with the
    logarithm of the longest chain.  Empty edges give an empty result.
    """
    now = pin(edges.filter(F.col("u") != F.col("v"))
              .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(now)
    while mark[0]:
        now = pin(_star(pin(_star(now, large=True)), large=False))
        if (after := _mark(now)) == mark:
            break
        mark = after
    # stars now: every node points to its root
    return pin(now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct())


def _mark(edges: DataFrame) -> tuple:
    """A bounded summary (count and two hash sums) that changes when the edge set does."""
    h = F.xxhash64("u", "v")
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.shiftright(h, 20)), F.sum(h.bitwiseAND(F.lit((1 << 40) - 1)))).first())
