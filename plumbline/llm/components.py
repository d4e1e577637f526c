"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.base import stored


def _unsettled(e: DataFrame) -> bool:
    """Whether some node is tied to two nodes, or to one that is tied itself."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("tied"), F.lit(0).alias("holds")).union(e.select("v", F.lit(0), F.lit(1)))
    ends = ends.groupBy("x").agg(F.sum("tied").alias("tied"), F.max("holds").alias("holds"))
    return ends.agg(F.bool_or((F.col("tied") > 1) | ((F.col("tied") > 0) & (F.col("holds") > 0)))).first()[0] or False


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): each node of the edges with the smallest node that it reaches.

    Every round ties a node's larger neighbours to its smallest one, then does
    the same to the smaller neighbours; it ends when every node is tied to one
    node that is tied to none, after about log(n) rounds. Minima are combined before the shuffle, so a hub
    costs one row for each task; the joins against a hub can be split. Null
    ends and loops are left out; no edges give no rows. Edges that are such
    stars already, as those made of an earlier result, cost no round.
    """
    e = stored(edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct())
    while _unsettled(e):
        both = e.select(F.col("u").alias("x"), F.col("v").alias("y")).union(e.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.join(least, "x").filter(F.col("y") > F.col("x")).select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        low = large.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"))
        tied = large.join(low, large["u"] == low["k"]).select("u", "v", "m")
        small = tied.select("u", F.col("m").alias("v")).union(tied.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()
        e = stored(small)
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
