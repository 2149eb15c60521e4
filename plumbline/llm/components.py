"""Connected components of an edge list, by joins only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared


#: Edges of a node beyond which its least neighbour is broadcast, so that the node's edges stay where they are.
HUB = 256


#: Hubs that are broadcast at most; beyond it their join shuffles, too.
BROADCAST_ROWS = 1_000_000


def _led(edges: DataFrame, least: DataFrame, count: int) -> DataFrame:
    """``edges`` (a, b) with m of ``least`` (a, m, n) for every a.

    Nodes of more than HUB edges are at most one for HUB of the ``count`` edges, in either direction; the others have so
    few that a join by a is even.
    """
    hubs = least.filter(F.col("n") > HUB).select("a", F.col("m").alias("_h"))
    hubs = F.broadcast(hubs) if 2 * count // HUB <= BROADCAST_ROWS else hubs
    near = edges.join(hubs, "a", "left")
    rest = near.filter("_h IS NULL").join(least.filter(F.col("n") <= HUB).select("a", "m"), "a").select("a", "b", "m")
    return near.filter("_h IS NOT NULL").select("a", "b", F.col("_h").alias("m")).unionByName(rest)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node of its component.

    Large-star and small-star rounds in turn: every node links its larger neighbours,
    then its smaller ones, to the least node near it, until no edge changes.  A
    node's neighbours are never collected; a hot node is reduced by partial
    aggregation and its edges stay spread.  Every round is checkpointed.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = shared.checkpoint(edges)
    count = edges.count()
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # Large star: larger neighbours of a go to the least node near a.
        large = _led(both.filter("b > a"), least, count).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: a and its smaller neighbours go to the least of these (all edges point to smaller nodes).
        small = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        step = _led(large, small, count).select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a <> b").distinct()
        step = shared.checkpoint(step)
        # A star forest has one edge for each node that is no root, and no root has an edge to a smaller node.
        ends = step.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(step.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
        ends = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
        done = ends.agg(F.sum("down").alias("n"), F.count(F.when((F.col("down") > 1) | (F.col("down") > 0) & (F.col("up") > 0), 1)).alias("odd")).first()
        edges, count = step, done["n"] or 0
        if not done["odd"]:
            break
    else:
        raise RuntimeError("the components did not settle")
    shared.tidied(edges.sparkSession)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
