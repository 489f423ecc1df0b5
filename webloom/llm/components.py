"""Connected components of an edge table, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webloom.llm.common import released, written


def _star(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per row (u, v): v's link to the least node among u and its neighbours; and the written minima."""
    least = written(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
    return edges.join(least, "u"), least  # of two plain shuffles: a hub's rows can be split


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """edges (a, b), undirected -> (node, root): the least node of each node's component. Nodes without edges are absent.

    Each round joins edges with per-node minima: rows never exceed the edges, hubs are summed before they are
    shuffled, and the number of rounds grows with the logarithm of the longest path. Null ends are ignored, as are edges
    of a node to itself; repeated edges count once; an empty table gives an empty result; extra columns are ignored.
    """
    current = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    state = None
    for _ in range(most_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        starred, minima = _star(both)
        large = starred.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        large = large.distinct()
        large = written(large, "cc-large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        after = written(small.filter("u <> v").distinct(), "cc")
        row = after.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        released(current, minima, large, least)
        current = after
        if tuple(row) == state:
            break
        state = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    roots = current.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
