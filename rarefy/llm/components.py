"""Connected components over an edge table, by alternating large-star and small-star rounds.

Both star steps are a grouped minimum and an equi-join, so a node that touches a third of all
edges is pre-aggregated on the map side and its join partition can be split by adaptive
execution. Edges never reach the driver; each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    # every edge points from the larger to the smaller node here
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows ``(node, root)`` for every node with an edge other than the root itself.

    The root is the smallest node of its component. Self loops, repeated edges and nulls are
    ignored; an empty edge table gives an empty result.
    """
    now = materialize(
        edges.where(f"{a} <> {b}").select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        step = materialize(_small_star(_large_star(now)), "edges")
        new = _mark(step)
        discard(now)
        now, done, mark = step, new == mark, new
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
