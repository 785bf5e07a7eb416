"""Connected components of an edge table, by alternating star contractions.

Each step is a grouped minimum and a join over written tables; neither edges
nor components reach the driver, only the count and a checksum of the edges
that tell when nothing changes any more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aqlens.llm.common import remove, written


def _least(pairs: DataFrame) -> DataFrame:
    """Per node, the least of itself and its neighbours (u, least)."""
    least = pairs.groupBy("u").agg(F.min("v").alias("least"))
    return written(least.select("u", F.least("u", "least").alias("least")), "star-least")


def _large_star(edges: DataFrame) -> DataFrame:
    """Join every larger neighbour to the least of the neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both)
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Join a node and its smaller neighbours to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    joined = down.join(least, "u")
    return joined.filter("v != least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(
        joined.select("u", F.col("least").alias("v"))
    )


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node that has an edge to another; the root is the
    least node of its component.  Loops and repeated edges change nothing; rows
    with a null end are no edges."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u != v").distinct()
    now, mark = written(pairs, "star-edges"), None
    while True:
        step = written(_small_star(written(_large_star(now).distinct(), "star-large")).filter("u != v").distinct(), "star-edges")
        seen = step.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        remove(now)
        now = step
        if tuple(seen) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = tuple(seen)
