"""Connected components over an edge table by alternating large-star and small-star steps.

Both steps need no more than a minimum per node (a partial aggregate, so a node with very many
neighbours costs each task one row) and an equi-join that adaptive execution may split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, store


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges(a, b)`` -> ``(node, component)``, component = smallest node reachable.

    Loops and repeated edges do no harm, rows with a null end are ignored, an empty table gives
    an empty table. Nodes without an edge don't appear. Raises if ``max_rounds`` don't suffice
    (every round at least halves the depth of the forest, so this takes 2^60 nodes in a chain).
    """
    now = store(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    mark = _mark(now)
    for _ in range(max_rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour is hung under the smallest node around
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        star = store(large, "cc")
        # small star: all smaller neighbours and the node itself are hung under the smallest
        least = star.groupBy("u").agg(F.min("v").alias("m"))
        small = star.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        after = store(small, "cc")
        discard(now, star)
        now, before = after, mark
        if (mark := _mark(now)) == before:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(now.groupBy(F.col("v").alias("node")).agg(F.min("v").alias("component")))
    raise RuntimeError("connected components did not settle")


def _mark(edges: DataFrame) -> tuple:
    """A checksum of the edge set."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
