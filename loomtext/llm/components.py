"""Connected components over an edge table, by hooking and pointer doubling on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import discard, materialise

DOUBLINGS = 3


def hooked(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (r, root): every node takes the least of itself and its neighbours, and follows those choices to
    their end, so that every ``root`` is its own.

    A node only moves to a lesser node of its component, so repeating the step on what is still apart ends with one
    root, the least node, for each component.  A hub's edges are summed before they move.
    """
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    root, _ = materialise(both.groupBy(F.col("u").alias("r")).agg(F.min("v").alias("m")).select("r", F.least("r", "m").alias("root")))
    while True:
        for _ in range(DOUBLINGS):
            root = root.join(root.select(F.col("r").alias("root"), F.col("root").alias("next")), "root").select("r", F.col("next").alias("root"))
        root, _ = materialise(root)
        ends = root.select(F.col("r").alias("root"), F.col("root").alias("next"))
        if not root.join(ends, "root").filter("root <> next").limit(1).count():
            return root


def connected(edges: DataFrame) -> DataFrame:
    """edges(u, v) -> (r, root): every node that has an edge, with the least node of its component."""
    spark = edges.sparkSession
    left, left_at = materialise(edges.filter("u <> v").distinct())
    total: DataFrame | None = None
    while True:
        moved = hooked(left)
        if total is None:
            total = moved
        else:
            onward = moved.select(F.col("r").alias("root"), F.col("root").alias("next"))
            total, _ = materialise(total.join(onward, "root", "left").select("r", F.coalesce("next", "root").alias("root")))
        to = [moved.select(F.col("r").alias(x), F.col("root").alias(f"r{x}")) for x in "uv"]
        apart = left.join(to[0], "u").join(to[1], "v").filter("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
        rest, rest_at = materialise(apart)
        discard(spark, left_at)
        left, left_at = rest, rest_at
        if not left.limit(1).count():
            discard(spark, left_at)
            return total
