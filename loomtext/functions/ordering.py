"""Ranks and running sums over a whole table without one task that sees all of it.

Rows are cut into ranges of the leading column; each range is ordered by itself, and what stands before a range comes
from one row of sums for each.  The cuts are percentiles, so ranges are of like size unless one value fills several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def with_range(df: DataFrame, lead: str, ranges: int = RANGES, descending: bool = False) -> DataFrame:
    """``df`` with ``range_no``, which rises (or, descending, falls) with the values of ``lead``; nulls come first."""
    cuts = df.agg(F.percentile_approx(lead, [k / ranges for k in range(1, ranges)], 10_000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts))
    number = F.lit(0)
    for c in cuts:
        number = number + F.when(F.col(lead) > c, 1).otherwise(0)
    return df.withColumn("range_no", F.lit(len(cuts)) - number if descending else number)


def _before(sums: DataFrame, value: str) -> DataFrame:
    """The sum of ``value`` over all earlier ranges; a row for each range goes in."""
    return sums.withColumn("before", F.coalesce(F.sum(value).over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def ranked(df: DataFrame, lead: str, order: list[Column | str], descending: bool = False, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``rank``: the place of each row in ``order``, whose first column is ``lead``."""
    rows = with_range(df, lead, ranges, descending)
    sums = _before(rows.groupBy("range_no").agg(F.count("*").alias("n")), "n").select("range_no", "before")
    place = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    return rows.join(F.broadcast(sums), "range_no").withColumn("rank", (F.col("before") + place).cast("int")).drop("range_no", "before")


def restarts(df: DataFrame, lead: str, order: list[str], number: str, ranges: int = RANGES) -> DataFrame:
    """``df`` with ``volume``: 1, and one more at each row whose ``number`` does not rise above that of the row before."""
    rows = with_range(df, lead, ranges)
    w = Window.partitionBy("range_no").orderBy(*order)
    flagged = rows.withColumn("restart", F.when(F.col(number) <= F.lag(number).over(w), 1).otherwise(0)).withColumn("so_far", F.sum("restart").over(w))
    ends = flagged.groupBy("range_no").agg(F.sum("restart").alias("within"), F.min_by(number, F.struct(*order)).alias("first"), F.max_by(number, F.struct(*order)).alias("last"))
    seam = F.when(F.col("first") <= F.lag("last").over(Window.orderBy("range_no")), 1).otherwise(0)
    sums = _before(ends.withColumn("seam", seam), "within").withColumn("seams", F.sum("seam").over(Window.orderBy("range_no")))
    starts = sums.select("range_no", (F.col("before") + F.col("seams")).alias("earlier"))
    return flagged.join(F.broadcast(starts), "range_no").withColumn("volume", (1 + F.col("earlier") + F.col("so_far")).cast("long")).drop("range_no", "restart", "so_far", "earlier")
