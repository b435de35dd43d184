"""Call events: inspection, captures, rotation, retention, latency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed values.
ROTATE_EVENTS, KEEP_EVENTS = 1000, 500
CAPTURE_CALLS, CAPTURE_BYTES, CAPTURE_ENTRIES = 500, 10 * 1024 * 1024, 100


def inspect(events: DataFrame, group: list[str], seq: str, failed: Column, limit: int = 20) -> DataFrame:
    """The state of each group's last ``limit`` events: calls, failures, healthy or degraded."""
    last = events.withColumn("k", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc(seq)))).filter(F.col("k") <= limit)
    state = last.groupBy(*group).agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"))
    return state.withColumn("state", F.when(F.col("failures") > 0, "degraded").otherwise("healthy"))


def rotate(events: DataFrame, group: list[str], seq: str, most: int = ROTATE_EVENTS, keep: int = KEEP_EVENTS) -> DataFrame:
    """Each log's rows after rotation: all of a log under ``most`` events, else the newest ``keep``."""
    w = Window.partitionBy(*group)
    rows = events.withColumns({"k": F.row_number().over(w.orderBy(F.desc(seq))), "n": F.count("*").over(w)})
    return rows.filter((F.col("n") < most) | (F.col("k") <= keep)).drop("k", "n")


def capture_totals(events: DataFrame, group: list[str], seq: str, failed: Column, elapsed: Column, trace: Column) -> DataFrame:
    """Calls, failures, time, first and last sequence and the failing traces of each capture."""
    return events.groupBy(*group).agg(
        F.count("*").alias("calls"), F.count_if(failed).alias("failures"), F.sum(elapsed).alias("elapsed"), F.min(seq).alias("first_seq"), F.max(seq).alias("last_seq"),
        F.array_sort(F.collect_list(F.when(failed, trace))).alias("failing"),
    )


def capture_caps(events: DataFrame, group: list[str], seq: str, size: Column, calls: int = CAPTURE_CALLS, cap: int = CAPTURE_BYTES) -> DataFrame:
    """Events a capture still takes: the first ``calls``, while their bytes fit."""
    w = Window.partitionBy(*group).orderBy(seq)
    rows = events.withColumns({"k": F.row_number().over(w), "bytes": F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return rows.filter((F.col("k") <= calls) & (F.col("bytes") <= cap)).drop("k")


def retention_plan(files: DataFrame, group: list[str], size: str, order: list[str], limit: float) -> DataFrame:
    """``files`` with ``deleted``: the oldest go until what is left fits."""
    w = Window.partitionBy(*group)
    before = F.coalesce(F.sum(size).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return files.withColumn("deleted", before < F.sum(size).over(w) - limit)


def nearest_rank(value: str, p: float) -> Column:
    """Nearest-rank percentile: the value at place ceil(p n)."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def top_hits(hits: Column, limit: int = CAPTURE_ENTRIES) -> Column:
    return F.slice(hits, 1, limit)
