"""Tables of an index in segments: what a change adds, what it takes away, and the two read as one table.

A revision lists its segments, oldest first.  A segment holds new rows (``<path>/<table>``) and the keys whose rows in
older segments are gone (``<path>/gone_<keys>``).  A table is read as the union of its segments without the rows that a
later segment took away; filters and columns go through to the files.  Up to ``FEW`` keys stand in the revision's file;
more are taken away by a join.  Frequencies of terms are differences, which add up.  ``due`` says when there is so much beside the first segment
that the next writer should put all of it together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Of each table, which keys take its rows away: (table of keys, column).
GONE = {
    "documents": ("gone_documents", "document_ref"), "spans": ("gone_documents", "document_ref"), "definitions": ("gone_documents", "document_ref"),
    "postings": ("gone_spans", "span_ref"), "mentions": ("gone_references", "span_ref"), "unresolved": ("gone_references", "span_ref"), "evidence": ("gone_references", "span_ref"),
    "entities": ("gone_entities", "entity_ref"), "aliases": ("gone_entities", "entity_ref"), "edges": ("gone_edges", "edge_ref"),
}
SUMMED = {"terms": (["work_ref", "term"], "df")}
MAX_SEGMENTS, MAX_SHARE, FEW = 8, 0.25, 1000


def due(segments: list[dict]) -> bool:
    """Whether segments should be put together: many of them, or rows beyond a share of the first one's."""
    first, more = segments[0].get("rows", 0), sum(s.get("rows", 0) for s in segments[1:])
    return len(segments) >= MAX_SEGMENTS or more > MAX_SHARE * first


def few(spark: SparkSession, path: str, tables: list[str]) -> dict[str, list]:
    """The keys that a segment takes away, table by table, where they are few: they then stand in the revision's file, and
    a read needs no join for them."""
    out = {}
    for name in tables:
        if name.startswith("gone_"):
            keys = [r[0] for r in spark.read.parquet(f"{path}/{name}").limit(FEW + 1).collect()]
            if len(keys) <= FEW:
                out[name] = keys
    return out


def read(spark: SparkSession, segments: list[dict], name: str) -> DataFrame:
    """A table of all segments as one."""
    have = [(k, s) for k, s in enumerate(segments) if name in s["tables"]]
    if not have:
        raise ValueError(f"INDEX_MISSING: the index has no table {name}")
    if name in SUMMED and len(have) > 1:
        keys, value = SUMMED[name]
        rows = spark.read.parquet(*[f"{s['path']}/{name}" for _, s in have])
        return rows.groupBy(*keys).agg(F.sum(value).alias(value)).filter(F.col(value) > 0)
    gone_in, key = GONE.get(name, ("", ""))
    out = None
    for k, s in have:
        rows = spark.read.parquet(f"{s['path']}/{name}")
        later = [t for t in segments[k + 1 :] if gone_in in t["tables"]]
        listed = sorted({x for t in later for x in t.get("gone", {}).get(gone_in, [])})
        if listed:
            rows = rows.filter(~F.col(key).isin(listed))
        for t in later:
            if gone_in not in t.get("gone", {}):
                rows = rows.join(spark.read.parquet(f"{t['path']}/{gone_in}").select(F.col(key).alias("_key")), F.col(key) == F.col("_key"), "left_anti")
        out = rows if out is None else out.unionByName(rows)
    return out
