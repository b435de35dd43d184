"""Result rows in the shape that callers see: items with evidence, locators of their lines, and hashes of what is shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.operators.search import excerpt_column

# Fields that hold local paths, and what an item is when its row does not say.
LOCAL_PATHS = ("artifactPath", "diagnosticsDirectory", "rootPath", "sourcePath")
SOURCE_KINDS = ("native", "heuristic")


def locators(first: Column, last: Column, path: Column, segments: Column, shift: Column) -> Column:
    """Where the lines ``first`` to ``last`` stand in the sources: a document made of several entries has segments.

    ``shift``: source line of the document's first line, less one; segments count lines of the document.
    """
    low, high = first - shift, last - shift
    hit = F.filter(segments, lambda s: (s["document_start_line"] <= high) & (s["document_end_line"] >= low))

    def clipped(s: Column) -> Column:
        move = s["start_line"] - s["document_start_line"]
        return F.struct(s["relative_path"].alias("relative_path"), (F.greatest(low, s["document_start_line"]) + move).cast("int").alias("start_line"), (F.least(high, s["document_end_line"]) + move).cast("int").alias("end_line"))

    plain = F.array(F.struct(path.alias("relative_path"), first.cast("int").alias("start_line"), last.cast("int").alias("end_line")))
    return F.when(segments.isNotNull() & (F.size(segments) > 0), F.transform(hit, clipped)).otherwise(plain)


def items(rows: DataFrame, revision: int) -> DataFrame:
    """One ``item`` struct for each row of a bounded result, with its other columns kept for ordering.

    rows: ref, kind, title, content, document_ref, relative_path, start_line, end_line; score, source_kind, confidence,
    segments, source_start_line, excerpt and pieces may be missing (the excerpt is then the beginning of the content).
    """
    have = lambda c, default: F.col(c) if c in rows.columns else default
    if "pieces" not in rows.columns:
        rows = rows.drop("excerpt").withColumn("x", excerpt_column(F.col("content"))).select("*", "x.excerpt", "x.pieces").drop("x")
    segments = have("segments", F.lit(None).cast("array<struct<k:bigint,relative_path:string,start_line:int,end_line:int,document_start_line:bigint,document_end_line:bigint>>"))
    shift = F.coalesce(have("source_start_line", F.lit(1)), F.lit(1)) - 1
    at = lambda a, b: locators(a, b, F.col("relative_path"), segments, shift)
    pieces = F.transform("pieces", lambda p: F.struct(p["excerpt_start"].alias("excerpt_start"), p["excerpt_end"].alias("excerpt_end"), at(F.col("start_line") + p["from_line"], F.col("start_line") + p["to_line"]).alias("locators")))
    source = have("source_kind", F.lit(None).cast("string"))
    evidence = F.struct(
        "document_ref", "relative_path", "start_line", "end_line", "excerpt", F.sha2("excerpt", 256).alias("evidence_hash"), F.lit(revision).cast("long").alias("revision"),
        at(F.col("start_line"), F.col("end_line")).alias("locators"), pieces.alias("excerpt_segments"),
    )
    item = F.struct(
        "ref", "kind", F.col("title").alias("title"), F.coalesce(have("score", F.lit(0.0)).cast("double"), F.lit(0.0)).alias("score"),
        F.when(source.isin(*SOURCE_KINDS), source).otherwise("deterministic").alias("source_kind"), F.coalesce(have("confidence", F.lit(1.0)).cast("double"), F.lit(1.0)).alias("confidence"), evidence.alias("evidence"),
    )
    return rows.withColumn("item", item)


def without_paths(value: object) -> object:
    """A result without any field that names a local path, at every depth."""
    if isinstance(value, dict):
        return {k: without_paths(v) for k, v in value.items() if k not in LOCAL_PATHS}
    return [without_paths(v) for v in value] if isinstance(value, list) else value
