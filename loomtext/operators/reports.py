"""Artifacts of captures, bounded renderings, and the reports of the evaluators."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
RECORD_BYTES, MARKDOWN_BYTES = 8_192, 16_384
MARKERS_A_SCAN = 200


def artifact(rows: DataFrame, order: list[str], path: str) -> DataFrame:
    """Write ``rows`` as JSON lines, in order, and give (lines, bytes, sha256) of what was written."""
    line = F.to_json(F.struct(*[F.col(c) for c in rows.columns]))
    lines = rows.repartitionByRange(8, *order).sortWithinPartitions(*order).select(line.alias("value"))
    lines.write.mode("overwrite").text(path)
    written = rows.sparkSession.read.text(path)
    digest = F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2("value", 256))), ""), 256)
    return written.agg(F.count("*").alias("lines"), F.sum(F.octet_length("value") + 1).alias("bytes"), digest.alias("sha256"))


def bounded_record(record: dict, limit: int = RECORD_BYTES) -> dict:
    """``record`` as it is, or with its longest values replaced by length and hash until its JSON fits."""
    out = dict(record)
    for key in sorted(record, key=lambda k: (-len(json.dumps(record[k], ensure_ascii=False)), k)):
        if len(json.dumps(out, ensure_ascii=False, separators=(",", ":")).encode()) <= limit:
            break
        text = json.dumps(record[key], ensure_ascii=False, sort_keys=True)
        out[key] = {"omitted": True, "length": len(text), "sha256": hashlib.sha256(text.encode()).hexdigest()}
    return out


def bounded_markdown(lines: list[str], limit: int = MARKDOWN_BYTES) -> str:
    """Whole lines while they fit, then a note of how many were left out."""
    out, used = [], 0
    for k, line in enumerate(lines):
        note = f"... {len(lines) - k} more"
        if used + len(line.encode()) + 1 + len(note.encode()) > limit:
            return "\n".join([*out, note])
        out.append(line)
        used += len(line.encode()) + 1
    return "\n".join(out)


def miss_attribution(facts: DataFrame) -> DataFrame:
    """facts(fact, candidates, rank, exposed) with ``miss``: L1 never a candidate, L2 ranked too low, L3 not shown."""
    miss = F.when(~F.col("candidates"), "L1").when(F.col("rank").isNull(), "L2").when(~F.col("exposed"), "L3")
    return facts.withColumn("miss", miss)


def monotonic(metrics: DataFrame) -> DataFrame:
    """Rows of recall metrics that a larger cutoff makes worse; a sound evaluator gives none."""
    return metrics.filter((F.col("recall_5") > F.col("recall_10")) | (F.col("recall_10") > F.col("recall_20")) | (F.col("recall_20") > F.col("recall_50")))


def marker_counts(texts: DataFrame, label: str, markers: DataFrame, text: str = "text") -> DataFrame:
    """(label, marker, hits): occurrences of each of a fixed list of markers, ``MARKERS_A_SCAN`` of them in a scan."""
    names = sorted(r["marker"] for r in markers.select("marker").distinct().collect())
    out = None
    for i in range(0, len(names), MARKERS_A_SCAN):
        some = names[i : i + MARKERS_A_SCAN]
        wide = texts.groupBy(label).agg(*[F.sum(F.regexp_count(text, F.lit("\\Q" + m + "\\E"))).alias(f"m{k}") for k, m in enumerate(some)])
        each = wide.select(label, F.explode(F.array(*[F.struct(F.lit(m).alias("marker"), F.col(f"m{k}").alias("hits")) for k, m in enumerate(some)])).alias("x")).select(label, "x.*")
        out = each if out is None else out.unionByName(each)
    return out if out is not None else texts.select(label, F.lit("").alias("marker"), F.lit(0).cast("long").alias("hits")).limit(0)


def latency_report(calls: DataFrame, group: list[str], millis: str, chars: Column) -> DataFrame:
    """Calls, nearest-rank P95 and milliseconds per million characters."""
    return calls.groupBy(*group).agg(F.count("*").alias("calls"), F.expr(f"percentile_disc(0.95) WITHIN GROUP (ORDER BY {millis})").alias("p95"), (F.sum(millis) / (F.sum(chars) / F.lit(1e6))).alias("per_million"))
