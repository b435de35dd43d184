"""Call events on disk: the log of a work, captures with their limits, and the artifacts of finished captures.

A work's folder holds ``log/`` (JSON lines, one file an event), ``runs/<ref>.meta.json`` and ``runs/<ref>/`` (a capture's
events).  Events are read with a stated schema.  What a caller said and saw never enters: strings become lengths and
hashes, results become references, scores and hashes of their locators.
"""

from __future__ import annotations

import datetime
import hashlib
import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.operators import events, reports
from loomtext.sources import storage

# Fixed values.
SCHEMA = (
    "schema_version int, trace_id string, diagnostic_run_ref string, sequence long, tool string, outcome string, recorded_at string, elapsed_ms double, work_ref string, revision long, "
    "input_summary string, output_summary string, output_hits string, error struct<code:string,recoverable:boolean>, execution_summary string"
)
SAFE_STRINGS = ("work_ref", "adapter_hint", "mode", "operation", "task_type", "purpose", "action", "diagnostic_run_ref", "content_policy")
SHOWN = ("status", "work_ref", "revision", "schema_version", "freshness", "operation", "budget_tokens", "used_tokens", "truncated", "diagnostic_run_ref", "artifact_ref")
COUNTED = ("candidates", "results", "ambiguous", "blocks", "omitted", "diagnostics", "recent_events")
KEPT_WHOLE = ("stats", "metrics", "limits", "aggregate")
EFFECT = ("trace_id", "tool", "outcome", "recorded_at", "execution_summary")
REDACTIONS = ("source_text", "returned_excerpts", "absolute_paths", "stack_traces", "sql", "credentials")
POLICIES, FORMATS, PURPOSES = ("metadata", "query"), ("json", "markdown"), ("development", "usage")
LABEL = 80


def now() -> str:
    """The time as an ISO-8601 string in UTC, with milliseconds."""
    return datetime.datetime.now(datetime.timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")


def digest(value: object) -> str:
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str)
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def input_summary(given: dict) -> dict:
    """Strings from a short list as they are, other strings, lists and objects by type, length and hash."""
    out: dict = {}
    for key, value in given.items():
        if isinstance(value, str):
            out[key] = value if key in SAFE_STRINGS else {"type": "string", "length": len(value), "sha256": digest(value)}
        elif isinstance(value, (list, tuple, set)):
            out[key] = {"type": "array", "length": len(value), "sha256": digest(list(value))}
        elif value is None or isinstance(value, (bool, int, float)):
            out[key] = value
        else:
            out[key] = {"type": "object", "sha256": digest(value)}
    return out


def output_summary(tool: str, result: dict) -> dict:
    out = {k: result[k] for k in SHOWN if isinstance(result.get(k), (str, int, float, bool))}
    out |= {f"{k}_count": len(result[k]) for k in COUNTED if isinstance(result.get(k), list)}
    return out | {k: result[k] for k in KEPT_WHOLE if isinstance(result.get(k), dict)} | {"tool": tool}


def output_hits(result: dict, most: int = events.CAPTURE_ENTRIES) -> dict:
    """Of each list of a result, up to ``most`` entries: references, kinds, scores and hashes of locators, nothing else."""

    def entry(item: dict, keys: tuple[str, ...]) -> dict:
        out = {k: item[k] for k in keys if item.get(k) is not None}
        where = (item.get("evidence") or {}).get("locators")
        return out | ({"locators_sha256": digest(where)} if where else {})

    shapes = {"results": ("ref", "kind", "source_kind", "score"), "ambiguous": ("ref", "kind", "source_kind", "score"), "blocks": ("ref", "kind", "source_kind", "score", "layer", "tokens", "required"), "omitted": ("ref", "reason", "tokens"), "candidates": ("work_ref", "adapter")}
    return {name: [entry(x, keys) for x in result[name][:most] if isinstance(x, dict)] for name, keys in shapes.items() if result.get(name)}


def read_events(spark: SparkSession, path: str) -> DataFrame:
    """Events of a folder or file of JSON lines, by the stated schema; a folder that is not there has none."""
    if not storage.names(spark, path):
        return spark.createDataFrame([], SCHEMA)
    return spark.read.schema(SCHEMA).json(path)


def effect_view(log: DataFrame) -> DataFrame:
    """What a user of the tools may see of events."""
    return log.select(*EFFECT)


def folder_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of all files under ``path``, from their listing."""
    if not storage.names(spark, path):
        return 0
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]


def file_retention(files: DataFrame, limit: int) -> DataFrame:
    """files(path, length, modificationTime) with ``deleted``: the oldest go until the rest fits; equal times by path."""
    return events.retention_plan(files.withColumn("all", F.lit(0)), ["all"], "length", ["modificationTime", "path"], limit).drop("all")


@dataclass
class Recorder:
    """The events of one work."""

    spark: SparkSession
    folder: str
    work_ref: str
    calls: int = events.CAPTURE_CALLS
    cap: int = events.CAPTURE_BYTES
    rotate_at: int = events.ROTATE_EVENTS
    keep: int = events.KEEP_EVENTS

    def _meta(self, run: str) -> str:
        return f"{self.folder}/runs/{run}.meta.json"

    def _read(self, run: str) -> dict:
        if not re.fullmatch("diag-[0-9a-f]{24}", run) or f"{run}.meta.json" not in storage.names(self.spark, f"{self.folder}/runs"):
            raise ValueError(f"DIAGNOSTIC_RUN_NOT_FOUND: {run}")
        return storage.get(self.spark, self._meta(run))

    def record(self, tool: str, outcome: str, given: dict, result: dict | None = None, elapsed_ms: float = 0.0, error: str | None = None, run: str | None = None, revision: int | None = None) -> str:
        """Append an event to the log, and to a capture if ``run`` names an active one; the trace of the event."""
        meta = self._read(run) if run else None
        if meta and meta["status"] != "active":
            raise ValueError(f"DIAGNOSTIC_RUN_CLOSED: {run}")
        trace = f"trace-{uuid.uuid4().hex[:24]}"
        summary = input_summary(given)
        event = {
            "schema_version": 1, "trace_id": trace, "diagnostic_run_ref": run, "sequence": None, "tool": tool, "outcome": outcome, "recorded_at": now(), "elapsed_ms": float(elapsed_ms), "work_ref": self.work_ref, "revision": revision,
            "input_summary": json.dumps(summary, ensure_ascii=False), "output_summary": json.dumps(output_summary(tool, result), default=str) if result else None, "output_hits": None,
            "error": {"code": error, "recoverable": True} if error else None, "execution_summary": f"{tool} completed" if outcome == "success" else f"{tool} failed",
        }
        event = reports.bounded_record(event)
        storage.put(self.spark, f"{self.folder}/log/{event['recorded_at'].replace(':', '')}-{trace}.json", event, False)
        if meta:
            self._capture(run, meta, event, summary, given, result)
        self.rotate()
        return trace

    def _capture(self, run: str, meta: dict, event: dict, summary: dict, given: dict, result: dict | None) -> None:
        at = f"{self.folder}/runs/{run}"
        if meta["next_sequence"] > self.calls or folder_bytes(self.spark, at) >= self.cap:
            if not meta["truncated"]:
                storage.put(self.spark, self._meta(run), dict(meta, truncated=True), True)
            return
        if meta["content_policy"] == "query" and isinstance(given.get("query"), str):
            event = dict(event, input_summary=json.dumps(dict(summary, query=given["query"]), ensure_ascii=False))
        hits = output_hits(result) if result else {}
        event = dict(event, sequence=meta["next_sequence"], output_hits=json.dumps(hits, default=str) if hits else None)
        storage.put(self.spark, f"{at}/{meta['next_sequence']:08d}.json", event, False)
        storage.put(self.spark, self._meta(run), dict(meta, next_sequence=meta["next_sequence"] + 1), True)

    def rotate(self) -> int:
        """The log keeps its newest events once it is full; how many files went.  File names sort by time."""
        names = storage.names(self.spark, f"{self.folder}/log")
        gone = names[: -self.keep] if len(names) >= self.rotate_at else []
        for n in gone:
            storage.delete(self.spark, f"{self.folder}/log/{n}")
        return len(gone)

    def start_capture(self, label: str = "", policy: str = "metadata") -> str:
        if policy not in POLICIES:
            raise ValueError("INVALID_DIAGNOSTIC_REQUEST: unknown content policy")
        run = f"diag-{uuid.uuid4().hex[:24]}"
        clean = re.sub(r"[\r\n\t]", " ", label.strip())[:LABEL]
        storage.put(self.spark, self._meta(run), {"schema_version": 1, "diagnostic_run_ref": run, "work_ref": self.work_ref, "content_policy": policy, "label": clean, "started_at": now(), "status": "active", "next_sequence": 1, "truncated": False}, False)
        return run

    def finish_capture(self, run: str, formats: tuple[str, ...] = ("json",)) -> dict:
        """Close a capture and write its artifact; a closed one gives the artifact it has."""
        if not set(formats) <= set(FORMATS):
            raise ValueError("INVALID_DIAGNOSTIC_REQUEST: unknown format")
        meta = self._read(run)
        if meta["status"] == "closed":
            return meta["artifact"]
        calls = read_events(self.spark, f"{self.folder}/runs/{run}")
        failed = F.col("outcome") == "failure"
        row = events.capture_totals(calls, ["diagnostic_run_ref"], "sequence", failed, F.col("elapsed_ms"), F.col("trace_id")).join(calls.groupBy("diagnostic_run_ref").agg(F.min_by("revision", "sequence").alias("before"), F.max_by("revision", "sequence").alias("after")), "diagnostic_run_ref").first()
        total = row.asDict() if row else {"calls": 0, "failures": 0, "elapsed": 0.0, "failing": [], "before": None, "after": None}
        findings = [{"code": "TOOL_FAILURES_OBSERVED", "severity": "warning", "evidence_refs": list(total["failing"])}] if total["failures"] else []
        written = reports.artifact(calls, ["sequence"], f"{self.folder}/runs/{run}.artifact").first()
        artifact = {
            "artifact_ref": f"diagnostic-artifact-{run}", "status": "truncated" if meta["truncated"] else "complete", "content_policy": meta["content_policy"], "started_at": meta["started_at"], "finished_at": now(),
            "revisions": {"before": total["before"], "after": total["after"]}, "calls": total["calls"], "failures": total["failures"], "elapsed_ms": total["elapsed"], "findings": findings, "sha256": written["sha256"], "lines": written["lines"],
            "redactions": list(REDACTIONS), "truncated": meta["truncated"],
        }
        if "markdown" in formats:
            lines = [f"# Capture {run}", "", f"- calls: {artifact['calls']}", f"- failures: {artifact['failures']}", f"- status: {artifact['status']}", *(f"- {f['code']}: {', '.join(f['evidence_refs'])}" for f in findings)]
            artifact["markdown"] = reports.bounded_markdown(lines)
        storage.put(self.spark, self._meta(run), dict(meta, status="closed", artifact=artifact), True)
        return artifact

    def active(self) -> int:
        runs = [n.removesuffix(".meta.json") for n in storage.names(self.spark, f"{self.folder}/runs") if n.endswith(".meta.json")]
        return sum(self._read(r)["status"] == "active" for r in runs)

    def inspect(self, purpose: str = "development", limit: int = 20) -> dict:
        """State of the work over its last calls; users of the tools see the effect of calls only."""
        if purpose not in PURPOSES:
            raise ValueError("INVALID_DIAGNOSTIC_REQUEST: unknown purpose")
        log = read_events(self.spark, f"{self.folder}/log")
        limit = max(1, min(100, limit))
        recent = log.orderBy(F.desc("recorded_at"), F.desc("trace_id")).limit(limit)
        state = events.inspect(log.filter(F.col("work_ref") == self.work_ref), ["work_ref"], "recorded_at", F.col("outcome") == "failure", limit).first()
        shown = recent if purpose == "development" else effect_view(recent)
        return {
            "work_ref": self.work_ref, "purpose": purpose, "status": state["state"] if state else "healthy", "event_history_available": state is not None, "active_capture_count": self.active(),
            "recent_events": [r.asDict(True) for r in shown.collect()][::-1],
        }
