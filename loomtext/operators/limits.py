"""Byte caps of responses: deterministic prefixes, and reductions from the least important end."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RESPONSE_BYTES = 200_000  # fixed value


def json_bytes(c: Column) -> Column:
    return F.octet_length(F.to_json(c))


def compact_bytes(value: object) -> int:
    """UTF-8 bytes of a driver-side result as compact JSON."""
    return len(json.dumps(value, ensure_ascii=False, separators=(",", ":"), default=str).encode())


def byte_cap(rows: DataFrame, size: Column, cap: int, group: list[str], order: list[Column | str]) -> DataFrame:
    """``rows`` with ``running`` bytes (a separator each) and ``returned``: the longest prefix that fits."""
    running = F.sum(size + 1).over(Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("running", running).withColumn("returned", F.col("running") <= cap)


def reduce_context(blocks: DataFrame, size: Column, cap: int, group: list[str]) -> DataFrame:
    """``blocks`` with ``returned``: the last optional block of the lowest layer goes first, required ones never."""
    total = F.sum(size + 1).over(Window.partitionBy(*group))
    order = Window.partitionBy(*group).orderBy(F.col("required"), F.desc("layer"), F.desc("place")).rowsBetween(Window.unboundedPreceding, -1)
    freed = F.coalesce(F.sum(F.when(~F.col("required"), size + 1).otherwise(0)).over(order), F.lit(0))
    return blocks.withColumn("returned", F.col("required") | (total - freed <= cap))


def too_large(tool: str) -> ValueError:
    return ValueError(f"RESPONSE_TOO_LARGE: the result of {tool} does not fit, and nothing more can be left out")


def shrink(tool: str, response: dict, lists: tuple[str, ...], cap: int = RESPONSE_BYTES, keep: object = None) -> tuple[dict, int]:
    """(``response``, items dropped): items leave the ends of ``lists``, one list after the other, until the JSON fits.

    keep: a test of items that must stay.  What cannot be made to fit, or has nothing to leave out, is an error.
    """
    out, dropped = dict(response), 0
    excess = compact_bytes(out) - cap
    for name in lists:
        held = list(out.get(name) or [])
        for k in range(len(held) - 1, -1, -1):
            if excess <= 0:
                break
            if keep is None or not keep(held[k]):
                excess -= compact_bytes(held.pop(k)) + 1
                dropped += 1
        out[name] = held
    if compact_bytes(out) > cap:
        raise too_large(tool)
    return out, dropped


def fit(tool: str, response: dict, cap: int = RESPONSE_BYTES) -> dict:
    """``response`` of a tool within ``cap`` bytes: explore drops ambiguous items, then results; resolve drops candidates
    but the chosen one; diagnose drops its newest events; an index result is never cut."""
    if compact_bytes(response) <= cap:
        return response
    note = {"code": "RESPONSE_TRUNCATED"}
    if tool == "explore":
        room = cap - 200  # for the note and the counts that change
        out, dropped = shrink(tool, response, ("ambiguous", "results"), room)
        metrics = dict(out["metrics"], returned_count=len(out["results"]), omitted_estimate=out["metrics"]["omitted_estimate"] + dropped)
        return dict(out, truncated=True, metrics=metrics, diagnostics=[*out["diagnostics"], note])
    if tool == "resolve":
        if response["status"] == "unsupported":
            raise too_large(tool)
        chosen = response.get("work_ref")
        out, _ = shrink(tool, response, ("candidates",), cap - 100, None if chosen is None else lambda c: c["work_ref"] == chosen)
        return dict(out, diagnostics=[*out["diagnostics"], note])
    if tool == "diagnose":
        return dict(shrink(tool, response, ("recent_events",), cap - 100)[0], truncated=True)
    raise too_large(tool)
