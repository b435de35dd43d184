"""Documents to bounded, line-addressable spans.

The cap is a running sum that starts anew whenever it overflows, which no window frame expresses; one Arrow pass per
document does it instead.  Nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.functions.text import stable_id, utf16_size, utf16_slice

SPAN_CAP = 2400  # fixed value, in UTF-16 units
_HEADING = re.compile(r"#{1,6}[\s﻿]+(.+)")


def split_spans(content: str, title: str, cap: int = SPAN_CAP) -> list[tuple[int, int, int, str, str]]:
    """(ordinal, first line, last line, heading, content) of each span; lines count from 1 and skip blank edges."""
    out: list[tuple[int, int, int, str, str]] = []
    held: list[str] = []
    size, begin, heading, solid = 0, 0, title, False

    def close() -> None:
        nonlocal held, size, solid
        full = [i for i, x in enumerate(held) if x.strip("﻿ \t\r\n\x0b\x0c\xa0　") and x.strip()]
        if full:
            a, b = full[0], full[-1]
            out.append((len(out), begin + a + 1, begin + b + 1, heading, "\n".join(held[a : b + 1])))
        held, size, solid = [], 0, False

    for i, line in enumerate(re.sub("\r\n?", "\n", content).split("\n")):
        m = _HEADING.match(line)
        named = m[1].strip() if m else ""
        if named and solid:
            close()
            begin, heading = i, named
        elif not held:
            begin = i
            heading = named or heading
        width = utf16_size(line)
        if width > cap:
            if solid:
                close()
            at = 0
            while at < width:
                piece = utf16_slice(line, at, at + cap)
                if not piece:
                    raise ValueError("the cap cannot hold the next character")
                out.append((len(out), i + 1, i + 1, heading, piece))
                at += utf16_size(piece)
            held, size, solid = [], 0, False
            continue
        if held and size + 1 + width > cap:
            close()
            begin = i
        size += width + (1 if held else 0)
        held.append(line)
        solid = solid or bool(line.strip())
        if size >= cap:
            close()
    close()
    return out


def _split(cap: int, keep: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["work_ref", "document_ref", "ordinal", "start_line", "end_line", "heading", "content"]
    types = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            for k, (work, ref, title, content, first) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("work_ref", "document_ref", "title", "content", "source_start_line")), strict=True)):
                shift = (first or 1) - 1
                made = [(work, ref, o, a + shift, b + shift, h, c) for o, a, b, h, c in split_spans(content or "", title or "", cap)]
                rows += made
                of += [k] * len(made)
            cols = zip(*rows, strict=True) if rows else [()] * len(names)
            carried = [batch.column(f"doc_{c}").take(pa.array(of, pa.int64())) for c in keep]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(cols, types, strict=True)), *carried], [*names, *(f"doc_{c}" for c in keep)])

    return run


def spans(documents: DataFrame, cap: int = SPAN_CAP, keep: list[str] = ()) -> DataFrame:
    """work_ref, span_ref, document_ref, ordinal, start_line, end_line, heading, content; ``keep``: columns of the document
    that each span carries as ``doc_...``."""
    given = documents.select("work_ref", "document_ref", "title", "content", "source_start_line", *[F.col(c).alias(f"doc_{c}") for c in keep])
    more = "".join(f", doc_{c} {documents.schema[c].dataType.simpleString()}" for c in keep)
    found = given.mapInArrow(_split(cap, list(keep)), "work_ref string, document_ref string, ordinal int, start_line int, end_line int, heading string, content string" + more)
    return found.withColumn("span_ref", stable_id("span", F.col("document_ref"), F.col("ordinal")))


def line_locators(lines: DataFrame, segments: DataFrame) -> DataFrame:
    """Where ranges of document lines come from: overlaps of (document_ref, start_line, end_line) with source segments.

    Both sides meet on the document, so the range test only sees lines of one document.
    """
    low, high = F.greatest("start_line", "document_start_line"), F.least("end_line", "document_end_line")
    shift = F.col("segment_start_line") - F.col("document_start_line")
    return lines.join(segments, "document_ref").filter((F.col("start_line") <= F.col("document_end_line")) & (F.col("document_start_line") <= F.col("end_line"))).withColumns({"locator_start": low + shift, "locator_end": high + shift})
