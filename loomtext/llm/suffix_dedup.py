"""Suffix-array deduplication of byte strings.

``dedup_bytes(docs, window)`` removes every byte covered by a ``window``-byte string that also starts anywhere else in
the corpus, the same document included.  Shards of pieces that share an anchor (see :mod:`repeats`) are sorted by
induced sorting, and permuted common prefixes tell which windows recur.

Cases: a null text is empty; an empty or short text keeps all it has; repeated rows are copies of each other, so their
windows are repeats; ids may be null or repeated; other columns of ``docs`` are not read; an empty table gives an empty
result with the same columns.  A text may be of any length: a task holds one text and about 1 MB beside it.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.repeats import Unit, remove_repeats
from loomtext.llm.suffix import common_prefixes, suffix_array

WINDOW = 400
ANCHOR = 96


def recurring(unit: Unit, text: np.ndarray, off: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """True at each window start of a block whose window starts elsewhere too: a common prefix of a neighbour covers it."""
    sa = suffix_array(text)
    before, after = common_prefixes(text, sa, off[:-1], int(np.diff(off).max()) + unit.window)
    room = np.repeat(off[1:] - 1, np.diff(off)) - np.arange(len(text))
    many = np.repeat(copies > 1, np.diff(off))
    return (room >= unit.window) & ((np.maximum(before, after) >= unit.window) | many)


def dedup_bytes(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_units (bytes), n_removed, spans (byte runs removed), kept (remaining bytes)."""
    return remove_repeats(docs, Unit(False, window, max(1, min(ANCHOR, window // 4))), recurring, id_col, text_col)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("n_units").alias("n_bytes"), "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
