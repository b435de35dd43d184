"""Substring deduplication by relative Lempel-Ziv parsing.

``dedup_words(docs, window)`` removes every word covered by a window of ``window`` words whose sequence also starts
anywhere else in the corpus.  The corpus is its own reference, cut into blocks that are dealt by anchor (see
:mod:`repeats`), so a document meets every block that can hold a window of it.  Each block is indexed once (a suffix
array of its words), and every piece is factored greedily: the longest factor that the block also holds elsewhere is
found by narrowing an interval of the index word by word, then the parse goes on behind it.

A window recurs if it lies in one factor.  Else it ends a factor and reaches into the next, and only one: a factor that
began inside it would have reached its end.  So where two neighbouring factors together have room for a window across
their boundary, and only there, the windows across it are looked up in the index.

Cases: a null text has no words; a text of fewer than ``window`` words keeps them all; repeated rows are copies of each
other; ids may be null or repeated; other columns are not read; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.repeats import Unit, remove_repeats
from loomtext.llm.suffix import suffix_array

WINDOW = 35
ANCHOR = 8


class Reference:
    """The index of a block: its words (0 ends a piece) and their suffix array."""

    def __init__(self, text: np.ndarray) -> None:
        self.text, self.sa, self.size = text, suffix_array(text), len(text)
        self.padded = np.append(text, np.full(1, -1, text.dtype))
        self.first = text[self.sa]

    def narrowed(self, low: np.ndarray, high: np.ndarray, depth: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the suffixes in [low, high), which agree in ``depth`` words, those that go on with ``word``."""
        out = []
        for after in (False, True):
            a, b = low.copy(), high.copy()
            open_ = np.flatnonzero(a < b)
            while len(open_):
                mid = (a[open_] + b[open_]) >> 1
                seen = self.padded[np.minimum(self.sa[mid] + depth[open_], self.size)]
                right = (seen <= word[open_]) if after else (seen < word[open_])
                a[open_] = np.where(right, mid + 1, a[open_])
                b[open_] = np.where(right, b[open_], mid)
                open_ = open_[a[open_] < b[open_]]
            out.append(a)
        return out[0], out[1]

    def extended(self, at: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Words, up to ``room``, of the longest string from each place ``at`` that also starts elsewhere in the block."""
        length = np.zeros(len(at), np.int64)
        low, high = np.searchsorted(self.first, self.text[at], "left"), np.searchsorted(self.first, self.text[at], "right")
        go = np.flatnonzero((high - low > 1) & (room > 0))
        low, high = low[go], high[go]
        while len(go):
            length[go] += 1
            more = length[go] < room[go]
            go, low, high = go[more], low[more], high[more]
            low, high = self.narrowed(low, high, length[go], self.text[at[go] + length[go]])
            more = high - low > 1
            go, low, high = go[more], low[more], high[more]
        return length

    def factors(self, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and lengths of the greedy factors of all pieces, in text order; a word found nowhere else is one by itself."""
        at, end = off[:-1].copy(), off[1:] - 1
        starts, lengths = [], []
        while (go := at < end).any():
            at, end = at[go], end[go]
            length = np.maximum(self.extended(at, end - at), 1)
            starts.append(at)
            lengths.append(length)
            at = at + length
        if not starts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        start, length = np.concatenate(starts), np.concatenate(lengths)
        order = np.argsort(start)
        return start[order], length[order]


def recurring(unit: Unit, text: np.ndarray, off: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """True at each window start that lies in a long factor, or is found across the boundary of two; of pieces with
    copies, at all their windows."""
    block, width = Reference(text), unit.window
    start, length = block.factors(off)
    stop = start + length
    found = np.zeros(len(text), bool)
    inside = np.zeros(len(text) + 1, np.int64)
    long = length >= width
    np.add.at(inside, start[long], 1)
    np.add.at(inside, stop[long] - width + 1, -1)
    found |= np.cumsum(inside)[:-1] > 0
    joined = np.flatnonzero(stop[:-1] == start[1:])  # not across the end of a piece, which has a separator
    low = np.maximum(start[joined] + 1, stop[joined] - width + 1)
    count = np.maximum(np.minimum(stop[joined] - 1, stop[joined + 1] - width) - low + 1, 0)
    across = np.repeat(low - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    found[across[block.extended(across, np.full(len(across), width)) == width]] = True
    room = np.repeat(off[1:] - 1, np.diff(off)) - np.arange(len(text))
    return (room >= width) & (found | np.repeat(copies > 1, np.diff(off)))


def dedup_words(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_units (words), n_removed, spans (word runs removed), kept (remaining words joined by one space)."""
    return remove_repeats(docs, Unit(True, window, max(1, min(ANCHOR, window // 4))), recurring, id_col, text_col)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_words(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.col("n_units").alias("n_words"), "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
