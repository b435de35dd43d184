"""Token counts with a whole-token shortcut.

Offline, every vocabulary string is encoded alone; those that come out as one token are *proven*, and a segment that
is one of them counts as one token without any merging.  Only other segments are merged, by the library, once per
distinct segment and worker (a worker remembers ``HELD`` of them, and those it met before).  Cutting a text into segments changes
no token, which :mod:`pieces` proves from the vocabulary.

Cases: a null or empty text has no tokens; repeated rows count alike; very long texts are cut line by line; ids may be
null; columns other than id and text are not read; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import small_batches
from loomtext.llm.pieces import MARK, Vocabulary, default_path, vocabulary

LIMIT = 4096
HELD = 1 << 17


class Lengths(dict):
    """Tokens of segments: the proven whole tokens, and what has been merged so far."""

    def __init__(self, vocab: Vocabulary, lead: str = "") -> None:
        self.vocab, self.lead = vocab, lead
        self.proven = {p[len(lead) :]: 1 for p, i in vocab.plain.items() if p.startswith(lead) and MARK not in p[len(lead) :] and p != lead and vocab.is_token(i)}
        self.older: dict[str, int] = {}
        super().__init__(self.proven)

    def __missing__(self, word: str) -> int:
        if len(self) >= HELD:  # words that come again are taken over from the older half
            self.older = dict(self)
            self.clear()
            self.update(self.proven)
        n = self.older.get(word)
        self[word] = n = len(self.vocab.encode(self.lead + word)) if n is None else n
        return n


class TokenCounter:
    def __init__(self, path: str) -> None:
        self.vocab = vocabulary(path)
        self.marked, self.bare = Lengths(self.vocab, MARK), Lengths(self.vocab)

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        if not self.vocab.cuts:
            return len(self.vocab.model.encode(text))
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or "\n " in text or " \n" in text or text[0] in " \n" or text[-1] == " ":
            return sum(1 if s == "\n" else self.bare[s] for s in self.vocab.segments(text))
        marked, bare = self.marked.__getitem__, self.bare.__getitem__
        first, *rest = text.split("\n")
        total = len(rest) + sum(map(marked, first.split(" ")))
        for line in rest:
            if line:
                words = line.split(" ")
                total += bare(words[0]) + sum(map(marked, words[1:]))
        return total


@lru_cache(maxsize=2)
def counter(path: str) -> TokenCounter:
    return TokenCounter(path)


def _count(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            text = batch.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), size, pa.array([count(x) for x in text.to_pylist()], pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = rows.mapInArrow(_count(path or default_path()), f"id {kind}, n_bytes long, n_tokens long")
    return found.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
