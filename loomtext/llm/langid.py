"""Language identification by compression.

For each language one raw-content zstandard dictionary is made from a bounded sample of labelled texts: ``SAMPLE_DOCS``
whole documents (chosen by hash of the id, so the same at every run), fewer where long texts or many languages would
take all dictionaries together past ``MAX_BYTES`` (of each language, one stays).  A text is encoded piece by piece, at
one level whatever its size, with every dictionary; the language that makes it smallest is predicted, and the prediction
is marked unsure when the second is nearer than ``MARGIN``.  Only letters count: numbers, marks and case are dropped.

Cases: a null text, or one without a letter, is ``und`` with score 0; no labelled document at all makes everything
``und``; ties go to the language with more labelled documents, then by name; long texts are encoded whole, in pieces;
repeated rows and ids are predicted alike; columns other than id, text (and, for learning, the label) are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import small_batches

SAMPLE_DOCS, MAX_BYTES = 32, 32 << 20
PIECE, LEVEL = 2048, 6
MARGIN = 0.02
_NOT_LETTERS = regex.compile(r"\P{L}+")


def normal(text: str | None) -> bytes:
    return _NOT_LETTERS.sub(" ", text or "").strip().lower().encode("utf-8", "replace")


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls in ``fold``; a null id never does."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


class Compressors:
    """The dictionaries of all languages, most frequent language first."""

    def __init__(self, samples: list[tuple[str, bytes]]) -> None:
        self.names = [k for k, _ in samples]
        self.encoders = []
        for _, data in samples:
            d = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False).compress)

    def sizes(self, data: bytes) -> list[int]:
        cuts = [data[i : i + PIECE] for i in range(0, len(data), PIECE)]
        return [sum(len(c(x)) for x in cuts) for c in self.encoders]

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, sure)."""
        data = normal(text)
        if not data or not self.names:
            return "und", 0.0, False
        sizes = self.sizes(data)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        scale = max(2.0, 0.01 * sizes[best])
        score = 1.0 / sum(math.exp((sizes[best] - s) / scale) for s in sizes)
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best] + 1)
        return self.names[best], score, second - sizes[best] >= MARGIN * second


def samples(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> list[tuple[str, bytes]]:
    """(language, sample) of the labelled rows, most frequent language first; bounded as the module says."""
    rows = train.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).filter("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    order = Window.partitionBy("lang").orderBy(F.xxhash64("id"), F.xxhash64("text"))
    drawn = rows.select("id", "lang", "text").withColumn("k", F.row_number().over(order)).filter(F.col("k") <= SAMPLE_DOCS)
    # Whole texts, in turns over the languages, until the bytes are used up; sizes are looked at before any text moves.
    sizes = drawn.select("lang", "k", F.octet_length("text").alias("n")).collect()
    room, held = MAX_BYTES, dict.fromkeys(counts, 0)
    for r in sorted(sizes, key=lambda r: (r["k"], r["lang"])):
        if held[r["lang"]] == r["k"] - 1 and (r["k"] == 1 or r["n"] <= room):
            held[r["lang"]] += 1
            room -= r["n"]
    few = train.sparkSession.createDataFrame(list(held.items()), "lang string, most int")
    data: dict[str, list[bytes]] = {k: [] for k in counts}
    for r in sorted(drawn.join(F.broadcast(few), "lang").filter("k <= most").collect(), key=lambda r: (r["lang"], r["k"])):
        data[r["lang"]].append(normal(r["text"]))
    return [(k, b" ".join(data[k]).ljust(8)) for k in sorted(counts, key=lambda k: (-counts[k], k))]


def _predict(held: list[tuple[str, bytes]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Compressors(held)
        for batch in batches:
            found = [model.predict(x) for x in batch.column("text").to_pylist()]
            lang, score, sure = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], ["id", "held_out", "lang_pred", "score", "sure"])

    return run


def identify(docs: DataFrame, held: list[tuple[str, bytes]], id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 0) -> DataFrame:
    """id, held_out, lang_pred, score (0 to 1), sure (the margin is wide enough)."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), folds, fold).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predict(held), f"id {kind}, held_out boolean, lang_pred string, score double, sure boolean").withColumnRenamed("id", id_col)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
    return identify(docs, samples(train))
