"""Fill-in-middle transformation of texts: whole Arrow batches at once, over their UTF-8 buffers.

A text is cut into units by a table of byte classes and a table of which pairs of neighbouring classes have a boundary
between them.  The boundaries of a whole batch are summed up once, every document starting again from zero; one
``searchsorted`` then finds the byte at which each cut of every document falls, and prefix, middle and suffix are slices
of the buffer as it is.  The units are code points by default; ``word`` (a word with the blanks before it) and ``line``
(a line with its end) are the other tables.

Where the cuts fall and which form a text takes follows from the hash of ``seed:id`` alone, so a lost task gives the
same rows when it is run again.  ``restore`` rebuilds the text from output and form.

Cases: a null text is empty; an empty text, and one that holds a sentinel, stays plain; a null id is hashed as no
characters; repeated ids are cut alike; a text of one unit has an empty prefix, middle or suffix; memory follows the
Arrow batch (16 MB) or one longer text; columns other than id and text are not read; an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import small_batches
from loomtext.llm.textkit import buffers

# Fixed values of the transformation.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
FIM_PERCENT = 90
SPM_PERCENT = 20

_TAIL, _SOLID, _BLANK, _BREAK = range(4)


def _classes() -> np.ndarray:
    of = np.full(256, _SOLID, np.uint8)
    of[0x80:0xC0] = _TAIL
    of[[0x20, 0x09, 0x0B, 0x0C, 0x0D]] = _BLANK
    of[0x0A] = _BREAK
    return of


CLASS = _classes()


def _boundaries(unit: str) -> np.ndarray:
    """[class of a byte, class of the next] -> whether a unit starts with the next; never inside a code point."""
    table = np.zeros((4, 4), bool)
    if unit == "codepoint":
        table[:, [_SOLID, _BLANK, _BREAK]] = True
    elif unit == "word":
        table[np.ix_([_TAIL, _SOLID], [_BLANK, _BREAK])] = True
    elif unit == "line":
        table[_BREAK, [_SOLID, _BLANK, _BREAK]] = True
    else:
        raise ValueError(f"unit is codepoint, word or line, not {unit}")
    return table


def unit_counts(raw: np.ndarray, off: np.ndarray, unit: str = "codepoint") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(unit starts up to each byte of the batch, starts before each document, units of each document)."""
    kind = CLASS[raw]
    starts = np.empty(len(raw), bool)
    if len(raw):
        starts[1:] = _boundaries(unit)[kind[:-1], kind[1:]]
        starts[off[:-1][off[:-1] < off[1:]]] = True
    so_far = np.cumsum(starts, dtype=np.int32 if len(raw) < 2**31 else np.int64)
    total = np.concatenate([[0], so_far]).astype(np.int64)
    return so_far, total[off[:-1]], total[off[1:]] - total[off[:-1]]


def cut_bytes(so_far: np.ndarray, before: np.ndarray, off: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """The byte at which unit number ``cut`` of each document starts; the document's end where it has no such unit."""
    at = np.searchsorted(so_far, (before + cut + 1).astype(so_far.dtype), "left")
    return np.minimum(at, off[1:])


def slices(column: pa.Array, *cuts: np.ndarray) -> list[pa.Array]:
    """The parts of every string between cuts (bytes from the start of the first string), without a copy of the buffer."""
    raw, off = buffers(column)
    edges = np.stack([off[:-1], *cuts, off[1:]], axis=1)
    return [_between(raw, edges[:, k], edges[:, k + 1], off) for k in range(edges.shape[1] - 1)]


def _between(raw: np.ndarray, start: np.ndarray, end: np.ndarray, off: np.ndarray) -> pa.Array:
    n = len(start)
    ends = np.empty(2 * n + 1, np.int64)
    ends[0] = 0
    ends[1::2], ends[2::2] = start, end
    # Strings in turn: what lies before a part, and the part.
    both = pa.LargeStringArray.from_buffers(2 * n, pa.py_buffer(ends), pa.py_buffer(raw if len(raw) else np.zeros(1, np.uint8)))
    return both.take(pa.array(np.arange(1, 2 * n, 2)))


def _joined(*parts: pa.Array | str) -> pa.Array:
    return pc.binary_join_element_wise(*[pa.scalar(x, pa.large_string()) if isinstance(x, str) else x for x in (*parts, "")])


def _kernel(unit: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column("text"), "")
            raw, off = buffers(text)
            so_far, before, n = unit_counts(raw, off, unit)
            chars = n if unit == "codepoint" else pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
            h1, h2, h3, h4 = (batch.column(f"h{k}").to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4))
            a, b = h1 % (n + 1), h2 % (n + 1)
            first, second = (cut_bytes(so_far, before, off, c) for c in (np.minimum(a, b), np.maximum(a, b)))
            prefix, middle, suffix = slices(text, first, second)
            marked = pc.or_(pc.or_(pc.match_substring(text, PREFIX), pc.match_substring(text, SUFFIX)), pc.match_substring(text, MIDDLE))
            plain = (n == 0) | (h3 % 100 >= FIM_PERCENT) | marked.to_numpy(zero_copy_only=False)
            spm = ~plain & (h4 % 100 < SPM_PERCENT)
            plain, spm = pa.array(plain), pa.array(spm)
            text = text.cast(pa.large_string())
            psm_text, spm_text = _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle)
            output = pc.if_else(plain, text, pc.if_else(spm, spm_text, psm_text)).cast(pa.string())
            form = pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm"))
            sizes = [pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(x).cast(pa.int64())) for x in (prefix, middle)]
            names = ["id", "n", "n_units", "form", "prefix_chars", "middle_chars", "output"]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(chars), pa.array(n), form, *sizes, output], names)

    return run


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: str = "1", unit: str = "codepoint") -> DataFrame:
    """id, n (code points), n_units, form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output."""
    _boundaries(unit)
    small_batches(docs.sparkSession)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), digest.alias("digest"))
    rows = rows.select("id", "text", *[F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)])
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n long, n_units long, form string, prefix_chars long, middle_chars long, output string"
    return rows.mapInArrow(_kernel(unit), schema).withColumnRenamed("id", id_col)


def _found(text: pa.Array, what: str, otherwise: np.ndarray) -> np.ndarray:
    """Byte of the first ``what`` in each text, ``otherwise`` where it has none."""
    at = pc.find_substring(text, what).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.where(at < 0, otherwise, at)


def restored(output: pa.Array, form: pa.Array) -> pa.Array:
    """The texts from outputs and forms.  A text that was cut holds no sentinel, so the first of each is the one put in."""
    raw, off = buffers(output)
    length, zero = off[1:] - off[:-1], np.zeros(len(off) - 1, np.int64)
    spm = pc.equal(form, "spm").to_numpy(zero_copy_only=False)
    inner = _found(output, SUFFIX, zero)
    inner = off[:-1] + np.where(spm, _found(output, PREFIX, zero), inner)
    last = off[:-1] + _found(output, MIDDLE, zero)
    mark = len(PREFIX)
    head = _between(raw, np.minimum(off[:-1] + mark, off[1:]), np.maximum(inner, np.minimum(off[:-1] + mark, off[1:])), off)
    tail = _between(raw, np.minimum(inner + mark, off[1:]), np.maximum(last, np.minimum(inner + mark, off[1:])), off)
    middle = _between(raw, np.minimum(last + mark, off[1:]), off[:-1] + length, off)
    psm_text, spm_text = _joined(head, middle, tail), _joined(tail, middle, head)
    return pc.if_else(pc.equal(form, "plain"), output.cast(pa.large_string()), pc.if_else(pa.array(spm), spm_text, psm_text)).cast(pa.string())


def restore(df: DataFrame, output_col: str = "output", form_col: str = "form", into: str = "restored") -> DataFrame:
    """``df`` with the text that each output was made from."""
    small_batches(df.sparkSession)
    schema = df.select("*", F.lit("").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = restored(batch.column(output_col), batch.column(form_col))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, into])

    return df.mapInArrow(run, schema)


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = restore(transform(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    digests = [F.sha2(F.col(c), 256).alias(f"{c}_sha256") for c in ("output", "restored")]
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
u AS (SELECT doc_id, text, length(text)::BIGINT AS n,
  ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
  ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4 FROM d),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
       WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
p AS (SELECT *, substr(text, 1, a) AS prefix, substr(text, a + 1, b - a) AS middle, substr(text, b + 1) AS suffix FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
         ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p
"""
