"""Source divergence audit: how far the term shares of the sources of a language lie apart, and which terms stand out.

Terms are runs of ASCII letters (A-Z lower-cased) and of all other characters beyond ASCII.  A language keeps the terms
that at least ``MIN_DOCS`` of its documents have.  A group (language, source), and the language itself, gives each kept
term the smoothed share ``1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V))`` in whole numbers.

The distances of all pairs of sources come from tiles.  Kept terms are numbered in chunks of about ``CHUNK``, the sources
of a language dealt to blocks of about ``BLOCK``, and each group's counts packed into one array a chunk.  A vector goes
to every tile (block by block) that has its block; a tile walks over its chunks one after another and adds to its
submatrix, so it holds one chunk of two blocks at a time, whatever the vocabulary.  A tile of many chunks is cut into
runs of ``CHUNKS_A_TASK``, whose submatrices are summed.  Terms that no group of a tile has are all alike, and are added
by their number.

Counting is done where the texts lie, one Counter a group, passed on when ``HELD_TERMS`` are held, so a source with a
third of all rows moves as few rows as any other.

Cases: null text, lang and source are ''; every row is a document, repeated rows included; a group without terms has
count 0 throughout; a language without kept terms has distances 0 and no ``term`` rows; a language with one source has no
``pair`` rows; equal values are ranked by the item's bytes; long texts are counted in pieces; other columns are not read;
an empty table gives no rows.  Sums of counts may reach 9e15; beyond that the whole-number division raises.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtext.llm.common import materialise, small_batches

# Fixed values of the audit.
SCALE, SMOOTH = 1_000_000_000, 5
MIN_DOCS = 30
TOP_TERMS = 50

BLOCK, CHUNK, CHUNKS_A_TASK = 64, 4096, 64
HELD_TERMS = 200_000
PIECE = 1 << 20
#: Term bytes as they are, A-Z lower-cased, everything else a blank.
_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _pieces(raw: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, some at a time; ``raw`` has blanks between terms."""
    at = 0
    while at < len(raw):
        end = len(raw)
        if end - at > PIECE:
            end = raw.find(b" ", at + PIECE)
            end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}

    def flushed() -> Iterator[pa.RecordBatch]:
        for (lang, source), (terms, docs) in held.items():
            n = len(terms)
            if n:
                names = [pa.array([x], pa.string()).take(pa.array(np.zeros(n, np.int64))) for x in (lang, source)]
                counts = [pa.array(list(terms.values()), pa.int64()), pa.array([docs[t] for t in terms], pa.int64())]
                yield pa.RecordBatch.from_arrays([*names, pa.array(list(terms), pa.binary()).cast(pa.string()), *counts], ["lang", "source", "term", "n", "docs"])
        held.clear()

    for batch in batches:
        for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
            terms, docs = held.setdefault((lang, source), (Counter(), Counter()))
            seen: set[bytes] = set()
            for part in _pieces(text.encode().translate(_TERM_BYTES)):
                terms.update(part)
                seen.update(part)
            docs.update(seen)
        if sum(len(t) for t, _ in held.values()) > HELD_TERMS:
            yield from flushed()
    yield from flushed()


def group_terms(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text) -> lang, source, term, n (occurrences), docs (documents that have it)."""
    small_batches(docs.sparkSession)
    part = docs.mapInArrow(_counted, "lang string, source string, term string, n long, docs long")
    return part.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def numbered_terms(counts: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """lang, term, lang_n, v (kept terms of the language), lang_total, chunk, idx (its number in the chunk)."""
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("lang_n")).filter(F.col("docs") >= min_docs)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_n").alias("lang_total"))
    dealt = kept.join(sizes, "lang").withColumn("chunk", F.pmod(F.xxhash64("term"), F.ceil(F.col("v") / CHUNK)).cast("int"))
    dealt = dealt.repartition("lang", "chunk")  # else the window keeps the rows of a language together, as the join left them
    place = F.row_number().over(Window.partitionBy("lang", "chunk").orderBy("term")) - 1
    return dealt.select("lang", "term", "lang_n", "v", "lang_total", "chunk", place.alias("idx"))


def blocks(docs: DataFrame, hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """lang, source, total (N), v, block, n_blocks for every group that occurs."""
    groups = docs.select("lang", "source").distinct()
    totals = hits.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    many = groups.groupBy("lang").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("n_blocks"))
    rows = groups.join(many, "lang").join(sizes.select("lang", "v"), "lang", "left").join(totals, ["lang", "source"], "left")
    return rows.select(
        "lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("v", F.lit(0)).cast("long").alias("v"),
        F.pmod(F.xxhash64("source"), F.col("n_blocks")).cast("int").alias("block"), "n_blocks",
    )


def share(count: Column, total: Column, v: Column) -> Column:
    """The smoothed share as a whole number, exactly."""
    over = (count + SMOOTH).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", over, (total + SMOOTH * v).cast("decimal(19,0)")) + 1


def shares(count: np.ndarray, divisor: int) -> np.ndarray:
    """The same over an array: long division by three decimal digits a step, so that nothing exceeds 64 bits."""
    if divisor >= 2**63 // 1000:
        raise OverflowError("counts beyond 9e15")
    if not divisor:
        return np.zeros(len(count), np.int64)
    whole, rest = np.divmod(count.astype(np.int64) + SMOOTH, divisor)
    for _ in range(3):
        digits, rest = np.divmod(rest * 1000, divisor)
        whole = whole * 1000 + digits
    return whole + 1


class Tile:
    """One tile over successive chunks: its groups, and the sums of |p - q| so far."""

    def __init__(self, key: tuple) -> None:
        self.key, self.groups, self.chunk, self.rows = key, [], None, []
        self.sums: np.ndarray | None = None

    def add(self, chunk: int, group: tuple, idx: np.ndarray | None, counts: np.ndarray | None) -> None:
        if chunk < 0:
            self.groups.append(group)
            return
        if chunk != self.chunk:
            self.close()
            self.chunk = chunk
        self.rows.append((group, idx, counts))

    def _start(self) -> None:
        _, bi, bj, _ = self.key
        self.left = [g for g in self.groups if g[0] == bi]
        self.right = [g for g in self.groups if g[0] == bj]
        self.place = {g[1]: k for k, g in enumerate(self.left + (self.right if bi != bj else []))}
        self.divisors = {g[1]: g[2] + SMOOTH * g[3] for g in self.groups}
        self.none = np.array([shares(np.zeros(1, np.int64), self.divisors[s])[0] for s in self.place], np.int64)
        self.sums, self.seen = np.zeros((len(self.left), len(self.right)), np.int64), 0

    def _parts(self, matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return matrix[: len(self.left)], matrix[len(matrix) - len(self.right) :]

    def close(self) -> None:
        """Take in the chunk that is held."""
        if self.sums is None:
            self._start()
        if not self.rows:
            return
        terms = np.unique(np.concatenate([idx for _, idx, _ in self.rows]))
        matrix = np.repeat(self.none[:, None], len(terms), axis=1)
        for (_, source, _, _), idx, counts in self.rows:
            matrix[self.place[source], np.searchsorted(terms, idx)] = shares(counts, self.divisors[source])
        left, right = self._parts(matrix)
        for k, row in enumerate(left):
            self.sums[k] += np.abs(right - row).sum(axis=1)
        self.seen += len(terms)
        self.rows = []

    def result(self) -> pa.RecordBatch:
        self.close()
        lang, bi, bj, part = self.key
        left, right = self._parts(self.none)
        v = self.groups[0][3] if self.groups and part == 0 else 0
        value = self.sums + (v - self.seen) * np.abs(left[:, None] - right[None, :])
        i, j = np.triu_indices(len(self.left), 1) if bi == bj else (x.ravel() for x in np.indices(value.shape))
        a, b = ([side[k][1] for k in at] for side, at in ((self.left, i), (self.right, j)))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(a), pa.string()), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(value[i, j], pa.int64())], ["lang", "a", "b", "value"])


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of tile and chunk, each tile's groups (chunk -1) first."""
    tile: Tile | None = None
    for batch in batches:
        heads = [batch.column(c).to_pylist() for c in ("lang", "bi", "bj", "part", "chunk", "block", "source", "total", "v")]
        idx, counts = batch.column("idx"), batch.column("counts")
        for k, (lang, bi, bj, part, chunk, *group) in enumerate(zip(*heads, strict=True)):
            key = (lang, bi, bj, part)
            if tile is None or tile.key != key:
                if tile is not None:
                    yield tile.result()
                tile = Tile(key)
            packed = (None, None) if chunk < 0 else (idx[k].values.to_numpy(), counts[k].values.to_numpy())
            tile.add(chunk, tuple(group), *packed)
    if tile is not None:
        yield tile.result()


def pair_distances(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: both directions of every pair of sources of a language."""
    spark = hits.sparkSession
    small_batches(spark)
    packed = F.sort_array(F.collect_list(F.struct(F.col("idx").cast("int").alias("idx"), F.col("n"))))
    vectors = hits.groupBy("lang", "source", "chunk").agg(packed.alias("x")).join(groups, ["lang", "source"])
    rows = vectors.select("lang", "source", "total", "v", "block", "n_blocks", "chunk", (F.col("chunk") / CHUNKS_A_TASK).cast("int").alias("part"), F.col("x.idx").alias("idx"), F.col("x.n").alias("counts"))
    parts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.ceil(F.col("v") / CHUNK) / CHUNKS_A_TASK).cast("int") - 1))
    heads = groups.select("lang", "source", "total", "v", "block", "n_blocks", F.lit(-1).alias("chunk"), F.explode(parts).alias("part"), F.array().cast("array<int>").alias("idx"), F.array().cast("array<bigint>").alias("counts"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    tiled = rows.unionByName(heads).withColumn("other", other).withColumn("bi", F.least("block", "other")).withColumn("bj", F.greatest("block", "other"))
    tiled = tiled.select("lang", "bi", "bj", "part", "chunk", "block", "source", "total", "v", "idx", "counts").repartition("lang", "bi", "bj", "part").sortWithinPartitions("lang", "bi", "bj", "part", "chunk")
    sums = tiled.mapInArrow(_tiles, "lang string, a string, b string, value long").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.inline(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", "value", both).select("lang", "source", "item", "value")


def standing_out(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item, value: terms that a group has and gives a larger share than its language does."""
    rows = hits.join(groups.select("lang", "source", "total"), ["lang", "source"])
    p, q = share(F.col("n"), F.col("total"), F.col("v")), share(F.col("lang_n"), F.col("lang_total"), F.col("v"))
    return rows.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).filter("value > 0")


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part (``pair`` or ``term``), item, value, rank."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang_col), ("source", source_col), ("text", text_col))])
    counts, _ = materialise(group_terms(docs))
    kept, _ = materialise(numbered_terms(counts, min_docs))
    hits, _ = materialise(counts.drop("docs").join(kept, ["lang", "term"]))
    sizes = kept.groupBy("lang").agg(F.first("v").alias("v"))
    groups, _ = materialise(blocks(docs, hits, sizes))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).cast("int")
    pairs = pair_distances(hits, groups).withColumn("rank", rank)
    terms = standing_out(hits, groups).withColumn("rank", rank).filter(F.col("rank") <= top)
    out = [df.select("lang", "source", F.lit(part).alias("part"), "item", F.col("value").cast("long").alias("value"), "rank") for part, df in (("pair", pairs), ("term", terms))]
    return out[0].unionByName(out[1])


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP11_SQL = r"""
WITH d AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS rid FROM documents),
t AS (SELECT lang, source, rid, translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT lang, source, rid, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM d)),
k AS (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS n FROM k GROUP BY lang),
c AS (SELECT t.lang, source, term, count(*)::HUGEINT AS n FROM t JOIN k USING (lang, term) GROUP BY t.lang, source, term),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY g.lang, g.source),
p AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (s.n + 5 * v.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 5)) // (v.n + 5 * v.v) AS q
      FROM s JOIN k USING (lang) JOIN v ON v.lang = s.lang LEFT JOIN c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
      FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
      UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM o)
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM r WHERE part = 'pair' OR rank <= 50
"""
