"""Trigram full text: postings, document frequencies, BM25.

Phrases of three characters and more are searched as case-insensitive substrings.  ``postings`` is the index table: for
each span and trigram, how often and where it stands; a span's rows are made from that span alone, so nothing is
shuffled.  With places, a row also carries the span's size and order, so ranking needs no other table, and the last one
and two characters of a field are terms as well: every character of a text then begins a term, and terms of one or two
characters are found as beginnings of terms (``short_spans``).  ``phrase_hits`` counts whole phrases from positions, and
``indexed_bm25`` ranks by them, without reading texts; ``add_bm25`` does the same by a scan where there is no index.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHUNK = 1 << 20  # characters that one step of the pass over the spans holds
# Fixed values of BM25.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
CARRIED = ["n_trigrams", "source_ordinal", "ordinal"]  # what each posting with places says of its span


def trigram_count(c: Column) -> Column:
    return F.greatest(F.length(c) - 2, F.lit(0))


def trigrams(c: Column) -> Column:
    """All trigrams of the lower-cased text, repeats included; one walk, for substring() would start anew at each place."""
    return F.regexp_extract_all(F.lower(c), F.lit("(?s)(?=(...))"), 1)


def _code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts together, and the offset of each text."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    return flat, np.cumsum([0, *map(len, texts)])


def _trigram_rows(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, trigram as one number, place) of every trigram of every text."""
    flat, off = _code_points(texts)
    n = np.maximum(np.diff(off) - 2, 0)
    doc = np.repeat(np.arange(len(texts)), n)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    at = off[doc] + place
    return doc, (flat[at] << 42) | (flat[at + 1] << 21) | flat[at + 2], place


def _sorted_rows(doc: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """doc and code ordered by both, and the places that their rows had; equal rows keep their order.

    Text, characters by their rank among those that occur, and place make one number where 63 bits have room for them.
    """
    signs = np.zeros(0x110000, bool)
    for shift in (42, 21, 0):
        signs[(code >> shift) & 0x1FFFFF] = True
    known = np.flatnonzero(signs)
    base, bits = len(known), max(len(code), 1).bit_length()
    if not len(code) or (int(doc.max()) + 1) * base**3 >= 1 << (63 - bits):
        order = np.lexsort((code, doc))
        return doc[order], code[order], order
    rank = np.cumsum(signs) - 1
    dense = (rank[code >> 42] * base + rank[(code >> 21) & 0x1FFFFF]) * base + rank[code & 0x1FFFFF]
    key = np.sort(((doc * base**3 + dense) << bits) | np.arange(len(code)))
    order = key & ((1 << bits) - 1)
    return doc[order], code[order], order


def _lists(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pa.array(values.astype(np.int32)))


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The same as bytes, four for each value, high ones first."""
    ends = np.append(0, np.cumsum(sizes) * 4).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(values.astype(">i4").tobytes())])


def _tails(heading: list[str], content: list[str]) -> tuple[list[int], list[str]]:
    """(text, term): the last one and two characters of each field, once a text."""
    made = [(k, t) for k, (h, c) in enumerate(zip(heading, content, strict=True)) for t in sorted({x for f in (h, c) for x in (f[-1:], f[-2:]) if x})]
    return [k for k, _ in made], [t for _, t in made]


def _post(places: bool, packed: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["work_ref", "span_ref", "term", "tf", "in_heading", "in_content", *CARRIED][: None if places else 4]
    lists = _packed if packed else _lists

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            heading, content = (pc.fill_null(batch.column(c), "").to_pylist() for c in ("heading", "content"))
            size = np.cumsum([0, *(len(h) + len(c) for h, c in zip(heading, content, strict=True))])
            i = 0
            while i < batch.num_rows:
                j = min(max(int(np.searchsorted(size, size[i] + CHUNK, "right")) - 1, i + 1), batch.num_rows)
                found = [_trigram_rows(x[i:j]) for x in (heading, content)]
                doc, code, place = (np.concatenate(x) for x in zip(*found, strict=True))
                field = np.repeat([0, 1], [len(found[0][0]), len(found[1][0])])
                doc, code, order = _sorted_rows(doc, code)  # places in the heading stay before those in the content
                place, field = place[order], field[order]
                head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (code[1:] != code[:-1])))[: len(doc)]
                tf = np.diff(np.append(head, len(doc)))
                terms, which = np.unique(code[head], return_inverse=True)
                named = pa.array(["".join(map(chr, ((t >> 42) & 0x1FFFFF, (t >> 21) & 0x1FFFFF, t & 0x1FFFFF))) for t in terms.tolist()], pa.string())
                at = pa.array(doc[head] + i)
                columns = [batch.column("work_ref").take(at), batch.column("span_ref").take(at), named.take(pa.array(which)), pa.array(tf.astype(np.int32))]
                if places:
                    in_content = np.add.reduceat(field, head) if len(head) else tf
                    counts = pa.array([max(len(h) - 2, 0) + max(len(c) - 2, 0) for h, c in zip(heading, content, strict=True)], pa.int32())
                    carried = [counts, *(batch.column(c).cast(pa.int32()) for c in CARRIED[1:])]
                    columns += [lists(place[field == 0], tf - in_content), lists(place[field == 1], in_content), *(c.take(at) for c in carried)]
                    k, tails = _tails(heading[i:j], content[i:j])
                    at, none = pa.array(np.asarray(k, np.int64) + i), np.zeros(len(k), np.int64)
                    last = [batch.column("work_ref").take(at), batch.column("span_ref").take(at), pa.array(tails, pa.string()), pa.array(none.astype(np.int32)), lists(none[:0], none), lists(none[:0], none), *(c.take(at) for c in carried)]
                    yield pa.RecordBatch.from_arrays(last, names)
                yield pa.RecordBatch.from_arrays(columns, names)
                i = j

    return run


def postings(spans: DataFrame, places: bool = False, packed: bool = False) -> DataFrame:
    """(work_ref, span_ref, term, tf): every trigram of heading and content; with ``places`` also where (in_heading,
    in_content: offsets in characters), the span's number of trigrams and its order (source_ordinal, ordinal: columns of
    ``spans``), and the ends of the fields as terms of one and two characters with ``tf`` 0.  ``packed``: places are bytes, which are
    written faster than lists; :func:`unpacked` reads them."""
    order = CARRIED[1:] if places else []
    given = spans.select("work_ref", "span_ref", F.lower("heading").alias("heading"), F.lower("content").alias("content"), *order)
    kind = "binary" if packed else "array<int>"
    more = f", in_heading {kind}, in_content {kind}, n_trigrams int, source_ordinal int, ordinal int" if places else ""
    return given.mapInArrow(_post(places, packed), "work_ref string, span_ref string, term string, tf int" + more)


def unpacked(posted: DataFrame) -> DataFrame:
    """Packed postings with places as arrays; those that are filtered out, or not asked, are not unpacked."""

    def places(c: str) -> Column:
        n = (F.octet_length(c) / 4).cast("int")
        values = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.conv(F.hex(F.substring(F.col(c), 4 * i + 1, F.lit(4))), 16, 10).cast("int"))
        return F.when(n > 0, values).otherwise(F.array().cast("array<int>"))

    return posted.withColumns({c: places(c) for c in ("in_heading", "in_content")})


def document_frequency(posted: DataFrame) -> DataFrame:
    """(work_ref, term, df) of the trigrams."""
    return posted.filter("tf > 0").groupBy("work_ref", "term").agg(F.count("*").alias("df"))


def phrase_candidates(posted: DataFrame, phrases: DataFrame) -> DataFrame:
    """phrases(phrase: distinct) x postings -> (phrase, work_ref, span_ref) that hold its rarest trigram; verify with
    contains().

    A phrase meets the postings on that one trigram, so common trigrams, which many phrases share, pair nothing.  A phrase
    with a trigram that no span has is nowhere.
    """
    terms = phrases.select("phrase", F.explode(F.array_distinct(trigrams(F.col("phrase")))).alias("term"))
    df = posted.join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    rarest = terms.join(df, "term", "left").groupBy("phrase").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "term")).alias("least"))
    marks = rarest.filter("least.df > 0").select("phrase", F.col("least.term").alias("term"))
    return posted.join(marks, "term").select("phrase", "work_ref", "span_ref")


def occurrences(c: Column, term: str) -> Column:
    """Occurrences of ``term`` in lower-cased text, overlapping ones too."""
    return F.regexp_count(c, F.lit(f"(?={re.escape(term)})"))


def add_bm25(spans: DataFrame, terms: list[str], heading: str = "heading", content: str = "content") -> DataFrame:
    """``spans`` that hold a term, with ``bm25`` over the whole table; one scan for the statistics, one for the rows."""
    low_h, low_c = F.lower(F.col(heading)), F.lower(F.col(content))
    size = trigram_count(F.col(heading)) + trigram_count(F.col(content))
    hits = [occurrences(low_h, t) + occurrences(low_c, t) for t in terms]
    stats = spans.agg(F.count("*").alias("n"), F.avg(size).alias("avg"), *[F.count_if(F.contains(low_h, F.lit(t)) | F.contains(low_c, F.lit(t))).alias(f"df{k}") for k, t in enumerate(terms)]).first()
    score = F.lit(0.0)
    for k, hit in enumerate(hits):
        df = stats[f"df{k}"]
        idf = math.log((stats["n"] - df + 0.5) / (df + 0.5)) if stats["n"] else LEAST_IDF
        idf = idf if idf > 0 else LEAST_IDF
        score = score + F.lit(idf) * hit * F.lit(K1 + 1) / (hit + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * size / F.lit(stats["avg"] or 1.0)))
    any_term = F.lit(False)
    for t in terms:
        any_term = any_term | F.contains(low_h, F.lit(t)) | F.contains(low_c, F.lit(t))
    return spans.filter(any_term).withColumn("bm25", score)


def phrase_hits(posted: DataFrame, phrases: list[str], frequency: Callable[[list[str]], dict[str, int]] | None = None) -> DataFrame:
    """(phrase, span_ref, hits, and what postings carry) from postings with places: a phrase stands where its trigrams
    stand one after the other.

    phrases: distinct, lower case, three characters or more, a bounded list.  The postings are read for their trigrams
    only; with ``frequency`` (trigrams -> spans that hold them), places are compared only in spans that hold the rarest
    trigram of a phrase.
    """
    spark = posted.sparkSession
    parts = [(p, p[i : i + 3], i, len(cover(len(p)))) for p in phrases for i in cover(len(p))]
    terms = spark.createDataFrame(parts, "phrase string, term string, step int, need int")
    rows = posted.filter(F.col("term").isin(*sorted({t for _, t, _, _ in parts}))).join(F.broadcast(terms), "term")
    if frequency is not None and any(n > 1 for *_, n in parts):
        known = frequency(sorted({t for _, t, _, _ in parts}))
        rarest = {p: min((p[i : i + 3] for i in cover(len(p))), key=lambda t: (known.get(t, 0), t)) for p in phrases}
        marks = spark.createDataFrame(list(rarest.items()), "phrase string, term string")
        maybe = posted.filter(F.col("term").isin(*sorted(set(rarest.values())))).select("term", "span_ref").join(F.broadcast(marks), "term").select("phrase", "span_ref")
        rows = rows.join(maybe, ["phrase", "span_ref"], "left_semi")
    return whole_phrases(rows)


def cover(length: int) -> list[int]:
    """Places of trigrams that together have every character of a phrase: where they stand, it stands."""
    return sorted({*range(0, length - 2, 3), length - 3})


def whole_phrases(rows: DataFrame) -> DataFrame:
    """rows(phrase, term, step, need and a posting's columns) -> phrase, span_ref, hits and what postings carry: where all
    the ``need`` trigrams of a phrase stand in their places.

    Rows are dealt by span once; all that is counted of a span, and of its phrases, is counted there.
    """
    kept = ["phrase", "span_ref", *CARRIED]
    # A place in the heading counts from below nought, one in the content from nought.
    starts = {c: F.filter(F.transform(c, lambda x: x - F.col("step")), lambda x: x >= 0) for c in ("in_heading", "in_content")}
    place = F.concat(F.transform(starts["in_heading"], lambda x: -1 - x), starts["in_content"])
    dealt = rows.select(*kept, "need", place.alias("at")).repartition("span_ref")
    each = dealt.select(*kept, "need", F.explode("at").alias("at")).groupBy(*kept, "need", "at").agg(F.count("*").alias("n")).filter("n = need")
    return each.groupBy(*kept).agg(F.count("*").alias("hits"))


def rarity(count: Column | float, df: Column) -> Column:
    """The weight of a phrase that ``df`` of ``count`` spans hold."""
    x = F.log((F.lit(count).cast("double") - df + 0.5) / (df + 0.5))
    return F.when(x > 0, x).otherwise(LEAST_IDF)


def term_weight(idf: Column, hits: Column, size: Column, average: Column) -> Column:
    f = hits.cast("double")
    return idf * f * F.lit(K1 + 1) / (f + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * size / average))


def indexed_bm25(posted: DataFrame, count: int, average: float, phrases: list[str], frequency: Callable[[list[str]], dict[str, int]] | None = None) -> DataFrame:
    """(span_ref, source_ordinal, ordinal, bm25) of the spans that hold a phrase (see :func:`add_bm25`)."""
    hits = phrase_hits(posted, phrases, frequency)
    df = hits.groupBy("phrase").agg(F.count("*").alias("df"))
    idf = df.select("phrase", rarity(float(count), F.col("df")).alias("idf"))  # a row for each phrase
    part = term_weight(F.col("idf"), F.col("hits"), F.col("n_trigrams"), F.lit(average or 1.0))
    return hits.join(F.broadcast(idf), "phrase").groupBy("span_ref", "source_ordinal", "ordinal").agg(F.sum(part).alias("bm25"))


def short_spans(posted: DataFrame, terms: list[str]) -> DataFrame:
    """(span_ref, source_ordinal, ordinal) of spans that hold one of ``terms`` (one or two characters, lower case): a term
    of the index begins with each of them wherever it stands."""
    begins = F.lit(False)
    for t in terms:
        begins = begins | F.startswith(F.col("term"), F.lit(t))
    return posted.filter(begins).groupBy("span_ref").agg(*[F.first(c).alias(c) for c in CARRIED[1:]])
