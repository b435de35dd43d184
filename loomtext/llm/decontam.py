"""Benchmark decontamination by template canonicalisation.

Words are reduced to a *template*: case and outer punctuation go, and numbers (in digits or one word), names (capitalised
inside a sentence) and units (after a number) become typed placeholders, whose values are the *slots*.  Windows of
``WINDOW`` template words of the benchmark are hash-joined with those of the documents.  A window with a name stands a
second time with its names as words, so a copy in lower case, capitals or title case is found whatever its case says
about names.  A window of fewer than ``PLAIN`` plain words stands as it is written, without placeholders: rows of figures
are evidence only where they are the same figures.

A document holds an item when the item's windows that occur in it cover at least ``COVERAGE`` of the item's words, the text has as many, and the
slots agree on one reading: each value of the item stands for one value of the document, over the whole text or in one
occurrence.  An occurrence is a stretch of text whose windows stand at like distances from their places in the item, up to
``WINDOW`` words more where words were put in, so a text may hold several variants.  Equal values make the hit ``exact``;
other consistent values make it ``reparameterised``; contradictory ones make it none.  Items of fewer words than a window
are one window by themselves.

The documents are scanned in place: a window leaves its partition only if the benchmark has its hash.  The benchmark's
hashes are broadcast while they are at most ``BROADCAST_WINDOWS`` (32 MB); beyond that all windows go to the join.  A
window of a text is joined once with each item that has it, however often the item repeats it; places are matched where
the text's and the item's windows meet, in time that follows their number.

Cases: null or empty texts and items have no windows and no hits; repeated rows are judged alike; repeated items with
one id are one item's windows together; ids may be null; ties cannot arise; extra columns are not read; an empty
benchmark or an empty table gives documents without hits, or none.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import content_key, materialise, small_batches
from loomtext.llm.textkit import BYTE_CODE, buffers, chunks, span_hashes, window_hashes, words

WINDOW = 8
COVERAGE = 0.8
PLAIN = 2
BROADCAST_WINDOWS = 4_000_000
# Unit words that may follow a number.
UNITS = (
    "mm cm m km inch inches ft foot feet yd yard yards mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces "
    "ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
    "mph kmh percent dollar dollars cent cents euro euros degree degrees"
).split()
# Numbers in one word.
NUMERALS = {w: str(k) for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty".split())}
NUMERALS |= {w: str(10 * k) for k, w in enumerate("thirty forty fifty sixty seventy eighty ninety hundred".split(), 3)} | {"thousand": "1000", "million": "1000000"}

_PUNCT = np.zeros(256, bool)
_PUNCT[[c for c in range(33, 128) if not chr(c).isalnum()]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
NUMBER, NAME, UNIT = (np.uint64(v) for v in (0xA11CE5ED00000001, 0xA11CE5ED00000002, 0xA11CE5ED00000003))


def _hash_strings(values: list[str]) -> np.ndarray:
    raw, off = buffers(pa.array(values, pa.string()))
    return span_hashes(BYTE_CODE[raw], off[:-1], off[1:])


def _among(codes: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, codes), len(known) - 1)] == codes


_UNIT_HASHES = np.sort(_hash_strings(UNITS))
_NUMERAL_HASHES = np.sort(_hash_strings(list(NUMERALS)))


def template(lower: tuple[np.ndarray, np.ndarray], raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of a chunk (given lower-cased, and as it is): word codes, slot types, bare punctuation, word starts, ends, first words.

    ``lower`` holds the same words in the same order, so only word numbers connect the two.
    """
    low, low_off = lower
    start, end, first = words(low, low_off)
    n = len(start)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int8), np.zeros(0, bool), start, end, first
    punct = np.append(0, np.cumsum(_PUNCT[low]))
    bare = punct[end] - punct[start] == end - start
    solid = np.flatnonzero(~_PUNCT[low])
    solid = np.append(solid, len(low))
    core_start = np.where(bare, start, np.minimum(solid[np.searchsorted(solid, start)], end))
    core_end = np.where(bare, end, solid[np.searchsorted(solid, end) - 1] + 1)
    codes = span_hashes(BYTE_CODE[low], core_start, core_end)
    digits = np.append(0, np.cumsum(_DIGIT[low]))
    number = (digits[core_end] > digits[core_start]) | _among(codes, _NUMERAL_HASHES)
    o_start, o_end, _ = words(raw, off)
    opening = np.zeros(n, bool)
    opening[first[:-1][first[:-1] < n]] = True
    opening[1:] |= _STOP[raw[o_end[:-1] - 1]]
    broke = np.append(0, np.cumsum(raw == 10))
    opening[1:] |= broke[o_start[1:]] > broke[o_end[:-1]]
    skip = np.zeros(n, np.int64)
    same_size = (o_end - o_start) == (end - start)
    skip[same_size] = (core_start - start)[same_size]
    head, head_low = raw[o_start + skip], low[core_start]
    second = raw[np.minimum(o_start + skip + 1, len(raw) - 1)], low[np.minimum(core_start + 1, len(low) - 1)]
    capital = (head != head_low) | ((head >= 0xC3) & (second[0] != second[1]))
    # A word all in capitals is not told apart from its neighbours by its case.
    tail = raw[np.maximum(o_end - 1, 0)], low[np.maximum(end - 1, 0)]
    name = capital & ~opening & ~number & (tail[0] == tail[1])
    unit = np.zeros(n, bool)
    unit[1:] = number[:-1] & _among(codes[1:], _UNIT_HASHES)
    kind = np.where(number, 1, np.where(name, 2, np.where(unit, 3, 0))).astype(np.int8)
    return codes, kind, bare, core_start, core_end, first


def windows_of(shape: tuple[np.ndarray, ...], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, word place in the document, hash, which slots stand open) of each window, some of them twice.

    Open slots: 0 none (the window as it is written), 1 numbers and units, 2 names as well.
    """
    codes, kind, bare, _, _, first = shape
    size = np.diff(first)
    n = np.where(size >= width, size - width + 1, 0)
    doc = np.repeat(np.arange(len(size)), n)
    at = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    start = first[doc] + at
    if not len(start):
        return doc, at, np.zeros(0, np.uint64), np.zeros(0, np.int8)

    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(flags))
        return total[start + width] - total[start]

    counted = codes.copy()
    counted[kind == 1], counted[kind == 3] = NUMBER, UNIT
    named = counted.copy()
    named[kind == 2] = NAME
    least = min(PLAIN, max(1, width // 4))
    has_name = inside(kind == 2) > 0
    out = []
    for level, shaped, plain in ((2, named, (kind == 0) & ~bare), (1, counted, ((kind == 0) | (kind == 2)) & ~bare)):
        enough = inside(plain) >= least
        out.append((np.where(enough, window_hashes(shaped, width)[start], window_hashes(codes, width)[start]), np.where(enough, level, 0).astype(np.int8)))
    (h2, o2), (h1, o1) = out
    # Without a name both are the same window; with one, the second is added if it is another.
    more = has_name & (h1 != h2)
    return np.append(doc, doc[more]), np.append(at, at[more]), np.append(h2, h1[more]), np.append(o2, o1[more])


def _rows(text: pa.Array) -> Iterator[tuple]:
    raw, off = buffers(text)
    low, low_off = buffers(pc.replace_substring(pc.utf8_lower(text), "ß", "ss"))  # what its capitals are lower-cased to
    for i, j, part, o in chunks(raw, off):
        small = low[low_off[i] : low_off[j]], low_off[i : j + 1] - low_off[i]
        yield i, j, small[0], template(small, part, o)


def _slots(low: bytes, shape: tuple[np.ndarray, ...], a: int, b: int, opened: int) -> list[str]:
    """The values in the open slots of a window, '' for its plain words."""
    kind, start, end = shape[1], shape[3], shape[4]
    typed = ((), (1, 3), (1, 2, 3))[opened]
    words = [low[start[k] : end[k]].decode("utf-8", "replace") if kind[k] in typed else "" for k in range(a, b)]
    return [NUMERALS.get(w, w) for w in words]


def _index(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Benchmark items -> their windows: item, place, width, hash, slots, places of the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            ids = batch.column("item").to_pylist()
            for i, _, low, shape in _rows(batch.column("text")):
                data, first = low.tobytes(), shape[5]
                sizes = np.diff(first)
                for w in {min(width, int(x)) for x in sizes if x}:
                    for d, k, h, o in zip(*(x.tolist() for x in windows_of(shape, w)), strict=True):
                        if min(width, sizes[d]) == w:
                            f = int(first[d]) + k
                            rows.append((ids[i + d], k, w, int(np.uint64(h).astype(np.int64)), _slots(data, shape, f, f + w, o), int(sizes[d]) - w + 1))
            if rows:
                kinds = [batch.schema.field("item").type, pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["item", "place", "width", "hash", "slots", "windows"])

    return run


def _probe(widths: list[int], wanted: np.ndarray | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Documents -> their windows that the benchmark has (all, if ``wanted`` is None)."""
    if wanted is not None:
        table = np.zeros(1 << 22, bool)
        table[(wanted >> np.uint64(42)).astype(np.int64)] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            th, tl = batch.column("th").to_pylist(), batch.column("tl").to_pylist()
            for i, _, low, shape in _rows(batch.column("text")):
                data, rows, first = low.tobytes(), [], shape[5]
                for w in widths:
                    doc, at, h, opened = windows_of(shape, w)
                    if wanted is not None:
                        maybe = np.flatnonzero(table[(h >> np.uint64(42)).astype(np.int64)])
                        maybe = maybe[np.isin(h[maybe], wanted)]
                        doc, at, h, opened = doc[maybe], at[maybe], h[maybe], opened[maybe]
                    for d, k, x, o in zip(doc.tolist(), at.tolist(), h.view(np.int64).tolist(), opened.tolist(), strict=True):
                        f = int(first[d]) + k
                        rows.append((th[i + d], tl[i + d], k, w, x, _slots(data, shape, f, f + w, o)))
                if rows:
                    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["th", "tl", "at", "width", "hash", "values"])

    return run


def _covered(places: set[int], width: int) -> int:
    """Words in the windows at ``places``."""
    ordered = sorted(places)
    return sum(min(width, b - a) for a, b in zip(ordered, ordered[1:], strict=False)) + (width if ordered else 0)


def _agree(slots: tuple, values: tuple, reading: dict[str, str]) -> bool:
    return all(reading.setdefault(s, v) == v for s, v in zip(slots, values, strict=True) if s)


def judge(found: list[tuple[int, int, tuple]], windows: list[tuple[int, int, tuple]], n_places: int, width: int, coverage: float = COVERAGE) -> tuple[str | None, float]:
    """How a text holds an item, and how much of it: (at, hash, values) of the text's windows that the item has, against
    (place, hash, slots) of the item's."""
    words = n_places + width - 1
    places: dict[int, list[int]] = defaultdict(list)
    slots = {}
    for place, h, s in sorted(windows):
        if not places[h] or places[h][-1] != place:
            places[h].append(place)
        slots[h, place] = s
    said: dict[int, set[tuple]] = defaultdict(set)
    for _, h, v in found:
        said[h].add(v)
    matched = {place for place, h, _ in windows if h in said}
    # The text must have the words too: a phrase that the item repeats is not the item.
    held = min(_covered(matched, width), _covered({at for at, _, _ in found}, width)) / words
    if held < coverage:
        return None, held
    own = {place for place, h, s in windows if s in said.get(h, ())}
    if len(own) / n_places >= coverage or own == matched:
        return "exact", held
    reading: dict[str, str] = {}
    if all((len(v) == 1 or not any(slots[h, places[h][0]])) and all(_agree(slots[h, p], next(iter(v)), reading) for p in places[h]) for h, v in said.items()):
        return "reparameterised", held
    ordered = sorted(found)
    ats = [at for at, _, _ in ordered]
    slack, done = min(width, n_places), None
    # Where an occurrence may start: by the first place of each window; a true start is among them.
    for s in sorted({at - places[h][0] for at, h, _ in ordered}):
        if done is not None and s <= done:
            continue
        lo, hi = bisect_left(ats, s), bisect_right(ats, s + slack + n_places - 1)
        if (hi - lo) * width < coverage * words:
            continue
        done, start, covered, reading, agreed = s + slack, s, set(), {}, True
        for at, h, v in ordered[lo:hi]:
            known = places[h]
            k = bisect_left(known, at - start)
            place = min(known[max(0, k - 1) : k + 1], key=lambda p, at=at, start=start: abs(at - p - start))
            if not s <= at - place <= s + slack:
                continue
            start = at - place
            covered.add(place)
            if not _agree(slots[h, place], v, reading):
                agreed = False
                break
        if agreed and _covered(covered, width) >= coverage * words:
            return "reparameterised", held
    return None, held


def _judged(coverage: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for found, windows, n, w in zip(*(batch.column(c).to_pylist() for c in ("found", "index", "windows", "width")), strict=True):
                texts = [(x["at"], x["hash"], tuple(x["values"])) for x in found]
                out.append(judge(texts, [(x["place"], x["hash"], tuple(x["slots"])) for x in windows], n, w, coverage))
            match, held = zip(*out, strict=True) if out else ((), ())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("th", "tl", "item")), pa.array(held, pa.float64()), pa.array(match, pa.string())], ["th", "tl", "item", "coverage", "match"])

    return run


def hits(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", width: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """th, tl, item, coverage, match ('exact' or 'reparameterised') for each text and item it holds."""
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.select(F.col(item_col).alias("item"), F.col("text").cast("string").alias("text"))
    kind = items.schema["item"].dataType.simpleString()
    index, _ = materialise(items.mapInArrow(_index(width), f"item {kind}, place int, width int, hash long, slots array<string>, windows int").distinct())
    known = index.select("hash", "width").distinct()
    shapes = [r["width"] for r in known.select("width").distinct().collect()]  # at most ``width`` values
    first = known.select("hash").limit(BROADCAST_WINDOWS + 1)
    wanted = None
    if known.count() <= BROADCAST_WINDOWS:
        wanted = np.sort(np.array([r["hash"] for r in first.toLocalIterator()], np.int64).view(np.uint64))
    texts = docs.select(*content_key(), F.col(text_col).cast("string").alias("text"))
    found = texts.mapInArrow(_probe(shapes, wanted), "th long, tl int, at int, width int, hash long, values array<string>")
    # Copies of a text say the same: one row of each is enough.
    found = found.distinct()
    by_hash = index.groupBy("item", "hash", "width").agg(F.count("*").alias("times"), F.max("windows").alias("windows"))
    by_item = index.groupBy("item").agg(F.collect_list(F.struct("place", "hash", "slots")).alias("index"))
    together = found.join(by_hash, ["hash", "width"]).groupBy("th", "tl", "item").agg(
        F.collect_list(F.struct("at", "hash", "values")).alias("found"), F.sum("times").alias("times"), F.max("windows").alias("windows"), F.max("width").alias("width"),
    )
    # Fewer windows than could cover the item are no hit, whatever they say.
    likely = together.filter(F.col("times") * F.col("width") >= coverage * (F.col("windows") + F.col("width") - 1))
    rows = likely.join(by_item.withColumnRenamed("item", "of"), F.col("item").eqNullSafe(F.col("of")))
    rows = rows.select("th", "tl", "item", "windows", "width", "found", "index")
    return rows.mapInArrow(_judged(coverage), f"th long, tl int, item {kind}, coverage double, match string").filter("match is not null")


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """id, contaminated, n_items, items (ids, sorted), n_exact, n_reparameterised: one row for each row of ``docs``."""
    found = hits(docs, benchmark).groupBy("th", "tl").agg(F.array_sort(F.collect_set("item")).alias("items"), F.count_if(F.col("match") == "exact").alias("n_exact"), F.count_if(F.col("match") != "exact").alias("n_reparameterised"))
    rows = docs.select(F.col(id_col), *content_key()).join(found, ["th", "tl"], "left")
    none = F.array().cast(found.schema["items"].dataType)
    return rows.select(id_col, F.col("items").isNotNull().alias("contaminated"), F.coalesce(F.size(F.coalesce("items", none)), F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", none).alias("items"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_exact", "n_reparameterised")])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows of ``docs`` (as they are) that hold no benchmark item."""
    tagged = docs.select(F.struct("*").alias("row"), *content_key())
    return tagged.join(hits(docs, benchmark).select("th", "tl").distinct(), ["th", "tl"], "left_anti").select("row.*")


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
