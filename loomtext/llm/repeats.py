"""Exact repeats of fixed length over a corpus: anchors, shards, and the removal of what they find.

Every window of ``W`` tokens has one *anchor*, its k-gram of least hash.  Equal windows have equal anchors at equal
offsets, so all occurrences of a window meet in the shard of its anchor's hash, and a window is looked at exactly once.
Consecutive windows with one anchor travel together as a *piece* (their union, under 2 W tokens).

1. ``anchors``      each text -> (anchor hash, piece hash, place); whole texts, no text leaves its partition.
2. candidates       anchors seen once are dropped: nothing else has their windows.
3. copies           pieces with one anchor that are all equal are repeats of each other as they stand; where pieces of
                    one anchor differ, one of each kind (with its number of copies) goes on, so a group of a million
                    copies is one piece.
4. shards           pieces are dealt by anchor and searched in blocks of bounded size by ``search`` (a suffix array, or
                    a relative Lempel-Ziv parse).
5. removal          window ranges come back to their texts.

An anchor whose kinds of pieces are more than a block is dealt again by *longer anchors* (``_split``): the windows of a
piece that have the anchor within ``step`` places of each other share all but ``step - 1`` of their tokens, and the hash
of those is their new anchor.  The last step is 1, where a longer anchor is a whole window and each group is one piece,
so blocks are bounded for every input; smaller pieces are searched the same way, and their ranges mapped back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtext.llm.common import content_key, discard, mark, materialise, partitions, release, small_batches
from loomtext.llm.textkit import BYTE_CODE, buffers, chunks, mix, sliding_min, span_hashes, window_hashes, word_hashes, words

BLOCK_TOKENS = 1 << 18  # bytes; half as many words
_PLACE_BITS = 28


@dataclass(frozen=True)
class Unit:
    """What a token is, and the window and anchor widths counted in it."""

    words: bool
    window: int
    anchor: int

    @property
    def block(self) -> int:
        return BLOCK_TOKENS // (2 if self.words else 1)


def tokens(unit: Unit, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Codes of a chunk's tokens, their first and last byte, and each document's first token."""
    if unit.words:
        start, end, first = words(raw, off)
        return word_hashes(raw, start, end), start, end, first
    at = np.arange(len(raw) + 1)
    return BYTE_CODE[raw], at[:-1], at[1:], off


def pieces_of(unit: Unit, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, first window, windows, anchor's place in the piece, anchor hash, piece hash) of each piece of a chunk."""
    grams = window_hashes(codes, unit.anchor)
    place = (1 << _PLACE_BITS) - 1
    least = sliding_min((grams & np.uint64(~place & (2**64 - 1))) | np.arange(len(grams), dtype=np.uint64), unit.window - unit.anchor + 1)
    size = np.diff(first)
    whole = size >= unit.window
    counts = np.where(whole, size - unit.window + 1, 0)
    doc = np.repeat(np.arange(len(size)), counts)
    if not len(doc):
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    start = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts) + first[doc]
    anchor = (least[start] & np.uint64(place)).astype(np.int64)
    head = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
    n = np.diff(np.append(head, len(doc)))
    begin = start[head]
    return doc[head], begin - first[doc[head]], n, anchor[head] - begin, grams[anchor[head]], span_hashes(codes, begin, begin + n - 1 + unit.window)


def _anchors(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["key", "piece", "th", "tl", "a", "n", "p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            th, tl = batch.column("th").to_numpy(), batch.column("tl").to_numpy()
            for i, _, part, o in chunks(raw, off):
                codes, _, _, first = tokens(unit, part, o)
                doc, a, n, p, key, piece = pieces_of(unit, codes, first)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(piece.view(np.int64)), pa.array(th[doc + i]), pa.array(tl[doc + i]), *(pa.array(x.astype(np.int32)) for x in (a, n, p))], names)

    return run


def _cut(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts with lists of wanted pieces -> the pieces' own bytes (words joined by one space)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = None
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            ids = list(zip(batch.column("th").to_pylist(), batch.column("tl").to_pylist(), strict=True))
            for i, j, part, o in chunks(raw, off):
                wanted = batch.column("wanted").slice(i, j - i).to_pylist()
                _, start, end, first = tokens(unit, part, o)
                data = part.tobytes()
                rows: list[tuple] = []
                for d in range(i, j):
                    if ids[d] == seen:  # copies of a text come together
                        continue
                    seen, f = ids[d], first[d - i]
                    for w in wanted[d - i]:
                        b = f + w["a"]
                        e = b + w["n"] - 1 + unit.window
                        body = b" ".join([data[x:y] for x, y in zip(start[b:e].tolist(), end[b:e].tolist(), strict=True)]) if unit.words else data[b:e]
                        rows.append((w["key"], w["piece"], w["copies"], w["hot"], w["p"], body))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()), strict=True)], ["key", "piece", "copies", "hot", "p", "body"])

    return run


def block_tokens(bodies: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Integer tokens of the pieces of a block, each piece followed by the separator 0, and the pieces' offsets."""
    raw = np.frombuffer(b"".join(bodies), ">u8" if width == 8 else np.uint8)
    first = np.cumsum([0, *(len(b) // width for b in bodies)])
    ids = np.unique(raw, return_inverse=True)[1].astype(np.int64) + 1 if width == 8 else raw.astype(np.int64) + 1
    count = len(bodies)
    out = np.zeros(len(ids) + count, np.int64)
    out[np.arange(len(ids)) + np.repeat(np.arange(count), np.diff(first))] = ids
    return out, first + np.arange(count + 1)


def _shared(a: bytes, b: bytes) -> int:
    """Bytes of the common prefix."""
    n = min(len(a), len(b))
    differs = (int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")).bit_length()
    return n - (differs + 7) // 8


def _reach(group: list[int], sides: list[bytes]) -> list[int]:
    """For each side text, the longest prefix (bytes) that it shares with another of its group."""
    order = sorted(range(len(sides)), key=lambda i: (group[i], sides[i]))
    best = [0] * len(sides)
    for i, j in zip(order, order[1:], strict=False):
        if group[i] == group[j]:
            k = _shared(sides[i], sides[j])
            best[i], best[j] = max(best[i], k), max(best[j], k)
    return best


def _shard(unit: Unit, search: Callable[[Unit, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces sorted by anchor -> ranges of their windows that occur elsewhere.

    A piece can only recur as far as it agrees with another piece of its anchor, to the left and to the right; it is
    trimmed to that reach first (and left out if the reach is under a window), and trimmed pieces that are equal are
    searched once.
    """
    schema = ["key", "piece", "s", "e"]
    width = 8 if unit.words else 1

    def body_tokens(bodies: list[bytes]) -> list[bytes]:
        if not unit.words:
            return bodies
        raw, off = buffers(pa.array(bodies, pa.binary()))
        start, end, first = words(raw, off)
        codes = word_hashes(raw, start, end).astype(">u8").tobytes()
        return [codes[8 * i : 8 * j] for i, j in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]

    def backward(side: bytes) -> bytes:
        return np.frombuffer(side, ">u8")[::-1].tobytes() if unit.words else side[::-1]

    def block(rows: list[tuple]) -> pa.RecordBatch | None:
        rows = list({r[:2]: r for r in rows}.values())
        bodies = body_tokens([r[4] for r in rows])
        group = [r[0] for r in rows]
        right = _reach(group, [b[width * r[3] :] for b, r in zip(bodies, rows, strict=True)])
        left = _reach(group, [backward(b[: width * r[3]]) for b, r in zip(bodies, rows, strict=True)])
        of: dict[bytes, int] = {}
        copies: list[int] = []
        owners: list[tuple[int, int, int]] = []
        whole: list[tuple[int, int, int, int]] = []
        for i, (r, b) in enumerate(zip(rows, bodies, strict=True)):
            low, high = r[3] - left[i] // width, r[3] + right[i] // width
            if r[2] > 1:  # it has copies: every window of it recurs
                whole.append((r[0], r[1], 0, len(b) // width - unit.window + 1))
            if high - low >= unit.window:
                k = of.setdefault(b[width * low : width * high], len(copies))
                if k == len(copies):
                    copies.append(0)
                copies[k] += r[2]
                owners.append((k, i, low))
        text, off = block_tokens(list(of), width)
        hit = np.zeros(len(text) + 1, np.int8)
        if of:
            hit[:-1] = search(unit, text, off, np.array(copies))
        edge = np.diff(np.append(0, hit))
        s, e = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        at = np.searchsorted(off, s, "right") - 1
        ranges: dict[int, list[tuple[int, int]]] = {}
        for k, x, y in zip(at.tolist(), (s - off[at]).tolist(), (e - off[at]).tolist(), strict=True):
            ranges.setdefault(k, []).append((x, y))
        out = whole + [(rows[i][0], rows[i][1], low + x, low + y) for k, i, low in owners if rows[i][2] == 1 for x, y in ranges.get(k, ())]
        if not out:
            return None
        key, piece, s, e = zip(*out, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(piece, pa.int64()), pa.array(s, pa.int32()), pa.array(e, pa.int32())], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "piece", "copies", "p", "body")), strict=True):
                if held and size >= width * unit.block and held[-1][0] != row[0]:
                    if (made := block(held)) is not None:
                        yield made
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
        if held and (made := block(held)) is not None:
            yield made

    return run


def _split(unit: Unit, step: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pieces of a hot anchor -> smaller pieces by longer anchors, each with the piece it is from and its place there."""
    names = ["key", "piece", "copies", "p", "body", "up_key", "up_piece", "at"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("body"))
            key, piece, copies, place = (batch.column(c).to_numpy() for c in ("key", "piece", "copies", "p"))
            for i, _, part, o in chunks(raw, off, 1 << 18):
                codes, start, end, first = tokens(unit, part, o)
                n = np.diff(first) - unit.window + 1
                doc = np.repeat(np.arange(len(n)), n)
                j = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                kind = (place[doc + i] - j) // step  # windows with the old anchor at one of ``step`` places
                head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (kind[1:] != kind[:-1])))
                tail = np.append(head[1:], len(doc)) - 1
                doc, low, high, kind = doc[head], j[head], j[tail], kind[head]
                core = place[doc + i] - kind * step  # all these windows have the tokens from here to W - step + 1 further on
                f = first[doc]
                longer = span_hashes(codes, f + core, f + core + unit.window - step + 1)
                new_key = mix(longer ^ mix(key[doc + i].view(np.uint64) + kind.astype(np.uint64)))
                new_piece = span_hashes(codes, f + low, f + high + unit.window)
                data = part.tobytes()
                bodies = [data[x:y] for x, y in zip(start[f + low].tolist(), end[f + high + unit.window - 1].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(new_key.view(np.int64)), pa.array(new_piece.view(np.int64)), pa.array(copies[doc + i]), pa.array((core - low).astype(np.int32)), pa.array(bodies, pa.binary()), pa.array(key[doc + i]), pa.array(piece[doc + i]), pa.array(low.astype(np.int32))], names
                )

    return run


_PIECE = "key long, piece long, copies long, p int, body binary"


_RANGES = "array<struct<s:int,e:int>>"


def _merged(ranges: Column) -> Column:
    """Ranges that touch or overlap as one, in order."""

    def add(done: Column, x: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        longer = F.struct(last["s"].alias("s"), F.greatest(last["e"], x["e"]).alias("e"))
        return F.when((F.size(done) > 0) & (last["e"] >= x["s"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(x)))

    return F.aggregate(F.array_sort(ranges), F.array().cast(_RANGES), add)


def _moved(ranges: str, by: str) -> Column:
    return F.transform(ranges, lambda x: F.struct((x["s"] + F.col(by)).alias("s"), (x["e"] + F.col(by)).alias("e")))


def _search(pieces: DataFrame, unit: Unit, search: Callable) -> DataFrame:
    """Kinds of pieces (key, piece, copies, p, body) -> (key, piece, ranges), a row for each kind that has any."""
    dealt = pieces.select("key", "piece", "copies", "p", "body").repartition(partitions(pieces.sparkSession), "key").sortWithinPartitions("key")
    found = dealt.mapInArrow(_shard(unit, search), "key long, piece long, s int, e int")
    return found.groupBy("key", "piece").agg(_merged(F.collect_list(F.struct("s", "e"))).alias("ranges"))


def _search_hot(pieces: DataFrame, unit: Unit, search: Callable, steps: list[int]) -> DataFrame:
    """:func:`_search` for pieces of hot anchors, dealt by longer anchors; ``steps`` ends with 1."""
    smaller, _ = materialise(pieces.mapInArrow(_split(unit, steps[0]), f"{_PIECE}, up_key long, up_piece long, at int"))
    kinds, _ = materialise(smaller.groupBy("key", "piece").agg(F.sum("copies").alias("copies"), F.first("p").alias("p"), F.first("body").alias("body")))
    if len(steps) == 1:
        found = _search(kinds, unit, search)
    else:
        hot, _ = materialise(kinds.groupBy("key").agg(F.sum(F.length("body")).alias("size")).filter(F.col("size") > unit.block * (6 if unit.words else 1)).select("key"))
        found = _search(kinds.join(hot, "key", "left_anti"), unit, search)
        if hot.limit(1).count():
            found = found.unionByName(_search_hot(kinds.join(hot, "key", "left_semi"), unit, search, steps[1:]))
    # One row for each smaller piece, however many ranges it has; they grow together again in the piece it is from.
    places = smaller.select("key", "piece", "up_key", "up_piece", "at").join(found, ["key", "piece"])
    return places.groupBy(F.col("up_key").alias("key"), F.col("up_piece").alias("piece")).agg(_merged(F.flatten(F.collect_list(_moved("ranges", "at")))).alias("ranges"))


def repeated_windows(docs: DataFrame, unit: Unit, search: Callable) -> DataFrame:
    """(th, tl, ranges): by text, the ranges [s, e) of window starts whose window also starts elsewhere in ``docs``."""
    spark, since = docs.sparkSession, mark()
    small_batches(spark)
    keyed = docs.select(*content_key(), "text")
    found, found_at = materialise(keyed.mapInArrow(_anchors(unit), "key long, piece long, th long, tl int, a int, n int, p int"))
    # Sums are written out before they are joined: then both sides of a join are dealt for it, and a hot key can be split.
    shared, shared_at = materialise(found.groupBy("key").agg(F.count("*").alias("rows"), F.min("piece").alias("lo"), F.max("piece").alias("hi")).filter("rows > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed")))
    cand, _ = materialise(found.join(shared, "key"))
    for path in (found_at, shared_at):
        discard(spark, path)

    kinds, kinds_at = materialise(cand.filter("mixed").groupBy("key", "piece").agg(F.count("*").alias("copies"), F.min(F.struct("th", "tl", "a", "n", "p")).alias("at")))
    hot, _ = materialise(kinds.groupBy("key").agg(F.sum(F.col("at.n") + unit.window - 1).alias("size")).filter(F.col("size") > unit.block).select("key", F.lit(True).alias("hot")))
    asked = (
        kinds.join(hot, "key", "left")
        .groupBy(F.col("at.th").alias("th"), F.col("at.tl").alias("tl"))
        .agg(F.collect_list(F.struct("key", "piece", "copies", F.coalesce("hot", F.lit(False)).alias("hot"), F.col("at.a").alias("a"), F.col("at.n").alias("n"), F.col("at.p").alias("p"))).alias("wanted"))
    )
    wanted, wanted_at = materialise(asked)
    cut, _ = materialise(keyed.join(wanted, ["th", "tl"]).mapInArrow(_cut(unit), "key long, piece long, copies long, hot boolean, p int, body binary"))
    for path in (kinds_at, wanted_at):
        discard(spark, path)
    ranges = _search(cut.filter("not hot"), unit, search)
    if hot.limit(1).count():
        ranges = ranges.unionByName(_search_hot(cut.filter("hot").dropDuplicates(["key", "piece"]), unit, search, [max(2, (unit.window - unit.anchor) // 8), 1]))

    ranges, _ = materialise(ranges)
    mixed = cand.filter("mixed").join(ranges, ["key", "piece"]).select("th", "tl", _moved("ranges", "a").alias("ranges"))
    plain = cand.filter("not mixed").select("th", "tl", F.array(F.struct(F.col("a").alias("s"), (F.col("a") + F.col("n")).alias("e"))).alias("ranges"))
    by_text, at = materialise(mixed.unionByName(plain).groupBy("th", "tl").agg(F.flatten(F.collect_set("ranges")).alias("ranges")))
    release(spark, since, at)
    return by_text


def _remove(unit: Unit) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for i, j, part, o in chunks(raw, off):
                ranges = batch.column("ranges").slice(i, j - i).to_pylist()
                _, start, end, first = tokens(unit, part, o)
                data = part.tobytes()
                n_units, n_removed, spans, kept = [], [], [], []
                for d in range(i, j):
                    f, n = int(first[d - i]), int(first[d - i + 1] - first[d - i])
                    gone: list[list[int]] = []
                    for s, e in sorted((r["s"], r["e"] - 1 + unit.window) for r in ranges[d - i] or ()):
                        if gone and s <= gone[-1][1]:
                            gone[-1][1] = max(gone[-1][1], e)
                        else:
                            gone.append([s, e])
                    left, at = [], 0
                    for s, e in [*gone, [n, n]]:
                        if at < s:
                            if unit.words:
                                left += [data[x:y] for x, y in zip(start[f + at : f + s].tolist(), end[f + at : f + s].tolist(), strict=True)]
                            else:
                                left.append(data[f + at : f + s])
                        at = e
                    n_units.append(n)
                    n_removed.append(sum(e - s for s, e in gone))
                    spans.append([{"s": s, "e": e} for s, e in gone])
                    kept.append((b" " if unit.words else b"").join(left))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(i, j - i), pa.array(n_units, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(spans, pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))), pa.array(kept, pa.binary())],
                    ["id", "n_units", "n_removed", "spans", "kept"],
                )

    return run


def remove_repeats(docs: DataFrame, unit: Unit, search: Callable, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_units, n_removed, spans array<struct<s,e>> (removed runs, in tokens), kept binary."""
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    ranges = repeated_windows(docs, unit, search)
    kind = docs.schema["id"].dataType.simpleString()
    return (
        docs.select("id", *content_key(), "text")
        .join(ranges, ["th", "tl"], "left")
        .select("id", "text", "ranges")
        .mapInArrow(_remove(unit), f"id {kind}, n_units long, n_removed long, spans array<struct<s:int,e:int>>, kept binary")
        .withColumnRenamed("id", id_col)
    )
