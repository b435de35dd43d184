"""MinHash near-duplicates by an LSH forest.

A text's set is its distinct ``width``-word shingles (A-Z lower-cased; fewer words: the whole sequence).  Texts with
equal sets are one *node* (named by 128 bits of the set).  Each node has ``TREES`` orders of ``DEPTH`` min-hashes.

1. ``candidates``  in each order the nodes of the whole corpus are sorted, and a node's candidates are its ``NEAR`` next
                   neighbours that share at least the least depth: those with the longest common prefix, so the depth
                   adapts to how crowded a region is.  Candidates whose signatures rule a link out are dropped.
2. ``_turn``       twice, each node's most similar candidate outside its component is confirmed on the full sets, and
                   components are joined.  This settles most regions, and its order decides no result.
3. ``_regions``    what is left: regions (nodes of one order with one prefix of least depth) that lie in several
                   components.  A link between two components has at least one end outside the region's largest one, so
                   only those *outsiders* are compared with the region's nodes.  Regions of up to ``BLOCK`` nodes are one
                   block.  In larger ones two nodes meet only if they share one of their rarest shingles: by size of their
                   sets, a pair at the threshold has one in common among the first ``n - ceil(t n) + 1`` of the larger and
                   the first ``n - ceil(2 t / (1 + t) n) + 1`` of the smaller set (``rare_shingles``).  Nodes that meet are
                   compared by signature; those that may be linked then exactly, as a matrix product of the full sets, in
                   blocks that follow from who may be linked with whom.  A block returns no more links than join its
                   components.

The least depth is the greatest at which all orders miss a pair at the threshold with a chance of at most 1e-6; the
signature test misses one with at most 3e-7.  There is no other loss: no cap on neighbours, regions or links, and every
link is exact.  A node of a large region has a row for each of its rarest shingles that a node of another component has
as well.  Rows are therefore in proportion to nodes wherever texts of a region have more of their own than the
threshold leaves to a pair; where thousands of texts of other components lie just below the threshold, they meet in
blocks of ``MEETING`` nodes a side, and rows grow with outsiders times nodes over ``MEETING``.

The order of shingles comes from the texts of at most ``ORDER_SAMPLE`` nodes and holds ``ORDER_ENTRIES`` shingles at
most; any order gives the same links, a better one fewer rows.

Cases: a null, empty or blank text has no shingles and is linked with nothing; ties and repeated rows: equal sets are
one node whose least id counts; null ids are kept, but never chosen as a component's name; very long texts are
hashed whole; only id and text are read, so other columns may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import content_key, discard, mark, materialise, partitions, release, small_batches
from loomtext.llm.components import connected
from loomtext.llm.textkit import LOWER, buffers, chunks, mix, span_hashes, window_hashes, word_hashes, words

WIDTH, PERCENT = 5, 80
TREES, DEPTH, NEAR = 16, 8, 3
TURNS = 2
BLOCK, BLOCK_SHINGLES, MEETING = 512, 1 << 18, 2048
ORDER_SAMPLE, ORDER_ENTRIES = 4096, 1 << 20
COLUMNS = 2048
ROWS_A_TASK = 10_000
SECOND = np.uint64(0x6A09E667F3BCC909)
_DRAW = np.random.default_rng(71)
_XOR = _DRAW.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32)
_TIMES = _DRAW.integers(0, 2**32, TREES * DEPTH, dtype=np.uint32) | np.uint32(1)


def least_depth(percent: int) -> int:
    depth = DEPTH
    while depth > 1 and (1 - (percent / 100) ** depth) ** TREES > 1e-6:
        depth -= 1
    return depth


def shingles(raw: np.ndarray, off: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a chunk's documents, sorted within each, and their offsets."""
    raw = LOWER[raw]
    start, end, first = words(raw, off)
    codes = word_hashes(raw, start, end)
    size = np.diff(first)
    n = np.where(size >= width, size - width + 1, (size > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(size)), n)
    at = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    hashes = np.zeros(len(doc), np.uint64)
    whole = size[doc] >= width
    hashes[whole] = window_hashes(codes, width)[at[whole]]
    few = doc[~whole]
    hashes[~whole] = mix(span_hashes(codes, first[few], first[few + 1]) + size[few].astype(np.uint64))
    order = np.lexsort((hashes, doc))
    doc, hashes = doc[order], hashes[order]
    new = np.append(True, (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1]))[: len(doc)]
    doc, hashes = doc[new], hashes[new]
    return hashes, np.searchsorted(doc, np.arange(len(size) + 1))


def signatures(hashes: np.ndarray, off: np.ndarray) -> np.ndarray:
    """TREES * DEPTH min-hashes (uint32) of each document; all ones where it has no shingle."""
    out = np.full((len(off) - 1, TREES * DEPTH), 0xFFFFFFFF, np.uint32)
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    for i in range(len(off) - 1):
        for a in range(off[i], off[i + 1], 2048):
            part = low[a : min(a + 2048, off[i + 1]), None] ^ _XOR
            part *= _TIMES
            np.minimum(out[i], part.min(0), out=out[i])
    return out


def _sign(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts -> the 128-bit name (h, g) of each set, its size, its signature, and the low byte of each min-hash."""
    names = ["id", "th", "tl", "h", "g", "n", "sig", "bits"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for i, j, part, o in chunks(raw, off):
                hashes, s = shingles(part, o, width)
                n = np.diff(s)
                sig = signatures(hashes, s)
                name = [span_hashes(x, s[:-1], s[1:]) ^ mix(n.astype(np.uint64)) for x in (hashes, mix(hashes ^ SECOND))]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in ("id", "th", "tl")), *(pa.array(x.view(np.int64)) for x in name), pa.array(n), _rows_of(sig.astype(">u4")), _rows_of((sig & 0xFF).astype(np.uint8))], names
                )

    return run


def _rows_of(grid: np.ndarray) -> pa.Array:
    """Each row of ``grid`` as a binary value."""
    grid = np.ascontiguousarray(grid)
    width = grid.dtype.itemsize * grid.shape[1]
    return pa.BinaryArray.from_buffers(pa.binary(), len(grid), [None, pa.py_buffer(np.arange(len(grid) + 1, dtype=np.int32) * width), pa.py_buffer(grid)])


def _neighbours(depth: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted (tree, key, node) rows -> pairs of near neighbours in the order, with their common prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, trees, nodes = np.zeros((0, DEPTH), np.uint32), np.zeros(0, np.int32), np.zeros(0, np.int64)
        for batch in batches:
            old = len(nodes)
            new = buffers(batch.column("key"))[0].view(">u4").reshape(-1, DEPTH).astype(np.uint32)
            keys, trees, nodes = np.concatenate([keys, new]), np.append(trees, batch.column("tree").to_numpy()), np.append(nodes, batch.column("node").to_numpy())
            for step in range(1, NEAR + 1):
                i = np.arange(max(0, old - step), max(0, len(nodes) - step))
                same = (keys[i] == keys[i + step]) & (trees[i] == trees[i + step])[:, None]
                lcp = np.where(same.all(1), DEPTH, same.argmin(1))
                i, lcp = i[lcp >= depth], lcp[lcp >= depth]
                yield pa.RecordBatch.from_arrays([pa.array(nodes[i]), pa.array(nodes[i + step]), pa.array(lcp.astype(np.int32))], ["a", "b", "lcp"])
            keys, trees, nodes = keys[-NEAR:], trees[-NEAR:], nodes[-NEAR:]

    return run


def _least_alike(percent: int) -> float:
    """Equal min-hashes that a pair at the threshold has, but for a chance of 3e-7 (five standard deviations)."""
    total, share = TREES * DEPTH, percent / 100
    return total * share - 5 * (total * share * (1 - share)) ** 0.5


def _alike(least: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (buffers(batch.column(c))[0].reshape(-1, TREES * DEPTH) for c in ("bits_a", "bits_b"))
            alike = np.count_nonzero(x == y, axis=1)
            ok = pa.array(alike >= least)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(alike.astype(np.int32))], ["a", "b", "alike"]).filter(ok)

    return run


def candidates(nodes: DataFrame, depth: int, percent: int) -> DataFrame:
    """nodes(node, sig, bits) -> pairs a < b that are neighbours in an order, with their number of equal min-hashes."""
    spark = nodes.sparkSession
    count = nodes.count() * TREES
    tasks = max(1, min(partitions(spark), count // ROWS_A_TASK + 1))
    width = 4 * DEPTH
    forest = nodes.select("node", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", t * width + 1, F.lit(width)))).alias("tree", "key"))
    order = ["tree", "key", "node"]
    found = forest.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_neighbours(depth), "a long, b long, lcp int")
    pairs = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    bits = [nodes.select(F.col("node").alias(x), F.col("bits").alias(f"bits_{x}")) for x in "ab"]
    return pairs.join(bits[0], "a").join(bits[1], "b").select("a", "b", "bits_a", "bits_b").mapInArrow(_alike(_least_alike(percent)), "a long, b long, alike int")


def _sets(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts -> their sorted shingle hashes; copies that follow each other come once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            node = batch.column("node").to_numpy()
            fresh = np.append(True, node[1:] != node[:-1])
            fresh[0] = not len(node) or node[0] != last
            last = node[-1] if len(node) else last
            batch = batch.filter(pa.array(fresh[: len(node)]))
            node = batch.column("node")
            raw, off = buffers(batch.column("text"))
            for i, j, part, o in chunks(raw, off):
                hashes, s = shingles(part, o, width)
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, pa.py_buffer(8 * s.astype(np.int64)), pa.py_buffer(hashes)])
                yield pa.RecordBatch.from_arrays([node.slice(i, j - i), sets.cast(pa.binary())], ["node", "shingles"])

    return run


def sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """wanted(node, th, tl) -> (node, shingles): the full set of each, once."""
    found = docs.select(*content_key(), "text").join(wanted, ["th", "tl"]).select("node", "text").mapInArrow(_sets(width), "node long, shingles binary")
    return found.groupBy("node").agg(F.first("shingles").alias("shingles"))


def _confirm(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            (x, ox), (y, oy) = (buffers(batch.column(c)) for c in ("set_a", "set_b"))
            x, ox, y, oy = x.view(np.uint64), ox // 8, y.view(np.uint64), oy // 8
            good = np.zeros(batch.num_rows, bool)
            for k in range(batch.num_rows):
                a, b = x[ox[k] : ox[k + 1]], y[oy[k] : oy[k + 1]]
                both = np.count_nonzero(b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a)
                good[k] = both > 0 and 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("u"), batch.column("v"), pa.array(good)], ["a", "b", "u", "v", "linked"])

    return run


def _labelled(df: DataFrame, labels: DataFrame, node: str, label: str) -> DataFrame:
    """``df`` with the label of each ``node``: that in ``labels``, else the node itself."""
    of = labels.select(F.col("u").alias(node), F.col("v").alias(label))
    return df.join(of, node, "left").withColumn(label, F.coalesce(label, node))


def _merged(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """``labels`` (node u, its label v) after joining the labels that ``edges`` (u, v) link."""
    moved = connected(edges)
    old = labels.join(moved.select(F.col("r").alias("v"), "root"), "v", "left").select("u", F.coalesce("root", "v").alias("v"))
    return materialise(old.unionByName(moved.filter("r <> root").select(F.col("r").alias("u"), F.col("root").alias("v"))))[0]


def _turn(cand: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(candidates that are still to be tried, labels): each node's most similar candidate elsewhere is confirmed."""
    live = _labelled(_labelled(cand, labels, "a", "u"), labels, "b", "v").filter("u <> v").select("a", "b", "alike", "u", "v")
    best = [live.groupBy(x).agg(F.max(F.struct("alike", y, "u", "v")).alias("m")).select(F.least(x, f"m.{y}").alias("a"), F.greatest(x, f"m.{y}").alias("b"), "m.u", "m.v") for x, y in ("ab", "ba")]
    picked = best[0].unionByName(best[1]).dropDuplicates(["a", "b"])
    sides = [sets.select(F.col("node").alias(x), F.col("shingles").alias(f"set_{x}")) for x in "ab"]
    tried, _ = materialise(picked.join(sides[0], "a").join(sides[1], "b").mapInArrow(_confirm(percent), "a long, b long, u long, v long, linked boolean"))
    return cand.join(tried.select("a", "b"), ["a", "b"], "left_anti"), _merged(labels, tried.filter("linked").select("u", "v"))


# Regions in several components -----------------------------------------------------------------------------------------

def _grid(rows: DataFrame, weight: Column, block: int) -> DataFrame:
    """Deal the rows of each ``main`` to blocks: outsiders (``q``) of block i meet nodes (``m``) of block j.

    A block has about ``block`` rows of a side, or ``BLOCK_SHINGLES`` of ``weight`` where that is less.
    """

    def blocks(count: Column, total: Column) -> Column:
        return F.greatest(F.ceil(count / block), F.ceil(total / BLOCK_SHINGLES), F.lit(1)).cast("int")

    out = F.col("outside").cast("int")
    # Written out: the join then deals both sides, and a main label with very many rows can be split.
    sizes, _ = materialise(rows.groupBy("main").agg(blocks(F.sum(out), F.sum(out * weight)).alias("gi"), blocks(F.count("*"), F.sum(weight)).alias("gj")))
    dealt = rows.join(sizes, "main").withColumns({"bi": F.pmod(F.hash("node"), "gi"), "bj": F.pmod(F.hash("node", F.lit(1)), "gj")})

    def role(i: Column, j: Column, q: bool, m: bool) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), F.lit(q).alias("q"), F.lit(m).alias("m"))

    one = F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j"), F.col("outside").alias("q"), F.lit(True).alias("m")))
    as_member = F.transform(F.sequence(F.lit(0), F.col("gi") - 1), lambda i: role(i, F.col("bj"), False, True))
    as_outsider = F.transform(F.sequence(F.lit(0), F.col("gj") - 1), lambda j: role(F.col("bi"), j, True, False))
    many = F.when(F.col("outside"), F.concat(as_member, as_outsider)).otherwise(as_member)
    roles = F.when((F.col("gi") == 1) & (F.col("gj") == 1), one).otherwise(many)
    return dealt.select(*rows.columns, F.inline(roles))


def _by_block(work: Callable[[pa.Table], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by (main, i, j): ``work`` gets the rows of one block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            key = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("main", "i", "j")])
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if held and last != key[:, a].tolist():
                    if (made := work(pa.Table.from_batches(held))) is not None:
                        yield made
                    held = []
                held.append(batch.slice(a, b - a))
                last = key[:, a].tolist()
        if held and (made := work(pa.Table.from_batches(held))) is not None:
            yield made

    return run


def _sides(rows: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(outsiders, members, labels) of a block: row numbers, and the label of each row."""
    q, m = (np.flatnonzero(rows.column(c).to_numpy()) for c in "qm")
    return q, m, rows.column("label").to_numpy()


def _possible(least: float, percent: int, edges: bool) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Of a block's rows, those that by signature and size may have a link to another component; with ``edges``, pairs of
    nodes instead, as many as join what may be linked."""

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        q, m, label = _sides(rows)
        if not len(q) or not len(m):
            return None
        bits, n = buffers(rows.column("bits"))[0].reshape(-1, TREES * DEPTH), rows.column("n").to_numpy()
        theirs, live, step = bits[m], np.zeros(len(bits), bool), max(1, (1 << 16) // len(m))
        node, found = rows.column("node").to_numpy(), []
        for k in range(0, len(q), step):
            some = q[k : k + step]
            small, large = np.minimum(n[some][:, None], n[m][None]), np.maximum(n[some][:, None], n[m][None])
            may = (label[some][:, None] != label[m][None]) & (100 * small >= percent * large)
            if not may.any():
                continue
            hit = may & (np.count_nonzero(bits[some][:, None] == theirs[None], axis=2) >= least)
            live[some] |= hit.any(1)
            live[m] |= hit.any(0)
            if edges and hit.any():
                x, y = np.nonzero(hit)
                found.append(spanning(node[some[x]], node[m[y]]))
        if not live.any():
            return None
        if edges:
            a, b = spanning(*(np.concatenate(x) for x in zip(*found, strict=True)))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["u", "v"])
        return rows.select(["main", "node", "label", "outside", "n"]).filter(pa.array(live)).combine_chunks().to_batches()[0]

    return work


def prefixes(n: int, percent: int) -> tuple[int, int]:
    """How many of its rarest shingles a set of n must look at: to find smaller sets, and to be found by larger ones."""
    return n - -(-percent * n // 100) + 1, n - -(-2 * percent * n // (100 + percent)) + 1


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets -> (shingle, count) of those held in each batch."""
    for batch in batches:
        values, counts = np.unique(buffers(batch.column("shingles"))[0].view(np.int64), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(counts.astype(np.int64))], ["shingle", "k"])


def shingle_order(nodes: DataFrame, sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(shingles, counts), by shingle: those that several of a bounded sample of nodes have; all others come before them."""
    some = nodes.select("node").distinct().orderBy(F.xxhash64("node")).limit(ORDER_SAMPLE)
    counts = sets.join(some, "node").select("shingles").mapInArrow(_common, "shingle long, k long").groupBy("shingle").agg(F.sum("k").alias("k")).filter("k > 1")
    held = counts.orderBy(F.desc("k"), "shingle").limit(ORDER_ENTRIES).toPandas()
    shingle, k = held["shingle"].to_numpy(np.int64), held["k"].to_numpy(np.int64)
    order = np.argsort(shingle)
    return shingle[order], k[order]


def rare_shingles(percent: int, known: np.ndarray, counts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(main, node, label, outside, n, shingles) -> a row for each of the rarest shingles that decide (``index``: a larger
    set finds it there)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["main", "node", "label", "outside", "n"]
        for batch in batches:
            flat, off = buffers(batch.column("shingles"))
            flat, off = flat.view(np.int64), off // 8
            often = np.zeros(len(flat), np.int64)
            if len(known):
                at = np.minimum(np.searchsorted(known, flat), len(known) - 1)
                often = np.where(known[at] == flat, counts[at], 0)
            row = np.repeat(np.arange(len(off) - 1), np.diff(off))
            order = np.lexsort((flat, often, row))
            place = np.arange(len(flat)) - off[row]
            limits = np.array([prefixes(int(n), percent) for n in np.diff(off)]).reshape(-1, 2)
            kept = place < limits[row, 0]
            shingle, index = flat[order][kept], (place < limits[row, 1])[kept]
            at = pa.array(row[kept])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in names), pa.array(shingle), pa.array(index)], [*names, "shingle", "index"])

    return run


def meetings(big: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """big(main, node, label, outside, n) -> (main, node, label, outside, n): a row for each rare shingle of a node that a
    node of another component in its region has too; ``main`` names region and shingle."""
    known, counts = shingle_order(big, sets)
    rows, _ = materialise(big.join(sets, "node").select("main", "node", "label", "outside", "n", "shingles").mapInArrow(rare_shingles(percent, known, counts), "main long, node long, label long, outside boolean, n long, shingle long, index boolean"))
    # Where nobody may be found, or all are of one component, nothing is to be compared.
    shared = rows.groupBy("main", "shingle").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.max("index").alias("index")).filter("low < high and index")
    return rows.drop("index").join(shared.select("main", "shingle"), ["main", "shingle"]).select(F.xxhash64("main", "shingle").alias("main"), "node", "label", "outside", "n")


def spanning(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the edges (u, v), as many as join what all of them join: a forest."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(ids))
    out: list[tuple[np.ndarray, np.ndarray]] = [(a[:0], b[:0])]
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low != high
        if not apart.any():
            break
        a, b, low, high = a[apart], b[apart], low[apart], high[apart]
        order = np.lexsort((low, high))
        first = order[np.append(True, high[order][1:] != high[order][:-1])]
        out.append((a[first], b[first]))
        up = np.arange(len(ids))
        up[high[first]] = low[first]
        while (up[up] != up).any():
            up = up[up]
        root = up[root]
    return ids[np.concatenate([x for x, _ in out])], ids[np.concatenate([y for _, y in out])]


def overlaps(sets: list[np.ndarray], q: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets ``q`` with the sets ``m``: a product of 0/1 matrices, ``COLUMNS`` at a time."""
    size = np.array([len(x) for x in sets])
    ids = np.unique(np.concatenate(sets), return_inverse=True)[1]
    row = np.repeat(np.arange(len(sets)), size)
    known = np.zeros((2, ids.max() + 1), bool)
    for side, chosen in enumerate((q, m)):
        picked = np.zeros(len(sets), bool)
        picked[chosen] = True
        known[side, ids[picked[row]]] = True
    shared = known.all(0)  # an element that one side lacks adds nothing
    keep = shared[ids]
    ids, row = (np.cumsum(shared) - 1)[ids[keep]], row[keep]
    order = np.argsort(ids, kind="stable")
    ids, row = ids[order], row[order]
    place = np.full((2, len(sets)), -1)
    place[0, q], place[1, m] = np.arange(len(q)), np.arange(len(m))
    total = np.zeros((len(q), len(m)), np.float32)
    for c in range(0, int(shared.sum()), COLUMNS):
        part = slice(*np.searchsorted(ids, [c, c + COLUMNS]))
        grids = []
        for side, count in enumerate((len(q), len(m))):
            at = place[side, row[part]]
            grid = np.zeros((count, COLUMNS), np.float32)
            grid[at[at >= 0], ids[part][at >= 0] - c] = 1
            grids.append(grid)
        total += grids[0] @ grids[1].T
    return total


def _links(percent: int) -> Callable[[pa.Table], pa.RecordBatch | None]:
    """Links (u, v) between the components of a block, found on the full sets; no more than join them."""

    def work(rows: pa.Table) -> pa.RecordBatch | None:
        q, m, label = _sides(rows)
        if not len(q) or not len(m):
            return None
        flat, off = buffers(rows.column("shingles"))
        flat = flat.view(np.uint64)
        sets = [flat[a // 8 : b // 8] for a, b in zip(off[:-1], off[1:], strict=True)]
        size = np.array([len(x) for x in sets])
        both = overlaps(sets, q, m)
        x, y = np.nonzero((both > 0) & (label[q][:, None] != label[m][None]))
        n = both[x, y].astype(np.int64)
        linked = 100 * n >= percent * (size[q[x]] + size[m[y]] - n)
        x, y = x[linked], y[linked]
        u, v = spanning(label[q][x], label[m][y])
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"]) if len(u) else None

    return work


def _regions(docs: DataFrame, nodes: DataFrame, labels: DataFrame, sets: DataFrame, depth: int, width: int, percent: int) -> DataFrame:
    """Links (u, v) between labels, of all regions that lie in several components."""
    spark = docs.sparkSession
    region = F.xxhash64(F.col("tree"), F.substring("sig", F.col("tree") * 4 * DEPTH + 1, F.lit(4 * depth)))
    labelled = _labelled(nodes.select("node", "n", "sig"), labels, "node", "label")
    forest = labelled.select("node", "label", "n", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree")).select(region.alias("region"), "node", "label", "n")
    # The label with most nodes is a region's main one; all regions with one main label are compared as one.
    sizes = forest.groupBy("region", "label").agg(F.count("*").alias("k")).groupBy("region").agg(F.count("*").alias("kinds"), F.max(F.struct("k", "label")).alias("top"))
    mixed = sizes.filter("kinds > 1").select("region", F.col("top.label").alias("main"))
    group, group_at = materialise(forest.join(mixed, "region").groupBy("main", "node").agg(F.first("label").alias("label"), F.first("n").alias("n")).withColumn("outside", F.col("label") != F.col("main")))
    many, _ = materialise(group.groupBy("main").agg(F.count("*").alias("k")).filter(F.col("k") > BLOCK).select("main"))
    bits, least = nodes.select("node", "bits"), _least_alike(percent)

    def blocks(rows: DataFrame, extra: DataFrame, weight: Column, block: int) -> DataFrame:
        key = ["main", "i", "j"]
        return _grid(rows, weight, block).join(extra, "node").repartition(partitions(spark), *key).sortWithinPartitions(*key)

    def with_sets(wanted: DataFrame, known: DataFrame) -> DataFrame:
        """The full sets of wanted(node): those that are known, and the others made from their texts."""
        missing, _ = materialise(wanted.join(known.select("node"), "node", "left_anti").join(nodes.select("node", "at.th", "at.tl"), "node"))
        if not missing.limit(1).count():
            return known
        return materialise(known.join(wanted, "node", "left_semi").unionByName(sets_of(docs, missing, width)))[0]

    fields = "main long, node long, label long, outside boolean, n long"
    small = group.join(many, "main", "left_anti").select("main", "node", "label", "outside", "n")
    live = blocks(small, bits, F.lit(0), BLOCK).mapInArrow(_by_block(_possible(least, percent, False)), fields).distinct()
    if many.limit(1).count():
        big, _ = materialise(group.join(many, "main", "left_semi").select("main", "node", "label", "outside", "n"))
        sets = with_sets(big.select("node").distinct(), sets)
        met = blocks(meetings(big, sets, percent), bits, F.lit(0), MEETING)
        pairs, _ = materialise(met.mapInArrow(_by_block(_possible(least, percent, True)), "u long, v long"))
        # Who may be linked with whom, directly or through others, is compared together.
        cluster = connected(pairs).select(F.col("r").alias("node"), F.col("root").alias("main"))
        placed, _ = materialise(big.groupBy("node").agg(F.first("label").alias("label"), F.first("n").alias("n")).join(cluster, "node"))
        top = placed.groupBy("main", "label").agg(F.count("*").alias("k")).groupBy("main").agg(F.max(F.struct("k", "label")).alias("top")).select("main", F.col("top.label").alias("most"))
        live = live.unionByName(placed.join(top, "main").select("main", "node", "label", (F.col("label") != F.col("most")).alias("outside"), "n"))
    live, live_at = materialise(live)
    discard(spark, group_at)
    sets = with_sets(live.select("node").distinct(), sets)
    links, _ = materialise(blocks(live, sets, F.col("n"), BLOCK).mapInArrow(_by_block(_links(percent)), "u long, v long"))
    discard(spark, live_at)
    return links


def near_duplicates(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, th, tl, n_shingles, component_id (least id reachable), kept, group (names the component; null without words):
    one row for each row of ``docs``."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, since = docs.schema["id"].dataType.simpleString(), mark()
    rows, rows_at = materialise(docs.select("id", *content_key(), "text").mapInArrow(_sign(width), f"id {kind}, th long, tl int, h long, g long, n long, sig binary, bits binary"))
    made = rows.filter("n > 0").groupBy("h", "g").agg(F.min("id").alias("least"), F.min(F.struct("th", "tl")).alias("at"), F.first("n").alias("n"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    nodes, nodes_at = materialise(made.withColumn("node", F.monotonically_increasing_id()))  # written once, so a name stays
    depth = least_depth(percent)
    cand, _ = materialise(candidates(nodes, depth, percent))
    wanted = cand.select(F.col("a").alias("node")).unionByName(cand.select(F.col("b").alias("node"))).distinct()
    sets, _ = materialise(sets_of(docs, wanted.join(nodes, "node").select("node", "at.th", "at.tl"), width))
    labels = spark.createDataFrame([], "u long, v long")
    left = cand
    for _ in range(TURNS):
        left, labels = _turn(left, sets, labels, percent)
    labels, labels_at = materialise(_merged(labels, _regions(docs, nodes, labels, sets, depth, width, percent)))
    release(spark, since, rows_at, nodes_at, labels_at)

    named = _labelled(nodes.select("node", "h", "g", "least"), labels, "node", "root")
    roots = named.groupBy("root").agg(F.min("least").alias("component"))
    of_node = named.join(roots, "root").select("h", "g", "root", "component")
    out = rows.select("id", "th", "tl", "n", "h", "g").join(of_node, ["h", "g"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "th", "tl", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"), F.when(F.col("n") > 0, F.col("root")).alias("group"))


def keep_one(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row of ``docs`` (as it is) for each group of near-duplicates, that of the least id, then text hash; texts
    without words all stay.  Groups are told by their links, so texts that share an id, or have none, stay apart."""
    found = near_duplicates(docs, width, percent)
    kept = found.filter("n_shingles > 0").groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th", "tl")).alias("k")).select("k.doc_id", "k.th", "k.tl")
    keep = kept.select(F.col("doc_id").alias("keep_id"), F.col("th").alias("keep_th"), F.col("tl").alias("keep_tl")).distinct()
    tagged = docs.select(F.struct("*").alias("row"), F.col("doc_id").alias("row_id"), F.length(F.translate(F.coalesce("text", F.lit("")), " \t\n\x0b\f\r", "")).alias("solid"), *content_key())
    left = tagged.filter("solid > 0").join(keep, (F.col("row_id").eqNullSafe(F.col("keep_id"))) & (F.col("th") == F.col("keep_th")) & (F.col("tl") == F.col("keep_tl")), "left_semi")
    return left.dropDuplicates(["row_id", "th", "tl"]).select("row.*").unionByName(tagged.filter("solid = 0").select("row.*"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", "kept")
