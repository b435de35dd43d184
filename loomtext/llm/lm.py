"""Language-model scoring with a log-bilinear neural model trained by noise-contrastive estimation.

*Corpus pass.*  Texts are read once into blocks of about ``BLOCK_BYTES``: the distinct words of a block (64-bit hashes)
and every token as a number into them, with the block's training counts.  Counts are summed over the cluster, so all
training words count, however many there are; each block then gets the counts of its own words back.

*Units.*  The ``TOP`` most frequent words and the end mark are units by themselves; all other words share ``BUCKETS`` hash
units, inside which a word has its smoothed share ``(c + 1) / (C + V + 1)`` of the unit (one share is left for words
never seen).  Units are sorted by frequency into ``CLASSES`` classes, so a token's probability is that of its class, of
its unit in the class, and of the word in the unit; each factor is normalised, hence so is the product.

*Model.*  The two units before a token predict a vector, the sum of their vectors weighted by position; class and unit
scores are its products with target vectors, plus biases that start at the log frequencies.  Training is noise-contrastive
estimation with the noise taken in expectation over a whole class table instead of by draws, so nothing in it is
random.  It is synchronous: texts are dealt by content to ``ROUNDS`` rounds, in each round every task sums the gradient
of its texts, the sums are added up over the cluster, and one step (Adam) moves the model.  Each training token is used
once, and the result does not depend on how the input is partitioned, but for rounding.

Cases: a null or empty text has one token, its end; repeated rows are scored alike; a text without known words is
scored by the unseen shares; a null id is in no fold, so its text is
neither held out nor learned from; ties in frequency go to the lesser hash; an
empty table, or one without training texts, gives its rows with the scores of an untrained model; extra columns are not
read.  A task holds one block and one text at a time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomtext.llm.common import discard, materialise, partitions, small_batches
from loomtext.llm.langid import held_out
from loomtext.llm.textkit import LOWER, buffers, chunks, word_hashes, words

BLOCK_BYTES = 16 << 20
TOP, BUCKETS, CLASSES = 3071, 1024, 64
UNITS = TOP + 1 + BUCKETS
WIDE = UNITS // CLASSES
DIM, CONTEXT, NOISE, BATCH = 16, 2, 16, 32768
ROWS = 1024  # rows of scores at a time: they stay in the cache of a core
ROUNDS, RATE, BIAS_RATE = 36, 0.2, 0.01
KEEP_MEAN, KEEP_SQUARE = 0.85, 0.95
SLICES = 16
END = np.uint64(0x454E44)


# Corpus pass -------------------------------------------------------------------------------------------------------

def _blocks(id_type: pa.DataType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list = []
        held: list[bool] = []
        turns: list[int] = []
        hashes: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal number, size
            flat, lengths = np.concatenate(hashes), np.concatenate(sizes)
            vocab, idx = np.unique(flat, return_inverse=True)
            train = np.repeat(np.array(turns) >= 0, lengths)
            counts = np.bincount(idx[train], minlength=len(vocab))
            made = pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([ids], pa.list_(id_type)), pa.array([held], pa.list_(pa.bool_())), pa.array([turns], pa.list_(pa.int32())), pa.array([lengths.tolist()], pa.list_(pa.int64())), *(pa.array([x.tobytes()], pa.binary()) for x in (vocab, counts.astype(np.int64), idx.astype(np.int32)))],
                ["block", "ids", "held", "turns", "lengths", "vocab", "counts", "idx"],
            )
            number += 1
            size = 0
            for x in (ids, held, turns, hashes, sizes):
                x.clear()
            return made

        for batch in batches:
            raw, off = buffers(batch.column("text"))
            for i, j, part, o in chunks(raw, off):
                low = LOWER[part]
                start, end, first = words(low, o)
                n = np.diff(first)
                flat = np.empty(len(start) + len(n), np.uint64)  # each text's words, then its end
                flat[np.arange(len(start)) + np.repeat(np.arange(len(n)), n)] = word_hashes(low, start, end)
                flat[np.cumsum(n + 1) - 1] = END
                ids += batch.column("id").slice(i, j - i).to_pylist()
                held += batch.column("held").slice(i, j - i).to_pylist()
                turns += batch.column("turn").slice(i, j - i).to_pylist()
                hashes.append(flat)
                sizes.append(n + 1)
                size += len(part) + 64 * len(n)
                if size >= BLOCK_BYTES:
                    yield flush()
        if ids:
            yield flush()

    return run


def _vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            h = np.frombuffer(batch.column("vocab")[k].as_py(), np.int64)
            c = np.frombuffer(batch.column("counts")[k].as_py(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), batch.column("block")[k].as_py())), pa.array(np.arange(len(h), dtype=np.int32)), pa.array(h), pa.array(c)], ["block", "pos", "h", "c"])


# Model ---------------------------------------------------------------------------------------------------------------

class Lexicon:
    """Units of words, and their corpus frequencies; small, of fixed size, and sent to every task."""

    def __init__(self, top: list[tuple[int, int]], mass: np.ndarray, kinds: np.ndarray, total: int, distinct: int) -> None:
        self.total, self.distinct = total, distinct
        hashes = np.array([h for h, _ in top if np.uint64(h % 2**64) != END][:TOP], np.int64)
        known = dict(top)
        end = int(END)
        self.mass = mass.copy()
        self.kinds = kinds.copy()
        freq = np.ones(UNITS)
        freq[: len(hashes)] += [known[int(h)] for h in hashes]
        freq[TOP] += known.get(end, 0)
        for h in [*hashes.tolist(), *([end] if end in known else [])]:  # single units leave their buckets
            b = h % BUCKETS
            self.mass[b] -= known[h]
            self.kinds[b] -= 1
        freq[TOP + 1 :] += self.mass
        order = np.argsort(-freq, kind="stable")
        self.slot = np.empty(UNITS, np.int64)  # unit number -> place in the classes
        self.slot[order] = np.arange(UNITS)
        self.freq = freq[order]
        by = np.argsort(hashes)
        self.hashes, self.of = hashes[by], self.slot[np.arange(len(hashes))[by]]
        self.end = int(self.slot[TOP])

    def units(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(unit of each word hash, its bucket or -1)."""
        h = h.view(np.int64)
        bucket = h % BUCKETS
        unit = self.slot[TOP + 1 + bucket]
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            single = self.hashes[at] == h
            unit = np.where(single, self.of[at], unit)
            bucket = np.where(single, -1, bucket)
        is_end = h == np.int64(END)
        return np.where(is_end, self.end, unit), np.where(is_end, -1, bucket)


def start(freq: np.ndarray) -> dict[str, np.ndarray]:
    """The untrained model: frequencies as biases, small context vectors, targets at zero."""
    rng = np.random.default_rng(5)
    grid = freq.reshape(CLASSES, WIDE)
    return {
        "context": rng.normal(0, 0.3, (UNITS + 1, DIM)).astype(np.float32),
        "weight": np.full((CONTEXT, DIM), 1 / CONTEXT, np.float32),
        "classes": np.zeros((CLASSES, DIM), np.float32),
        "units": np.zeros((UNITS, DIM), np.float32),
        "class_bias": np.log(grid.sum(1) / grid.sum()).astype(np.float32),
        "unit_bias": np.log(grid / grid.sum(1, keepdims=True)).astype(np.float32).ravel(),
    }


def contexts(unit: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """(tokens, CONTEXT) units before each token, nearest first; UNITS stands for the start of a text."""
    out = np.full((len(unit), CONTEXT), UNITS, np.uint16)
    begin = np.cumsum(lengths) - lengths
    for k in range(CONTEXT):
        out[k + 1 :, k] = unit[: -k - 1]
        for j in range(k + 1):
            out[begin[lengths > j] + j, k] = UNITS
    return out


def _parts(lengths: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Whole texts, about 4 batches of tokens at a time: (first text, end text, first token, end token)."""
    ends = np.append(0, np.cumsum(lengths))
    i = 0
    while i < len(lengths):
        j = min(max(int(np.searchsorted(ends, ends[i] + 4 * BATCH, "right")) - 1, i + 1), len(lengths))
        yield i, j, int(ends[i]), int(ends[j])
        i = j


class Noise:
    """The noise: classes and units by frequency, ``NOISE`` of them to each true choice."""

    def __init__(self, freq: np.ndarray) -> None:
        grid = freq.reshape(CLASSES, WIDE)
        self.classes = (NOISE * grid.sum(1) / grid.sum()).astype(np.float32)
        self.units = (NOISE * grid / grid.sum(1, keepdims=True)).astype(np.float32)
        self.log_classes, self.log_units = np.log(self.classes), np.log(self.units)


def _ahead(p: dict[str, np.ndarray], before: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(predicted vectors, each followed by a 1 for the bias; the vectors of the units before)."""
    vectors = [np.take(p["context"], before[:, k], axis=0) for k in range(CONTEXT)]
    hat = np.ones((len(before), DIM + 1), np.float32)
    hat[:, :DIM] = sum(v * p["weight"][k] for k, v in enumerate(vectors))
    return hat, vectors


def _runs(cls: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(class, first row, end row) of sorted classes, at most ``ROWS`` rows at a time."""
    cuts = [0, *(np.flatnonzero(np.diff(cls)) + 1).tolist(), len(cls)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        for x in range(a, b, ROWS):
            yield int(cls[a]), x, min(x + ROWS, b)


def gradient(p: dict[str, np.ndarray], noise: Noise, unit: np.ndarray, before: np.ndarray, into: dict[str, np.ndarray]) -> None:
    """Add the gradient of one batch to ``into``: the true class, and unit in its class, are told from the noise, whose
    part is its expectation over the table.  Tokens are sorted by unit, so a class is a run of rows."""
    order = np.argsort(unit.astype(np.uint16), kind="stable")  # a radix sort
    unit, before, n = unit[order], before[order], len(unit)
    hat, vectors = _ahead(p, before)
    d_hat = np.empty((n, DIM), np.float32)
    cls, within, at = unit // WIDE, unit % WIDE, np.arange(ROWS)
    sums = {"class": np.zeros((CLASSES, DIM + 1)), "unit": np.zeros((UNITS, DIM + 1))}

    def against(names: tuple[str, str], table: slice, log_often: np.ndarray) -> np.ndarray:
        """Targets and biases for the products with ``hat`` that are the scores, negated."""
        return np.ascontiguousarray(-np.concatenate((p[names[0]][table], (p[names[1]][table] - log_often)[:, None]), 1).T)

    def contrast(x: int, y: int, choice: np.ndarray, negated: np.ndarray, target: np.ndarray, often: np.ndarray, total: np.ndarray) -> np.ndarray:
        g = hat[x:y] @ negated
        np.exp(g, out=g)
        g += 1
        true = at[: y - x], choice[x:y]
        missed = 1 - 1 / g[true]
        np.divide(often, g, out=g)  # what overflowed to infinity ends as 0, as it should
        g[true] -= missed
        total += g.T @ hat[x:y]
        return g @ target

    with np.errstate(over="ignore"):
        negated = against(("classes", "class_bias"), slice(None), noise.log_classes)
        for x in range(0, n, ROWS):
            y = min(x + ROWS, n)
            d_hat[x:y] = contrast(x, y, cls, negated, p["classes"], noise.classes, sums["class"])
        last = -1
        for c, x, y in _runs(cls):
            own = slice(c * WIDE, (c + 1) * WIDE)
            if c != last:
                negated, last = against(("units", "unit_bias"), own, noise.log_units[c]), c
            d_hat[x:y] += contrast(x, y, within, negated, p["units"][own], noise.units[c], sums["unit"][own])
    for target, bias, total in (("classes", "class_bias", sums["class"]), ("units", "unit_bias", sums["unit"])):
        into[target] += total[:, :DIM]
        into[bias] += total[:, DIM]
    for k, v in enumerate(vectors):
        into["weight"][k] += (d_hat * v).sum(0)
        moved, rows = np.ascontiguousarray((d_hat * p["weight"][k]).T), before[:, k].astype(np.intp)
        for j in range(DIM):
            into["context"][:, j] += np.bincount(rows, moved[j], UNITS + 1)


class Trainer:
    """The model and the state of Adam; lives on the driver, and has a fixed size."""

    def __init__(self, freq: np.ndarray) -> None:
        self.p, self.noise = start(freq), Noise(freq)
        self.mean = {k: np.zeros(v.shape) for k, v in self.p.items()}
        self.square = {k: np.zeros(v.shape) for k, v in self.p.items()}
        self.steps = 0

    def zero(self) -> dict[str, np.ndarray]:
        return {k: np.zeros(v.shape) for k, v in self.p.items()}

    def move(self, grads: dict[str, np.ndarray], tokens: int, slower: float = 1.0) -> None:
        self.steps += 1
        for k, g in grads.items():
            g = g / tokens
            self.mean[k] = KEEP_MEAN * self.mean[k] + (1 - KEEP_MEAN) * g
            self.square[k] = KEEP_SQUARE * self.square[k] + (1 - KEEP_SQUARE) * g * g
            mean, square = self.mean[k] / (1 - KEEP_MEAN**self.steps), self.square[k] / (1 - KEEP_SQUARE**self.steps)
            rate = slower * (BIAS_RATE if k.endswith("bias") else RATE)
            self.p[k] = (self.p[k] - rate * mean / (np.sqrt(square) + 1e-9)).astype(np.float32)

    def step(self, unit: np.ndarray, before: np.ndarray) -> None:
        grads = self.zero()
        gradient(self.p, self.noise, unit, before, grads)
        self.move(grads, len(unit))


def _chooser(p: dict[str, np.ndarray], target: str, bias: str, table: slice) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """(contexts, choices) -> log of each choice's share of the table.

    A score is a sum over the places of the context, so its exponential is a product of what the units there give: those
    factors are made once for each unit and place.  Where a product could leave the range, scores are made row by row.
    """
    parts = [(p["context"] * p["weight"][k]) @ p[target][table].T for k in range(CONTEXT)]
    parts[0] += p[bias][table]
    at = np.arange(ROWS)
    if sum(max(float(x.max()), -float(x.min())) for x in parts) < 80:
        factors = [np.exp(x, out=x) for x in parts]
        ones = np.ones(factors[0].shape[1], np.float32)

        def share(before: np.ndarray, choice: np.ndarray) -> np.ndarray:
            g = np.take(factors[0], before[:, 0], axis=0)
            for k in range(1, CONTEXT):
                g *= np.take(factors[k], before[:, k], axis=0)
            return np.log(g[at[: len(g)], choice].astype(np.float64) / (g @ ones))

        return share

    def plain(before: np.ndarray, choice: np.ndarray) -> np.ndarray:
        s = sum(np.take(parts[k], before[:, k], axis=0) for k in range(CONTEXT))
        true = s[at[: len(s)], choice]
        return true - _log_sum(s)

    return plain


def log_probabilities(p: dict[str, np.ndarray], unit: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Natural log of the probability of each unit after its context, normalised exactly; tokens are sorted by unit, so a
    class is a run of rows, and its factors are made once."""
    out = np.empty(len(unit))
    order = np.argsort(unit.astype(np.uint16), kind="stable")
    unit = unit[order]
    cls, within = unit // WIDE, unit % WIDE
    in_all, last = _chooser(p, "classes", "class_bias", slice(None)), -1
    for c, x, y in _runs(cls):
        if c != last:
            in_class, last = _chooser(p, "units", "unit_bias", slice(c * WIDE, (c + 1) * WIDE)), c
        rows = order[x:y]
        b = before[rows]
        out[rows] = in_all(b, cls[x:y]) + in_class(b, within[x:y])
    return out


def _log_sum(s: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials of each row; ``s`` is used up."""
    shift = s.max(1, keepdims=True)
    s -= shift
    return np.log(np.exp(s, out=s) @ np.ones(s.shape[1], s.dtype)) + shift[:, 0]


# Over the cluster ----------------------------------------------------------------------------------------------------

def _streams(lexicon: Lexicon) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks -> the units of the training texts of each round, two bytes a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                unit = lexicon.units(np.frombuffer(batch.column("vocab")[k].as_py(), np.uint64))[0].astype(np.uint16)[np.frombuffer(batch.column("idx")[k].as_py(), np.int32)]
                lengths = np.array(batch.column("lengths")[k].as_py())
                turn = np.array(batch.column("turns")[k].as_py())
                of_token = np.repeat(turn, lengths)
                for r in np.unique(turn[turn >= 0]).tolist():
                    yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([unit[of_token == r].tobytes()], pa.binary()), pa.array([lengths[turn == r].astype(np.int32).tobytes()], pa.binary())], ["turn", "units", "sizes"])

    return run


def _gradients(p: dict[str, np.ndarray], noise: Noise) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Streams of one round -> the gradient of a task's texts, flat and cut into ``SLICES``, and its tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grads, tokens = {k: np.zeros(v.shape) for k, v in p.items()}, 0
        for batch in batches:
            for k in range(batch.num_rows):
                unit = np.frombuffer(batch.column("units")[k].as_py(), np.uint16)
                lengths = np.frombuffer(batch.column("sizes")[k].as_py(), np.int32).astype(np.int64)
                for i, j, a, b in _parts(lengths):
                    before = contexts(unit[a:b], lengths[i:j])
                    for x in range(0, b - a, BATCH):
                        gradient(p, noise, unit[a + x : min(a + x + BATCH, b)], before[x : x + BATCH], grads)
                tokens += len(unit)
        if tokens:
            parts = np.array_split(np.concatenate([v.ravel() for v in grads.values()]), SLICES)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array(np.full(SLICES, tokens)), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "tokens", "g"])

    return run


def _summed(rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(g.as_py(), np.float64) for g in rows.column("g"))
    return pa.table({"slice": rows.column("slice").slice(0, 1), "tokens": pa.array([sum(rows.column("tokens").to_pylist())]), "g": pa.array([total.tobytes()], pa.binary())})


def train(streams: DataFrame, lexicon: Lexicon) -> dict[str, np.ndarray]:
    """One step for each round; a round without training texts is passed over."""
    t = Trainer(lexicon.freq)
    most = partitions(streams.sparkSession)
    tasks = min(most, max(64, most // 16))  # each task sends one gradient, whatever it has read
    schema = "slice int, tokens long, g binary"
    for r in range(ROUNDS):
        sums = streams.filter(F.col("turn") == r).select("units", "sizes").coalesce(tasks).mapInArrow(_gradients(t.p, t.noise), schema).groupby("slice").applyInArrow(_summed, schema)
        parts = {x["slice"]: x for x in sums.collect()}  # a model has a fixed size
        if not parts:
            continue
        flat = np.concatenate([np.frombuffer(parts[k]["g"], np.float64) for k in range(SLICES)])
        grads, at = {}, 0
        for k, v in t.p.items():
            grads[k] = flat[at : at + v.size].reshape(v.shape)
            at += v.size
        t.move(grads, parts[0]["tokens"], min(1.0, 2 * (1 - r / ROUNDS)))
    return t.p


def _score(lexicon: Lexicon, p: dict[str, np.ndarray], id_type: pa.DataType) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for k in range(left.num_rows):
            h = np.frombuffer(left.column("vocab")[k].as_py(), np.uint64)
            idx = np.frombuffer(left.column("idx")[k].as_py(), np.int32)
            lengths = np.array(left.column("lengths")[k].as_py())
            c = np.zeros(len(h), np.int64)
            c[right.column("pos").to_numpy()] = right.column("c").to_numpy()
            unit, bucket = lexicon.units(h)
            share = np.where(bucket < 0, 0.0, np.log10(c + 1.0) - np.log10(lexicon.mass[bucket] + lexicon.kinds[bucket] + 1.0))
            n = len(lengths)
            score, base, seen = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
            log_count = np.log10(c + 1.0)
            flat = unit.astype(np.uint16)[idx]
            chosen = log_probabilities(p, flat, contexts(flat, lengths))
            for i, j, a, b in _parts(lengths):
                at = np.cumsum(lengths[i:j]) - lengths[i:j]
                score[i:j] = np.add.reduceat(chosen[a:b] / np.log(10) + share[idx[a:b]], at)
                base[i:j] = np.add.reduceat(log_count[idx[a:b]], at)
                seen[i:j] = np.add.reduceat((c > 0)[idx[a:b]].astype(np.int64), at)
            out.append(
                pa.table(
                    {
                        "id": pa.array(left.column("ids")[k].as_py(), id_type),
                        "held_out": pa.array(left.column("held")[k].as_py(), pa.bool_()),
                        "n_tokens": pa.array(lengths),
                        "n_known": pa.array(seen),
                        "train_tokens": pa.array(np.full(n, lexicon.total, np.int64)),
                        "base_score": pa.array(base - lengths * np.log10(lexicon.total + lexicon.distinct + 1.0)),
                        "score": pa.array(score),
                    }
                )
            )
        return pa.concat_tables(out)

    return run


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, fold: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score (unigrams), score (the model): logs to base 10."""
    spark = docs.sparkSession
    small_batches(spark)
    text = F.col(text_col).cast("string")
    held = held_out(F.col(id_col), folds, fold)
    turn = F.when(held | F.col(id_col).isNull(), -1).otherwise(F.pmod(F.xxhash64(F.coalesce(text, F.lit(""))), F.lit(ROUNDS))).cast("int")
    rows = docs.select(F.col(id_col).alias("id"), held.alias("held"), turn.alias("turn"), text.alias("text"))
    kind = rows.schema["id"].dataType
    id_type = to_arrow_type(kind)
    blocks, _ = materialise(rows.mapInArrow(_blocks(id_type), f"block long, ids array<{kind.simpleString()}>, held array<boolean>, turns array<int>, lengths array<long>, vocab binary, counts binary, idx binary"))
    vocab = blocks.select("block", "vocab", "counts").mapInArrow(_vocabularies, "block long, pos int, h long, c long")
    counts, _ = materialise(vocab.filter("c > 0").groupBy("h").agg(F.sum("c").alias("c")))
    total, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = [(r["h"], r["c"]) for r in counts.orderBy(F.desc("c"), "h").limit(TOP + 1).collect()]
    top += [(r["h"], r["c"]) for r in counts.filter(F.col("h") == int(END)).collect() if (r["h"], r["c"]) not in top]
    mass, kinds = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in counts.groupBy(F.pmod("h", F.lit(BUCKETS)).alias("b")).agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        mass[r["b"]], kinds[r["b"]] = r["c"], r["n"]
    lexicon = Lexicon(top, mass, kinds, total, distinct)
    # Sorted by round, in small row groups: a round reads its own share of the files only.
    dealt = blocks.select("turns", "lengths", "vocab", "idx").mapInArrow(_streams(lexicon), "turn int, units binary, sizes binary")
    streams, streams_at = materialise(dealt.sortWithinPartitions("turn"), {"parquet.block.size": str(1 << 20)})
    p = train(streams, lexicon)
    discard(spark, streams_at)
    mine = vocab.select("block", "pos", "h").join(counts, "h").select("block", "pos", "c")
    schema = f"id {kind.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    found = blocks.select("block", "ids", "held", "lengths", "vocab", "idx").groupby("block").cogroup(mine.groupby("block")).applyInArrow(_score(lexicon, p, id_type), schema)
    return found.withColumnRenamed("id", id_col)


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
