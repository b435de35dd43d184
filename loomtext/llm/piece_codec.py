"""SentencePiece encoding and decoding by shared-prefix Viterbi.

The distinct marked words of a batch are sorted, so that they form a trie in depth-first order: a word shares with its
predecessor the forward states of their common prefix, and only the rest of it is scored.  State ``i`` holds the best
way to reach character ``i``: its score (of a unigram model), its last piece and where that began.

For a unigram model the score of a path is the sum of its pieces' scores.  A BPE model ranks merges instead, and its
encoding is the one path on which every two neighbours are encoded side by side as themselves; such a path is unique
for every prefix, so the same forward pass finds it with that test as its transition rule.  A character that no piece
covers is spelled in byte pieces.

Cases: a null text is empty and has no ids; repeated rows encode alike; very long texts are cut into segments; ids may
be null; an empty table gives an empty result.  Decoding gives back the text, with the mark character read as a space
(as the library does); ``round_trip`` says whether it did.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import small_batches
from loomtext.llm.pieces import MARK, Vocabulary, default_path, vocabulary
from loomtext.llm.textkit import buffers

SHORT = (2, 1)  # sizes of pieces that any characters may end
HELD = 1 << 18  # words that a worker remembers, and as many that it may soon forget


class PieceCodec:
    def __init__(self, vocab: Vocabulary, unigram: bool = False) -> None:
        self.vocab, self.unigram = vocab, unigram
        self.known: dict[str, list[int]] = {}
        self.older: dict[str, list[int]] = {}
        self.raw = [bytes([int(p[3:5], 16)]) if vocab.model.is_byte(i) else p.replace(MARK, " ").encode() for i, p in enumerate(vocab.pieces)]
        # Pieces that can come out of an encoding at all, and by their last three characters how long they may be.
        self.good = {p: i for p, i in vocab.plain.items() if unigram or vocab.is_token(i)}
        sizes: dict[str, set[int]] = {}
        for p in self.good:
            if len(p) > 2:
                sizes.setdefault(p[-3:], {1, 2}).add(len(p))
        self.sizes = {end: tuple(sorted(s, reverse=True)) for end, s in sizes.items()}
        self.widths = np.array([len(x) for x in self.raw], np.int64)
        self.places = np.cumsum(self.widths) - self.widths
        self.bytes = np.frombuffer(b"".join(self.raw), np.uint8)
        self.score = [vocab.model.get_score(i) for i in range(len(vocab.pieces))]

    def _forward(self, word: str, begin: int, score: list[float], last: list[int], start: list[int]) -> None:
        """Extend the forward states of ``word`` from ``begin`` to its end: best score, last piece (-1: a character that
        is spelled in bytes, or nothing yet; -2: out of reach) and where it begins, for each prefix."""
        good, sizes, pair, unigram = self.good.get, self.sizes.get, self.vocab.pair.get, self.unigram
        add_score, add_last, add_start = score.append, last.append, start.append
        for i in range(begin + 1, len(word) + 1):
            best, piece, at = 0.0, -2, 0
            for size in sizes(word[i - 3 : i], SHORT) if i > 2 else SHORT:  # the longest first
                j = i - size
                if j < 0:
                    continue
                t = good(word[j:i])
                if t is None:
                    continue
                before = last[j]
                if before == -2:
                    continue
                if unigram:
                    value = score[j] + self.score[t]
                    if piece == -2 or value > best:
                        best, piece, at = value, t, j
                    continue
                if before >= 0:
                    fits = pair((before, t))
                    if fits is None:
                        fits = self.vocab.may_follow(before, t)
                    if not fits:
                        continue
                piece, at = t, j
                break
            if piece == -2 and word[i - 1] not in self.vocab.plain and last[i - 1] != -2:
                best, piece, at = score[i - 1] + (-1e6 if unigram else 0.0), -1, i - 1
            add_score(best)
            add_last(piece)
            add_start(at)

    def _path(self, word: str, last: list[int], start: list[int]) -> list[int]:
        ids: list[int] = []
        i = len(word)
        while i:
            t = last[i]
            if t == -2:  # a vocabulary whose merges are not local: the library decides
                return self.vocab.encode(word)
            ids += [t] if t >= 0 else [self.vocab.byte[b] for b in reversed(word[i - 1].encode("utf-8"))]
            i = start[i]
        return ids[::-1]

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words not yet known, depth first through their trie.  Words that come again stay remembered."""
        if len(self.known) > HELD:
            self.known, self.older = {}, self.known
        if len(self.vocab.pair) > 4 * HELD:
            self.vocab.pair.clear()
        score, last, start = [0.0], [-1], [0]
        before = ""
        known, forward, path = self.known, self._forward, self._path
        new = set(words) - known.keys()
        again = new & self.older.keys()
        known.update((w, self.older[w]) for w in again)
        for word in sorted(new - again):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del score[shared + 1 :], last[shared + 1 :], start[shared + 1 :]
            forward(word, shared, score, last, start)
            known[word] = path(word, last, start)
            before = word

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        cut = [self.vocab.segments(x or "") for x in texts]
        self.learn({s for c in cut for s in c})
        return [list(chain.from_iterable(map(self.known.__getitem__, c))) for c in cut]

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``; the space that stands for the first mark goes."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


@lru_cache(maxsize=2)
def codec(path: str) -> PieceCodec:
    return PieceCodec(vocabulary(path))


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for size[0] places, then the same of start[1], and so on."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)


def encode_column(c: PieceCodec, text: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    """(ids, their number, whether decoding gives the text back) of each text: a batch's distinct segments go through
    the trie, everything per segment or per token is array work."""
    text = pc.fill_null(text, "")
    if pc.any(pc.match_substring(text, MARK)).as_py():
        text = pc.replace_substring(text, MARK, " ")
    raw, off = buffers(pc.binary_join_element_wise(" ", text, ""))  # the model's own mark before each text
    full = np.diff(off) > 1
    starts = np.zeros(len(raw) + 1, bool)
    if c.vocab.cuts and len(raw):
        space, feed = raw == 32, raw == 10
        starts[1:-1] = (space[1:] & ~space[:-1]) | feed[1:] | feed[:-1]
    starts[off] = True
    at = np.flatnonzero(starts)
    segments = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).dictionary_encode()
    words = [w.decode("utf-8").replace(" ", MARK) for w in segments.dictionary.to_pylist()]
    c.learn(words)
    found = [c.known[w] for w in words]
    size = np.fromiter(map(len, found), np.int64, len(found))
    pool = np.fromiter(chain.from_iterable(found), np.int32, int(size.sum()))
    which = segments.indices.to_numpy()
    doc = np.searchsorted(off, at[:-1], "right") - 1
    which, doc = which[full[doc]], doc[full[doc]]  # an empty text has no mark either
    ids = pool[_spread((np.cumsum(size) - size)[which], size[which])]
    n = np.bincount(doc, weights=size[which], minlength=len(text)).astype(np.int64)
    ends = np.append(0, np.cumsum(n))
    # Decoding: the pieces' bytes one after the other, compared with the marked text.
    width = c.widths[ids]
    back = c.bytes[_spread(c.places[ids], width)]
    reach = np.append(0, np.cumsum(width))[ends]
    same = np.diff(reach) == np.where(full, np.diff(off), 0)
    if same.all() and np.array_equal(back, raw[np.repeat(full, np.diff(off))]):
        ok = same
    else:
        ok = np.array([bool(s) and np.array_equal(back[reach[i] : reach[i + 1]], raw[off[i] : off[i + 1]] if full[i] else raw[:0]) for i, s in enumerate(same)], bool)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids)), pa.array(n), pa.array(ok)


def _encode(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for batch in batches:
            _, off = buffers(batch.column("text"))
            at = 0
            while at < batch.num_rows:  # about 1 MB of text at a time
                end = min(max(int(np.searchsorted(off, off[at] + (1 << 20), "right")) - 1, at + 1), batch.num_rows)
                part = batch.slice(at, end - at)
                at = end
                made = encode_column(c, part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("row"), *made], schema=pa.schema([part.schema.field("row"), ("token_ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("round_trip", pa.bool_())]))

    return run


def encode(docs: DataFrame, path: str | None = None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (default: all), then token_ids, n_tokens, round_trip (those names are replaced)."""
    small_batches(docs.sparkSession)
    made = {"token_ids", "n_tokens", "round_trip"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in made]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    found = rows.mapInArrow(_encode(path or default_path()), f"row {kind}, token_ids array<int>, n_tokens long, round_trip boolean")
    return found.select("row.*", "token_ids", "n_tokens", "round_trip")


def op4_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
