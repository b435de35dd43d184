r"""Secret scans through nested encodings.

Each text is searched for three kinds of secrets.  A worklist then holds *layers*: the text itself, and every text
unwrapped from a part of a layer (URL escapes, Unicode and hex escapes, base64, and gzip, zlib or zstandard data inside
base64).  Each new layer is searched too and unwrapped again, until none is left; a layer whose content was seen before
at the same place of the original is not opened again, which ends cycles.  Every character of a layer carries the range of the original
text it came from, so spans always point into the original, in code points, end exclusive.

Base64 is read line by line, also with its lines joined where it is wrapped (by line ends or by ``\n`` and ``\r`` written
out), and also where other characters are glued to it; what it holds may be UTF-8 or UTF-16.  Compressed data that is
glued to other characters is tried on its first bytes before all of it is read, so each place costs a bounded look.  A URL escape that is no UTF-8 stays as it is; those around it are decoded.  Compressed data is read to its end,
over all its members and frames.  It is decoded and searched in pieces of about ``PIECE`` characters; a piece ends only
behind a character that is part of no match and of no encoding, so pieces find what the whole would.  Memory is that of
a piece, or of the longest stretch without such a character; time grows with the content.

Cases: a null text is empty and has no spans; an empty table gives an empty result; repeated rows are scanned alike;
texts are scanned whole; a part that does not decode, or not to text, is no layer; compressed data that breaks off or is
damaged is read up to there, and ``truncated`` counts such layers.  Columns other than id and text are kept only where a
caller asks for them.
"""

from __future__ import annotations

import base64
import binascii
import codecs
import hashlib
import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtext.llm.common import small_batches

KINDS = ("assign", "access", "hex")
PIECE = 4 << 20
LOOK = 64  # bytes of what may be compressed that are tried first


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile("(" + "|".join(map(_either, ("password", "passwd", "secret", "token"))) + "|" + _either("api") + "_?" + _either("key") + ")[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")  # a longer run starts earlier, so 18 characters can be asked for at once
_HEX = re.compile(r"[0-9a-f]{16,}")
_HEX2, _TAIL = "[0-9A-Fa-f]", "%[89ABab][0-9A-Fa-f]"
# The escapes of one character each, so that characters keep their places; bytes that are no UTF-8 stay as they are.
_URL = re.compile(f"%[0-7]{_HEX2}|%[CcDd]{_HEX2}{_TAIL}|%[Ee]{_HEX2}(?:{_TAIL}){{2}}|%[Ff][0-4](?:{_TAIL}){{3}}")
_UNICODE = re.compile(r"\\u[Dd][89ABab][0-9A-Fa-f]{2}\\u[Dd][C-Fc-f][0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\x[0-9A-Fa-f]{2}|\\U[0-9A-Fa-f]{8}")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
_LINES = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]++(?:(?:\r\n?|\n|\\r\\n|\\n|\\r)[ \t]*+[A-Za-z0-9+/_-]++)++={0,2}")
_RUN = re.compile(r"(?:\r\n?|\n|\\[rn])[ \t]*+|([A-Za-z0-9+/_-]+={0,2})")
_UNTIL_BREAK = re.compile(r".*[^A-Za-z0-9+/_.=\-\"' :%\\\r\n\t]", re.DOTALL)  # its last character ends all matches and encodings
_MAGIC = re.compile(r"H4sI|KLUv|(?<=[+/_-])eJ")  # gzip, zstandard and (behind what it is glued to) zlib in base64
_TEXT = re.compile(rb"(?:[\t\n\r\x20-\x7e]|[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}){12,}")  # no secret is shorter
_PLAIN = re.compile(r"[^\x00-\x08\x0e-\x1f\x7f�]*\Z")

Span = tuple[str, int, int]


def matches(text: str) -> list[Span]:
    """Spans of all kinds in one layer, leftmost and without overlaps within a kind."""
    found: list[Span] = []
    if ":" in text or "=" in text:
        found += [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A text with, for each character, where it stands in the original: ``lo[i]`` to ``hi[i]``.

    None: as it is; two numbers instead of arrays: all characters have that one place.
    """

    __slots__ = ("hi", "lo", "text")

    def __init__(self, text: str, lo: array | int | None = None, hi: array | int | None = None) -> None:
        self.text, self.lo, self.hi = text, lo, hi

    def place(self, start: int, end: int) -> tuple[int, int]:
        if self.lo is None:
            return start, end
        if isinstance(self.lo, int):
            return self.lo, self.hi
        return min(self.lo[start:end]), max(self.hi[start:end])

    def key(self) -> bytes:
        """Equal for layers of one content at one place."""
        made = hashlib.sha256(self.text.encode("utf-8", "surrogatepass"))
        for places in (self.lo, self.hi):
            made.update(b"|" + (places.tobytes() if isinstance(places, array) else str(places).encode()))
        return made.digest()


def _utf16(data: bytes) -> str | None:
    """The text of ``data`` that is UTF-16, as far as its zero bytes or its mark tell."""
    if len(data) % 2 or len(data) < 2:
        return None
    zeros = [data[k::2].count(0) for k in (0, 1)]
    order = "utf-16-le" if data[:2] == b"\xff\xfe" or 4 * zeros[1] > 3 * (len(data) // 2) else "utf-16-be" if data[:2] == b"\xfe\xff" or 4 * zeros[0] > 3 * (len(data) // 2) else None
    try:
        return data.decode(order) if order else None
    except UnicodeDecodeError:
        return None


def _from_bytes(data: bytes, origin: Callable[[int], tuple[int, int]]) -> Layer | None:
    """A layer of ``data``, UTF-8 or UTF-16; ``origin`` gives the place of each byte."""
    try:
        text, wide = data.decode("utf-8"), False
    except UnicodeDecodeError:
        text, wide = None, False
    if text is None or "\0" in text:
        text, wide = _utf16(data), True
    if not text or not _PLAIN.match(text):
        return None
    lo, hi, at = array("q"), array("q"), 0
    for c in text:
        n = (2 if c < "\U00010000" else 4) if wide else 1 if c < "\x80" else len(c.encode("utf-8"))
        lo.append(origin(at)[0])
        hi.append(origin(at + n - 1)[1])
        at += n
    return Layer(text, lo, hi)


def _substituted(layer: Layer, pattern: re.Pattern, value: Callable[[str], str | None]) -> Layer | None:
    """The layer with each match of ``pattern`` replaced by its value; None if nothing changes."""
    text, out, lo, hi, at, changed = layer.text, [], array("q"), array("q"), 0, False
    if isinstance(layer.lo, int):
        made = pattern.sub(lambda m: m[0] if (new := value(m[0])) is None else new, text)
        return Layer(made, layer.lo, layer.hi) if made != text else None
    for m in pattern.finditer(text):
        new = value(m[0])
        if new is None:
            continue
        changed = True
        for i in range(at, m.start()):
            a, b = layer.place(i, i + 1)
            lo.append(a)
            hi.append(b)
        out += [text[at : m.start()], new]
        a, b = layer.place(m.start(), m.end())
        lo += array("q", [a]) * len(new)
        hi += array("q", [b]) * len(new)
        at = m.end()
    if not changed:
        return None
    for i in range(at, len(text)):
        a, b = layer.place(i, i + 1)
        lo.append(a)
        hi.append(b)
    return Layer("".join([*out, text[at:]]), lo, hi)


def _url(part: str) -> str | None:
    try:
        return bytes.fromhex(part.replace("%", "")).decode("utf-8")
    except UnicodeDecodeError:
        return None


def _escape(part: str) -> str | None:
    if len(part) == 12:  # a surrogate pair
        return chr(0x10000 + ((int(part[2:6], 16) & 0x3FF) << 10) + (int(part[8:], 16) & 0x3FF))
    code = int(part[2:].strip("{}"), 16)
    return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else None


def _opener(head: bytes) -> Callable | None:
    """A decompressor for data that begins with ``head``, if it is compressed."""
    if head[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor().decompressobj()
    if head[:2] == b"\x1f\x8b" or (head[:1] == b"\x78" and len(head) > 2 and int.from_bytes(head[:2], "big") % 31 == 0):
        return zlib.decompressobj(47)
    return None


def inflated(data: bytes, ends: list[int]) -> Iterator[bytes]:
    """Content of all members and frames of compressed ``data``, in bounded chunks; ``ends`` gets the place behind the
    last whole one, and -1 after it if the next breaks off or is damaged."""
    at = 0
    while True:
        ends[:] = [at]
        while at and data[at : at + 1] == b"\0":  # padding between members
            at += 1
        while data[at + 1 : at + 4] == b"\x2a\x4d\x18" and data[at] >> 4 == 5:  # a frame to be skipped
            at += 8 + int.from_bytes(data[at + 4 : at + 8], "little")
        if (opened := _opener(data[at : at + 4])) is None:
            ends[:] = [at]
            return
        bounded, chunk = data[at] != 0x28, min(PIECE, 1 << 20)  # zlib can be asked for so much at a time
        step = 1 << 16 if bounded else 256  # a zstandard block of a few bytes holds up to 128 KB
        try:
            while not opened.eof and at < len(data):
                part = data[at : at + step]
                at += len(part)
                while True:
                    out = opened.decompress(part, chunk) if bounded else opened.decompress(part)
                    if out:
                        yield out
                    part = opened.unconsumed_tail if bounded else b""
                    if opened.eof or not (part or (bounded and len(out) == chunk)):
                        break
        except (zlib.error, zstandard.ZstdError):
            ends.append(-1)
            return
        if not opened.eof:
            ends.append(-1)
            return
        at -= len(opened.unused_data)


def _decoded(data: bytes, ends: list[int]) -> Iterator[str]:
    """Content of compressed ``data`` as text; fails where it is no UTF-8."""
    decoder = codecs.getincrementaldecoder("utf-8")()
    for chunk in inflated(data, ends):
        yield decoder.decode(chunk)
    yield decoder.decode(b"", final=len(ends) == 1)  # what breaks off may do so inside a character


def _pieces(data: bytes) -> Iterator[str]:
    held: list[str] = []
    size = 0
    for chunk in _decoded(data, []):
        if size + len(chunk) >= PIECE and (m := _UNTIL_BREAK.match(chunk)):
            yield "".join([*held, chunk[: m.end()]])
            held, size, chunk = [], 0, chunk[m.end() :]
        held.append(chunk)
        size += len(chunk)
    if size:
        yield "".join(held)


def _contents(data: bytes, place: Callable[[int, int], tuple[int, int]]) -> Iterator[tuple[Layer, bool, bool]]:
    """Layers of compressed ``data``, none if it is not, or holds no text; ``place`` gives that of a range of bytes."""
    ends: list[int] = []
    size = 0
    try:
        for chunk in _decoded(data, ends):
            size += len(chunk)
            if not _PLAIN.match(chunk):
                return
    except UnicodeDecodeError:
        return
    if not size:
        return
    broken = len(ends) > 1
    at = place(0, len(data) if broken else ends[0])
    for k, piece in enumerate(_pieces(data)):
        yield Layer(piece, *at), k == 0, broken and k == 0
    if not broken and ends[0] < len(data) and (rest := _from_bytes(bytes(data[ends[0] :]), lambda _: place(ends[0], len(data)))):
        yield rest, True, False


def _wrapped(text: str) -> Iterator[list[tuple[int, int]]]:
    """Places of lines that may be one base64 text, wrapped: neighbours of one width, with the (often shorter) line
    before or behind them or without, and all lines that follow each other; of one start, the longest first."""
    for m in _LINES.finditer(text):
        runs = [r.span() for r in _RUN.finditer(text, m.start(), m.end()) if r[1]]
        made = {(0, len(runs))}
        a = 0
        while a < len(runs):
            width, b = runs[a][1] - runs[a][0], a + 1
            while b < len(runs) and runs[b][1] - runs[b][0] == width:
                b += 1
            tail = b < len(runs) and runs[b][1] - runs[b][0] < width
            made |= {(x, y) for x in {max(a - 1, 0), a} for y in {b, b + tail} if y - x > 1}
            a = b
        for x, y in sorted(made, key=lambda r: (r[0], -r[1])):
            if runs[y - 1][1] - runs[x][0] >= 16 and sum(e - s for s, e in runs[x:y]) >= 16:
                yield runs[x:y]


def _bytes(body: str) -> bytes:
    """Base64 of either alphabet, decoded; a lone last character says nothing."""
    body = body.rstrip("=")
    body = body[: len(body) - (len(body) % 4 == 1)]
    return base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4))


def _opened(layer: Layer, runs: list[tuple[int, int]], ended: dict[int, bool], known: memoryview | None = None) -> Iterator[tuple[Layer, bool, bool]]:
    """Layers inside the base64 text that stands at ``runs``, whose bytes may be ``known``.

    ended: starts of compressed data in ``layer`` that was read before, each with whether it was whole.
    """
    if known is None:
        body = "".join([layer.text[s:e] for s, e in runs]).rstrip("=")
        if len(body) % 4 == 1:
            return
        try:
            data = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
        except (binascii.Error, ValueError):
            return
        n = len(body)
    else:
        data, n = known, -(-len(known) * 4 // 3)
    first = runs[0][0]
    if len(runs) == 1:
        at: range | array = range(*runs[0])
    else:
        at = array("q")
        for s, e in runs:
            at.extend(range(s, e))

    def place(a: int, b: int) -> tuple[int, int]:
        return layer.place(at[a // 3 * 4], runs[-1][1] if b == len(data) else at[min((b - 1) // 3 * 4 + 4, n) - 1] + 1)

    if not ended.get(first):  # else these are its first lines only
        for inner, new, broken in _contents(data, place):
            yield inner, new, broken and first not in ended
            if new:
                ended[first] = not broken
    if known is not None:
        return
    if isinstance(layer.lo, int):
        made = _from_bytes(data, lambda _: (layer.lo, layer.hi))
    else:
        made = _from_bytes(data, lambda i: layer.place(at[i // 3 * 4], at[min(i // 3 * 4 + 4, n) - 1] + 1))
    if made:
        yield made, True, False


class _Aligned:
    """The bytes of a run of base64 at each of its four alignments, decoded once, and where compressed data may begin."""

    def __init__(self, text: str) -> None:
        self.data = [_bytes(text[k:]) for k in range(4)]
        self.zeros = [None] * 4

    def _past_zero(self, k: int, at: int) -> int:
        """The place behind the next zero byte; the end where there is none."""
        if self.zeros[k] is None:
            self.zeros[k] = [m.start() for m in re.finditer(b"\0", self.data[k])]
        i = bisect_left(self.zeros[k], at)
        return self.zeros[k][i] + 1 if i < len(self.zeros[k]) else len(self.data[k])

    def compressed(self, offset: int) -> memoryview | None:
        """The bytes from character ``offset`` of the run on, if they begin as compressed data does."""
        k, at = offset % 4, offset // 4 * 3
        data = self.data[k]
        head = data[at : at + LOOK]
        if _opener(head[:4]) is None:
            return None
        try:
            if head[:2] == b"\x1f\x8b":
                if len(head) < 18 or head[2] != 8 or head[3] & 0xE0:
                    return None
                body, flags = at + 10, head[3]
                if flags & 4:
                    body += 2 + int.from_bytes(data[body : body + 2], "little")
                for bit in (8, 16):
                    body = self._past_zero(k, body) if flags & bit else body
                body += 2 if flags & 2 else 0
                if body >= len(data):
                    return None
                zlib.decompressobj(-15).decompress(data[body : body + LOOK], 1 << 12)
            elif head[:1] == b"\x78":
                zlib.decompressobj().decompress(head, 1 << 12)
            else:
                zstandard.ZstdDecompressor().decompressobj().decompress(head)
        except (zlib.error, zstandard.ZstdError):
            return None
        return memoryview(data)[at:]


def _glued(layer: Layer, start: int, end: int, aligned: _Aligned) -> Iterator[tuple[Layer, bool, bool]]:
    """Layers of base64 that stands in the run ``start`` to ``end`` with other characters before or behind it: stretches
    of text in what comes out at each alignment are layers."""
    for k, data in enumerate(aligned.data):
        n = end - start - k
        for m in _TEXT.finditer(data):
            if k or len(m[0]) < len(data):
                first = m.start()
                made = _from_bytes(m[0], lambda i, b=start + k, f=first, n=n: layer.place(b + (f + i) // 3 * 4, b + min((f + i) // 3 * 4 + 4, n)))
                if made:
                    yield made, True, False


def unwrapped(layer: Layer) -> Iterator[tuple[Layer, bool, bool]]:
    """The layers directly inside ``layer``, each with whether it is new (or goes on the one before), and breaks off."""
    text = layer.text
    if "%" in text and (made := _substituted(layer, _URL, _url)):
        yield made, True, False
    if "\\" in text and (made := _substituted(layer, _UNICODE, _escape)):
        yield made, True, False
    ended: dict[int, bool] = {}
    if "\n" in text or "\r" in text or "\\" in text:
        for runs in _wrapped(text):
            yield from _opened(layer, runs, ended)
    for m in _BASE64.finditer(text):
        yield from _opened(layer, [m.span()], ended)
        aligned = _Aligned(m[0].rstrip("="))
        for inner in _MAGIC.finditer(text, m.start() + 1, m.end()):
            data = aligned.compressed(inner.start() - m.start())
            if data is not None:
                yield from _opened(layer, [(inner.start(), m.end())], ended, data)
        yield from _glued(layer, *m.span(), aligned)


def scan(text: str | None) -> tuple[list[Span], list[Span], int, int]:
    """(base spans, all spans, layers opened, compressed layers that break off) of one text."""
    text = text or ""
    base = matches(text)
    found = set(base)
    whole = Layer(text)
    work, layers, cut = [unwrapped(whole)], 0, 0
    seen = {whole.key()}
    while work:
        if (step := next(work[-1], None)) is None:
            work.pop()
            continue
        inner, new, broken = step
        if (key := inner.key()) in seen:
            continue
        seen.add(key)
        layers += new
        cut += broken
        found |= {(k, *inner.place(s, e)) for k, s, e in matches(inner.text)}
        work.append(unwrapped(inner))
    return base, sorted(found, key=_order), layers, cut


def _order(span: Span) -> tuple[int, int, int]:
    return span[1], KINDS.index(span[0]), span[2]


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=_order))


def masked(text: str | None, spans: list[Span]) -> str | None:
    """``text`` with each span replaced by a placeholder of its kind; overlapping spans become one."""
    if not spans or text is None:
        return text
    out, at = [], 0
    for k, s, e in spans:
        if s >= at:
            out += [text[at:s], f"<{k.upper()}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text in batch.column("text").to_pylist():
            base, spans, layers, cut = scan(text)
            kinds = [k for k, _, _ in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), layers, cut, masked(text, spans)))
        cols = zip(*rows, strict=True) if rows else [()] * 8
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("row"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["row", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "layers", "truncated", "masked"])


def find_secrets(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """row (struct of the columns ``keep``, default all), counts, base_sha256, spans, layers, truncated, masked text."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in (docs.columns if keep is None else keep)]).alias("row"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(_scan, f"row {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, layers long, truncated long, masked string")


def mask_secrets(docs: DataFrame) -> DataFrame:
    """``docs`` with secrets in ``text`` masked; ``n_chars``, if there, follows the new text."""
    found = find_secrets(docs)
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("masked") != F.col("row.text"), F.length("masked").cast("long")).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return found.select(*[new[c].alias(c) if new.get(c) is not None else F.col(f"row.`{c}`") for c in docs.columns])


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=["doc_id"])
    return found.select("row.doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
