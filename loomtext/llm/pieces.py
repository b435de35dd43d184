"""What a SentencePiece vocabulary allows to be cut apart: marked words, lone tokens, admissible neighbours.

``Vocabulary`` proves, from the vocabulary alone, that no piece holds the space mark after another character and none
holds a line feed.  No merge can then join what lies on both sides of such a place, so a text may be cut there into
*segments* (a run of marks and the characters up to the next mark), each of which is encoded on its own.  A vocabulary
without that property is not cut: the whole text is then one segment.
"""

from __future__ import annotations

import re
from functools import lru_cache

import sentencepiece

MARK = "▁"


class Vocabulary:
    def __init__(self, path: str) -> None:
        self.model = m = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = [m.id_to_piece(i) for i in range(m.get_piece_size())]
        self.plain = {p: i for i, p in enumerate(self.pieces) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i))}
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if m.is_byte(i)}
        self.cuts = not any(MARK in p.lstrip(MARK) or "\n" in p for p in self.plain) and len(m.encode("\n")) == 2
        self.longest = max(map(len, self.plain), default=1)
        self.pair: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def encode(self, segment: str) -> list[int]:
        """The model's ids of a segment, without the mark it would put before a text."""
        if segment.startswith(MARK):
            return self.model.encode(segment[1:]) if len(segment) > 1 else self.model.encode("\n")[:1]
        return self.model.encode("\n" + segment)[2:]

    def is_token(self, i: int) -> bool:
        """Whether piece ``i``, as a text of its own, is encoded as itself."""
        if i not in self.alone:
            self.alone[i] = self.encode(self.pieces[i]) == [i]
        return self.alone[i]

    def may_follow(self, i: int, j: int) -> bool:
        """Whether the pieces ``i``, ``j`` side by side are encoded as themselves (merging never crosses them)."""
        known = self.pair.get((i, j))
        if known is None:
            known = self.pair[i, j] = self.encode(self.pieces[i] + self.pieces[j]) == [i, j]
        return known

    def segments(self, text: str) -> list[str]:
        """The segments of a text, line feeds being segments too; the first has the mark that the model puts there."""
        if not text:
            return []
        marked = MARK + text.replace(" ", MARK)
        return _SEGMENT.findall(marked) if self.cuts else [marked]


_SEGMENT = re.compile(f"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per worker process and file."""
    return Vocabulary(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")
