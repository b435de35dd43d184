"""The sizes that the forward pass tries at a place: all that can be, and few others."""

import random

from loomtext.llm.piece_codec import SHORT, codec
from loomtext.llm.pieces import default_path


def test_sizes_hold_every_piece_and_few_more():
    c = codec(default_path())
    for p in c.good:
        assert len(p) in c.sizes.get(p[-3:], SHORT)
    rng = random.Random(2)
    pieces = sorted(c.good)
    words = ["".join(rng.choice(pieces) for _ in range(rng.randint(1, 4))) for _ in range(300)]
    tried = places = 0
    for w in words:
        c.learn([w])
        assert c.known[w] == c.vocab.encode(w)
        for i in range(3, len(w) + 1):
            tried, places = tried + len(c.sizes.get(w[i - 3 : i], SHORT)), places + 1
    longest: dict[str, int] = {}
    for p in c.good:
        longest[p[-2:]] = max(longest.get(p[-2:], 1), len(p))
    before = sum(min(i, longest.get(w[i - 2 : i], 1)) for w in words for i in range(3, len(w) + 1))
    assert tried < 0.8 * before, (tried, places, before)
