"""Suffix arrays by induced sorting, and longest common prefixes by text position.

The construction is SA-IS: suffixes are classified as S (smaller than their right neighbour) or L, the leftmost S
suffixes of each run (LMS) are named and sorted recursively, and everything else is induced from them.  numpy has no
cheap scalar loop, so induction goes by *waves* rather than by single entries: wave ``d`` holds the suffixes ``d``
runs of equal symbols before an already sorted one, and a whole wave is merged into the order at once.  Equal LMS substrings keep
equal class numbers through a pass, which names them without a second comparison.

Common prefixes follow the permuted (text order) formulation: only positions whose left neighbours differ are compared
symbol by symbol; every other value is its left neighbour's minus one.
"""

from __future__ import annotations

import numpy as np


def _distance(stop: np.ndarray) -> np.ndarray:
    """Steps from each position to the next True in ``stop`` (0 on it); the last entry must be True."""
    at = np.where(stop, np.arange(len(stop)), len(stop))
    return np.minimum.accumulate(at[::-1])[::-1] - np.arange(len(stop))


def _induce(code: np.ndarray, nxt: np.ndarray, order: np.ndarray, held: np.ndarray, depth: np.ndarray, todo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merge the positions ``todo`` into ``order``.

    code: rank of first symbol, type and run; nxt: where the next run starts; order: sorted seeds; held: class of each
    seed (by position); depth: wave of each position of ``todo``.  Returns the sorted positions and the class of each.
    """
    n = len(code)
    keys = code[order] * n + held[order]
    cls = np.zeros(n, np.int64)
    cls[order[1:]] = np.cumsum(keys[1:] != keys[:-1])
    fixed = np.ones(len(order), bool)
    by = todo[np.argsort(depth[todo], kind="stable")]
    ends = np.cumsum(np.bincount(depth[by])[1:]) if len(by) else []
    begin = 0
    for end in ends:
        new = by[begin:end]
        begin = end
        if begin and not fixed.all():
            loose = order[~fixed]
            keys[~fixed] = code[loose] * n + cls[nxt[loose]]
        if not len(new):
            continue
        k = code[new] * n + cls[nxt[new]]
        o = np.argsort(k, kind="stable")
        new, k = new[o], k[o]
        at = np.searchsorted(keys, k) + np.arange(len(new))
        size = len(order) + len(new)
        old = np.ones(size, bool)
        old[at] = False
        merged, fresh, kept = np.empty(size, order.dtype), np.empty(size, keys.dtype), np.zeros(size, bool)
        merged[at], merged[old] = new, order
        fresh[at], fresh[old] = k, keys
        kept[old] = fixed
        order, keys, fixed = merged, fresh, kept
        rank = np.zeros(size, np.int64)
        np.cumsum(keys[1:] != keys[:-1], out=rank[1:])
        cls[order] = rank
    return order, cls


def _sais(t: np.ndarray) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol is its only 0 and its smallest."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int64)
    step = np.sign(t[1:] - t[:-1])
    ahead = np.flatnonzero(step)
    s = np.ones(n, bool)
    s[:-1] = step[ahead[np.searchsorted(ahead, np.arange(n - 1))]] > 0
    lms = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    is_lms = np.zeros(n, bool)
    is_lms[lms] = True
    # Within a bucket an L suffix with a longer run of its symbol comes later and an S suffix earlier, so a run is one
    # step of induction: a text of one long run does not need a wave for each of its symbols.
    new_run = np.append(step != 0, True)
    run = _distance(new_run) + 1
    nxt = np.minimum(np.arange(n) + run, n - 1)
    run_no = np.cumsum(np.append(True, new_run[:-1]))
    longest = run.max() + 1
    code = np.unique((t * 2 + s) * longest + np.where(s, longest - run, run), return_inverse=True)[1].astype(np.int64)
    to_lms, to_l = (run_no[np.minimum(np.arange(n) + _distance(stop), n - 1)] - run_no for stop in (is_lms, ~s | (np.arange(n) == n - 1)))
    larger = np.flatnonzero(~s)
    smaller = np.flatnonzero(s[:-1])

    def passes(order: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order, cls = _induce(code, nxt, order, held, to_lms, larger)
        order = order[~s[order] | (order == n - 1)]
        return _induce(code, nxt, order, cls, to_l, smaller)

    held = np.zeros(n, np.int64)
    _, cls = passes(lms[np.argsort(code[lms], kind="stable")], held)
    names = np.unique(cls[lms], return_inverse=True)[1]
    if names.max() + 1 < len(lms):
        sorted_lms = lms[_sais(names.astype(np.int64))]
    else:
        sorted_lms = np.empty(len(lms), np.int64)
        sorted_lms[names] = lms
    held[sorted_lms] = np.arange(len(lms))
    return passes(sorted_lms, held)[0]


def suffix_array(tokens: np.ndarray) -> np.ndarray:
    """Start positions of the suffixes of ``tokens`` (non-negative integers) in sorted order."""
    if not len(tokens):
        return np.zeros(0, np.int64)
    ids = np.unique(tokens, return_inverse=True)[1].astype(np.int64)
    return _sais(np.append(ids + 1, 0))[1:]


def common_prefixes(tokens: np.ndarray, sa: np.ndarray, fresh: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """By position: length shared with the suffix before it in ``sa``, and with the one after it.

    fresh: positions at which a new piece starts (compared outright); most: lengths above it may be reported as any
    value that is still at least ``most`` minus the distance to the last compared position.
    """
    n = len(sa)
    before = np.full(n, -1)
    before[sa[1:]] = sa[:-1]
    plcp = np.zeros(n, np.int64)
    left = np.full(n, True)
    inner = np.flatnonzero(before > 0)
    inner = inner[inner > 0]
    left[inner] = tokens[inner - 1] != tokens[before[inner] - 1]
    left[before < 0] = True
    left[fresh] = True
    left[0] = True
    anchor = np.flatnonzero(left)
    active = anchor[before[anchor] >= 0]
    other = before[active]
    padded = np.concatenate([tokens.astype(np.int64), np.full(16, -1)])
    reach = np.arange(16)
    done = 0
    while len(active) and done < most:
        a, b = np.minimum(active + done, n)[:, None] + reach, np.minimum(other + done, n)[:, None] + reach
        same = padded[np.minimum(a, n)] == padded[np.minimum(b, n)]
        same &= (a < n) & (b < n)
        run = np.where(same.all(1), 16, same.argmin(1))
        plcp[active] += run
        more = run == 16
        active, other = active[more], other[more]
        done += 16
    at = np.maximum.accumulate(np.where(left, np.arange(n), 0))
    plcp = np.maximum(plcp[at] - (np.arange(n) - at), 0)
    after = np.zeros(n, np.int64)
    after[sa[:-1]] = plcp[sa[1:]]
    return plcp, after
