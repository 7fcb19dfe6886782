"""Suffix arrays by induced sorting, and permuted longest common prefixes, in whole-array steps.

Induced sorting (Nong, Zhang and Chan, 2009): suffixes are classified as smaller (S) or larger (L) than the next one;
leftmost-S substrings are sorted by inducing, named, and the string of names is sorted in turn; L and then S suffixes
are induced from the result in linear time. A scan of one bucket is done in batches instead of one suffix at a time:
all suffixes that are known in the bucket put their predecessors into their buckets together, in order, and those that fall
into the same bucket are the next batch.
"""

from __future__ import annotations

import numpy as np


def s_types(t: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next; the last one is larger than the empty suffix."""
    n = len(t)
    smaller = np.zeros(n, bool)
    if n < 2:
        return smaller
    at = np.where(t[1:] != t[:-1], np.arange(n - 1, dtype=np.int32), n)
    at = np.minimum.accumulate(at[::-1])[::-1]  # the first place from i on where neighbours differ
    inside = at < n
    d = at[inside]
    smaller[:-1][inside] = t[d] < t[d + 1]
    return smaller


class _Buckets:
    """Lists of suffixes by first symbol, each in the order in which they came."""

    def __init__(self, size: int):
        self.parts: list[list[np.ndarray]] = [[] for _ in range(size)]

    def add(self, suffixes: np.ndarray, symbols: np.ndarray) -> None:
        if not len(suffixes):
            return
        order = np.argsort(symbols, kind="stable")
        suffixes, symbols = suffixes[order], symbols[order]
        cuts = np.r_[0, np.flatnonzero(symbols[1:] != symbols[:-1]) + 1, len(symbols)].tolist()
        for a, b in zip(cuts[:-1], cuts[1:]):
            self.parts[symbols[a]].append(suffixes[a:b])

    def take(self, symbol: int) -> np.ndarray:
        parts = self.parts[symbol]
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else _NONE


_NONE = np.empty(0, np.int32)


def _induce(t: np.ndarray, size: int, lms: _Buckets) -> np.ndarray:
    """All suffixes in the order that the given order of the leftmost-S ones induces."""
    n = len(t)
    larger = _Buckets(size)
    larger.add(np.array([n - 1], np.int32), t[n - 1 :])
    done: list[np.ndarray] = [_NONE] * size
    for c in range(size):
        batch, got = larger.take(c), []
        while len(batch):
            got.append(batch)
            p = batch[batch > 0] - 1
            s = t[p]
            larger.add(p[s > c], s[s > c])
            batch = p[s == c]
        done[c] = np.concatenate(got) if got else _NONE
        q = lms.take(c)
        p = q[q > 0] - 1
        larger.add(p, t[p])
    smaller = _Buckets(size)
    out: list[np.ndarray] = []
    for c in range(size - 1, -1, -1):
        batch, got = smaller.take(c), []
        while len(batch):
            got.append(batch)
            p = batch[batch > 0] - 1
            s = t[p]
            smaller.add(p[s < c], s[s < c])
            batch = p[s == c]
        q = done[c][::-1]
        p = q[q > 0] - 1
        s = t[p]
        smaller.add(p[s < c], s[s < c])
        out += [*got, q]
    return np.concatenate(out)[::-1]


def _doubled(names: np.ndarray) -> np.ndarray:
    """The suffix array of a string over a large alphabet, by doubling the length that ranks tell apart.

    A rank is the place of the first suffix that is equal so far; only suffixes that are not alone there are sorted again.
    """
    n, step = len(names), 1
    order = np.argsort(names, kind="stable")
    left = np.arange(n)  # places that hold suffixes which are not yet alone
    rank = np.empty(n, np.int64)
    key = names[order].astype(np.int64)
    while True:
        new = np.r_[True, key[1:] != key[:-1]]
        first = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        rank[order[left]] = first
        alone = new & np.r_[new[1:], True]
        left = left[~alone]
        if not len(left):
            return order
        suffixes = order[left]
        after = suffixes + step
        key = rank[suffixes] * (n + 1) + np.where(after < n, rank[np.minimum(after, n - 1)] + 1, 0)
        again = np.argsort(key)
        order[left], key = suffixes[again], key[again]
        step *= 2


def suffix_array(t: np.ndarray, size: int = 256) -> np.ndarray:
    """The suffix array of t, whose symbols are below size. Strings of names are sorted by inducing while there are few names."""
    n = len(t)
    if n < 2:
        return np.arange(n)
    small = s_types(t)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    order = lms
    if len(lms) > 1:
        start = _Buckets(size)
        start.add(lms, t[lms])
        is_lms = np.zeros(n, bool)
        is_lms[lms] = True
        by_substring = _induce(t, size, start)
        by_substring = by_substring[is_lms[by_substring]]
        ends = np.r_[lms[1:], n - 1]
        length = np.zeros(n, np.int64)
        length[lms] = ends - lms + 1
        a, b = by_substring[:-1], by_substring[1:]
        same = (length[a] == length[b]) & (a != lms[-1]) & (b != lms[-1])
        left = np.flatnonzero(same)
        step = 0
        while len(left):  # equal as far as step: those with more to compare go on
            x, y = a[left] + step, b[left] + step
            ok = (t[x] == t[y]) & (small[x] == small[y])
            same[left[~ok]] = False
            left = left[ok]
            step += 1
            left = left[length[a[left]] > step]
        names = np.empty(n, np.int64)
        names[by_substring] = np.cumsum(np.r_[0, ~same])
        reduced = names[lms]
        many = int(reduced.max()) + 1
        if many == len(lms):
            order = by_substring
        else:
            order = lms[suffix_array(reduced, many) if many <= 512 else _doubled(reduced)]
    final = _Buckets(size)
    final.add(order, t[order])
    return _induce(t, size, final)


def permuted_lcp(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """plcp[i]: length of the longest common prefix of suffix i and the suffix before it in sa (0 for the first).

    By Kaerkkaeinen, Manzini and Puglisi, 2009: where the two suffixes are preceded by one symbol the value is one less than
    that of i - 1; only the others are compared, eight bytes at a time.
    """
    n = len(t)
    if not n:
        return np.empty(0, np.int64)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    i = np.arange(n)
    derived = (i > 0) & (phi > 0) & (t[i - 1] == t[np.maximum(phi - 1, 0)])
    at = np.flatnonzero(~derived)
    out = np.zeros(n, np.int64)
    raw = np.concatenate([t.astype(np.uint8), np.zeros(16, np.uint8)])
    word = np.ndarray((n + 8,), "<u8", raw.data, strides=(1,))
    left = at[phi[at] >= 0]
    lcp = np.zeros(len(left), np.int64)
    active = np.arange(len(left))
    while len(active):
        a, b = left[active] + lcp[active], phi[left[active]] + lcp[active]
        room = n - np.maximum(a, b)
        x = word[np.minimum(a, n)] ^ word[np.minimum(b, n)]
        low = x & (~x + np.uint64(1))
        equal = np.where(x == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) >> 3)
        lcp[active] += np.minimum(equal, room)
        active = active[(equal == 8) & (room > 8)]
    out[left] = lcp
    base = np.zeros(n, np.int64)
    base[at] = at
    base = np.maximum.accumulate(base)
    return np.maximum(out[base] - (i - base), 0)
