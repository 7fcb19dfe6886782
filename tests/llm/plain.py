"""Plain versions of corpus operators, by trying everything, for more than one test file."""

from __future__ import annotations

import collections
import re


def linked_components(rows, k, percent):
    def shingles(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", (text or ""))
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in w]
        return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in sets:
        for y in sets:
            both = len(sets[x] & sets[y])
            if x < y and both and 100 * both >= percent * len(sets[x] | sets[y]):
                p, q = sorted((find(x), find(y)))
                up[q] = p
    return {i: (len(sets[i]), find(i)) for i in sets}


def tiles_plain(a, b, least):
    """Greedy string tiling by trying all pairs of places."""
    in_a, in_b = [False] * len(a), [False] * len(b)
    while True:
        best = (0, 0, 0)
        for x in range(len(a)):
            for y in range(len(b)):
                n = 0
                while x + n < len(a) and y + n < len(b) and a[x + n] == b[y + n] and not in_a[x + n] and not in_b[y + n]:
                    n += 1
                if n > best[0]:
                    best = (n, x, y)
        if best[0] < least:
            return sum(in_a)
        for k in range(best[0]):
            in_a[best[1] + k] = in_b[best[2] + k] = True


def water(sizes, weights, share, cap):
    """Targets by resharing the excess until none is above."""
    total, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_ and total > 1e-9:
        w = sum(weights[i] for i in open_)
        over = {i for i in open_ if total * weights[i] / w >= cap * sizes[i]}
        if not over:
            for i in open_:
                target[i] = total * weights[i] / w
            return target
        for i in over:
            target[i] = cap * sizes[i]
            total -= target[i]
        open_ -= over
    return target


def mix_plain(rows, place, weights=(5, 2, 1), share=1.5, cap=2):
    """Words taken from each row by sorting whole sources; place gives a row's key."""
    source = collections.defaultdict(list)
    for n, (i, t, s) in enumerate(rows):
        source[s].append(n)
    order = sorted((s for s in source if s is not None)) + ([None] if None in source else [])
    size = [len((t or "").split()) for _, t, _ in rows]
    totals = [sum(size[n] for n in source[s]) for s in order]
    target = water(totals, [weights[i % 3] for i in range(len(order))], share, cap)
    taken = {}
    for s, whole, want in zip(order, totals, target):
        epochs = int(want / whole + 1e-9) if whole else 0
        left = round(want - epochs * whole)
        for n in sorted(source[s], key=place):
            give = min(size[n], max(0, left))
            left -= give
            taken[n] = epochs * size[n] + give
    return taken
