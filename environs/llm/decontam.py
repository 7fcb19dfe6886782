"""Benchmark decontamination by greedy string tiling (Wise, 1993).

Words are joined with a benchmark's items by shared seeds of MIN_MATCH words, or of all words of a shorter item (Karp-Rabin fingerprints). For a document
and an item that share one, the longest common run that no tile covers yet is marked as a tile, again and again down to
MIN_MATCH words; reordered passages are so found piece by piece. A document is contaminated when tiles cover at least
``coverage`` of an item's words.

The benchmark goes to the workers in blocks of at most BLOCK_BYTES of text; documents are read where they lie, without
a shuffle, and meet BLOCKS_AT_ONCE blocks in one pass. A larger benchmark takes several passes, whose verdicts are written between them.
Pairs of a document and an item with more than SEEDS_AT_ONCE shared seeds, as very repetitive texts have, are tiled by scans
for the longest run that is left, which need memory for the two texts only.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import U64, WordHashes, drop, free_name, hashed_words, mix64, plain_columns, ship, stash, utf8, worker

MIN_MATCH = 5
COVERAGE = 0.8
BLOCK_BYTES, BLOCKS_AT_ONCE = 8_000_000, 4
SEEDS_AT_ONCE = 1_000_000
_BASE = U64(0x9E3779B97F4A7C15)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
#: ASCII punctuation separates words; A-Z are lower-cased.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256)).lower()


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_PLAIN).split() if text else []


def fingerprints(h: np.ndarray, k: int) -> np.ndarray:
    """Karp-Rabin fingerprints, modulo 2**64, of all runs of k words; the first word has the highest power."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    out = np.zeros(n, U64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = out * _BASE + h[i : i + n]
    return mix64(out)


class Block:
    """Some items, with their seeds sorted for look-up behind a bitmap."""

    MASK = U64((1 << 22) - 1)

    def __init__(self, items: list[tuple]):
        known = WordHashes()
        self.items = [(i, words_of(t)) for i, t in items]
        self.hashes = [hashed_words(w, known) for _, w in self.items]
        seeds = [fingerprints(h, MIN_MATCH) for h in self.hashes]
        key = np.concatenate([*seeds, np.empty(0, U64)])
        owner = np.repeat(np.arange(len(seeds)), [len(s) for s in seeds])
        place = np.concatenate([*[np.arange(len(s)) for s in seeds], np.empty(0, np.int64)])
        order = np.argsort(key, kind="stable")
        self.key, self.owner, self.place = key[order], owner[order], place[order]
        # an item of fewer words is one seed of its whole length
        self.short = {k: [x for x, h in enumerate(self.hashes) if len(h) == k] for k in range(1, MIN_MATCH)}
        self.maybe = np.zeros(1 << 22, bool)
        self.maybe[(self.key & self.MASK).astype(np.int64)] = True

    def coverage(self, h: np.ndarray) -> Iterator[tuple[object, float]]:
        """Items that share a seed with the document, and the share of each that tiles cover."""
        for k, owners in self.short.items():
            if owners:
                f = fingerprints(h, k)
                whole = np.concatenate([fingerprints(self.hashes[x], k) for x in owners])
                for x, seed in zip(np.array(owners)[np.isin(whole, f)].tolist(), whole[np.isin(whole, f)]):
                    at = np.flatnonzero(f == seed)
                    if (h[at[:, None] + np.arange(k)] == self.hashes[x]).all(axis=1).any():
                        yield self.items[x][0], 1.0
        f = fingerprints(h, MIN_MATCH)
        at = np.flatnonzero(self.maybe[(f & self.MASK).astype(np.int64)])
        found, times = np.unique(f[at], return_counts=True)
        lo, hi = np.searchsorted(self.key, found, "left"), np.searchsorted(self.key, found, "right")
        n = hi - lo
        # each seed of the block comes up once at most here, however often the document has it
        which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        owner, inverse = np.unique(self.owner[which], return_inverse=True)
        if not len(owner):
            return
        pairs = np.bincount(inverse, weights=np.repeat(times, n))
        if pairs.sum() <= SEEDS_AT_ONCE:
            lo, hi = np.searchsorted(self.key, f[at], "left"), np.searchsorted(self.key, f[at], "right")
            n = hi - lo
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            order = np.argsort(self.owner[which], kind="stable")
            which, j = which[order], np.repeat(at, n)[order]
            cuts = np.searchsorted(self.owner[which], [*owner.tolist(), owner[-1] + 1])
            for x, a, b in zip(owner.tolist(), cuts[:-1].tolist(), cuts[1:].tolist()):
                yield self.items[x][0], tiled(self.place[which[a:b]], j[a:b], self.hashes[x], h) / len(self.hashes[x])
            return
        for x, m in zip(owner.tolist(), pairs.tolist()):
            a = self.hashes[x]
            if m > SEEDS_AT_ONCE:
                yield self.items[x][0], scanned(a, h) / len(a)
                continue
            own = fingerprints(a, MIN_MATCH)
            order = np.argsort(own, kind="stable")
            place = at[np.isin(f[at], own)]
            lo, hi = np.searchsorted(own[order], f[place], "left"), np.searchsorted(own[order], f[place], "right")
            n = hi - lo
            which = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
            yield self.items[x][0], tiled(order[which], np.repeat(place, n), a, h) / len(a)


def scanned(a: np.ndarray, b: np.ndarray, least: int = MIN_MATCH) -> int:
    """Words of a under tiles, as ``tiled`` counts them, by running fingerprints over what is left of both texts.

    The longest common run of unmarked words is found by halving; all runs of that length are marked, those that come first in a and
    then in b before others, and the next length is looked for.
    """
    free_a, free_b = np.ones(len(a), bool), np.ones(len(b), bool)
    most = min(len(a), len(b))

    def windows(x: np.ndarray, free: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and fingerprints of the runs of k words that are free."""
        n = len(x) - k + 1
        room = np.cumsum(np.r_[0, ~free])
        at = np.flatnonzero(room[k : k + n] == room[:n])
        return at, running(x, k)[at]

    while most >= least:
        low, high = least - 1, most  # a common run of low words exists (or low is too short); none of more than high does
        while low < high:
            k = (low + high + 1) // 2
            if np.isin(windows(a, free_a, k)[1], windows(b, free_b, k)[1]).any():
                low = k
            else:
                high = k - 1
        if low < least:
            break
        (x, fx), (y, fy) = windows(a, free_a, low), windows(b, free_b, low)
        both = np.isin(fx, fy)
        order = np.argsort(fy, kind="stable")
        fy = fy[order]
        for i, f in zip(x[both].tolist(), fx[both].tolist()):
            if not free_a[i : i + low].all():
                continue
            for p in range(int(np.searchsorted(fy, U64(f), "left")), int(np.searchsorted(fy, U64(f), "right"))):
                j = int(y[order[p]])
                if free_b[j : j + low].all() and (a[i : i + low] == b[j : j + low]).all():
                    free_a[i : i + low] = free_b[j : j + low] = False
                    break
        most = low - 1
    return int((~free_a).sum())


def running(h: np.ndarray, k: int) -> np.ndarray:
    """Fingerprints of all runs of k words in one pass, whatever k: differences of a running sum, each brought to the first power."""
    n = len(h)
    with np.errstate(over="ignore"):
        up, down = (np.cumprod(np.r_[U64(1), np.full(n, x)], dtype=U64) for x in (_BASE, _INVERSE))
        total = np.cumsum(np.r_[U64(0), mix64(h) * up[:n]], dtype=U64)
        return mix64((total[k:] - total[: n - k + 1]) * down[: n - k + 1])


def tiled(i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray) -> int:
    """Words of a under tiles, from the seeds at a[i], b[j]."""
    real = np.ones(len(i), bool)
    for k in range(MIN_MATCH):  # a fingerprint is confirmed word by word
        real &= a[i + k] == b[j + k]
    i, j = i[real], j[real]
    order = np.lexsort((i, j - i))
    i, j = i[order], j[order]
    if not len(i):
        return 0
    new = np.flatnonzero(np.r_[True, (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    runs = np.diff(np.r_[new, len(i)]) + MIN_MATCH - 1
    queue = [(-int(n), int(x), int(y)) for n, x, y in zip(runs, i[new], j[new])]
    heapq.heapify(queue)
    in_a, in_b = np.zeros(len(a), bool), {}
    while queue:
        n, x, y = heapq.heappop(queue)
        n = -n
        used = in_a[x : x + n].copy()
        if in_b:
            used |= np.fromiter((y + k in in_b for k in range(n)), bool, n)
        if not used.any():
            in_a[x : x + n] = True
            in_b.update(dict.fromkeys(range(y, y + n)))
            continue
        edges = np.flatnonzero(np.diff(np.r_[True, used, True].astype(np.int8)))
        for s, e in zip(edges[::2], edges[1::2]):  # what is left of the run, if it is long enough, waits its turn
            if e - s >= MIN_MATCH:
                heapq.heappush(queue, (-int(e - s), x + int(s), y + int(s)))
    return int(in_a.sum())


def blocks(benchmark: DataFrame) -> Iterator[list[tuple]]:
    held, size = [], 0
    for r in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        held.append((r.item_id, r.text.encode("utf-8", "surrogatepass")))
        size += len(held[-1][1])
        if size >= BLOCK_BYTES:
            yield held
            held, size = [], 0
    if held:
        yield held


def rows_measured(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """row (a struct of the columns of docs) and leak (n_items, item_id, coverage)."""
    ship(docs.sparkSession)
    kind = benchmark.schema["item_id"].dataType
    leak = T.StructType([T.StructField("n_items", T.LongType()), T.StructField("item_id", kind), T.StructField("coverage", T.DoubleType())])
    rows = docs.select(F.struct(*plain_columns(docs)).alias("row"), utf8("text").alias("utf8"), F.lit(None).cast(leak).alias("leak"))
    into = T.StructType([rows.schema["row"], T.StructField("utf8", T.BinaryType()), T.StructField("leak", leak)])
    table, held = None, []
    for items in blocks(benchmark):
        if len(held) == BLOCKS_AT_ONCE:
            before, table = table, stash(rows, "leaks")
            rows = table
            for shared in held:
                shared.unpersist()
            held = []
            if before is not None:
                drop(before)
        held.append(docs.sparkSession.sparkContext.broadcast(Block(items)))

        def run(batches: Iterator[pa.RecordBatch], shared=held[-1]) -> Iterator[pa.RecordBatch]:
            known, block = WordHashes(), shared.value
            for b in batches:
                out = [judge(text.as_py(), block, known, x) for text, x in zip(b.column(1), b.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, b.schema.field(2).type)], ["row", "utf8", "leak"])

        rows = rows.mapInArrow(worker(run), into)
    none = F.struct(F.lit(0).cast("long").alias("n_items"), F.lit(None).cast(kind).alias("item_id"), F.lit(0.0).alias("coverage"))
    return rows.select("row", F.coalesce("leak", none).alias("leak"))


def measure(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs(text, ...) -> the same rows and columns and a struct ``leak``: n_items found over COVERAGE, and item_id and coverage of the best.

    An item of fewer than MIN_MATCH words is found where all of it stands in a text. Items without a word match nothing, nor do null or empty
    texts (coverage 0, null item). Of items with
    equal coverage the smallest item_id is named. Rows are judged each. An empty benchmark gives 0 for all. Other columns may have any
    names; where one is called ``leak``, ours is ``leak_1``.
    """
    return rows_measured(docs, benchmark).select("row.*", F.col("leak").alias(free_name(docs.columns, "leak")))


def judge(text: bytes | None, block: Block, known: WordHashes, before: dict | None) -> dict | None:
    n, best = (before["n_items"], (-before["coverage"], before["item_id"])) if before else (0, (0.0, None))
    for item, c in block.coverage(hashed_words(words_of(text), known)):
        n += c >= COVERAGE
        if best[1] is None or (-c, item) < best:
            best = (-c, item)
    return before if best[1] is None else {"n_items": int(n), "item_id": best[1], "coverage": -best[0]}


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, with the columns they had. Odd rows are treated as in ``measure``."""
    return rows_measured(docs, benchmark).where("leak.n_items = 0").select("row.*")
