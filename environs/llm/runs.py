"""Importance resampling towards a target's distribution of n-grams, over suffix arrays of word ids (operator 11).

Each task numbers the words of a block of texts and orders the block's suffixes of word ids. Equal n-grams stand next to each other
there: a run is a stretch whose neighbours have n or more words in common. A run's n-gram is hashed once, and its bucket is scattered back
to the places where it occurs. No run of more than MAX_N words counts, so suffixes are ordered by their first MAX_N words, which fit one integer.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from environs.operators.ranks import numbered

from .common import drop, ship, stash, utf8, worker

MAX_N, BUCKETS = 3, 10_000
MIN_WORDS, SHARE_PERCENT, SEED = 20, 5, 42
#: Words of one suffix array, at most; a longer text is cut into pieces that overlap by MAX_N - 1 words.
BLOCK_WORDS = 1 << 19
_BITS = 21  # of a word's number within a block: a block has at most BLOCK_WORDS + MAX_N - 1 different words
_MASK = (1 << _BITS) - 1

#: Bytes of words, A-Z in lower case; all others are blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


# A CRC of joined strings from those of the parts: crc(a + b) = zeros(crc(a), len(b)) ^ crc(b), where zeros is linear over bits.


def _one_zero() -> np.ndarray:
    """What one zero byte makes of each byte of a CRC: four tables of 256."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return np.stack([c, *[np.arange(256, dtype=np.uint32) << np.uint32(8 * (j - 1)) for j in (1, 2, 3)]])


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 255]
    for j in (1, 2, 3):
        out = out ^ tables[j][(crc >> np.uint32(8 * j)) & 255]
    return out


class Zeros:
    """zeros(crc, length) for arrays: tables for 1, 2, 4, 8 ... zero bytes, as far as lengths need them."""

    def __init__(self) -> None:
        self.tables = [_one_zero()]

    def __call__(self, crc: np.ndarray, length: np.ndarray) -> np.ndarray:
        out, k = crc.astype(np.uint32), 0
        while (left := length >> k).any():
            if k == len(self.tables):
                t = self.tables[-1]
                self.tables.append(np.stack([_apply(t, x) for x in t]))
            odd = (left & 1).astype(bool)
            out[odd] = _apply(self.tables[k], out[odd])
            k += 1
        return out


class Numbers(dict):
    """word -> 1, 2, 3 ... in the order in which words are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


class Block:
    """The suffix array of some texts' word ids, and the runs of 1 to MAX_N words in it."""

    def __init__(self, texts: list[list[bytes]], own: list[int], zeros: Zeros):
        """own: of each text, how many of its first places count; the words after them are only there to be read on into."""
        known = Numbers()
        sizes = np.array([len(t) for t in texts], np.int64)
        ids = np.zeros(int(sizes.sum()) + len(texts) + MAX_N, np.int64)  # 0 ends a text
        starts = np.concatenate(([0], np.cumsum(sizes + 1)))[:-1].astype(np.int64)
        for t, at in zip(texts, starts.tolist()):
            ids[at : at + len(t)] = np.fromiter(map(known.__getitem__, t), np.int64, len(t))
        assert len(known) <= _MASK
        self.starts, self.own = starts, np.array(own, np.int64)
        self.places = np.concatenate([np.arange(a, a + n) for a, n in zip(starts.tolist(), own)] or [np.empty(0, np.int64)])
        a, b, c = (ids[self.places + k] for k in range(MAX_N))
        c = np.where(b == 0, 0, c)  # nothing is read past a text's end
        key = (a << (2 * _BITS)) | (b << _BITS) | c
        self.order = np.argsort(key)
        self.sorted = key[self.order]
        words = list(known)
        self.bare = np.array([0] + [zlib.crc32(w) for w in words], np.uint32)
        self.spaced = np.array([0] + [zlib.crc32(b" " + w) for w in words], np.uint32)
        self.length = np.array([0] + [len(w) + 1 for w in words], np.int64)
        self.zeros = zeros

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For n = 1 to MAX_N: where runs begin in the suffix array, how long they are, their buckets, and which suffixes have n words."""
        crc_of = None
        for n in range(1, MAX_N + 1):
            prefix = self.sorted >> (_BITS * (MAX_N - n))
            whole = (prefix & _MASK) != 0
            # a neighbour has fewer than n words in common where the prefixes of n words differ
            begin = np.ones(len(prefix), bool)
            begin[1:] = prefix[1:] != prefix[:-1]
            heads = np.flatnonzero(begin & whole)
            ends = np.append(np.flatnonzero(begin), len(prefix))
            length = ends[np.searchsorted(ends, heads, "right")] - heads
            last = prefix[heads] & _MASK
            if n == 1:
                crc = self.bare[last]
            else:
                crc = self.zeros(crc_of[heads], self.length[last]) ^ self.spaced[last]
            yield heads, length, (crc % np.uint32(BUCKETS)).astype(np.int64), whole
            if n < MAX_N:  # each suffix keeps the CRC of its first n words for the runs of n + 1
                crc_of = np.zeros(len(prefix), np.uint32)
                crc_of[whole] = np.repeat(crc, length)

    def counts(self) -> np.ndarray:
        out = np.zeros(BUCKETS, np.int64)
        for _, length, bucket, _ in self.runs():
            np.add.at(out, bucket, length)
        return out

    def sums(self, gains: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each text, the number of n-grams that begin at its own places, and the sum of their gains."""
        n, total = np.zeros(len(self.places), np.int64), np.zeros(len(self.places), np.int64)
        for _, length, bucket, whole in self.runs():
            at = self.order[whole]  # a run's suffixes follow each other: repeated buckets fall on their places
            total[at] += np.repeat(gains[bucket], length)
            n[at] += 1
        edges = np.concatenate(([0], np.cumsum(self.own)))
        parts = [np.concatenate(([0], np.cumsum(x)))[edges] for x in (n, total)]
        return np.diff(parts[0]), np.diff(parts[1])


def blocks(texts: Iterator[list[bytes]], zeros: Zeros) -> Iterator[tuple[list[int], Block]]:
    """Blocks of consecutive texts, with the numbers of the texts that their pieces belong to; no text is left out."""
    held, own, at, size = [], [], [], 0
    for i, t in enumerate(texts):
        for a in range(0, max(len(t), 1), BLOCK_WORDS):
            piece = t[a : a + BLOCK_WORDS + MAX_N - 1]
            if held and size + len(piece) > BLOCK_WORDS:
                yield at, Block(held, own, zeros)
                held, own, at, size = [], [], [], 0
            held.append(piece)
            own.append(min(BLOCK_WORDS, len(t) - a))
            at.append(i)
            size += len(piece)
    if held:
        yield at, Block(held, own, zeros)


def bucket_counts(texts: DataFrame) -> np.ndarray:
    """texts(text) -> the occurrences of all n-grams by bucket. A task sends one row a bucket; the driver gets BUCKETS rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros, total = Zeros(), np.zeros(BUCKETS, np.int64)
        for _, block in blocks((words_of(t) for b in batches for t in b.column(0).to_pylist()), zeros):
            total += block.counts()
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["bucket", "n"])

    rows = texts.select(utf8("text")).mapInArrow(worker(run), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the ratio of the smoothed shares of target and corpus), by bucket."""
    s, t = int(corpus.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + BUCKETS) / ((int(a) + 1) * (t + BUCKETS)))) for a, b in zip(corpus, target)], np.int64)


def noise(key: str = "doc_id") -> Column:
    """A Gumbel draw in thousandths, from the doc_id's hash: reruns agree."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{SEED}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def weigh(docs: DataFrame, gain: np.ndarray) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_words, n_features, weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zeros = Zeros()
        for b in batches:
            texts = [words_of(t) for t in b.column(1).to_pylist()]
            found = np.zeros((2, len(texts)), np.int64)
            for at, block in blocks(iter(texts), zeros):
                for side, x in zip(found, block.sums(gain)):
                    np.add.at(side, at, x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(found[0]), pa.array(found[1])], ["doc_id", "n_words", "n_features", "weight"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(worker(run), f"doc_id {kind}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, *, percent: int = SHARE_PERCENT) -> DataFrame:
    """docs(doc_id, text), target(text) -> doc_id, n_features, weight, score, rank: one row for each row of docs.

    Features are runs of 1 to 3 words, counted over all docs and all of target in 10,000 buckets; a weight is the sum of the gains of a text's
    features, a score that and a Gumbel draw. Of the N rows with 20 words or more, the percent * N / 100 highest scores (rounded down) are
    drawn and ranked from 1, ties by doc_id, a missing doc_id last; the others have a null rank. Null and empty texts have no features and
    weigh 0. Repeated rows are rows of their own, ranked one after the other. Either table may be empty. Other columns are not looked at.
    The ranks are made by ranges of scores over all tasks. The result reads a table in the shared folder.
    """
    ship(docs.sparkSession)
    gain = gains(bucket_counts(docs), bucket_counts(target))
    scored = weigh(docs, gain).withColumn("score", F.col("weight") + noise())
    scored = stash(scored.withColumn("row", F.monotonically_increasing_id()), "scored")
    eligible = scored.where(F.col("n_words") >= MIN_WORDS)
    drawn = eligible.count() * percent // 100
    placed = numbered(eligible, [], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row").asc()], "rank")
    rest = scored.where(F.col("n_words") < MIN_WORDS)
    columns = ["doc_id", "n_features", "weight", "score"]
    ranks = placed.select(*columns, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank"))
    out = stash(ranks.unionByName(rest.select(*columns, F.lit(None).cast("long").alias("rank"))), "resampled")
    drop(scored, placed)
    return out
