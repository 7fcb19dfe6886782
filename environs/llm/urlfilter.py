"""URL filters by a sorted array of 64-bit digests.

The rules are kept as one file: the sorted xxh64 keys, the rules' full strings and their verdicts. The driver hands the
file to every executor (``SparkContext.addFile``; a replacement executor fetches it again), workers map it into memory,
probe it with a vectorised binary search, and compare the stored string before a hit counts. A probe is made for every
host suffix at a label and every path prefix of a length that some rule has, longest first.
"""

from __future__ import annotations

import os
import shutil
import struct
import uuid
from collections.abc import Iterable, Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import scratch, ship, worker

#: (verdict, host and path): the rule holds for the host, all its subdomains, and paths that begin with the path.
RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or where there is no ``://``."""
    if url is None:
        return "", ""
    _, found, rest = url.partition("://")
    if not found:
        return "", ""
    end = min((i for i in map(rest.find, "/?#") if i >= 0), default=len(rest))
    path = rest[end:]
    stop = min((i for i in map(path.find, "?#") if i >= 0), default=len(path))
    return rest[:end].translate(_LOWER), path[:stop]


def write_sorted(items: Iterable[tuple[int, bytes, bool]], path: str) -> None:
    """The file of (key, string, blocks) that come sorted by key: each section grows beside the others, and none is held in memory."""
    n, at, lengths = 0, 0, set()
    sections = [f"{path}.{x}" for x in ("keys", "ends", "verdicts", "strings")]
    with ExitStack() as open_:
        keys, ends, verdicts, strings = (open_.enter_context(open(x, "wb")) for x in sections)
        for key, string, blocks in items:
            n, at = n + 1, at + len(string)
            keys.write(struct.pack("<Q", key))
            ends.write(struct.pack("<q", at))
            verdicts.write(bytes([blocks]))
            strings.write(string)
            slash = string.find(b"/")
            lengths.add(len(string) - slash if slash >= 0 else 0)
    with open(path, "wb") as f:
        f.write(struct.pack("<qq", n, len(lengths)))
        for section, more in zip(sections, (b"", np.array(sorted(lengths, reverse=True), "<i8").tobytes(), b"", b"")):
            with open(section, "rb") as part:
                shutil.copyfileobj(part, f)
            f.write(more)
            os.remove(section)


def write_digests(rules: list[tuple[str, str]], path: str) -> None:
    """keys, string ends and verdicts, sorted by key; equal keys (a collision) stand side by side. For two verdicts on one string the last counts."""
    by_string = {s: v for v, s in rules}
    write_sorted(sorted((xxhash.xxh64_intdigest(s.encode()), s.encode(), v == "block") for s, v in by_string.items()), path)


def sorted_rules(rules: DataFrame) -> Iterator[tuple[int, bytes, bool]]:
    """rules(verdict, rule) in the order of their digests, sorted by the executors and read a partition at a time.

    Null rules are passed over. Of two verdicts on one rule, block counts.
    """

    def digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            strings = [x.encode() for x in b.column(0).to_pylist()]
            keys = np.array([xxhash.xxh64_intdigest(x) for x in strings], np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((keys ^ np.uint64(1 << 63)).view(np.int64)), pa.array(strings, pa.binary()), b.column(1)], ["key", "rule", "blocks"])

    one = rules.where(F.col("rule").isNotNull()).groupBy("rule").agg(F.max(F.col("verdict") == "block").alias("blocks"))
    for r in one.mapInArrow(worker(digested), "key long, rule binary, blocks boolean").orderBy("key", "rule").toLocalIterator():
        yield (r.key & ((1 << 64) - 1)) ^ (1 << 63), bytes(r.rule), bool(r.blocks)


class Digests:
    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n, m = struct.unpack("<qq", raw[:16].tobytes())
        at = 16
        self.keys, at = raw[at : at + 8 * n].view("<u8"), at + 8 * n
        self.ends, at = raw[at : at + 8 * n].view("<i8"), at + 8 * n
        self.path_lengths, at = raw[at : at + 8 * m].view("<i8").tolist(), at + 8 * m
        self.block, at = raw[at : at + n], at + n
        self.strings = raw[at:]

    def string(self, i: int) -> bytes:
        return self.strings[(self.ends[i - 1] if i else 0) : self.ends[i]].tobytes()

    def find(self, probes: list[bytes]) -> np.ndarray:
        """The rule of each probe, or -1."""
        out = np.full(len(probes), -1, np.int64)
        if not len(self.keys) or not probes:
            return out
        h = np.fromiter(map(xxhash.xxh64_intdigest, probes), np.uint64, len(probes))
        at = np.searchsorted(self.keys, h)
        for i in np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == h)):
            j = int(at[i])
            while j < len(self.keys) and self.keys[j] == h[i]:
                if self.string(j) == probes[i]:
                    out[i] = j
                    break
                j += 1
        return out

    def judge(self, parts: list[tuple[str, str]]) -> list[tuple[str | None, str | None]]:
        """(rule, verdict) of each (host, path): that of the longest rule which fits, else nulls."""
        probes: list[bytes] = []
        owner: list[int] = []
        for i, (host, path) in enumerate(parts):
            raw = path.encode("utf-8", "surrogatepass")
            ends = [raw[:n] for n in self.path_lengths if n <= len(raw)]
            if not host or not ends:
                continue
            h = host.encode("utf-8", "surrogatepass")
            while True:
                probes += [h + e for e in ends]
                owner += [i] * len(ends)
                cut = h.find(b".")
                if cut < 0:
                    break
                h = h[cut + 1 :]
        best: dict[int, int] = {}
        hits = self.find(probes)
        for k in np.flatnonzero(hits >= 0):
            i = owner[k]
            if i not in best or len(probes[k]) > len(probes[best[i]]):
                best[i] = k
        return [(probes[best[i]].decode(), "block" if self.block[hits[best[i]]] else "allow") if i in best else (None, None) for i in range(len(parts))]


def filter_urls(pages: DataFrame, rules: list[tuple[str, str]] | DataFrame | None = None, *, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """pages(page_id, url) -> page_id, host, path, rule, verdict, one row for each row.

    Null urls, urls without ``://`` and urls that no rule fits get a null rule and the default verdict. Equal rows and null
    ids stay. Other columns are not looked at. An empty table and an empty rule list work. A rule without a slash fits every path of its
    host and of all subdomains. rules: pairs of verdict and rule, or for
    long lists a table(verdict, rule), which passes through the driver's disk, not its memory.
    """
    ship(pages.sparkSession)
    name = f"environs-urls-{uuid.uuid4().hex}.bin"
    local = os.path.join(scratch(), name)
    if isinstance(rules, DataFrame):
        write_sorted(sorted_rules(rules), local)
    else:
        write_digests(RULES if rules is None else rules, local)
    pages.sparkSession.sparkContext.addFile(local)
    into = T.StructType([T.StructField(key, pages.schema[key].dataType), *[T.StructField(c, T.StringType()) for c in ("host", "path", "rule", "verdict")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = Digests(SparkFiles.get(name))
        for b in batches:
            parts = [split_url(u) for u in b.column(1).to_pylist()]
            found = digests.judge(parts)
            columns = [[p[0] for p in parts], [p[1] for p in parts], [r for r, _ in found], [v or default for _, v in found]]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in columns]], into.names)

    return pages.select(key, url).mapInArrow(worker(run), into)
