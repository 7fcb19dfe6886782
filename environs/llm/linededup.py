"""Line deduplication with two Bloom filters.

Pass 1 hashes the keys of all long lines. Each task merges equal hashes first, so a line in a third of all documents is
a few rows; hashes then go to the filter segment that their top bits name, where a once-seen filter finds those that
come again and sets their bits in the twice-seen filter. Pass 2 probes the twice-seen filter, and only suspected repeats
are shuffled: they are counted exactly by a 128-bit digest of the key, and the document that keeps a line is chosen.
Dropped digests go back to their documents by doc_id.

The filters' size follows the input, up to MAX_BITS; beyond that more lines are suspected by chance and shuffled, and the
result stays exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ASCII_SPACE, drop, free_name, heavy_keys, plain_columns, ship, spread_join, stash, utf8, worker

MIN_CHARS, MIN_DOCS = 40, 5
#: Bits of a hash that name the filter segment: there are as many as the input fills with SEGMENT_BYTES each, within these bounds.
SEGMENT_BITS, MOST_SEGMENT_BITS, SEGMENT_BYTES = 8, 16, 1 << 26
#: 32 MB: what a worker loads at most.
MAX_BITS = 1 << 28
MERGE_AT = 1_000_000


def digest(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the line's key, or None if the key is too short to be judged."""
    key = line.strip(ASCII_SPACE)
    if len(key) < min_chars:
        return None
    if not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def digests(text: bytes | None, min_chars: int) -> set[bytes]:
    if not text:
        return set()
    return {d for line in text.split(b"\n") if len(line) >= min_chars and (d := digest(line, min_chars))}


def _split(h: np.ndarray, segments: int, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segment and the two slots in it of each hash."""
    h = h.astype(np.uint64)
    s = np.uint64(slots - 1)
    return (h >> np.uint64(65 - segments.bit_length())).astype(np.int64), (h & s).astype(np.int64), ((h >> np.uint64(28)) & s).astype(np.int64)


def twice_seen(docs: DataFrame, min_chars: int) -> np.ndarray:
    """The packed twice-seen filter, one row for each segment."""
    chars = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    bits = 1 << 20
    while bits < min(MAX_BITS, 8 * chars // (min_chars + 1)):
        bits *= 2
    segment_bits = SEGMENT_BITS
    while segment_bits < MOST_SEGMENT_BITS and chars >> segment_bits > SEGMENT_BYTES:
        segment_bits += 1
    segments, slots = 1 << segment_bits, bits >> segment_bits

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []

        def merged() -> pa.RecordBatch:
            u, n = np.unique(np.frombuffer(b"".join(d[:8] for d in held), np.uint64), return_counts=True)
            seg = (u >> np.uint64(64 - segment_bits)).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array(seg), pa.array(u.view(np.int64)), pa.array(np.minimum(n, 2).astype(np.int8))], ["segment", "h", "n"])

        for b in batches:
            for text in b.column(0):
                held += digests(text.as_py(), min_chars)
                if len(held) >= MERGE_AT:
                    yield merged()
                    held = []
        if held:
            yield merged()

    def filters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        once: dict[int, np.ndarray] = {}
        twice: dict[int, np.ndarray] = {}
        for b in batches:
            u, at = np.unique(b.column(1).to_numpy().view(np.uint64), return_inverse=True)
            n = np.bincount(at, weights=b.column(2).to_numpy(zero_copy_only=False), minlength=len(u))
            seg, p, q = _split(u, segments, slots)
            for s in np.unique(seg).tolist():
                if s not in once:
                    once[s], twice[s] = np.zeros(slots, bool), np.zeros(slots, bool)
                mine = seg == s
                ps, qs = p[mine], q[mine]
                again = (once[s][ps] & once[s][qs]) | (n[mine] >= 2)
                twice[s][ps[again]] = True
                twice[s][qs[again]] = True
                once[s][ps] = True
                once[s][qs] = True
        for s in once:
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(twice[s]).tobytes()])], ["segment", "bits"])

    seen = docs.select(utf8("text").alias("text")).mapInArrow(worker(hashes), "segment int, h long, n tinyint")
    out = np.zeros((segments, slots // 8), np.uint8)
    for r in seen.repartition("segment").mapInArrow(worker(filters), "segment int, bits binary").collect():  # MAX_BITS bits at most
        out[r.segment] = np.frombuffer(r.bits, np.uint8)
    return out


def suspects(docs: DataFrame, twice: np.ndarray, min_chars: int) -> DataFrame:
    """doc_id and digest of each line, once a document, whose hash the filter may have seen twice."""
    shared = docs.sparkSession.sparkContext.broadcast(twice)
    segments, slots = twice.shape[0], twice.shape[1] * 8

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = shared.value
        for b in batches:
            owner: list[int] = []
            found: list[bytes] = []
            for i, text in enumerate(b.column(1)):
                new = digests(text.as_py(), min_chars)
                found += new
                owner += [i] * len(new)
            if not found:
                continue
            seg, p, q = _split(np.frombuffer(b"".join(d[:8] for d in found), np.uint64), segments, slots)
            hit = (bits[seg, p >> 3] >> (7 - (p & 7)).astype(np.uint8)) & (bits[seg, q >> 3] >> (7 - (q & 7)).astype(np.uint8)) & 1
            at = np.flatnonzero(hit)
            ids = b.column(0).take(pa.array(np.array(owner, np.int64)[at]))
            yield pa.RecordBatch.from_arrays([ids, pa.array([found[i] for i in at], pa.binary())], ["doc_id", "digest"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(worker(run), f"doc_id {kind}, digest binary")


#: Common lines whose keepers are sent to all tasks, at most: 24 bytes each.
KNOWN = 250_000


def common_lines(pairs: DataFrame, min_docs: int) -> DataFrame:
    """digest, n and keeper of lines in min_docs documents or more; a line in a third of all is counted before it is shuffled."""
    return stash(pairs.distinct().groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs), "common")


def dropped_lines(pairs: DataFrame, common: DataFrame) -> DataFrame:
    """doc_id and the digests of the lines that it loses, a table in the shared folder. A heavy line's keeper goes to all its parts."""
    lost = spread_join(pairs, common.select("digest", "keeper"), "digest", heavy_keys(common, "digest", "n")).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("keeper")))
    return stash(lost.groupBy("doc_id").agg(F.collect_set("digest").alias("gone")), "dropped")


class Keepers:
    """The common lines in memory: sorted digests, and the document that keeps each."""

    def __init__(self, digests: list[bytes], keepers: list):
        order = sorted(range(len(digests)), key=digests.__getitem__)
        self.digests = np.array([digests[i] for i in order], "V16") if order else np.empty(0, "V16")
        self.first = np.frombuffer(self.digests.tobytes(), ">u8")[::2].astype(np.uint64)
        self.keepers = [keepers[i] for i in order]

    def gone(self, doc, found: list[bytes]) -> set[bytes]:
        """Those of a document's digests that are common lines which another document keeps."""
        first = np.frombuffer(b"".join(found), ">u8")[::2].astype(np.uint64)
        at = np.searchsorted(self.first, first)
        hit = np.flatnonzero((at < len(self.first)) & (self.first[np.minimum(at, len(self.first) - 1)] == first)) if len(self.first) else ()
        out = set()
        for i in hit:
            j = int(at[i])
            while j < len(self.first) and self.first[j] == first[i]:  # digests that begin alike stand side by side
                if self.digests[j].tobytes() == found[i] and self.keepers[j] != doc:
                    out.add(found[i])
                j += 1
        return out


def dropped(docs: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """row (a struct of the columns of docs) and lines (n_lines, n_dropped, text).

    Where the common lines are few enough to be sent to all tasks, documents are read where they lie; beyond KNOWN the lines that go are
    joined with their documents.
    """
    ship(docs.sparkSession)
    slim = docs.select("doc_id", "text")
    pairs = stash(suspects(slim, twice_seen(slim, min_chars), min_chars), "lines")
    common = common_lines(pairs, min_docs)
    rows = docs.select(F.col("doc_id").alias("id"), F.struct(*plain_columns(docs)).alias("row"), utf8("text").alias("utf8"))
    shared = None
    if common.limit(KNOWN + 1).count() <= KNOWN:
        known = common.select("digest", "keeper").toArrow()
        shared = docs.sparkSession.sparkContext.broadcast(Keepers(known["digest"].to_pylist(), known["keeper"].to_pylist()))
        rows = rows.select("row", "id", "utf8")
    else:
        drops = dropped_lines(pairs, common)
        rows = rows.join(drops, F.col("id").eqNullSafe(F.col("doc_id")), "left").select("row", "gone", "utf8")
    drop(pairs, common)
    into = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("lines", T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()), T.StructField("text", T.BinaryType())]))])

    def known_of(x: pa.Scalar, raw: bytes) -> set[bytes]:
        if shared is None:
            return set(x.as_py()) if x.is_valid else set()
        found = sorted(digests(raw, min_chars))
        return shared.value.gone(x.as_py(), found) if found else set()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n_lines, n_dropped, texts = [], [], []
            for gone, text in zip(b.column(1), b.column(2)):
                raw = text.as_py() or b""
                lines = raw.split(b"\n")
                rest = lines
                if known := known_of(gone, raw):
                    rest = [x for x in lines if len(x) < min_chars or digest(x, min_chars) not in known]
                    raw = b"\n".join(rest)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(rest))
                texts.append(raw)
            s = pa.StructArray.from_arrays([pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(texts, pa.binary())], ["n_lines", "n_dropped", "text"])
            yield pa.RecordBatch.from_arrays([b.column(0), s], ["row", "lines"])

    return rows.mapInArrow(worker(run), into)


def dedup_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs(doc_id, text, ...) -> the same rows and columns, and a struct ``lines`` of n_lines, n_dropped and text (UTF-8).

    A line's key is the line without ASCII white space at its ends and with A-Z lower-cased. Keys of at least min_chars code
    points in at least min_docs documents (distinct doc_ids) lose all their lines but those in the document with the largest
    doc_id. Null and empty texts are one empty line. A null doc_id is one document, below all others. Rows with the
    same doc_id are one document when counted; each of them loses its lines. Other columns may have any names; where one is
    called ``lines``, ours is ``lines_1``.
    """
    return dropped(docs, min_chars, min_docs).select("row.*", F.col("lines").alias(free_name(docs.columns, "lines")))


def without_repeats(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """docs with their texts (and n_chars, where there is one) after dropping; rows that lose nothing stay as they are.

    Odd rows are treated as in ``dedup_lines``.
    """
    d = dropped(docs, min_chars, min_docs)
    changed = F.col("lines.n_dropped") > 0
    new = F.decode(F.col("lines.text"), "UTF-8")
    out = {c: F.col(f"row.`{c}`") for c in docs.columns}
    text = F.when(changed, new).otherwise(out["text"])
    out["text"] = text
    if "n_chars" in out:
        out["n_chars"] = F.when(changed, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(out["n_chars"])
    return d.select(*[x.alias(c) for c, x in out.items()])
