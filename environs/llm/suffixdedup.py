"""Removal of long repeated byte strings by shard suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts in a document with a smaller doc_id.

Sampling. Every string of LENGTH bytes is assigned to the position of the smallest hash among its K-byte strings (its
anchor; the leftmost if equal), so equal strings have the same anchor wherever they stand. Consecutive strings with one
anchor form a stretch, and its bytes are a piece. Hashes only say which shard a piece goes to; they decide nothing.

Sending. A task holds a few megabytes of text at a time and makes one piece of those that are equal byte by byte, with the places of
the smallest document that has it; places in larger documents go at once, for a smaller one is in hand. Pieces are packed by bucket of
their anchors, compressed and shuffled once. Anchors that a sample shows to be common are dealt by whole strings instead of stretches.

Shards. A bucket passes over anchors that only one document has. The others' distinct pieces are gathered into shards, the suffix array
of a shard is induced, permuted common prefixes give the classes of equal LENGTH-byte strings, and a string goes where its class has a
smaller document. Strings of different anchors are never equal, so shards are independent and no match is lost between them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix64, ship, stash, utf8, worker
from .suffixarray import permuted_lcp, suffix_array

LENGTH, K = 50, 16
SIDE = (LENGTH - K) // 2
#: Text that a task holds when it makes its pieces, text for each bucket, and bytes of a shard.
MERGE_BYTES, BUCKET_BYTES, SHARD_BYTES = 5_000_000, 5_000_000, 600_000
#: Text whose anchors are found together; a longer text is read in slices that overlap by LENGTH - 1 bytes.
CHUNK_BYTES, SLICE_BYTES = 250_000, 2_000_000
#: Bits of a place in a chunk; the others compare hashes.
PLACE_BITS = 28
#: One document in SAMPLE shows which anchors are common: those with more pieces than one in COMMON of a bucket's share. LISTED
#: anchors at most, and as many shared doc_ids, are sent to all tasks.
SAMPLE, COMMON, LISTED = 64, 4, 10_000

#: Bytes of an anchor's hash that are sent, the high ones.
KEY_BYTES = 6
KEY_MASK = ~U64((1 << (64 - 8 * KEY_BYTES)) - 1)
_B = 0x9E3779B97F4A7C15
_LOW, _HIGH = U64(0xD6E8FEB86659FD93), U64(0xA0761D6478BD642F)


def stretches(texts: list[bytes], raw: bytes) -> tuple[np.ndarray, ...]:
    """Of each stretch of the texts, which lie one after another in raw: text, start in raw, number of strings, anchor hash and place
    of the anchor in the stretch."""
    none = np.empty(0, np.int64)
    n = len(raw)
    sizes = np.array([len(x) for x in texts], np.int64)
    if n < LENGTH or sizes.max() < LENGTH:
        return none, none, none, none.astype(U64), none
    a = np.frombuffer(raw + b"\0" * 8, np.uint8)
    word = np.ndarray((n + 1,), "<u8", a.data, strides=(1,)).copy()
    with np.errstate(over="ignore"):
        h = word[: n - K + 1] * _LOW + word[8 : n - K + 9] * _HIGH
        h = (h ^ (h >> U64(32))) * U64(_B)
        h ^= h >> U64(29)
    # the smallest of the hashes' high bits, then the leftmost: one minimum finds both
    value = (h & ~U64((1 << PLACE_BITS) - 1)) | np.arange(len(h), dtype=U64)
    width, wanted = 1, LENGTH - K + 1
    while width < wanted:
        step = min(width, wanted - width)
        value = np.minimum(value[:-step], value[step:])
        width += step
    at = (value & U64((1 << PLACE_BITS) - 1)).astype(np.int32)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    start = np.arange(n - LENGTH + 1)
    ok = start + LENGTH <= ends[owner[: len(start)]]
    start, at = start[ok], at[: len(ok)][ok]
    first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)])
    s = start[first]
    # anchors are small hashes: they are mixed again to be dealt evenly, and keep KEY_BYTES
    return owner[s], s, np.diff(np.r_[first, len(start)]), mix64(h[at[first]]) & KEY_MASK, at[first] - s


def single(owner: np.ndarray, s: np.ndarray, count: np.ndarray, key: np.ndarray, anchor: np.ndarray, common: np.ndarray, raw: bytes) -> tuple[np.ndarray, ...]:
    """Stretches whose anchors are common are cut into single strings, with a hash of each whole string in the anchor's place."""
    at = np.minimum(np.searchsorted(common, key), max(0, len(common) - 1))
    cut = common[at] == key if len(common) else np.zeros(len(key), bool)
    if not cut.any():
        return owner, s, count, key, anchor
    n = count[cut]
    starts = np.repeat(s[cut] - np.cumsum(n) + n, n) + np.arange(n.sum())
    keys = np.array([xxhash.xxh64_intdigest(raw[a : a + LENGTH]) for a in starts.tolist()], U64) & KEY_MASK
    own, ones = np.repeat(owner[cut], n), np.ones(len(starts), np.int64)
    return np.r_[owner[~cut], own], np.r_[s[~cut], starts], np.r_[count[~cut], ones], np.r_[key[~cut], keys], np.r_[anchor[~cut], 0 * ones]


#: A place where a piece stands: its number (sent as the step from the place before), the number of its row and where it starts.
PLACE = np.dtype([("piece", "<u4"), ("row", "<u4"), ("start", "<i8")])
#: What tells rows apart: doc_id and, where rows share one, a hash of the text.
ROW = np.dtype([("doc", "<i8"), ("text", "<i8")])
HEAD = 3 * 8


def planes(x: np.ndarray) -> bytes:
    """The numbers byte by byte, all first bytes before all second ones: small numbers compress to little more than what they say."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.dtype.itemsize).T.tobytes()


def from_planes(b: bytes, kind: str, n: int, at: int) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8, n * width, at).reshape(width, n).T).view(kind).ravel()


def pack(pieces: list[bytes], key: np.ndarray, anchor: np.ndarray, places: np.ndarray, rows: np.ndarray) -> bytes:
    """Distinct pieces with their anchors, and their places in rows, compressed."""
    seen, number = np.unique(places["row"], return_inverse=True)
    by_doc = np.argsort(rows[seen]["doc"], kind="stable")
    rank = np.empty(len(seen), np.uint32)
    rank[by_doc] = np.arange(len(seen))
    own = rows[seen][by_doc]
    parts = [np.array([len(pieces), len(places), len(own)], "<i8").tobytes(), key.view(np.uint8).reshape(-1, 8)[:, 8 - KEY_BYTES :].tobytes()]
    parts += [np.array([len(x) - LENGTH for x in pieces], np.uint8).tobytes(), anchor.tobytes()]
    parts += [planes(np.diff(places["piece"], prepend=np.uint32(0))), planes(rank[number]), planes(places["start"]), planes(np.diff(own["doc"], prepend=0)), planes(own["text"])]
    return zstandard.ZstdCompressor(level=5).compress(b"".join([*parts, *pieces]))


class Packs:
    """The packs of a bucket, joined: keys and bytes of pieces, places and rows, numbered through."""

    def __init__(self, packs: list[bytes]):
        key, size, anchor, self.bodies, places, rows = [], [], [], [], [], []
        n_pieces = n_rows = 0
        for p in packs:
            b = zstandard.ZstdDecompressor().decompress(p)
            n, m, r = np.frombuffer(b, "<i8", 3).tolist()
            at = HEAD
            columns = []
            for kind, count in (("u1", n * KEY_BYTES), ("u1", n), ("u1", n), ("<u4", m), ("<u4", m), ("<i8", m), ("<i8", r), ("<i8", r)):
                columns.append(from_planes(b, kind, count, at))
                at += columns[-1].nbytes
            key.append(np.zeros((n, 8), np.uint8))
            key[-1][:, 8 - KEY_BYTES :] = columns[0].reshape(n, KEY_BYTES)
            size.append(columns[1].astype(np.int64) + LENGTH)
            anchor.append(columns[2])
            found = np.empty(m, PLACE)
            found["piece"], found["row"], found["start"] = np.cumsum(columns[3]) + n_pieces, columns[4] + n_rows, columns[5]
            places.append(found)
            own = np.empty(r, ROW)
            own["doc"], own["text"] = np.cumsum(columns[6]), columns[7]
            rows.append(own)
            self.bodies.append((n_pieces, b[at:]))
            n_pieces, n_rows = n_pieces + n, n_rows + r
        self.key, self.size, self.anchor = np.concatenate(key).view(U64).ravel(), np.concatenate(size), np.concatenate(anchor)
        self.places, self.rows = np.concatenate(places), np.concatenate(rows)

    def pieces(self, wanted: np.ndarray) -> list[bytes]:
        """The bytes of the wanted pieces, which are numbered upwards."""
        out: list[bytes] = []
        ends = [n for n, _ in self.bodies[1:]] + [len(self.key)]
        for (first, body), end in zip(self.bodies, ends):
            mine = wanted[np.searchsorted(wanted, first) : np.searchsorted(wanted, end)] - first
            size = self.size[first:end]
            to = np.cumsum(size)
            out += [body[a:b] for a, b in zip((to - size)[mine].tolist(), to[mine].tolist())]
        return out


OUT = "kind tinyint, doc_id long, text_hash long, at long, n int, records binary"


def gone(rows: np.ndarray, at: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """kind 0: n strings from at on go."""
    m = len(rows)
    columns = [pa.array(np.zeros(m, np.int8)), pa.array(rows["doc"].copy()), pa.array(rows["text"].copy()), pa.array(at.astype(np.int64)), pa.array(n.astype(np.int32)), pa.nulls(m, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "text_hash", "at", "n", "records"])


def pieces_of(texts: list[bytes], begins: np.ndarray, rows: np.ndarray, common: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pieces of the texts, their anchors' hashes and places, the pieces' places, and of each of these the number of strings."""
    ids: dict[bytes, int] = {}
    held, keys, anchors, counts = [], [], [], []
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size < CHUNK_BYTES):
            size += len(texts[hi])
            hi += 1
        raw = b"".join(texts[lo:hi])
        owner, s, count, key, anchor = single(*stretches(texts[lo:hi], raw), common, raw)
        known = len(ids)
        number = np.array([ids.setdefault(raw[a:b], len(ids)) for a, b in zip(s.tolist(), (s + count + LENGTH - 1).tolist())], np.int64)
        # the key of each piece that is new, by the first place that has it
        fresh, first = np.unique(number, return_index=True)
        first = first[fresh >= known]
        keys.append(key[first])
        anchors.append(anchor[first].astype(np.uint8))
        sizes = np.array([len(x) for x in texts[lo:hi]], np.int64)
        found = np.empty(len(s), PLACE)
        found["piece"], found["row"] = number, owner + lo
        found["start"] = s - (np.cumsum(sizes) - sizes)[owner] + begins[lo:hi][owner]
        held.append(found)
        counts.append(count)
        lo = hi
    return list(ids), np.concatenate(keys), np.concatenate(anchors), np.concatenate(held), np.concatenate(counts)


def sent(docs: DataFrame, n_buckets: int, common: np.ndarray) -> DataFrame:
    """Places that go at once (kind 0), and packs of pieces with the bucket in ``at`` (kind 2)."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts: list[bytes] = []
        of: list[tuple[int, int, int]] = []  # of each text: document, hash of the whole text, and where the slice begins in it
        size = 0

        def made() -> Iterator[pa.RecordBatch]:
            what = np.array(of, np.int64).reshape(-1, 3)
            rows = np.empty(len(of), ROW)
            rows["doc"], rows["text"] = what[:, 0], what[:, 1]
            pieces, key, anchor, places, count = pieces_of(texts, what[:, 2], rows, shared.value)
            doc = rows["doc"][places["row"]]
            least = np.full(len(pieces), np.iinfo(np.int64).max)
            np.minimum.at(least, places["piece"], doc)
            own = doc == least[places["piece"]]
            if not own.all():
                p = places[~own]
                yield gone(rows[p["row"]], p["start"], count[~own])
            places = places[own]
            bucket = ((key >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            places["piece"] = rank[places["piece"]]
            places = places[np.argsort(places["piece"], kind="stable")]
            key, anchor, bucket = key[order], anchor[order], bucket[order]
            cuts = np.r_[0, np.flatnonzero(np.diff(bucket)) + 1, len(bucket)]
            to = np.searchsorted(places["piece"], cuts)
            packs, of_bucket, size = [], [], 0
            for a, b, x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist(), to[:-1].tolist(), to[1:].tolist()):
                mine = places[x:y].copy()
                mine["piece"] -= a
                packs.append(pack([pieces[i] for i in order[a:b].tolist()], key[a:b], anchor[a:b], mine, rows))
                of_bucket.append(bucket[a])
                size += len(packs[-1])
                if size >= 1_000_000 or b == len(bucket):
                    m = len(packs)
                    columns = [pa.array(np.full(m, 2, np.int8)), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.array(of_bucket, np.int64)), pa.nulls(m, pa.int32()), pa.array(packs, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, ["kind", "doc_id", "text_hash", "at", "n", "records"])
                    packs, of_bucket, size = [], [], 0
            texts.clear()
            of.clear()

        for b in batches:
            for doc, h, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
                t = text.as_py()
                if doc is None or not t or len(t) < LENGTH:
                    continue
                for begin in range(0, len(t) - LENGTH + 1, SLICE_BYTES):
                    of.append((doc, h, begin))
                    texts.append(t[begin : begin + SLICE_BYTES + LENGTH - 1])
                    size += len(texts[-1])
                    if size >= MERGE_BYTES:
                        yield from made()
                        size = 0
        if texts:
            yield from made()

    return docs.select("doc_id", "text_hash", utf8("text")).mapInArrow(worker(run), OUT)


def common_anchors(docs: DataFrame, n_buckets: int) -> np.ndarray:
    """Anchors with so many different pieces, by a sample of the documents, that they would fill a good part of a bucket, sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t[:SLICE_BYTES] for x in b.column(0) if (t := x.as_py())]
            if texts:
                ids, key, *_ = pieces_of(texts, np.zeros(len(texts), np.int64), np.empty(0, ROW), np.empty(0, U64))
                k, n = np.unique(key, return_counts=True)
                # one row says how many pieces there are in all
                yield pa.RecordBatch.from_arrays([pa.array(np.r_[k[n > 1].view(np.int64), 0]), pa.array(np.r_[n[n > 1], len(ids)]), pa.array(np.r_[np.zeros(int((n > 1).sum()), bool), True])], ["key", "n", "all"])

    picked = docs.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(SAMPLE)) == 0).select(utf8("text").alias("text"))
    counts = picked.mapInArrow(worker(run), "key long, n long, all boolean").groupBy("key", "all").agg(F.sum("n").alias("n"))
    top = counts.orderBy(F.desc("all"), F.desc("n"), "key").limit(LISTED + 1).collect()  # LISTED keys at most
    total = sum(r.n for r in top if r["all"])
    most = max(64, total / n_buckets / COMMON)
    return np.sort(np.array([r.key for r in top if not r["all"] and r.n > most], np.int64).view(U64))


def shard_classes(text: np.ndarray) -> np.ndarray:
    """A class for each position of text such that equal LENGTH-byte strings have one class."""
    sa = suffix_array(text)
    lcp = permuted_lcp(text, sa)[sa]
    out = np.empty(len(text), np.int64)
    out[sa] = np.cumsum(lcp < LENGTH)
    return out


def smallest(pieces: list[bytes], least: np.ndarray) -> np.ndarray:
    """Of each string of the pieces, one after another, the smallest document that any piece with such a string has."""
    body = [x + b"\xff" + i.to_bytes(4, "big") for i, x in enumerate(pieces)]  # 0xff is in no text: matches end there
    text = np.frombuffer(b"".join(body), np.uint8)
    n = np.array([len(x) - LENGTH + 1 for x in pieces], np.int64)
    size = n + (LENGTH - 1 + 5)
    piece = np.repeat(np.arange(len(pieces)), n)
    at = np.arange(len(piece)) + np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n)
    classes = shard_classes(text)[at]
    best = np.full(classes.max() + 1, np.iinfo(np.int64).max)
    np.minimum.at(best, classes, least[piece])
    return best[classes]


def may_match(pieces: list[bytes], key: np.ndarray, anchor: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Which pieces, sorted by key, can have a string in two documents: those that are in several (shared), and those that have the SIDE
    bytes before or after their anchor in common with another piece, as a string with the anchor has as many on one side."""
    out = shared.copy()
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    ends = np.r_[begins[1:], len(key)]
    more = ends - begins > 1
    place = anchor.tolist()
    for lo, hi in zip(begins[more].tolist(), ends[more].tolist()):
        first: dict[tuple[bool, bytes], int] = {}
        for i in range(lo, hi):
            x, p = pieces[i], place[i]
            for side in ((False, x[p - SIDE : p]) if p >= SIDE else None, (True, x[p + K : p + K + SIDE]) if len(x) >= p + K + SIDE else None):
                if side and (other := first.setdefault(side, i)) != i:
                    out[i] = out[other] = True
    return out


def judged(packs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The places of a bucket that go."""
    b = Packs(packs)
    doc = b.rows["doc"][b.places["row"]]
    low, high = np.full(len(b.key), np.iinfo(np.int64).max), np.full(len(b.key), np.iinfo(np.int64).min)
    np.minimum.at(low, b.places["piece"], doc)
    np.maximum.at(high, b.places["piece"], doc)
    order = np.argsort(b.key, kind="stable")
    begins = np.flatnonzero(np.r_[True, b.key[order][1:] != b.key[order][:-1]])
    several = np.minimum.reduceat(low[order], begins) != np.maximum.reduceat(high[order], begins)
    wanted = np.sort(order[np.repeat(several, np.diff(np.r_[begins, len(order)]))])
    if not len(wanted):
        return
    # equal pieces are one, and they are put in the order of their anchors
    ids: dict[bytes, int] = {}
    number = np.full(len(b.key), -1)
    number[wanted] = [ids.setdefault(x, len(ids)) for x in b.pieces(wanted)]
    first = np.unique(number[wanted], return_index=True)[1]
    key, anchor, pieces = b.key[wanted][first], b.anchor[wanted][first], list(ids)
    least, most = np.full(len(pieces), np.iinfo(np.int64).max), np.full(len(pieces), np.iinfo(np.int64).min)
    np.minimum.at(least, number[wanted], low[wanted])
    np.maximum.at(most, number[wanted], high[wanted])
    order = np.argsort(key, kind="stable")
    pieces, key = [pieces[i] for i in order.tolist()], key[order]
    open_ = np.flatnonzero(may_match(pieces, key, anchor[order], (least != most)[order]))
    if not len(open_):
        return
    pieces, key, least = [pieces[i] for i in open_.tolist()], key[open_], least[order[open_]]
    rank = np.full(len(order) + 1, -1)  # the last entry is for those that aren't wanted
    rank[order[open_]] = np.arange(len(open_))
    number = rank[number]
    places = b.places[number[b.places["piece"]] >= 0]
    places["piece"] = number[places["piece"]]
    count = np.array([len(x) - LENGTH + 1 for x in pieces], np.int64)
    offset = np.cumsum(count) - count
    # a shard ends between anchors
    ends = np.cumsum(count + LENGTH - 1)
    cuts, last = [0], 0
    for at in [*(np.flatnonzero(key[1:] != key[:-1]) + 1).tolist(), len(key)]:
        if ends[at - 1] - last >= SHARD_BYTES or at == len(key):
            cuts.append(at)
            last = ends[at - 1]
    found = np.concatenate([smallest(pieces[x:y], least[x:y]) for x, y in zip(cuts[:-1], cuts[1:])])
    # a place goes as a whole, in part or not at all
    top, bottom = np.maximum.reduceat(found, offset), np.minimum.reduceat(found, offset)
    doc = b.rows["doc"][places["row"]]
    whole = doc > top[places["piece"]]
    if whole.any():
        p = places[whole]
        yield gone(b.rows[p["row"]], p["start"], count[p["piece"]])
    p = places[~whole & (doc > bottom[places["piece"]])]
    if len(p):
        n = count[p["piece"]]
        which = np.repeat(np.arange(len(p)), n)
        inside = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        goes = np.flatnonzero(b.rows["doc"][p["row"]][which] > found[offset[p["piece"]][which] + inside])
        head = np.flatnonzero(np.r_[True, (np.diff(goes) != 1) | (np.diff(which[goes]) != 0)])
        p = p[which[goes[head]]]
        yield gone(b.rows[p["row"]], p["start"] + inside[goes[head]], np.diff(np.r_[head, len(goes)]))


def met(mapped: DataFrame, n_buckets: int) -> DataFrame:
    """Packs -> the places that go; those that went at once pass through. A task reads one bucket, or a few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packs: dict[int, list[bytes]] = {}
        for b in batches:
            is_pack = b.column(0).to_numpy() == 2
            if not is_pack.all():
                yield b.filter(pa.array(~is_pack)).select(["doc_id", "text_hash", "at", "n"])
            held = b.filter(pa.array(is_pack))
            for bucket, records in zip(held.column(3).to_pylist(), held.column(5)):
                packs.setdefault(bucket, []).append(records.as_py())
        while packs:
            for found in judged(packs.popitem()[1]):
                yield found.select(["doc_id", "text_hash", "at", "n"])

    bucket = F.when(F.col("kind") == 2, F.col("at")).otherwise(F.pmod(F.xxhash64("doc_id", "at"), F.lit(n_buckets)))
    columns = ["kind", "doc_id", "text_hash", "at", "n", "records"]
    return mapped.repartition(n_buckets, bucket).select(columns).mapInArrow(worker(run), "doc_id long, text_hash long, at long, n int")


def marked(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> with text_hash, which tells rows of one doc_id apart: 0 where no rows with different texts share it."""
    h = F.xxhash64("text")
    shared = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(h).alias("a"), F.max(h).alias("z")).where("a <> z").select("doc_id")
    shared = stash(shared, "shared-ids")
    n = shared.limit(LISTED + 1).count()
    if n > LISTED:  # too many to send to all tasks: every row says its hash
        return docs.select("doc_id", h.alias("text_hash"), "text")
    if not n:
        return docs.select("doc_id", F.lit(0).cast("long").alias("text_hash"), "text")
    told = docs.join(F.broadcast(shared.withColumn("several", F.lit(True))), "doc_id", "left")
    return told.select("doc_id", F.when(F.col("several"), h).otherwise(F.lit(0)).cast("long").alias("text_hash"), "text")


def repeated(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text_hash, text) -> doc_id, text_hash, at, n: the strings that go, a table in the shared folder."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first().n or 0
    n_buckets = max(1, -(-size // BUCKET_BYTES))
    common = common_anchors(docs, n_buckets)
    return stash(met(sent(docs, n_buckets, common), n_buckets), "repeats")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (bytes).

    Texts are UTF-8 bytes, null is empty. Matches never cross documents, and are judged on the input. A null doc_id is in no
    order: its text neither loses bytes nor makes others lose any. Rows with one doc_id lose nothing to each other, only to smaller ones,
    and each by its own text. doc_id is a whole number. Empty tables give no rows; other columns are not looked at.
    """
    ship(docs.sparkSession)
    docs = marked(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    spans = repeated(docs).groupBy("doc_id", "text_hash").agg(F.collect_list(F.struct("at", "n")).alias("spans"))
    rows = docs.select("doc_id", "text_hash", utf8("text").alias("text"))
    both = rows.join(spans, ["doc_id", "text_hash"], "left").select("doc_id", "text", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, spans in zip(b.column(1), b.column(2)):
                t = text.as_py() or b""
                if not spans.is_valid:
                    out.append((len(t), 0, 0, t))
                    continue
                flat = spans.values
                starts, counts = flat.field("at").to_numpy(), flat.field("n").to_numpy()
                ends = np.minimum(starts + counts + LENGTH - 1, len(t))
                change = np.bincount(np.minimum(starts, len(t)), minlength=len(t) + 1) - np.bincount(ends, minlength=len(t) + 1)
                gone = np.cumsum(change[:-1]) > 0
                a = np.frombuffer(t, np.uint8)
                runs = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
                out.append((len(t), int(gone.sum()), runs, a[~gone].tobytes()))
            if out:
                n, r, s, kept = zip(*out)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(r), pa.array(s), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return both.mapInArrow(worker(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
