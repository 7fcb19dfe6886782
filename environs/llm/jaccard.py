"""N-gram Jaccard self-join over size-banded tiles, with hashed bitmap signatures before exact intersections.

A document's set holds 48-bit hashes of its distinct word shingles. Documents with equal sets are one node.

Tiles. Sets are banded by size; tile t compares the sets of band t with each other and with those smaller ones that are
large enough to link with them. Two sets link at ``percent`` only if their symmetric difference is at most
d = (100 - percent) / (100 + percent) * (|A| + |B|). In a tile the hash space is cut into P > d parts, so two sets that link
agree on at least one whole part; P has room for parts that are empty, which aren't used. Sets that agree on a part meet in a
bucket. A passage that many documents share rarely fills a whole part of theirs, so buckets of common passages stay small, no
link can be missed, and no statistics of the corpus are needed.

Links. (1) Each node is compared with the bucket centre that it meets most often, and components are made of the links
found. (2) In buckets that still hold several components, pairs of different components whose bitmaps allow a link are
compared: first a forest of such pairs, at most as many as there are components, as often as ROUNDS says, then all that are
left. Every pair that links is then in one component: large groups of copies take a number of comparisons in proportion to their size.

A comparison bounds the overlap from above by the signatures, |A n B| <= (|A| + |B| - popcount(a xor b)) / 2 for
parity bitmaps a and b, and only then intersects the sorted arrays. Bitmaps grow with their sets, for a popcount says nothing
about sets of more elements than bits; two of different length are compared after the longer one is folded. Buckets are first
judged by bitmaps folded to BRIEF_BITS, and the pairs that are left by the whole ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from environs.operators.graph import components

from .common import U64, WordHashes, drop, hashed_words, heavy_keys, mix64, parts_of, ship, signed, spread_join, stash, utf8, window_hashes, worker

SHINGLE, PERCENT = 5, 80
RATIO = 1.6
#: Bits of a bitmap for each element, at least; of any bitmap, at least, and of the one that is kept beside buckets.
BITS_AN_ELEMENT, BRIEF_BITS = 2, 1024
#: Bytes of a hash that are kept, the high ones, and bits of the bitmap that keeps sets of other documents at home, at most.
KEPT_BYTES, MAX_BITMAP = 6, 1 << 28
KEPT = ~U64((1 << (64 - 8 * KEPT_BYTES)) - 1)
#: Rounds in which buckets give a forest of their open pairs before they give all of them.
ROUNDS = 2
#: Nodes of a bucket that a task holds at a time, of which it compares all whose bitmaps allow a link.
BLOCK_ROWS = 8_192


def shingle_set(text: bytes | None, k: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes, of 48 bits, of all k-word shingles; of the whole sequence if it is shorter."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, U64)
    h = hashed_words(words, known)
    return np.unique(window_hashes(h, min(k, len(h))) & KEPT)


def node_of(s: np.ndarray) -> tuple[int, int]:
    """128 bits that name the set, as two signed numbers."""
    d = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
    return int(d[0]), int(d[1])


def signature(s: np.ndarray) -> np.ndarray:
    """Bit i, of a power of two of them, is the parity of the number of elements that hash to i."""
    bits = BRIEF_BITS
    while bits < BITS_AN_ELEMENT * len(s):
        bits *= 2
    place = ((s >> U64(16)) & U64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(place, minlength=bits).astype(np.uint8) & 1, bitorder="little").view(U64)


def folded(x: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps in rows, brought to a number of 64-bit words: the bitmaps that the same sets have with fewer bits."""
    while x.shape[-1] > words:
        half = x.shape[-1] // 2
        x = x[..., :half] ^ x[..., half:]
    return x


def packed(s: np.ndarray) -> bytes:
    return s.view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    a = np.zeros((len(b) // KEPT_BYTES, 8), np.uint8)
    a[:, 8 - KEPT_BYTES :] = np.frombuffer(b, np.uint8).reshape(-1, KEPT_BYTES)
    return a.view(U64).ravel()


#: Empty parts that a tile has room for, in deviations above the mean; the next number is tried when a set has more.
ROOM = (8, 16, 32)


@lru_cache(maxsize=4096)
def tile(t: int, percent: int, room: int = ROOM[0]) -> tuple[int, int, int]:
    """Smallest and largest size of band t, and the parts of its tile."""
    low = 1
    for _ in range(t):
        low = max(low + 1, int(low * RATIO))
    high = max(low + 1, int(low * RATIO)) - 1
    d = (100 - percent) * 2 * high // (100 + percent)
    spare, parts = 0, d + 1
    for _ in range(20):  # empty parts that a set of the largest size may have
        empty = parts * float(np.exp(-high / parts))
        new = int(np.ceil(empty + room * empty**0.5 + room - 2))
        if new <= spare or parts > 4 * (d + 1) + 32:
            break
        spare = new
        parts = d + 1 + spare
    return low, high, parts


def tiles_of(n: int, percent: int) -> list[int]:
    """The tiles that a set of n elements takes part in."""
    t = 0
    while tile(t, percent)[1] < n:
        t += 1
    out = [t]
    while 100 * n >= percent * tile(t + 1, percent)[0]:
        t += 1
        out.append(t)
    return out


class SlackError(RuntimeError):
    """A set leaves more parts of a tile empty than the tile allows for: links could be missed."""


def bucket_keys(s: np.ndarray, percent: int, room: int = ROOM[0]) -> np.ndarray:
    """A key for each part, of each tile, that the set has elements in. Sets too small to differ and link have none."""
    n = len(s)
    out = []
    for t in tiles_of(n, percent) if n else []:
        _, high, parts = tile(t, percent, room)
        if (100 - percent) * 2 * high < 100 + percent:
            continue  # only equal sets link here
        part = ((s >> U64(32)) * U64(parts)) >> U64(32)
        first = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
        partner = min(high, 100 * n // percent)
        if parts - len(first) >= parts - (100 - percent) * (n + partner) // (100 + percent):
            raise SlackError(f"{parts - len(first)} of {parts} parts are empty in a set of {n}")
        with np.errstate(over="ignore"):
            total = np.add.reduceat(mix64(s), first)
            out.append(mix64(total ^ mix64(part[first] * U64(4096) + U64(t))))
    return np.concatenate(out) if out else np.empty(0, U64)


#: Sets that a task remembers to have given.
REMEMBERED = 1_000_000


def nodes(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n (set size), node, node2, and where a task meets a node first brief and bits (bitmaps) and elements (the set, packed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = WordHashes(), set()
        for b in batches:
            out: list[tuple] = []
            size, first = 0, 0
            for i, text in enumerate(b.column(1)):
                s = shingle_set(text.as_py(), k, known)
                x, y = node_of(s)
                new = len(s) and (x, y) not in done
                if new and len(done) < REMEMBERED:
                    done.add((x, y))
                bits = signature(s) if new else None
                out.append((len(s), x, y, folded(bits, BRIEF_BITS // 64).tobytes() if new else None, bits.tobytes() if new else None, packed(s) if new else None))
                size += len(s)
                if size > 2_000_000 or i == b.num_rows - 1:
                    n, a, c, *bodies = zip(*out)
                    columns = [pa.array(v, pa.int64()) for v in (n, a, c)] + [pa.array(v, pa.binary()) for v in bodies]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(out)), *columns], ["doc_id", "n", "node", "node2", "brief", "bits", "elements"])
                    out, size, first = [], 0, i + 1

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", utf8("text").alias("text")).mapInArrow(worker(run), f"doc_id {kind}, n long, node long, node2 long, brief binary, bits binary, elements binary")


def keyed(members: DataFrame, percent: int, room: int = ROOM[0]) -> DataFrame:
    """key, node: the buckets of each set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, names, size = [], [], 0
            for i, (name, elements) in enumerate(zip(b.column(0).to_pylist(), b.column(1))):
                keys.append(bucket_keys(unpacked(elements.as_py()), percent, room))
                names.append(np.full(len(keys[-1]), name, np.int64))
                size += len(keys[-1])
                if size > 500_000 or i == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(keys))), pa.array(np.concatenate(names))], ["key", "node"])
                    keys, names, size = [], [], 0

    return members.where("elements is not null").select("node", "elements").mapInArrow(worker(run), "key long, node long")


def shared_buckets(rows: DataFrame) -> DataFrame:
    """rows(key, node) -> key, node, centre for buckets of several nodes, centre being the smallest; each node once."""
    s = rows.repartition("key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = node = centre = None  # of the last row read
        pending = None  # the first row of a bucket, until another node joins it
        for b in batches:
            if not b.num_rows:
                continue
            k, v = b.column(0).to_numpy(), b.column(1).to_numpy()
            fresh = np.r_[key is None or k[0] != key or v[0] != node, (k[1:] != k[:-1]) | (v[1:] != v[:-1])]
            k, v = k[fresh], v[fresh]
            if not len(k):
                continue
            begins = np.r_[key is None or k[0] != key, k[1:] != k[:-1]]
            at = np.maximum.accumulate(np.where(begins, np.arange(len(k)), -1))
            c = np.where(at >= 0, v[at], centre if centre is not None else 0)
            joined = np.r_[~begins[1:], False]  # a row whose next row is in its bucket
            out_k, out_v, out_c = [], [], []
            if pending is not None and not begins[0]:
                out_k.append(np.array([pending[0]]))
                out_v.append(np.array([pending[1]]))
                out_c.append(np.array([pending[1]]))
            pending = None
            keep = ~begins | joined
            out_k.append(k[keep])
            out_v.append(v[keep])
            out_c.append(c[keep])
            if begins[-1]:
                pending = (k[-1], v[-1])
            key, node, centre = k[-1], v[-1], c[-1]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (out_k, out_v, out_c)], ["key", "node", "centre"])

    return s.mapInArrow(worker(run), "key long, node long, centre long")


def bitmap(rows: DataFrame, column: str, count: int) -> np.ndarray:
    """One bit for each hash in a column, packed; at most MAX_BITMAP bits. Its slots are made in tasks, by segment."""
    bits = 1 << 16
    while bits < min(MAX_BITMAP, 16 * count):
        bits *= 2
    segments = 64
    slots = bits // segments

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            p = (b.column(1).to_numpy().view(U64) & U64(bits - 1)).astype(np.int64)
            for s in np.unique(p // slots).tolist():
                held.setdefault(s, np.zeros(slots, bool))[p[p // slots == s] % slots] = True
        for s, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([s], pa.int32()), pa.array([np.packbits(x).tobytes()])], ["segment", "bits"])

    cut = F.floor(F.col(column).bitwiseAND(F.lit(bits - 1)) / F.lit(slots)).cast("int")
    out = np.zeros((segments, slots // 8), np.uint8)
    for r in rows.select(cut.alias("segment"), column).repartition("segment").mapInArrow(worker(run), "segment int, bits binary").collect():  # MAX_BITMAP bits at most
        out[r.segment] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def sets_of(members: DataFrame, wanted: DataFrame, body: str) -> DataFrame:
    """wanted(node) -> node, n and the column named in body. A bitmap of the wanted nodes keeps most other sets from being shuffled."""
    filled = bitmap(wanted, "node", wanted.count())
    shared = members.sparkSession.sparkContext.broadcast(filled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = shared.value
        mask = U64(len(seen) * 8 - 1)
        for b in batches:
            p = (b.column(0).to_numpy().view(U64) & mask).astype(np.int64)
            at = np.flatnonzero(seen[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1)
            if len(at):
                yield b.take(pa.array(at))

    found = members.where("elements is not null").select("node", "n", body).mapInArrow(worker(run), f"node long, n long, {body} binary")
    return found.dropDuplicates(["node"]).join(wanted, "node", "left_semi")


def may_link(n: int, m: np.ndarray, popcounts: np.ndarray, percent: int) -> np.ndarray:
    """The upper bound on the overlap allows a link."""
    most = np.minimum((n + m - popcounts) // 2, np.minimum(n, m))
    return (100 + percent) * most >= percent * (n + m)


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """pairs(centre, node) -> those that link. A centre's set is read once, or once in each part that a heavy one is dealt to."""
    heavy = heavy_keys(pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("members")), "centre", "members")
    parts = parts_of("centre", heavy) if heavy else F.lit(1)
    salt = F.pmod(F.hash("node"), parts).cast("int")
    copies = F.sequence(F.lit(0), (parts - 1).cast("int"))
    body = ["n", "elements"]
    members = pairs.select("centre", salt.alias("salt"), F.lit(1).alias("kind"), "node").join(sets, "node").select("centre", "salt", "kind", "node", *body)
    heads = pairs.select("centre").distinct().join(sets.withColumnRenamed("node", "centre"), "centre")
    heads = heads.select("centre", F.explode(copies).alias("salt"), F.lit(0).alias("kind"), F.col("centre").alias("node"), *body)
    rows = heads.union(members).repartition("centre", "salt").sortWithinPartitions("centre", "salt", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = None
        for b in batches:
            us, vs = [], []
            for centre, _, kind, node, n, elements in zip(*[c.to_pylist() for c in b.columns]):
                if kind == 0:
                    head = (centre, n, unpacked(elements))
                    continue
                both = len(np.intersect1d(head[2], unpacked(elements), assume_unique=True))
                if 100 * both >= percent * (head[1] + n - both):
                    us.append(centre)
                    vs.append(node)
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(us), pa.array(vs)], ["u", "v"])

    return rows.mapInArrow(worker(run), "u long, v long")


class Forest(dict):
    """Union-find over the roots that a task has joined."""

    def find(self, x: int) -> int:
        while (up := self.get(x, x)) != x:
            self[x] = self.get(up, up)
            x = up
        return x


def possible(pairs: DataFrame, info: DataFrame, percent: int) -> DataFrame:
    """pairs(centre, node) whose sizes and whole bitmaps allow a link: only these have their sets fetched."""
    a = info.select(F.col("node").alias("centre"), F.col("n").alias("n1"), F.col("bits").alias("bits1"))
    heavy = heavy_keys(pairs.groupBy("centre").agg(F.count(F.lit(1)).alias("members")), "centre", "members")
    both = spread_join(pairs.join(info, "node"), a, "centre", heavy, spread="node").select("centre", "node", "n", "bits", "n1", "bits1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (b.column(c).to_pylist() for c in ("bits", "bits1"))
            widths = np.array([(len(i), len(j)) for i, j in zip(x, y)], np.int64) // 8
            n, m = b.column("n").to_numpy(), b.column("n1").to_numpy()
            ok = np.zeros(b.num_rows, bool)
            for w in np.unique(widths, axis=0):
                at = np.flatnonzero((widths == w).all(1))
                one, two = (folded(np.frombuffer(b"".join(z[i] for i in at.tolist()), U64).reshape(len(at), -1), int(w.min())) for z in (x, y))
                ok[at] = may_link(n[at], m[at], np.bitwise_count(one ^ two).sum(1, dtype=np.int64), percent)
            yield b.select(["centre", "node"]).filter(pa.array(ok))

    return both.mapInArrow(worker(run), "centre long, node long")


def open_pairs(buckets: DataFrame, labels: DataFrame, info: DataFrame, percent: int, forest: bool) -> DataFrame:
    """buckets(key, node) -> (null, centre, node) for pairs of nodes in one bucket but in different components whose sizes and
    bitmaps allow a link, and (key, null, node) for the rows that have such a partner: no other row needs to be read again.

    forest: of the pairs only those that join components which no other pair given by the task has joined.

    A bucket of more than BLOCK_ROWS nodes is dealt into blocks of that size, and each two of them are compared in a task of their own.
    """
    b = buckets.select("key", "node").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node"))
    several = b.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("z"), F.count(F.lit(1)).alias("rows")).where("a <> z")
    mixed = stash(several.select("key", "rows", F.ceil(F.col("rows") / F.lit(BLOCK_ROWS)).cast("int").alias("blocks")), "mixed")
    rows = spread_join(b, mixed.select("key", "blocks"), "key", heavy_keys(mixed, "key", "rows"), spread="node").join(info, "node")
    rows = rows.withColumn("own", F.pmod(F.hash("node"), F.col("blocks")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.least("own", j) * F.col("blocks") + F.greatest("own", j))
    rows = rows.withColumn("tile", F.explode(F.when(F.col("blocks") > 1, meets).otherwise(F.array(F.lit(0)))))
    rows = rows.repartition("key", "tile").sortWithinPartitions("key", "tile", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, place, held, done, trees = None, None, [], set(), Forest()

        def judged() -> Iterator[tuple]:
            if len(held) < 2:
                return
            v = np.array([x[0] for x in held])
            root = np.array([x[1] for x in held])
            n = np.array([x[2] for x in held])
            bits = np.frombuffer(b"".join(x[3] for x in held), U64).reshape(len(held), -1)
            own = np.array([x[4] for x in held])
            apart = own.min() != own.max()  # two blocks: each has been compared with itself elsewhere
            tree = np.array([trees.find(r) for r in root.tolist()])
            alive = np.zeros(len(held), bool)
            for i in range(len(held) - 1):
                end = np.searchsorted(n, 100 * n[i] // percent, "right")
                j = np.flatnonzero((root[i + 1 : end] != root[i]) & (not apart or own[i + 1 : end] != own[i])) + i + 1
                if not len(j):
                    continue
                j = j[may_link(int(n[i]), n[j], np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64), percent)]
                if not len(j):
                    continue
                alive[i] = alive[j] = True
                if forest:
                    j = j[tree[j] != tree[i]]
                    j = j[np.unique(tree[j], return_index=True)[1]]
                    other = tree[j]
                    for r in other.tolist():
                        trees[r] = int(tree[i])
                    tree[np.isin(tree, other)] = tree[i]
                for x in v[j].tolist():
                    p = (min(int(v[i]), x), max(int(v[i]), x))
                    if p not in done:
                        if len(done) < REMEMBERED:
                            done.add(p)
                        yield (None, *p)
            if forest:
                for x in v[alive].tolist():
                    yield (key, None, x)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["key", "centre", "node"])

        out: list[tuple] = []
        for b in batches:
            for k, node, root, n, bits, own, at in zip(*[b.column(x).to_pylist() for x in ("key", "node", "root", "n", "bits", "own", "tile")]):
                if (k, at) != (key, place):
                    out += judged()
                    key, place, held = k, at, []
                held.append((node, root, n, bits, own))
            if out:
                yield batch(out)
                out = []
        out += judged()
        if out:
            yield batch(out)

    found = stash(rows.select("key", "node", "root", "n", "bits", "own", "tile").mapInArrow(worker(run), "key long, centre long, node long"), "open")
    drop(mixed)
    return found


def named_apart(members: DataFrame) -> DataFrame:
    """members with a node for each set: sets whose 64 bits agree though their 128 differ, a handful in 10**10, get new ones.

    Their number is the square of that of the sets over 2**65, so they can be listed.
    """
    for turn in range(8):
        both = members.where("n > 0").groupBy("node").agg(F.min("node2").alias("a"), F.max("node2").alias("z"))
        shared = [r.node for r in both.where("a <> z").select("node").collect()]
        if not shared:
            return members
        members = members.withColumn("node", F.when(F.col("node").isin(shared), F.xxhash64("node", "node2", F.lit(turn))).otherwise(F.col("node")))
    raise RuntimeError("sets keep sharing names")


def bucketed(members: DataFrame, percent: int) -> DataFrame:
    """The shared buckets of all sets, with more room for empty parts where a set needs it."""
    for room in ROOM:
        try:
            return stash(shared_buckets(keyed(members, percent, room)), "buckets")
        except Exception as e:
            if SlackError.__name__ not in str(e) or room == ROOM[-1]:
                raise
    raise AssertionError


def named_components(members: DataFrame, labels: DataFrame) -> DataFrame:
    """members(doc_id, n, node), labels(node, root) -> doc_id, n_shingles, component_id.

    Copies of one set and components may hold a third of all rows: minima are combined before they are shuffled, by node and then by
    root, and heavy nodes and roots are dealt over all tasks when the minima go back.
    """
    slim = members.select("doc_id", "n", "node")
    nodes = stash(slim.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    sized = labels.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    least = nodes.join(labels, "node").groupBy("root").agg(F.min("least").alias("component"))
    linked_nodes = spread_join(labels, least, "root", heavy_keys(sized, "root", "n"), spread="node").select("node", "component")
    # a set that one document has and that links with nothing needs no answer
    answers = nodes.join(linked_nodes, "node", "left").where("copies > 1 or component is not null").select("node", F.coalesce("component", "least").alias("component"))
    found = spread_join(slim, answers, "node", heavy_keys(nodes, "node", "copies"), "left")
    out = stash(found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id")), "components")
    drop(nodes)
    return out


def join_components(docs: DataFrame, *, shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """docs(doc_id, text) -> doc_id, n_shingles, component_id: the smallest doc_id reachable by links, itself included.

    Words are runs of non-white-space with A-Z lower-cased. Two documents link when 100 * |A n B| >= percent * |A u B| of
    their sets of shingles; a text with fewer words is one shingle. Null, empty and blank texts have an empty set and link with
    nothing. Repeated rows link with each other. A null doc_id is passed over when the smallest is chosen. Other columns are not
    looked at. An empty table gives no rows. The result is a table in the shared folder; what was made for it is gone.
    """
    ship(docs.sparkSession)
    members_table = stash(nodes(docs.select("doc_id", "text"), shingle), "sets")
    members = named_apart(members_table)
    buckets = bucketed(members, percent)
    brief = members.where("bits is not null").groupBy("node").agg(F.first("n").alias("n"), F.first("brief").alias("bits"))

    def compared(pairs: DataFrame) -> DataFrame:
        named = stash(pairs.select("node").union(pairs.select("centre")).distinct(), "wanted")
        close = stash(possible(pairs, sets_of(members, named, "bits"), percent), "possible")
        wanted = stash(close.select("node").union(close.select("centre")).distinct(), "wanted")
        found = stash(linked(close, sets_of(members, wanted, "elements"), percent), "links")
        drop(named, close, wanted)
        return found

    meetings = buckets.where("centre <> node").groupBy("node", "centre").agg(F.count(F.lit(1)).alias("times"))
    best = F.max_by("centre", F.struct("times", -F.col("centre")))
    first = stash(meetings.groupBy("node").agg(best.alias("centre")).select("centre", "node"), "first")
    found = [compared(first)]
    drop(first)
    labels = components(found[0])
    left = buckets
    for turn in range(ROUNDS + 1):
        opened = open_pairs(left, labels, brief, percent, turn < ROUNDS)
        drop(buckets)
        more = opened.where("key is null").select("centre", "node").distinct()
        if not more.limit(1).count():
            drop(opened)
            break
        found.append(compared(more))
        before, labels = labels, components(reduce(DataFrame.union, found))
        drop(before)
        buckets, left = opened, opened.where("key is not null").select("key", "node").distinct()
    drop(buckets, *found)
    out = named_components(members, labels)
    drop(members_table, labels)
    return out


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents of docs without the copies: of each group the one with the smallest doc_id, a missing one being the last.

    Copies are told apart by doc_id and a hash of the text, so of different texts under one doc_id, or under none, one stays.
    Rows that are equal in both are one document and stay or go together. Texts without a word are no copies of each other and all
    stay. The columns are those of docs, whatever their names.
    """
    row = F.struct(F.col("doc_id").isNull().alias("missing"), F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash"))
    groups = join_components(docs.select(row.alias("doc_id"), "text"), **options)
    gone = stash(groups.where(~F.col("component_id").eqNullSafe(F.col("doc_id"))).select("doc_id").distinct(), "copies")
    drop(groups)
    # the row travels in a struct: no name in it clashes with ours
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), row.alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
