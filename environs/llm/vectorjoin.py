"""Near duplicates among embeddings by an epsilon grid order join (operator 12).

Unit vectors with a cosine of at least c are within eps = sqrt(2 - 2c) of each other. Vectors are turned to principal axes, which keeps distances,
and sorted by the cells, eps wide, of the leading axes: the grid order. The order is cut into intervals with a box each, and intervals
of 8, 64 ... intervals above them. Pairs of intervals are joined recursively from the top: those whose boxes are further apart than eps are
skipped, those whose boxes lie within eps as wholes are settled by counting, the others are opened. Within a task the recursion goes on
over shorter intervals down to tiles of vectors, where products decide. No pair of vectors is ever a row: a task sends a count for each
vector and a spanning forest of its links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from environs.operators.graph import components
from environs.operators.ranks import numbered

from .common import drop, heavy_keys, ship, small_batches, spread_join, stash, worker

COSINE = 0.9
#: Vectors of one interval at the lowest level, of a tile, and intervals of one interval above.
INTERVAL, TILE, FAN = 4096, 512, 8
#: Axes that the grid has, and vectors that the axes are fitted on. Any axes give the same result; good ones skip more.
AXES, SAMPLE = 12, 4096
#: Boxes are widened by so much, for the rounding of coordinates.
SLACK = 1e-9


def units(x: np.ndarray) -> np.ndarray:
    """Rows in double precision, of length 1."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def usable(column: str = "embedding"):
    """Vectors that can link: no null or non-finite component, and one that isn't zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False)))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def axes_of(vectors: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and principal axes of at most SAMPLE vectors, chosen by a hash of the row."""
    rows = vectors.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v").collect()
    x = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        x[i, : len(r.v)] = r.v
    x = units(x)
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T, bias=True).reshape(width, width))
    return mean, axes[:, ::-1]


def padded(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Lists of numbers as rows of a matrix, filled up with zeros, and their lengths."""
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    n = np.diff(ends)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(ends[0], ends[-1]) - np.repeat(ends[:-1], n)] = flat[ends[0] : ends[-1]]
    return out, n


def celled(vectors: DataFrame, width: int, eps: float, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """row, dim, cells: a vector's number of components and its cells on the leading axes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, n = padded(b.column("v"), width)
            cells = np.floor(((units(x) - mean) @ axes[:, :AXES]) / eps).astype(np.int32) if len(x) else np.zeros((0, min(AXES, width)), np.int32)
            offsets = np.arange(len(x) + 1, dtype=np.int32) * cells.shape[1]
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("v"), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(cells.ravel()))], ["row", "v", "dim", "cells"])

    kind = vectors.schema["v"].dataType.simpleString()
    return vectors.select("row", "v").mapInArrow(worker(run), f"row long, v {kind}, dim int, cells array<int>")


def box_of(lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, bytes]:
    return lo.astype("<f8").tobytes(), hi.astype("<f8").tobytes()


def intervals(ordered: DataFrame, width: int, mean: np.ndarray, axes: np.ndarray, kind: str) -> DataFrame:
    """ordered(leaf, place, row, v, dim) -> leaf, n, first, rows, dims, vectors, lo, hi: one row for each interval of the grid order.

    A box has the number of components as its first side: vectors of different lengths are never near.
    """

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("place").combine_chunks()
        x, n = padded(t.column("v").chunk(0) if t.column("v").num_chunks else t.column("v").combine_chunks(), width)
        y = np.concatenate([n[:, None].astype(float), (units(x) - mean) @ axes], axis=1)
        lo, hi = box_of(y.min(axis=0) - SLACK, y.max(axis=0) + SLACK)
        rows = t.column("row").to_numpy()
        one = {"leaf": t.column("leaf")[0].as_py(), "n": len(rows), "first": int(rows[0]), "rows": rows.astype("<i8").tobytes(), "dims": n.astype("<i4").tobytes(), "vectors": x.astype(kind).tobytes(), "lo": lo, "hi": hi}
        return pa.table({k: pa.array([v], pa.int64() if isinstance(v, int) else pa.binary()) for k, v in one.items()})

    return ordered.groupBy("leaf").applyInArrow(run, "leaf long, n long, first long, rows binary, dims binary, vectors binary, lo binary, hi binary")


def wider(nodes: DataFrame) -> DataFrame:
    """node, n, lo, hi of the intervals -> the same of the intervals above, FAN of them in one."""

    def run(t: pa.Table) -> pa.Table:
        lo = np.stack([np.frombuffer(b, "<f8") for b in t.column("lo").to_pylist()]).min(axis=0)
        hi = np.stack([np.frombuffer(b, "<f8") for b in t.column("hi").to_pylist()]).max(axis=0)
        lo, hi = box_of(lo, hi)
        n = sum(t.column("n").to_pylist())
        return pa.table({"node": pa.array([t.column("node")[0].as_py()], pa.int64()), "n": pa.array([n], pa.int64()), "lo": pa.array([lo], pa.binary()), "hi": pa.array([hi], pa.binary())})

    return nodes.withColumn("node", F.floor(F.col("node") / FAN)).groupBy("node").applyInArrow(run, "node long, n long, lo binary, hi binary")


def verdict(alo: np.ndarray, ahi: np.ndarray, blo: np.ndarray, bhi: np.ndarray, eps2: float) -> int:
    """-1: no vector of one box is within eps of one of the other; 1: all are; 0: open."""
    gap = np.maximum(0.0, np.maximum(alo - bhi, blo - ahi))
    if gap @ gap > eps2 + SLACK:
        return -1
    span = np.maximum(ahi - blo, bhi - alo)
    return 1 if span @ span < eps2 - SLACK else 0


def judged(pairs: DataFrame, nodes: DataFrame, eps2: float) -> DataFrame:
    """pairs(a, b) of intervals that exist -> a, b, na, nb, near: those that aren't provably distant; near: settled as wholes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            boxes = [[np.frombuffer(x, "<f8") for x in b.column(c).to_pylist()] for c in ("alo", "ahi", "blo", "bhi")]
            v = np.array([verdict(*x, eps2) for x in zip(*boxes)], np.int8)
            out = pa.RecordBatch.from_arrays([*[b.column(c) for c in ("a", "b", "na", "nb")], pa.array(v == 1)], ["a", "b", "na", "nb", "near"])
            yield out.filter(pa.array(v >= 0))

    met = pairs
    for side in ("a", "b"):
        met = met.join(nodes.select(F.col("node").alias(side), F.col("n").alias(f"n{side}"), F.col("lo").alias(f"{side}lo"), F.col("hi").alias(f"{side}hi")), side)
    return met.select("a", "b", "na", "nb", "alo", "ahi", "blo", "bhi").mapInArrow(worker(run), "a long, b long, na long, nb long, near boolean")


def meetings(levels: list[DataFrame], eps2: float) -> tuple[DataFrame, list[DataFrame]]:
    """The intervals at the lowest level that must be compared, as a table of (a, b), a <= b; and at each level those near as wholes."""
    spark = levels[0].sparkSession
    pairs, settled = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")), []
    for level in range(len(levels) - 1, -1, -1):
        found = stash(judged(pairs, levels[level], eps2), "interval-pairs")
        settled.append(found.where("near").withColumn("level", F.lit(level)))
        settled[-1]._environs_table = found._environs_table
        open_ = found.where("not near").select("a", "b")
        if level:
            child = lambda c: F.explode(F.sequence(F.col(c) * FAN, F.col(c) * FAN + FAN - 1))
            open_ = open_.withColumn("x", child("a")).withColumn("y", child("b")).where("x <= y").select(F.col("x").alias("a"), F.col("y").alias("b"))
        pairs = open_
    return pairs, settled


class Links:
    """Counts of links and a forest over the vectors of one or two intervals."""

    def __init__(self, n: int):
        self.count, self.root = np.zeros(n, np.int64), np.arange(n)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Union by edges: roots are hooked under smaller ones until each edge has one root."""
        root = self.root
        while True:
            p, q = root[i], root[j]
            if not (open_ := p != q).any():
                return
            i, j, p, q = i[open_], j[open_], p[open_], q[open_]
            np.minimum.at(root, np.maximum(p, q), np.minimum(p, q))
            while (root != (up := root[root])).any():
                root[:] = up


def compared(a: dict, b: dict | None, cosine: float, mean: np.ndarray, axes: np.ndarray) -> Links:
    """All links between the vectors of two intervals, or within one (b is None)."""
    eps2, sides = 2 - 2 * cosine, [a] if b is None else [a, b]
    u = [units(s["x"]) for s in sides]
    n0 = len(u[0])
    links = Links(sum(map(len, u)))
    slim = [x.astype(np.float32) for x in u]
    doubt = (u[0].shape[1] + 8) * 2.0**-23  # of a product in single precision
    y = [np.concatenate([s["dims"][:, None].astype(float), (x - mean) @ axes], axis=1) for s, x in zip(sides, u)]
    other, shift = (0, 0) if b is None else (1, n0)
    one_length = len(np.unique(np.concatenate([s["dims"] for s in sides]))) == 1

    def box(side: int, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        return y[side][lo:hi].min(axis=0) - SLACK, y[side][lo:hi].max(axis=0) + SLACK

    def tile(p: int, q: int, r: int, s: int, same: bool) -> None:
        c = slim[0][p:q] @ slim[other][r:s].T
        if same:
            np.fill_diagonal(c, -2)
        i, j = np.nonzero(c >= cosine - doubt)
        if len(i):
            unsure = np.flatnonzero(c[i, j] < cosine + doubt)
            if len(unsure):
                exact = np.einsum("ij,ij->i", u[0][p + i[unsure]], u[other][r + j[unsure]])
                keep = np.ones(len(i), bool)
                keep[unsure] = exact >= cosine
                i, j = i[keep], j[keep]
            if not one_length:
                keep = sides[0]["dims"][p + i] == sides[other]["dims"][r + j]
                i, j = i[keep], j[keep]
        found(p, r, i, j, q - p, s - r, same)

    def found(p: int, r: int, i: np.ndarray, j: np.ndarray, m: int, n: int, same: bool) -> None:
        if not len(i):
            return
        links.count[p : p + m] += np.bincount(i, minlength=m)
        if not same:  # within one interval a tile beside the diagonal stands for both directions
            links.count[shift + r : shift + r + n] += np.bincount(j, minlength=n)
        links.join(p + i, shift + r + j)

    def walk(p: int, q: int, r: int, s: int) -> None:
        same = b is None and p == r
        if not same:
            v = verdict(*box(0, p, q), *box(other, r, s), eps2)
            if v < 0:
                return
            if v > 0:
                links.count[p:q] += s - r
                links.count[shift + r : shift + s] += q - p
                every = np.concatenate([np.arange(p, q), shift + np.arange(r, s)])
                links.join(np.full(len(every), p), every)
                return
        if q - p <= TILE and s - r <= TILE:
            tile(p, q, r, s, same)
            return
        if same:
            m = (p + q) // 2
            walk(p, m, p, m)
            walk(p, m, m, q)
            walk(m, q, m, q)
        elif q - p >= s - r:
            m = (p + q) // 2
            walk(p, m, r, s)
            walk(m, q, r, s)
        else:
            m = (r + s) // 2
            walk(p, q, r, m)
            walk(p, q, m, s)

    walk(0, n0, 0, len(u[other]))
    return links


def linked(pairs: DataFrame, leaves: DataFrame, cosine: float, width: int, kind: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """pairs(a, b) of intervals -> row, n (links found in a meeting), root (another row of its tree in this meeting, or itself)."""

    def side(rows: bytes, dims: bytes, vectors: bytes) -> dict:
        return {"rows": np.frombuffer(rows, "<i8"), "dims": np.frombuffer(dims, "<i4"), "x": np.frombuffer(vectors, kind).reshape(-1, width).astype(np.float64)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                r = {c: batch.column(c)[k].as_py() for c in batch.schema.names}
                a = side(r["rows"], r["dims"], r["vectors"])
                b = None if r["a"] == r["b"] else side(r["rows2"], r["dims2"], r["vectors2"])
                links = compared(a, b, cosine, mean, axes)
                rows = a["rows"] if b is None else np.concatenate([a["rows"], b["rows"]])
                at = np.flatnonzero(links.count)
                yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(links.count[at]), pa.array(rows[links.root[at]])], ["row", "n", "root"])

    # either of the two may be fetched first, so that no interval is fetched second by all
    turned = (F.col("a") + F.col("b")) % 2 == 1
    pairs = pairs.select(F.when(turned, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(turned, F.col("a")).otherwise(F.col("b")).alias("b"))
    data = leaves.select("leaf", "rows", "dims", "vectors")
    met = pairs.join(data.withColumnRenamed("leaf", "a").hint("shuffle_hash"), "a")
    met = met.join(data.select(F.col("leaf").alias("b"), *[F.col(c).alias(f"{c}2") for c in ("rows", "dims", "vectors")]).hint("shuffle_hash"), "b")
    return met.mapInArrow(worker(run), "row long, n long, root long")


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE) -> DataFrame:
    """vectors(vec_id, embedding) -> vec_id, n_links, component_id, kept: one row for each row.

    Two rows link when the cosine of their vectors is at least ``cosine``, in double precision. Vectors that are null, empty, all zeros, or hold
    null or non-finite components link with nothing; neither do vectors of different lengths. n_links counts other rows, component_id is the
    smallest vec_id reachable by links, the row's own included; kept says whether it is the row's own. Rows that share a vec_id are rows of their
    own. A null vec_id is passed over when the smallest is chosen; alone it is its own component. An empty table gives no rows. Other
    columns are not looked at. The result is a table in the shared folder.
    """
    if not 0 < cosine <= 1:
        raise ValueError("cosine must lie in (0, 1]")
    spark = vectors.sparkSession
    ship(spark)
    eps2 = 2 - 2 * cosine
    everything = stash(vectors.select("vec_id", F.col("embedding").alias("v"), usable().alias("fit")).withColumn("row", F.monotonically_increasing_id()), "vectors")
    fit = everything.where("fit").select("row", "v")
    n, width = everything.where("fit").agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    alone = F.col("vec_id").alias("component_id")
    if not n:
        out = stash(everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), alone, F.lit(True).alias("kept")), "near")
        drop(everything)
        return out
    kind = "<f4" if "float" in everything.schema["v"].dataType.simpleString() else "<f8"
    mean, axes = axes_of(fit, width)
    with small_batches(vectors):
        cells = celled(fit, width, max(math.sqrt(eps2), 1e-6), mean, axes)
        ordered = numbered(cells, [], [F.col("dim").asc(), F.col("cells").asc(), F.col("row").asc()])
        placed = stash(ordered.select(F.floor((F.col("place") - 1) / INTERVAL).alias("leaf"), "place", "row", "v"), "grid-order")
        drop(ordered)
        leaves = stash(intervals(placed, width, mean, axes, kind), "intervals")
        levels = [leaves.select(F.col("leaf").alias("node"), "n", "lo", "hi")]
        tables = [everything, placed, leaves]
        size = -(-n // INTERVAL)
        while size > 1:
            levels.append(stash(wider(levels[-1]), "intervals"))
            tables.append(levels[-1])
            size = -(-size // FAN)
        open_, settled = meetings(levels, eps2)
        found = stash(linked(open_, leaves, cosine, width, kind, mean, axes), "links")
    tables += [found, *settled]

    # intervals that are near as wholes: each vector of one has all of the other, and all are in one tree
    first_leaf = lambda c: F.col(c) * F.pow(F.lit(FAN), "level").cast("long")
    whole = reduce(DataFrame.union, settled)
    two = F.array(F.struct(F.col("a").alias("node"), F.when(F.col("a") == F.col("b"), F.col("nb") - 1).otherwise(F.col("nb")).alias("more")), F.struct(F.col("b").alias("node"), F.when(F.col("a") == F.col("b"), 0).otherwise(F.col("na")).alias("more")))
    spans = whole.select("level", first_leaf("a").alias("to"), F.explode(two).alias("s")).select("to", "s.more", F.col("s.node").alias("node"), "level")
    spans = spans.select("to", "more", F.explode(F.sequence(first_leaf("node"), first_leaf("node") + F.pow(F.lit(FAN), "level").cast("long") - 1)).alias("leaf"))
    spans = stash(spans.join(leaves.select("leaf", "first"), "leaf").join(leaves.select(F.col("leaf").alias("to"), F.col("first").alias("root")), "to").select("leaf", "first", "root", "more"), "spans")
    added = spans.groupBy("leaf").agg(F.sum("more").alias("n"), F.first("first").alias("root"))
    inside = stash(placed.select("leaf", "row").join(added, "leaf").select("row", "n", "root"), "inside")
    counts = found.select("row", "n").union(inside.select("row", "n")).groupBy("row").agg(F.sum("n").alias("n"))
    edges = reduce(DataFrame.union, [found.select("row", "root"), inside.select("row", "root"), spans.select(F.col("first").alias("row"), "root").distinct()])
    labels = components(edges.select(F.col("row").alias("u"), F.col("root").alias("v")))
    tables += [spans, inside]

    names = everything.select("row", "vec_id")
    least = labels.join(names.withColumnRenamed("row", "node"), "node").groupBy("root").agg(F.min("vec_id").alias("least"))
    sizes = labels.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    answers = spread_join(labels, least, "root", heavy_keys(sizes, "root", "size"), spread="node").select(F.col("node").alias("row"), "least")
    d = names.join(counts, "row", "left").join(answers, "row", "left")
    component = F.coalesce("least", "vec_id")
    out = stash(d.select("vec_id", F.coalesce("n", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")), "near")
    drop(labels, *tables)
    return out
