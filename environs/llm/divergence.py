"""How far a language's sources are from each other and from the language as a whole (operator 13).

A group is a source within a language, its vector the counts of the terms that the language keeps. Vectors are cut into blocks of
terms and stay where they were dealt to, by language, block and group. A tournament in rounds brings every two groups of a language together
once: in each round a group meets one other, and one of the two vectors travels, compressed, to where the other one lives. A meeting gives the
value for both directions. The language's own vector comes to each group in the same way, and a local heap keeps the group's best terms.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, ship, small_batches, stash, utf8, worker

MIN_DOCS, SMOOTHING, SCALE, TOP = 30, 5, 1_000_000_000, 50
#: Terms of a block, about, and rounds of the tournament whose travelling vectors are under way at once.
BLOCK_TERMS, ROUNDS_AT_ONCE = 1 << 15, 8
#: So many languages' sizes, three numbers each, are sent to all tasks.
LANGUAGES = 10_000
#: A task sends its counts on when it holds so many.
HELD = 300_000

#: Bytes of terms, A-Z in lower case; all others are blanks.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def counted(docs: DataFrame) -> DataFrame:
    """docs(lang, source, text) -> lang, source, term, n (occurrences), docs (rows with the term), and a row without a term for each group.

    Tasks add up their own rows first; a task that holds HELD counts sends them on.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: dict[tuple, Counter] = defaultdict(Counter)
        rows: dict[tuple, Counter] = defaultdict(Counter)

        def sent() -> Iterator[pa.RecordBatch]:
            for (lang, source), found in n.items():
                terms = [None, *found]
                of = rows[lang, source]
                columns = [pa.array([lang] * len(terms)), pa.array([source] * len(terms)), pa.array(terms, pa.binary()).cast(pa.string()), pa.array([0, *found.values()], pa.int64()), pa.array([0, *[of[t] for t in found]], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
            n.clear()
            rows.clear()

        held = 0
        for b in batches:
            for lang, source, text in zip(*[c.to_pylist() for c in b.columns]):
                words = terms_of(text)
                group = n[lang, source]
                before = len(group)
                group.update(words)
                rows[lang, source].update(set(words))
                held += len(group) - before
                if held > HELD:
                    yield from sent()
                    held = 0
        yield from sent()

    read = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), utf8("text").alias("text"))
    found = read.mapInArrow(worker(run), "lang string, source string, term string, n long, docs long")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def parts_per_billion(counts: np.ndarray, total: int, terms: int) -> np.ndarray:
    """1 + floor(SCALE * (count + SMOOTHING) / (total + SMOOTHING * terms)), exactly, in integers of 64 bits."""
    d, x = total + SMOOTHING * terms, counts.astype(np.int64) + SMOOTHING
    if d < (1 << 63) // SCALE:  # x <= d
        return 1 + x * SCALE // d
    assert d < (1 << 63) // 1000
    out = np.zeros(len(x), np.int64)
    for _ in range(3):  # long division, three digits at a time
        x = x * 1000
        out = out * 1000 + x // d
        x = x % d
    return 1 + out


def packed(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places as steps, with their counts, compressed."""
    steps = np.diff(places, prepend=0).astype("<u4")
    wide = int(counts.max(initial=0) >= 1 << 32)
    return bytes([wide]) + zlib.compress(steps.tobytes() + counts.astype("<u8" if wide else "<u4").tobytes(), 1)


def unpacked(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(b[1:])
    n = len(raw) // (12 if b[0] else 8)
    return np.cumsum(np.frombuffer(raw, "<u4", n).astype(np.int64)), np.frombuffer(raw, "<u8" if b[0] else "<u4", n, 4 * n).astype(np.int64)


def shares(vector: bytes | None, width: int, total: int, terms: int) -> np.ndarray:
    """A group's parts per billion for all terms of a block, those that it lacks included."""
    counts = np.zeros(width, np.int64)
    if vector is not None:
        at, n = unpacked(vector)
        counts[at] = n
    return parts_per_billion(counts, total, terms) if width else counts


def opponent(seat: Column, round_: Column, seats: Column) -> Column:
    """Whom a seat meets in a round of a tournament of ``seats`` seats, an even number: everyone once in seats - 1 rounds."""
    m = seats - 1
    other = F.pmod(round_ - seat, m)
    last = F.pmod(round_ * (seats / 2).cast("long"), m)  # the seat that would meet itself
    return F.when(seat == m, last).when(other == seat, m).otherwise(other)


def meetings(resident: DataFrame, dealt: int) -> DataFrame:
    """resident(lang, block, seat, seats, width, terms, total, vector) -> lang, seat, other, value: each meeting once, summed over blocks."""
    key = ["lang", "block", "seat"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            c = {n: b.column(n).to_pylist() for n in ("width", "terms", "vector", "total", "peer_vector", "peer_total")}
            value = [int(np.abs(shares(v, w, n, t) - shares(pv, w, pn, t)).sum()) for w, t, v, n, pv, pn in zip(*c.values())]
            yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("seat"), b.column("peer"), pa.array(value, pa.int64())], ["lang", "seat", "other", "value"])

    here = resident.repartition(dealt, *key).persist(StorageLevel.MEMORY_AND_DISK)
    rounds = resident.agg(F.max(F.col("seats") - 1)).first()[0] or 0
    found = []
    for first in range(0, rounds, ROUNDS_AT_ONCE):
        at = F.explode(F.sequence(F.lit(first), F.least(F.lit(first + ROUNDS_AT_ONCE), F.col("seats") - 1) - 1))
        away = resident.where(F.col("seats") - 1 > first).select("lang", "block", F.col("seat").alias("peer"), "seats", F.col("total").alias("peer_total"), F.col("vector").alias("peer_vector"), at.alias("round"))
        away = away.withColumn("seat", opponent(F.col("peer"), F.col("round"), F.col("seats")))
        # one of the two travels: by turns the one with the smaller and the one with the larger seat
        travels = (F.col("peer") < F.col("seat")) == ((F.col("peer") + F.col("seat")) % 2 == 0)
        met = here.drop("seats").join(away.where(travels).drop("seats", "round").hint("merge"), key)
        with small_batches(resident):
            met = met.select("lang", "seat", "peer", "width", "terms", "vector", "total", "peer_vector", "peer_total")
            value = met.mapInArrow(worker(run), "lang string, seat long, other long, value long")
            found.append(stash(value.groupBy("lang", "seat", "other").agg(F.sum("value").alias("value")), "meetings"))
    here.unpersist()
    return found


def heaps(resident: DataFrame, lexicon: DataFrame, top: int) -> DataFrame:
    """resident, lexicon(lang, block, words, counts, lang_total) -> lang, seat, item, value: each task's best terms of its groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple, list] = defaultdict(list)
        for b in batches:
            for lang, seat, vector, total, terms, names, counts, lang_total in zip(*[b.column(c).to_pylist() for c in ("lang", "seat", "vector", "total", "terms", "words", "counts", "lang_total")]):
                at, n = unpacked(vector)
                over = parts_per_billion(n, total, terms) - parts_per_billion(np.array(counts, np.int64)[at], lang_total, terms)
                more = np.flatnonzero(over > 0)
                first = more[np.lexsort((at[more], -over[more]))[:top]]  # places are in the order of the terms
                heap = best[lang, seat]
                heap += [(-int(over[i]), names[at[i]].encode()) for i in first]
                heap.sort()
                del heap[top:]
        rows = [(lang, seat, t.decode(), -v) for (lang, seat), heap in best.items() for v, t in heap]
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int64(), pa.string(), pa.int64()))], ["lang", "seat", "item", "value"])

    met = resident.where("vector is not null").join(lexicon.hint("merge"), ["lang", "block"])
    return met.select("lang", "seat", "vector", "total", "terms", "words", "counts", "lang_total").mapInArrow(worker(run), "lang string, seat long, item string, value long")


def audit(docs: DataFrame, *, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """docs(lang, source, text) -> lang, source, part, item, value, rank.

    Terms are runs of letters with A-Z lower-cased; a language keeps those in at least ``min_docs`` of its rows. Part ``pair`` has for each two
    sources of a language the sum of the differences of their shares of all kept terms, part ``term`` the ``top`` terms that a
    source has more of than its language. All arithmetic is exact. Null language, source or text count as empty; a group without a kept term
    has counts of 0, and a language without one has pairs of value 0. Repeated rows count each. An empty table gives no rows. Other
    columns are not looked at. The result is a table in the shared folder.
    """
    spark = docs.sparkSession
    ship(spark)
    with small_batches(docs):
        counts = stash(counted(docs), "counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("n").alias("count"), F.sum("docs").alias("docs")).where(F.col("docs") >= min_docs).drop("docs")
    kept = stash(kept, "kept")
    # one row for each language: few enough for all tasks, or else joined by language
    sizes = stash(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("count").alias("lang_total")), "sizes")
    few = F.broadcast(sizes) if sizes.count() <= LANGUAGES else sizes
    blocks = F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("int")
    dealt = kept.join(few, "lang").withColumn("block", F.pmod(F.xxhash64("term"), blocks).cast("int"))
    dealt = dealt.withColumn("at", (F.row_number().over(Window.partitionBy("lang", "block").orderBy("term")) - 1).cast("long"))
    dealt = stash(dealt, "terms")
    drop_later = [counts, kept, sizes, dealt]
    lexicon = dealt.groupBy("lang", "block").agg(F.array_sort(F.collect_list(F.struct("at", "term", "count"))).alias("rows"), F.first("lang_total").alias("lang_total"))
    lexicon = stash(lexicon.select("lang", "block", F.col("rows.term").alias("words"), F.col("rows.count").alias("counts"), "lang_total", F.size("rows").cast("long").alias("width")), "lexicon")

    rows = counts.where("term is not null").join(dealt.select("lang", "term", "block", "at"), ["lang", "term"]).select("lang", "source", "block", "at", "n")
    vectors = stash(rows.groupBy("lang", "source", "block").agg(F.array_sort(F.collect_list(F.struct("at", "n"))).alias("v"), F.sum("n").alias("n")), "vectors")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = b.column("v")
            out = [packed(np.array([x["at"] for x in r], np.int64), np.array([x["n"] for x in r], np.int64)) for r in v.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in ("lang", "source", "block")], pa.array(out, pa.binary())], ["lang", "source", "block", "vector"])

    with small_batches(docs):
        tight = stash(vectors.select("lang", "source", "block", "v").mapInArrow(worker(pack), "lang string, source string, block int, vector binary"), "tight")
    groups = counts.where("term is null").select("lang", "source")
    by_lang = Window.partitionBy("lang")
    groups = groups.withColumn("seat", (F.row_number().over(by_lang.orderBy("source")) - 1).cast("long"))
    groups = groups.withColumn("n", F.count(F.lit(1)).over(by_lang)).withColumn("seats", F.col("n") + F.col("n") % 2)
    totals = vectors.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = groups.join(totals, ["lang", "source"], "left").join(few.select("lang", "terms"), "lang", "left")
    groups = stash(groups.select("lang", "source", "seat", "seats", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("terms", F.lit(0)).alias("terms")), "groups")
    drop_later += [lexicon, vectors, tight, groups]
    places = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("terms") / BLOCK_TERMS), F.lit(1)).cast("int") - 1)))
    resident = places.join(lexicon.select("lang", "block", "width"), ["lang", "block"], "left").join(tight, ["lang", "source", "block"], "left")
    resident = stash(resident.select("lang", "block", "seat", "seats", F.coalesce("width", F.lit(0)).alias("width"), "terms", "total", "vector"), "resident")
    drop_later.append(resident)

    def named(rows: DataFrame, seat: str, name: str) -> DataFrame:
        return rows.join(groups.select("lang", F.col("seat").alias(seat), F.col("source").alias(name)), ["lang", seat])

    met = meetings(resident, int(spark.conf.get("spark.sql.shuffle.partitions")))
    drop_later += met
    out = heaps(resident, lexicon, top)
    terms = named(out, "seat", "source").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    rows = terms
    for m in met:
        both = named(named(m, "seat", "a"), "other", "b")
        both = both.select("lang", "value", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("s"))
        rows = rows.unionByName(both.select("lang", "s.source", F.lit("pair").alias("part"), "s.item", "value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order)).where((F.col("part") == "pair") | (F.col("rank") <= top))
    with small_batches(docs):
        out = stash(ranked, "audit")
    drop(*drop_later)
    return out
