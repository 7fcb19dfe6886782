"""Mixing sources to target weights with weighted sampling without replacement (Efraimidis and Spirakis, 2006).

Everything here is DataFrame code. A document's key is the exponential key -ln(u)/w, with u a hash of its id and w its
quality weight; within a source the documents with the smallest keys come first (the order of u**(1/w), descending), and
a prefix sum of their sizes fills the source's token budget. A source whose target is above its own size is taken whole
as often as it fits (complete epochs); only the rest is sampled.

No source is ever ordered as a whole. Sizes are summed by bins of the key (equal steps of its logarithm, which no weight can
crowd), the prefix sums over bins name the bin in which a source's budget ends, and only that bin is ordered to find
the document at the edge. What a document gives then follows from its own key and the edge: texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, drop, stash

#: Bins in each doubling of the key: at most 0.03 % of a source's documents of one weight are in a bin. A bin that holds the end of a
#: budget and more than RANGE_ROWS documents is binned again, as often as LEVELS says, before it is ordered.
BINS, LEVELS, RANGE_ROWS = 1024, 3, 1 << 20


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def letter_share(text: Column) -> Column:
    """Quality weight in [0.25, 1]: the share of characters that are letters, but not capitals, or blanks."""
    t = F.coalesce(text, F.lit(""))
    plain = F.length(F.regexp_replace(t, r"[^\p{Ll}\p{Lo}\p{M}\x20]+", ""))
    return F.lit(0.25) + F.lit(0.75) * plain / F.greatest(F.length(t), F.lit(1))


def water_filled(sources: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """sources(source, source_size) -> with target.

    Sources in code-point order (null last) have the weights in turn. Targets are min(cap, level * weight), cap =
    max_epochs * source_size: what repeated resharing of the excess by weight ends in. With caps sorted by cap / weight,
    the level is the first (T - caps below) / (weights left) under which the next cap isn't reached. One row a source is ordered.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    s = sources.withColumn("weight", F.get(turn, (F.row_number().over(by_name) - 1) % F.lit(len(weights))))
    s = s.withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size")).withColumn("reach", F.col("cap") / F.col("weight"))
    up = Window.orderBy("reach", F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    total = F.lit(float(share)) * F.sum("source_size").over(everything)
    s = s.withColumn("level", (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(rest))
    s = s.withColumn("level", F.max(F.when(F.col("level") <= F.col("reach"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.col("weight") * F.col("level"))
    return s.select("source", "source_size", F.round(F.coalesce(target, F.col("cap")), 6).alias("target"))


def budgets(sizes: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """no_source, source_name, source_size -> with target, epochs (complete ones) and left (words of the sampled epoch)."""
    s = water_filled(sizes.withColumn("source", F.when(~F.col("no_source"), F.col("source_name"))), weights, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size") + F.lit(1e-9))).otherwise(F.lit(0)).cast("long")
    left = F.round(F.greatest(F.lit(0.0), F.col("target") - F.col("epochs") * F.col("source_size"))).cast("long")
    s = s.select(F.col("source").isNull().alias("no_source"), F.coalesce("source", F.lit("")).alias("source_name"), "source_size", "target", whole.alias("epochs"))
    return s.withColumn("left", left)


def measured(docs: DataFrame, quality: Column | None, seed: int, carry: list[str] | None) -> DataFrame:
    """no_source, source_name (a null source compares by plain equality), size, place (key, doc_id, text hash) and the row."""
    w = letter_share(F.col("text")) if quality is None else quality
    u = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    key = -F.log(u) / F.greatest(w.cast("double"), F.lit(1e-6))
    return docs.select(
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source_name"),
        word_count(F.col("text")).alias("size"),
        F.struct(key.alias("key"), F.col("doc_id").alias("doc_id"), F.xxhash64("text").alias("hash")).alias("place"),
        *([F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row")] if carry else []),
    )


def edges(rows: DataFrame, weights: tuple[float, ...], share: float, max_epochs: float) -> DataFrame:
    """rows of ``measured`` -> one row a source: source_size, target, epochs and the edge of its sampled epoch.

    Documents before ``edge`` are taken whole in that epoch; those at it (``at_edge`` of them, one unless rows are repeated) share
    ``edge_room`` words; a source without an edge is taken whole.
    """
    on = ["no_source", "source_name"]
    at, targets, steps = rows.select(*on, "size", "place"), None, []
    earlier = Window.partitionBy(*on).orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(1, LEVELS + 1):
        at = at.withColumn("bin", F.floor(F.log2(F.greatest(F.col("place.key"), F.lit(1e-300))) * F.lit(BINS**level)))
        bins = stash(at.groupBy(*on, "bin").agg(F.sum("size").alias("bin_size"), F.count(F.lit(1)).alias("n")), "bins")
        if targets is None:
            targets = stash(budgets(bins.groupBy(*on).agg(F.sum("bin_size").alias("source_size")), weights, share, max_epochs), "targets")
            room = targets.select(*on, F.col("left").alias("room"))
        summed = bins.withColumn("before", F.coalesce(F.sum("bin_size").over(earlier), F.lit(0))).join(room, on)
        ends = stash(summed.where("before <= room and room < before + bin_size").select(*on, "bin", (F.col("room") - F.col("before")).alias("room"), "n"), "ends")
        steps += [bins, ends]
        at = at.join(ends.select(*on, "bin"), [*on, "bin"]).drop("bin")
        room = ends.select(*on, "room")
        if not ends.where(F.col("n") > RANGE_ROWS).limit(1).count():
            break
    inside = Window.partitionBy(*on).orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    at = at.join(room, on).withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    # where the room runs out; repeated rows are equal in place, and the first of them says what is left for all
    last = at.where("before <= room and room < before + size").select(*on, F.col("place").alias("edge"))
    same = at.join(last, on).where("place = edge").groupBy(*on).agg(F.first("edge").alias("edge"), F.max(F.col("room") - F.col("before")).alias("edge_room"), F.count(F.lit(1)).alias("at_edge"))
    out = stash(targets.join(same, on, "left"), "edges")
    drop(targets, *steps)
    return out


def mix(
    docs: DataFrame,
    *,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    share: float = 1.5,
    max_epochs: float = 2.0,
    seed: int = 17,
    quality: Column | None = None,
    carry: list[str] | None = None,
) -> DataFrame:
    """docs(doc_id, text, source) -> doc_id, size, source_size, target, taken, epochs and a struct ``row`` of carried columns.

    taken counts the words that the mix takes from a document: size for each complete epoch, and in the sampled epoch
    all of it, or as much as is left of the budget in the one document at its edge.

    Null or empty text has size 0 and is taken 0 times. A null source is a source, after all others. Repeated rows count
    each; equal keys are ordered by doc_id and then by a hash of the text. An empty table gives no rows. Other columns
    are not looked at, whatever their names. max_epochs must not be below share.

    With carry the texts are read twice, once to sum and once to give the rows, and are never shuffled; without it they are read once.
    """
    on = ["no_source", "source_name"]
    rows = measured(docs, quality, seed, None)
    rows = stash(rows, "sizes")
    ends = edges(rows, weights, share, max_epochs)
    if carry:
        drop(rows)
        rows = measured(docs, quality, seed, carry)
    d = rows.join(ends, on)
    keep = ["place.doc_id", "size", "source_size", "target"]
    give = lambda extra: [*keep, (F.col("epochs") * F.col("size") + extra).cast("long").alias("taken"), "epochs", *(["row"] if carry else [])]
    is_edge = F.coalesce(F.col("place") == F.col("edge"), F.lit(False))
    before = F.coalesce(F.col("place") < F.col("edge"), F.lit(True))
    rest = lambda nth: F.least(F.col("size"), F.greatest(F.lit(0), F.col("edge_room") - nth * F.col("size")))
    if not ends.where("at_edge > 1").limit(1).count():
        return d.select(*give(F.when(is_edge, rest(F.lit(0))).when(before, F.col("size")).otherwise(F.lit(0))))
    # rows that are repeated exactly at an edge take what is left one after another
    turn = Window.partitionBy(*on).orderBy(F.lit(1))
    at = d.where(is_edge).withColumn("nth", F.row_number().over(turn) - 1)
    return d.where(~is_edge).select(*give(F.when(before, F.col("size")).otherwise(F.lit(0)))).union(at.select(*give(rest(F.col("nth")))))
