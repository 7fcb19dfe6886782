"""Exact order statistics of groups of any size, without an ordered or collected group.

For all groups and columns at once, each round counts the values in BINS equal parts of the range that still holds the wanted one, and
goes on with the part that has it. Tasks add up before anything is shuffled, so a round moves BINS rows for each group, column and task at most.
A part's own minimum and maximum bound the next round; a part with one distinct value ends it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import drop, stash

BINS = 256
#: So many wanted statistics, a few dozen bytes each, go to all tasks; beyond that they are copied into PARTS parts and rows meet theirs by a hash.
BROADCAST_ROWS, PARTS = 100_000, 64


def _meet(rows: DataFrame, wanted: DataFrame, keys: list[str], n: int) -> DataFrame:
    named = wanted.select(*[F.col(k).alias(f"__{k}") for k in keys], *[c for c in wanted.columns if c not in keys])
    left = rows
    if n <= BROADCAST_ROWS:
        named, on = F.broadcast(named), F.lit(True)
    else:
        left = rows.withColumn("__part", F.pmod(F.xxhash64("value", F.rand(7)), F.lit(PARTS)))
        named = named.withColumn("__to", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        on = F.col("__part") == F.col("__to")
    for k in keys:
        on = left[k].eqNullSafe(named[f"__{k}"]) & on
    return left.join(named, on).drop(*[f"__{k}" for k in keys], "__part", "__to")


def _bin() -> Column:
    """The part of [lo, hi] that a value is in; lo is in the first and hi in the last, so that each round takes something away."""
    share = (F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2)
    return F.when(F.col("value") >= F.col("hi"), F.lit(BINS - 1)).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 2)).cast("int"))


def order_statistics(df: DataFrame, by: list[str], columns: list[str], places: dict[str, Column]) -> DataFrame:
    """df(by, columns) -> by, column, n and the value at each place, by name: one row for each group and column that has a value.

    ``places`` are 0-based places in ascending order as expressions of n, the number of the group's values that aren't null. NaN stands
    above all numbers, as Spark sorts it. The result is a small table in the shared folder.
    """
    long = df.select(*by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("v")).select(*by, "v.column", "v.value")
    long = stash(long.where("value is not null"), "values")
    keys = [*by, "column"]
    number = F.when(~F.isnan("value"), F.col("value"))
    sizes = stash(long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(number).alias("numbers"), F.min(number).alias("lo"), F.max(number).alias("hi")), "sizes")
    cases = F.array(*[F.struct(F.lit(name).alias("name"), p.cast("long").alias("k")) for name, p in places.items()])
    state = sizes.select(*keys, "n", "numbers", "lo", "hi", F.explode(cases).alias("p")).select(*keys, "n", "numbers", "p.name", "p.k", "lo", "hi", F.lit(0).cast("long").alias("below"))
    state = stash(state.where("k >= 0 and k < n"), "wanted")
    done, tables = [], [long, sizes, state]
    while True:
        nan = F.col("k") >= F.col("numbers")
        done.append(state.where(nan | (F.col("lo") == F.col("hi"))).select(*keys, "n", "name", F.when(nan, F.lit(float("nan"))).otherwise(F.col("lo")).alias("found")))
        open_ = state.where(~nan & (F.col("lo") < F.col("hi")))
        # several places of a group may still share a range: its values are counted once
        ranges = open_.select(*keys, "lo", "hi").distinct()
        n = ranges.count()
        if not n:
            break
        met = _meet(long.where(~F.isnan("value")), ranges, keys, n).where("value between lo and hi")
        bins = met.groupBy(*keys, "lo", "hi", _bin().alias("bin")).agg(F.count(F.lit(1)).alias("m"), F.min("value").alias("lo2"), F.max("value").alias("hi2"))
        before = Window.partitionBy(*keys, "lo", "hi").orderBy("bin")
        bins = bins.withColumn("upto", F.sum("m").over(before))
        named = bins.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), "m", "lo2", "hi2", "upto")
        on = (F.col("lo") == F.col("__lo")) & (F.col("hi") == F.col("__hi")) & (F.col("k") < F.col("below") + F.col("upto")) & (F.col("k") >= F.col("below") + F.col("upto") - F.col("m"))
        for k in keys:
            on = open_[k].eqNullSafe(named[f"__{k}"]) & on
        state = stash(open_.join(named, on).select(*keys, "n", "numbers", "name", "k", F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), (F.col("below") + F.col("upto") - F.col("m")).alias("below")), "wanted")
        tables.append(state)
    found = done[0]
    for d in done[1:]:
        found = found.union(d)
    out = stash(found.groupBy(*keys, "n").agg(*[F.max(F.when(F.col("name") == name, F.col("found"))).alias(name) for name in places]), "order-statistics")
    drop(*tables)
    return out


def medians(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """by and a column of medians under each name: the mean of the two middle values where their number is even."""
    n = F.col("n")
    found = order_statistics(df, by, columns, {"low": F.floor((n - 1) / 2), "high": F.floor(n / 2)})
    half = F.col("low") + (F.col("high") - F.col("low")) / 2
    return found.groupBy(*by).agg(*[F.max(F.when(F.col("column") == c, half)).alias(c) for c in columns])
