"""Exact ranks of groups of any size: values are dealt by ranges, each task orders its own range, and ranges are put one after the other.

A window by group holds a whole group in one task. Here a group may span all tasks: range bounds come from a sample of the data, the
rows before a range are a sum over the ranges before it, and ties can't cross a bound, since each value is one row when it is dealt.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stash

#: monotonically_increasing_id keeps the row's number in its partition in so many low bits.
_LOW_BITS = 33


#: Groups of up to so many rows are ranked by a window each: it is the shorter way where a group fits a task with ease.
TASK_ROWS = 2_000_000


def fits(df: DataFrame, by: list[str]) -> bool:
    """No group has more than TASK_ROWS rows. df should be cheap to count, such as the table that the groups come from."""
    return (df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0) <= TASK_ROWS


def _ranged(df: DataFrame, by: list[str], order: list[Column], name: str) -> DataFrame:
    """df in a table, dealt by ranges of (by, order) and sorted, with __part (the range) and __at (the place in it)."""
    keys = [F.col(b).asc() for b in by] + order
    d = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    at = F.monotonically_increasing_id() % (1 << _LOW_BITS)
    return stash(d.select("*", F.spark_partition_id().alias("__part"), at.alias("__at")), name)


def _offsets(sizes: DataFrame, by: list[str], *sums: str) -> DataFrame:
    """sizes(by, __part, ...) -> for each column in sums, what stands in ranges before (__before_x) and in the whole group (__all_x).

    One row for each range and each group that a range holds: no more than ranges and groups together.
    """
    group = Window.partitionBy(*[F.col(b) for b in by]) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    out = sizes
    for s in sums:
        out = out.withColumn(f"__before_{s}", F.coalesce(F.sum(s).over(before), F.lit(0))).withColumn(f"__all_{s}", F.sum(s).over(group))
    return out.drop(*sums)


def numbered(df: DataFrame, by: list[str], order: list[Column], place: str = "place", total: str | None = None) -> DataFrame:
    """df with ``place``: 1, 2, 3 ... in each group by order, which must be total, and the group's size where total names a column.

    One shuffle of the rows, by ranges; the frame reads a table in the shared folder. Nulls sort as Spark sorts them.
    """
    d = _ranged(df, by, order, "numbered")
    sizes = d.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    found = _offsets(sizes, by, "__n")
    renamed = found.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__part").alias("__range"), "__first", "__before___n", "__all___n")
    on = d["__part"] == renamed["__range"]
    for b in by:
        on = on & d[b].eqNullSafe(renamed[f"__{b}"])
    out = d.join(renamed, on)
    columns = [F.col(f"`{c}`") for c in df.columns] + [(F.col("__before___n") + F.col("__at") - F.col("__first") + 1).alias(place)]
    out = out.select(*columns, *([F.col("__all___n").alias(total)] if total else []))
    out._environs_table = vars(d).get("_environs_table")
    return out


def running(rows: DataFrame, by: list[str], value: str, sums: list[str]) -> DataFrame:
    """rows(by, value, sums), one row for each value of a group -> before_x and all_x beside each x of sums: what rows with a smaller value
    have in the group, and what the whole group has. Null is the smallest value. The frame reads a table in the shared folder.
    """
    d = _ranged(rows, by, [F.col(value).asc_nulls_first()], "running")
    sizes = d.groupBy(*by, "__part").agg(*[F.sum(s).alias(s) for s in sums])
    found = _offsets(sizes, by, *sums)
    renamed = found.select(*[F.col(b).alias(f"__{b}") for b in by], F.col("__part").alias("__range"), *[f"__{k}_{s}" for s in sums for k in ("before", "all")])
    on = d["__part"] == renamed["__range"]
    for b in by:
        on = on & d[b].eqNullSafe(renamed[f"__{b}"])
    here = Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    less = [(F.col(f"__before_{s}") + F.coalesce(F.sum(s).over(here), F.lit(0))).alias(f"before_{s}") for s in sums]
    out = d.join(renamed, on).select(*[d[c] for c in rows.columns], *less, *[F.col(f"__all_{s}").alias(f"all_{s}") for s in sums])
    out._environs_table = vars(d).get("_environs_table")
    return out


def ranked(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """by, value -> less (rows with a smaller value in the group), ties (rows with this one), total: one row for each distinct value.

    Rows are counted by value before they are dealt, so that a value that very many rows have is one row. Null counts as the smallest.
    """
    r = running(df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("ties")), by, value, ["ties"])
    out = r.select(*by, value, F.col("before_ties").alias("less"), "ties", F.col("all_ties").alias("total"))
    out._environs_table = vars(r).get("_environs_table")
    return out


def with_rank(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """df with less, ties and total of its value in its group (see ``ranked``): rank() is less + 1, percent_rank() less / (total - 1)."""
    r = ranked(df, by, value)
    named = r.select(*[F.col(b).alias(f"__{b}") for b in by], F.col(value).alias("__value"), "less", "ties", "total")
    on = df[value].eqNullSafe(named["__value"])
    for b in by:
        on = on & df[b].eqNullSafe(named[f"__{b}"])
    out = df.join(named, on).select(*[df[c] for c in df.columns], "less", "ties", "total")
    out._environs_table = vars(r).get("_environs_table")
    return out


def percent_rank(less: str = "less", total: str = "total") -> Column:
    """percent_rank() from the columns of ``with_rank``."""
    return F.when(F.col(total) > 1, F.col(less) / (F.col(total) - 1)).otherwise(F.lit(0.0))


def average_rank(less: str = "less", ties: str = "ties") -> Column:
    """The mean place of rows that tie."""
    return F.col(less) + (F.col(ties) + 1) / 2.0
