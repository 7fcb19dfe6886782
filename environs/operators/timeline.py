"""Gaps and islands in probe logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def gaps(log: DataFrame, more_than_s: float, by: str = "url", at: str = "ts") -> DataFrame:
    """Consecutive rows further apart than the limit."""
    before = F.lag(at).over(Window.partitionBy(by).orderBy(at, "event_id"))
    d = log.withColumn("before", before).withColumn("gap_s", (F.unix_micros(F.col(at).cast("timestamp")) - F.unix_micros(F.col("before").cast("timestamp"))) / 1e6)
    return d.where(F.col("gap_s") > more_than_s).select(by, "event_id", "gap_s")


def islands(log: DataFrame, by: str = "url", state: str = "up", at: str = "ts") -> DataFrame:
    """Runs of one state: first and last time, rows and seconds."""
    order = Window.partitionBy(by).orderBy(at, "event_id")
    changed = F.when(F.lag(state).over(order).eqNullSafe(F.col(state)), 0).otherwise(1)
    d = log.withColumn("changed", changed).withColumn("run", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    g = d.groupBy(by, "run", state).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count(F.lit(1)).alias("n"))
    seconds = (F.unix_micros(F.col("last").cast("timestamp")) - F.unix_micros(F.col("first").cast("timestamp"))) / 1e6
    return g.select(by, "run", state, "n", seconds.alias("seconds"))
