"""Questions over events that hold for a batch and for a stream.

Every function takes a DataFrame with ts; a streaming one should carry a watermark (see watermarked). The same plan then runs
incrementally, with state bounded by the watermark; rows later than that are dropped.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Table

LATE = "2 hours"
#: Data folders without a commit are taken for abandoned after so many seconds.
GRACE_S = 3600.0


def timed(df: DataFrame) -> DataFrame:
    """ts as an instant: event files hold it without a zone, and the session's zone is UTC."""
    return df.withColumn("ts", F.col("ts").cast("timestamp"))


def read_events(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the event files in a folder; the schema is that of its files now."""
    schema = spark.read.parquet(folder).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def watermarked(df: DataFrame, late: str = LATE) -> DataFrame:
    return timed(df).withWatermark("ts", late)


def _instants(df: DataFrame) -> DataFrame:
    return df if df.isStreaming else timed(df)


def tumbling(df: DataFrame, width: str = "1 hour") -> DataFrame:
    g = _instants(df).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sliding(df: DataFrame, width: str = "1 hour", step: str = "30 minutes") -> DataFrame:
    g = _instants(df).groupBy(F.window("ts", width, step), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(df: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = _instants(df).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return g.select("user_id", F.col("session_window.start").alias("start"), "n")


def zero_results(df: DataFrame, width: str = "1 day") -> DataFrame:
    """The share of searches without a result; an event's result count is floor(value) mod 5."""
    none = F.floor("value") % 5 == 0
    g = _instants(df).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), F.avg(none.cast("double")).alias("zero_rate"))
    return g.select(F.col("window.start").alias("start"), "n", "zero_rate")


def first_seen(df: DataFrame) -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return df.dropDuplicatesWithinWatermark(["event_id"]) if df.isStreaming else df.dropDuplicates(["event_id"])


def upsert_stream(stream: DataFrame, store: str, key: list[str], at: str, checkpoint: str, buckets: int = 64, keep: int = 2):
    """Keep the newest row of each key in a ``versions.Table``, batch by batch.

    A batch rewrites only the buckets that it has keys for, and its number is part of the commit: a batch that is run again changes nothing.
    The newest ``keep`` versions stay for readers, older ones go.
    """
    table = Table(stream.sparkSession, store, buckets)

    def write(batch: DataFrame, number: int) -> None:
        table.upsert(batch, key, at, ("stream", number))
        table.expire(keep, grace_s=GRACE_S)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_once(frame: DataFrame, name: str, plan: Callable[[DataFrame], DataFrame], mode: str = "complete") -> DataFrame:
    """Run a plan over all that a stream holds now, into a table in memory: for tests and small reports."""
    q = plan(watermarked(frame)).writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return frame.sparkSession.table(name)
