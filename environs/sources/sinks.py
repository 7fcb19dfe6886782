"""Sinks: partitioned Parquet, replaced folders, manifests, reports, sharded JSON, CSV, append logs."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .versions import Table


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_parquet(df: DataFrame, path: str, by: str | None = "city_id", **counts: Column) -> dict:
    """One folder for each city, rows of a city kept together so that a city is a few files and not one for each task.

    Returns what the writing tasks have counted on the way: rows, and what ``counts`` names as aggregates; the table isn't read for it.
    """
    # AQE merges small parts and splits large ones, so that files follow the size of a city
    rows = df if by is None else df.hint("rebalance", by)
    seen = Observation()
    # observed behind the last shuffle: only tasks that end well are counted, each once
    rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in counts.items()])
    writer = rows.write.mode("overwrite")
    (writer if by is None else writer.partitionBy(by)).parquet(path)
    return {k: v or 0 for k, v in seen.get.items()}


def file_sizes(table: DataFrame, by: str = "city_id") -> DataFrame:
    """by, files, bytes: of the files that a table is read from, from the reader's metadata; no column but ``by`` is read."""
    f = table.select(by, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
    return f.groupBy(by).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def replace(df: DataFrame, path: str) -> int:
    """A new version of the table in path: readers that use ``versions.Table`` see it or the one before, whole, at any moment; versions
    before it stay until they expire. The version's number."""
    return Table(df.sparkSession, path).replace(df)


def write_text(spark: SparkSession, content: str, path: str) -> None:
    """A small text file in any store."""
    at, fs = _fs(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(content.encode()))
    finally:
        out.close()


def write_manifest(spark: SparkSession, values: dict, path: str) -> None:
    write_text(spark, json.dumps(values, indent=2, default=str), path)


def write_shards(df: DataFrame, path: str, key: str = "slug") -> None:
    """JSON by (city, last character of the key): a look-up reads one shard."""
    d = df.withColumn("bucket", F.lower(F.right(F.col(key), F.lit(1))))
    d.repartition("city_id", "bucket").write.mode("overwrite").partitionBy("city_id", "bucket").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def append_log(df: DataFrame, path: str) -> None:
    """Rows are added; every part file has its header."""
    df.write.mode("append").csv(path, header=True)


def table(headers: list[str], rows: list) -> str:
    """A Markdown table."""
    lines = ["| " + " | ".join(headers) + " |", "|" + "---|" * len(headers)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])
