"""Tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Spark then frees the shuffle files of a write as soon as it has ended; the table stands for them from there on.
FREE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; one of our own only where it names none and all runs on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="environs-")
        spark.sparkContext.setCheckpointDir(named)
        _path(spark, named, lambda fs, path: fs.deleteOnExit(path))
    return named


def _path(spark: SparkSession, name: str, act):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    return act(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """The session's setting has another value for a while."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it again: it is computed once, and lost executors lose nothing.

    The table goes when ``drop`` is called with what this returns, with ``clear``, or when the driver's JVM ends, whether or not
    the session was stopped before.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/environs/{name}-{uuid.uuid4().hex}"
    with setting(spark, FREE_SHUFFLES, "true"):
        df.write.parquet(path)
    _path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    out = spark.read.schema(df.schema).parquet(path)
    out._environs_table = path
    held = vars(spark.sparkContext).setdefault("_environs_tables", set())
    held.add(path)
    return out


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder for a table in any format; it goes when the driver's JVM ends."""
    path = f"{shared_folder(spark).rstrip('/')}/environs/{name}-{uuid.uuid4().hex}"
    _path(spark, path, lambda fs, p: fs.deleteOnExit(p))
    return path


def drop(*tables: DataFrame) -> None:
    """Delete stashed tables that no later step reads."""
    for df in tables:
        path = vars(df).pop("_environs_table", None)
        if path:
            _forget(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that are left, once their readers have been written or collected: for sessions that go on for long."""
    for path in sorted(vars(spark.sparkContext).get("_environs_tables", ())):
        _forget(spark, path)


def _forget(spark: SparkSession, path: str) -> None:
    _path(spark, path, lambda fs, p: (fs.delete(p, True), fs.cancelDeleteOnExit(p)))
    vars(spark.sparkContext)["_environs_tables"].discard(path)
