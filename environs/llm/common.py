"""Shared pieces of the corpus operators: words, hashes, shared-folder tables."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import AbstractContextManager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from environs.session import scratch, ship  # noqa: F401
from environs.storage import drop, setting  # noqa: F401
from environs.storage import stash as stash_as_is

#: A word is a run of characters that are not ASCII white space; ``bytes.split()`` cuts at the same characters.
WORD = r"[^\x20\x09-\x0D]+"
ASCII_SPACE = b"\x20\x09\x0a\x0b\x0c\x0d"

U64 = np.uint64
_MIX = U64(0x9E3779B97F4A7C15)


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4_000_000


def prepare(spark: SparkSession) -> None:
    """For queries: the package goes to the executors, and rows to Python in batches of a few megabytes for as long as the session lives."""
    ship(spark)
    spark.conf.set(BATCH, str(BATCH_BYTES))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def utf8(column: str) -> Column:
    """The text as UTF-8 bytes; null stays null."""
    return F.encode(F.col(column), "UTF-8")


def small_batches(df: DataFrame) -> AbstractContextManager:
    """While a step runs, rows go to Python in batches of a few megabytes: both sides hold less at a time."""
    return setting(df.sparkSession, BATCH, str(BATCH_BYTES))


def worker(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow, after which its process gives the memory that it no longer needs back: processes wait for later tasks."""

    @wraps(run)
    def trimmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # only where the C library can do it
                ctypes.CDLL("libc.so.6").malloc_trim(0)

    return trimmed


def stash(df: DataFrame, name: str) -> DataFrame:
    """A table in the shared folder, made in small batches."""
    with small_batches(df):
        return stash_as_is(df, name)


def free_name(columns: list[str], wanted: str) -> str:
    """The name for a column of ours beside others: wanted, or with a number if one of them has that name."""
    taken, name, i = {c.lower() for c in columns}, wanted, 0
    while name.lower() in taken:
        i += 1
        name = f"{wanted}_{i}"
    return name


def plain_columns(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


#: A key is heavy with more than one HEAVY-th of all rows, so that there can't be more than HEAVY of them, and PART_ROWS rows; that many
#: rows of it, on average, go to one part.
HEAVY, PART_ROWS = 1024, 4_096


def heavy_keys(counts: DataFrame, key: str, n: str) -> dict:
    """counts(key, n), one row a key -> the heavy keys and the number of parts that each is dealt to."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    found = counts.where((F.col(n) > F.lit(total / HEAVY)) & (F.col(n) > PART_ROWS)).select(key, n).collect()
    return {bytes(r[0]) if isinstance(r[0], bytearray) else r[0]: -(-r[1] // PART_ROWS) for r in found}


def parts_of(key: str, heavy: dict) -> Column:
    """The number of parts of a row's key: 1 unless it is heavy."""
    known = F.create_map(*[F.lit(x) for k, n in heavy.items() for x in (k, n)])
    return F.coalesce(F.try_element_at(known, F.col(key)), F.lit(1))


def spread_join(rows: DataFrame, looked_up: DataFrame, key: str, heavy: dict, how: str = "inner", spread: str = "doc_id") -> DataFrame:
    """rows joined with looked_up (one row a key) on key: rows of the heavy keys are dealt over parts, by a hash of the column named in
    spread, and only their rows of looked_up are copied into these parts."""
    if not heavy:
        return rows.join(looked_up, key, how)
    parts = parts_of(key, heavy)
    salted = rows.withColumn("__part", F.pmod(F.xxhash64(spread), parts).cast("int"))
    copied = looked_up.withColumn("__part", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    return salted.join(copied, [key, "__part"], how).drop("__part")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit integers (the finalizer of splitmix64), vectorised."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + _MIX
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


class WordHashes(dict):
    """word -> xxh64, remembered up to a bound so that frequent words are hashed once."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh64_intdigest(word)
        if len(self) < self.LIMIT:
            self[word] = h
        return h


def hashed_words(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), dtype=U64, count=len(words))


def window_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """One hash for each run of k words, in order; empty when there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        out = h[:n].copy()
        for i in range(1, k):
            out = mix64(out) + h[i : i + n]
    return mix64(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
