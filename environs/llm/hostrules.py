"""Quality rules of documents and of their hosts.

Each document is judged by its own text (base rules); then failures are summed by host, each host's failure rate is
shrunk towards the corpus by a beta prior fitted to all hosts (empirical Bayes), and a host whose shrunken rate is too
high takes all its documents with it. Sums by host are combined on the map side, so a host with a third of all rows is
no hot group; verdicts go back by a join on the host's name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, heavy_keys, ship, spread_join, stash, utf8, worker

SYMBOLS = b"#*$%&|<>"
_SYMBOLS = [bytes([c]) for c in SYMBOLS]
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunken failure rate is above this.
MAX_HOST_RATE = 0.8
#: Hosts whose rates are sent to all tasks; more are joined by shuffling.
BROADCAST_HOSTS = 10_000
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice in the list."""
    n = len(words) - 2
    if n < 2:
        return 0
    ids: dict[bytes, int] = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, len(words))
    v = len(ids)
    if v < 2_000_000:
        windows = (a[:n] * v + a[1 : n + 1]) * v + a[2:]
    else:  # v**3 would overflow
        pairs = np.unique(a[:-1] * v + a[1:], return_inverse=True)[1]
        windows = pairs[:n] * v + a[2:]
    order = np.argsort(windows, kind="stable")
    s = windows[order]
    same = s[1:] == s[:-1]
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    covered[:n] |= twice
    covered[1 : n + 1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


def measure(text: bytes | None) -> tuple[int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0
    words = text.split()
    if not words:
        return 0, 0, sum(map(text.count, _SYMBOLS)), 0, 0
    size = sum(map(len, words))
    word_chars = size if text.isascii() else size - int(((np.frombuffer(text, np.uint8) & 0xC0) == 0x80).sum())
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(words), word_chars, sum(map(text.count, _SYMBOLS)), len(lines) - len(set(lines)), repeated_words(words)


def measured(docs: DataFrame) -> DataFrame:
    """docs(..., utf8) -> its other columns and a struct column ``measured`` of MEASURES; null text counts nothing."""
    names = [c for c in docs.columns if c != "utf8"]
    into = T.StructType([*[docs.schema[c] for c in names], T.StructField("measured", T.StructType([T.StructField(m, T.LongType()) for m in MEASURES]))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            last = len(names)
            found = np.array([measure(x.as_py()) for x in b.column(last)], np.int64).reshape(-1, len(MEASURES))
            s = pa.StructArray.from_arrays([pa.array(found[:, i]) for i in range(len(MEASURES))], MEASURES)
            yield pa.RecordBatch.from_arrays([*b.columns[:last], s], [*names, "measured"])

    return docs.select(*names, "utf8").mapInArrow(worker(run), into)


def base_failed(min_words: int = MIN_WORDS, max_repeat_percent: int = MAX_REPEAT_PERCENT) -> Column:
    m = F.col("measured")
    return (m.n_words < min_words) | (F.lit(100) * m.n_repeat_words > F.lit(max_repeat_percent) * m.n_words)


def host_rates(hosts: DataFrame) -> DataFrame:
    """hosts(host, n_docs, n_failed) -> with rate (shrunken).

    The prior's mean and spread are the mean and variance of the hosts' own rates (method of moments), so one number of
    each is all that leaves the executors. With one host, or hosts that all have one rate, the prior is that rate.
    """
    p = F.col("n_failed") / F.col("n_docs")
    one = hosts.agg(F.avg(p).alias("m"), F.var_pop(p).alias("v")).first()
    mean, var = (one.m or 0.0), (one.v or 0.0)
    strength = min(1e6, max(1.0, mean * (1 - mean) / var - 1)) if var > 1e-12 else 1e6 * (0 < mean < 1) + 1
    alpha, beta = mean * strength, (1 - mean) * strength
    return hosts.withColumn("rate", F.round((F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta)), 9))


def judged(docs: DataFrame, host: Column | None, max_host_rate: float, carry: list[str]) -> DataFrame:
    """row (a struct of the carried columns of docs), measured and verdict (base_failed, host_rate, kept).

    Without the text among the carried columns, measures are written once and read twice; with it, documents are measured twice, so
    that no text is written. A host may have a third of all rows: its rate goes to all tasks that have such rows.
    """
    ship(docs.sparkSession)
    h = F.col("source") if host is None else host
    # a null host is a host of its own: it is told apart from an empty name
    key = F.when(h.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), h.cast("string"))).alias("host")
    slim = docs.select(key, utf8("text").alias("utf8"))
    whole = docs.select(key, F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), utf8("text").alias("utf8"))
    rows = measured(whole)
    if "text" not in carry:
        rows = stash(rows, "measures")
        slim_rows = rows.select("host", "measured")
    else:
        slim_rows = measured(slim)
    sums = stash(slim_rows.select("host", base_failed().alias("failed")).groupBy("host").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed")), "hosts")
    rates = host_rates(sums).select("host", "rate")
    rows = spread_join(rows, rates, "host", heavy_keys(sums, "host", "n_docs"), "left", spread="measured") if sums.limit(BROADCAST_HOSTS + 1).count() > BROADCAST_HOSTS else rows.join(F.broadcast(rates), "host", "left")
    failed = base_failed()
    verdict = F.struct(failed.alias("base_failed"), F.col("rate").alias("host_rate"), (~failed & (F.col("rate") <= F.lit(max_host_rate))).alias("kept"))
    return rows.select("row", "measured", verdict.alias("verdict"))


def judge(docs: DataFrame, *, host: Column | None = None, max_host_rate: float = MAX_HOST_RATE, text_too: bool = True) -> DataFrame:
    """docs(doc_id, text, source, ...) -> the same rows with structs ``measured`` and ``verdict`` (base_failed, host_rate, kept).

    host: the column that names a document's host; by default its source. A null host is a host of its own. An empty text
    fails for want of words. Equal rows are judged each. An empty table stays empty. Other columns pass through, whatever their names;
    where one is called ``measured`` or ``verdict``, ours has ``_1`` after it. Without text_too the text is left out, which is faster.
    """
    carry = [c for c in docs.columns if text_too or c != "text"]
    rows = judged(docs, host, max_host_rate, carry)
    return rows.select("row.*", *[F.col(c).alias(free_name(carry, c)) for c in ("measured", "verdict")])


def keep(docs: DataFrame, *, host: Column | None = None, max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The documents that pass, with the columns they had. Odd rows are treated as in ``judge``."""
    return judged(docs, host, max_host_rate, docs.columns).where("verdict.kept").select("row.*")
