"""Gaps and up/down windows of an append log as a stream: state by key, in the order of event time.

A key's rows wait in its state until the watermark has passed them; then they are taken in the order of (time, event), exactly as the batch
operators of ``operators.timeline`` order them. A row that comes later than the watermark is dropped. What is still open when the log falls silent
stays in the state until the next row or, for a window, until it has been silent for ``idle_s`` seconds of event time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: ``before`` is the last row taken (-1: none), then the open window: its state, number, first and last time, rows; then the rows that wait.
STATE = "before long, state boolean, run long, first long, last long, n long, ats array<long>, ids array<long>, states array<boolean>"
OUT = "kind string, key string, event_id long, gap_s double, run long, state boolean, n long, seconds double"


class Window:
    """One key's state and what it gives while rows are taken in order."""

    def __init__(self, key: str, kept: tuple | None, more_than_us: int, idle_us: int | None):
        self.key, self.more, self.idle, self.out = key, more_than_us, idle_us, []
        self.before, self.state, self.run, self.first, self.last, self.n, ats, ids, states = kept or (-1, None, 0, 0, 0, 0, [], [], [])
        self.waiting = list(zip(ats, ids, states))

    def close(self) -> None:
        if self.n:
            self.out.append(("window", self.key, None, None, self.run, self.state, self.n, (self.last - self.first) / 1e6))
        self.n = 0

    def take(self, upto: int) -> None:
        """All waiting rows up to a time, in order; then windows that were idle for too long end."""
        self.waiting.sort(key=lambda r: r[:2])
        ready = [r for r in self.waiting if r[0] <= upto]
        self.waiting = self.waiting[len(ready) :]
        for at, event, state in ready:
            self.silent(at)
            if self.before >= 0 and at - self.before > self.more:
                self.out.append(("gap", self.key, event, (at - self.before) / 1e6, None, None, None, None))
            if not self.n or state is not self.state:
                self.close()
                self.run, self.state, self.first = self.run + 1, state, at
            self.n, self.last, self.before = self.n + 1, at, at
        self.silent(upto)

    def silent(self, now: int) -> None:
        if self.idle is not None and self.n and now - self.last > self.idle:
            self.close()

    def kept(self) -> tuple:
        ats, ids, states = map(list, zip(*self.waiting)) if self.waiting else ([], [], [])
        return (self.before, self.state, self.run, self.first, self.last, self.n, ats, ids, states)


def gaps_and_windows(log: DataFrame, more_than_s: float, by: str = "url", state: str = "up", at: str = "ts", late: str = "2 hours", idle_s: float | None = None) -> DataFrame:
    """A stream log(by, event_id, at, state) -> rows of OUT: kind ``gap`` (event_id, gap_s) or ``window`` (run, state, n, seconds).

    The log carries event time with a watermark of ``late``. Append mode; a window is given when it ends, by a row of another state or by silence.
    Rows without a time or a key are dropped; a null state is a state of its own. The state of a key holds the rows of the last ``late`` only.
    """
    more, idle = int(more_than_s * 1e6), None if idle_s is None else int(idle_s * 1e6)

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        w = Window(key[0], kept.get if kept.exists else None, more, idle)
        mark = kept.getCurrentWatermarkMs() * 1000
        for f in frames:
            for t, event, s in zip(f["t"], f["event_id"], f["state"]):
                if t > mark:  # Spark drops later rows too, but only from the second batch on
                    w.waiting.append((int(t), int(event), None if pd.isna(s) else bool(s)))
        w.take(mark)
        kept.update(w.kept())
        due = [min(t for t, _, _ in w.waiting)] if w.waiting else []
        if idle is not None and w.n:
            due.append(w.last + idle)
        if due:
            kept.setTimeoutTimestamp(max(min(due) // 1000, mark // 1000) + 1)
        if w.out:
            yield pd.DataFrame(w.out, columns=["kind", "key", "event_id", "gap_s", "run", "state", "n", "seconds"]).astype({"event_id": "Int64", "run": "Int64", "n": "Int64", "state": "boolean"})

    rows = log.select(F.col(by).cast("string").alias("key"), F.col(at).cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), F.col(state).cast("boolean").alias("state"))
    rows = rows.where("key is not null and ts is not null").withWatermark("ts", late).withColumn("t", F.unix_micros("ts"))
    return rows.groupBy("key").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)
