"""Tables with a commit log, upserts by bucket, state by key on a stream."""

from __future__ import annotations

import os
import threading

import pytest
from pyspark.sql import functions as F

from environs.operators import publication
from environs.sources import versions
from environs.streaming import events

ROWS = "k long, at long, v string"


def folders(path):
    return {os.path.join(d, x).removeprefix(f"{path}/") for d, names, _ in os.walk(path) for x in names if x.startswith("__bucket=")}


def test_two_writers_and_a_reader(spark, tmp_path):
    """A reader in a loop finds a whole version at any moment, and no number is taken twice."""
    path, wrong, done = str(tmp_path / "t"), [], threading.Event()
    versions.Table(spark, path).replace(spark.range(10).select("id"))
    taken = []

    def write(n):
        t = versions.Table(spark, path)
        for _ in range(4):
            taken.append(t.replace(spark.range(n).select("id")))

    def read():
        t = versions.Table(spark, path)
        while not done.is_set():
            try:
                n = t.read().count()
                if n not in (10, 20, 30):
                    wrong.append(n)
            except Exception as e:
                wrong.append(repr(e))

    reader, writers = threading.Thread(target=read), [threading.Thread(target=write, args=(n,)) for n in (20, 30)]
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    done.set()
    reader.join()
    assert wrong == [] and sorted(taken) == list(range(2, 10)) and versions.Table(spark, path).versions() == list(range(1, 10))


def test_a_taken_number_is_refused(spark, tmp_path):
    t = versions.Table(spark, str(tmp_path / "t"))
    assert t._take(1, '{"a": 1}') and not t._take(1, '{"a": 2}') and t.entry(1) == {"a": 1}
    with pytest.raises(FileNotFoundError):
        versions.Table(spark, str(tmp_path / "none")).read()


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    path = str(tmp_path / "t")
    t = versions.Table(spark, path, buckets=8)
    t.upsert(spark.createDataFrame([(i, 0, "a") for i in range(64)], ROWS), ["k"], "at")
    first = folders(path)
    one = spark.createDataFrame([(3, 1, "b"), (100, 1, "c"), (5, -1, "old"), (3, 1, "b")], ROWS)
    touched = one.select(F.pmod(F.xxhash64("k"), F.lit(8))).distinct().count()
    t.upsert(one, ["k"], "at")
    assert len(folders(path) - first) == touched < 8
    got = {r.k: r.v for r in t.read().collect()}
    assert len(got) == 65 and (got[3], got[100], got[5], got[6]) == ("b", "c", "a", "a")
    assert {r.k: r.v for r in t.read(1).collect()}[3] == "a"
    # versions that expire take their folders with them
    gone = t.expire(keep=1, grace_s=-1)
    assert gone == touched and t.versions() == [2] and len(folders(path)) == 8 and t.read().count() == 65


def test_a_batch_counts_once(spark, tmp_path):
    t = versions.Table(spark, str(tmp_path / "t"), buckets=4)
    rows = spark.createDataFrame([(1, 1, "a")], ROWS)
    assert t.upsert(rows, ["k"], "at", ("s", 0)) == 1
    assert t.upsert(rows.withColumn("v", F.lit("again")), ["k"], "at", ("s", 0)) == 1
    assert t.upsert(rows.limit(0), ["k"], "at", ("s", 1)) == 2 and t.upsert(rows.withColumn("v", F.lit("other")), ["k"], "at", ("r", 0)) == 3
    assert [r.v for r in t.read().collect()] == ["other"]


def test_a_replaced_table_takes_upserts(spark, tmp_path):
    t = versions.Table(spark, str(tmp_path / "t"), buckets=4)
    t.replace(spark.createDataFrame([(i, 0, "a") for i in range(9)], ROWS))
    t.upsert(spark.createDataFrame([(2, 1, "b")], ROWS), ["k"], "at")
    assert {r.k: r.v for r in t.read().collect()} == {i: "b" if i == 2 else "a" for i in range(9)}


def test_upserts_of_two_writers(spark, tmp_path):
    path = str(tmp_path / "t")

    def write(lo):
        for i in range(lo, lo + 3):
            versions.Table(spark, path, buckets=2).upsert(spark.createDataFrame([(i, 0, "x")], ROWS), ["k"], "at")

    both = [threading.Thread(target=write, args=(n,)) for n in (0, 10)]
    for t in both:
        t.start()
    for t in both:
        t.join()
    assert sorted(r.k for r in versions.Table(spark, path).read().collect()) == [0, 1, 2, 10, 11, 12]


def test_decisions_recorded_while_compacting(spark, tmp_path):
    store = publication.Store(spark, str(tmp_path / "s"))
    store.set_status("city", "london", "draft", "first", "owner")

    def kept(rows):
        store.set_status("city", "london", "indexable", "meanwhile", "other")
        return publication.latest(rows, store.KEY, "seq", "decided_at")

    store.log.compact(kept)
    assert store.get_status("city", "london")["reason"] == "meanwhile" and store.generation() == 1
    store.set_status("city", "london", "noindex", "later", "owner")
    store.compact(keep=1)
    assert store.get_status("city", "london")["reason"] == "later" and store.current().count() == 1


# state by key -------------------------------------------------------------------------------------------------------

EVENTS = "/root/testdata/sf0.001/events.parquet"


def collected(spark, tmp_path, log, name, **options):
    """All that a stream over the folder gives, file by file."""
    from environs.streaming import probes

    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = probes.gaps_and_windows(stream, 600, **options)
    q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def test_stateful_stream_equals_batch(spark, tmp_path):
    """Files overlap in time by less than the watermark; a last row of each key far ahead pushes everything through."""
    from environs.operators import timeline

    e = spark.read.parquet(EVENTS)
    log = e.select((F.col("user_id") % 4).cast("string").alias("url"), "event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("event_type") != "error").alias("up"))
    order = F.unix_micros("ts") + F.pmod(F.xxhash64("event_id"), F.lit(3_600_000_000))  # up to an hour out of order
    ordered = log.withColumn("o", order).repartitionByRange(6, "o").drop("o")
    parts = [log.sparkSession.createDataFrame(p, log.schema) for p in ordered.rdd.glom().collect() if p]
    last = log.groupBy("url").agg(F.lit(-1).cast("long").alias("event_id"), (F.max("ts") + F.expr("interval 9 days")).alias("ts"), F.lit(None).cast("boolean").alias("up")).select(log.columns)
    for p in [*parts, last, last.withColumn("ts", F.col("ts") + F.expr("interval 1 day"))]:
        p.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = collected(spark, tmp_path, log, "t_probes", late="3 hours")
    gaps = {(r.key, r.event_id): r.gap_s for r in got.where("kind = 'gap' and event_id >= 0").collect()}
    assert gaps == {(r.url, r.event_id): r.gap_s for r in timeline.gaps(log, 600).collect()} and gaps
    windows = {(r.key, r.run): (r.state, r.n, r.seconds) for r in got.where("kind = 'window' and state is not null").collect()}
    assert windows == {(r.url, r.run): (r.up, r.n, r.seconds) for r in timeline.islands(log).collect()} and windows


def test_late_rows_and_idle_windows(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda m: datetime(2026, 1, 1) + timedelta(minutes=m)
    schema = "url string, event_id long, ts timestamp, up boolean"
    files = [[("a", 1, at(0), True), ("a", 2, at(5), True), (None, 3, at(5), True), ("a", 4, None, True)], [("a", 5, at(300), False)], [("a", 6, at(10), True), ("a", 7, at(301), False)], [("b", 8, at(900), True)], [("b", 9, at(901), True)]]
    for f in files:
        spark.createDataFrame(f, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = collected(spark, tmp_path, spark.createDataFrame([], schema), "t_idle", late="1 hour", idle_s=3600.0)
    rows = sorted((r.kind, r.key, r.event_id or 0, r.n or 0, r.gap_s or 0.0) for r in got.collect())
    # row 6 is later than the watermark and counts nowhere; both windows of a end by silence
    assert rows == [("gap", "a", 5, 0, 295 * 60.0), ("window", "a", 0, 2, 0.0), ("window", "a", 0, 2, 0.0)]
