"""Events and probe logs in time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import timeline
from ..sources.atlas import Atlas
from ..streaming import events as S
from .registry import query


def probe_log(a: Atlas) -> DataFrame:
    return a.table("events").select((F.col("user_id") % 4).alias("url"), "event_id", "ts", (F.col("event_type") != "error").alias("up"))


LOG = "log as (select user_id % 4 as url, event_id, ts, event_type <> 'error' as up from events)"


@query(f"with {LOG} select url, event_id, gap_s from (select *, (epoch_us(ts) - epoch_us(lag(ts) over (partition by url order by ts, event_id))) / 1e6 as gap_s from log) where gap_s > 600", plain=True)
def gap_detection(a: Atlas) -> DataFrame:
    return timeline.gaps(probe_log(a), 600)


@query(
    f"""with {LOG}, ch as (select *, case when lag(up) over (partition by url order by ts, event_id) is not distinct from up then 0 else 1 end as c from log),
  rn as (select *, sum(c) over (partition by url order by ts, event_id rows unbounded preceding)::bigint as run from ch)
  select url, run, up, count(*) as n, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as seconds from rn group by 1, 2, 3""",
    plain=True,
)
def up_down_windows(a: Atlas) -> DataFrame:
    return timeline.islands(probe_log(a))


@query("select epoch_us(time_bucket(interval '1 hour', ts)) // 1000000 as start_s, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2", plain=True)
def events_tumbling(a: Atlas) -> DataFrame:
    return S.tumbling(a.table("events")).select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """select w as start_s, event_type, count(*) as n, round(sum(value), 4) as total from (select event_type, value, unnest([s // 1800 * 1800, s // 1800 * 1800 - 1800]) as w from (select *, epoch_us(ts) // 1000000 as s from events)) group by 1, 2""",
    plain=True,
)
def events_sliding(a: Atlas) -> DataFrame:
    return S.sliding(a.table("events")).select(F.unix_seconds("start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    """with g as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as new from events), s as (select *, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select user_id, epoch_us(min(ts)) as start_us, count(*) as n from s group by user_id, k""",
    plain=True,
)
def events_session(a: Atlas) -> DataFrame:
    return S.sessions(a.table("events")).select("user_id", F.unix_micros("start").alias("start_us"), "n")


@query("select epoch_us(date_trunc('day', ts)) // 1000000 as day_s, count(*) as n, round(count(*) filter (where floor(value)::bigint % 5 = 0) / count(*)::double, 6) as zero_rate from events group by 1", plain=True)
def events_zero_result_rate(a: Atlas) -> DataFrame:
    return S.zero_results(a.table("events")).select(F.unix_seconds("start").alias("day_s"), "n", F.round("zero_rate", 6).alias("zero_rate"))
