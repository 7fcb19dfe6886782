"""Sources and sinks as queries: tables are written to the shared folder in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import quality
from ..sources import readers, sinks, versions
from ..sources.atlas import Atlas
from ..storage import scratch_path
from .name_queries import scores_sql, table_scores
from .registry import query

# formats ------------------------------------------------------------------------------------------------------------


@query("select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders", plain=True)
def csv_round_trip(a: Atlas) -> DataFrame:
    path = scratch_path(a.spark, "csv")
    sinks.write_csv(a.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), path)
    return readers.read_csv(a.spark, path, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderpriority string")


@query("select event_id % 10 as url, (epoch_us(ts) // 1000000)::bigint as at, count(*) as n, count(*) filter (where event_type <> 'error') as up from events group by all", plain=True)
def probe_log_csv(a: Atlas) -> DataFrame:
    """Two appends to a probe log; its timestamps are parsed again."""
    path, e = scratch_path(a.spark, "log"), a.table("events")
    ok = F.col("event_type") != "error"
    log = e.select(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp_utc"), (F.col("event_id") % 10).cast("string").alias("url"), F.when(ok, 200).alias("status"), F.lit(None).cast("string").alias("cf_ray"), F.when(~ok, "down").alias("error"), "event_id")
    for odd in (0, 1):
        sinks.append_log(log.where(F.col("event_id") % 2 == odd).drop("event_id"), path)
    p = readers.read_probes(a.spark, path)
    return p.groupBy(F.col("url").cast("long").alias("url"), F.unix_seconds("ts").alias("at")).agg(F.count(F.lit(1)).alias("n"), F.count_if("up").alias("up"))


@query("select city_id, right(id, 1) as bucket, id, balanced_score, food_essentials as food from sc", scores_sql("sc"))
def json_shards(a: Atlas) -> DataFrame:
    """Nested JSON by city and bucket, read back with its partitions."""
    path = scratch_path(a.spark, "shards")
    sinks.write_shards(table_scores(a).select("city_id", "id", "balanced_score", F.struct("food_essentials").alias("scores")), path, "id")
    d = a.spark.read.schema("id string, balanced_score double, scores struct<food_essentials:double>, city_id string, bucket string").json(path)
    return d.select("city_id", "bucket", "id", "balanced_score", F.col("scores.food_essentials").alias("food"))


@query("select city_id, count(*) as n, max(key) as largest, true as counted from pois group by city_id")
def parquet_by_city(a: Atlas) -> DataFrame:
    """One folder for each city; what the write counts is what the table holds."""
    path = scratch_path(a.spark, "pois")
    seen = sinks.write_parquet(a.pois.select("city_id", "poi_id", "key"), path)
    d = a.spark.read.parquet(path)
    return d.groupBy("city_id").agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("largest")).withColumn("counted", F.lit(seen["rows"]) == F.lit(a.pois.count()))


@query("select c_custkey as id, case when c_custkey % 3 = 0 then 2 when c_custkey % 2 = 0 then 1 else 0 end::int as version, c_acctbal as balance from customer", plain=True)
def versioned_upserts(a: Atlas) -> DataFrame:
    """Three batches into a table of buckets; the second is run twice, the last comes out of order."""
    c = a.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    t = versions.Table(a.spark, scratch_path(a.spark, "store"), buckets=8)
    batch = lambda n, rows: t.upsert(rows.select("id", F.lit(n).alias("version"), "balance"), ["id"], "version", ("query", n))
    batch(0, c)
    batch(1, c.where("id % 2 = 0"))
    batch(1, c.where("id % 2 = 0"))
    batch(2, c.where("id % 3 = 0"))
    t.upsert(c.where("id % 3 = 0").select("id", F.lit(1).alias("version"), F.lit(-1.0).alias("balance")), ["id"], "version")
    t.expire(keep=1, grace_s=-1)
    return t.read()


@query("select id, case when key % 4 = 0 then 'full' else 'shard' end as found_in, city_id from hotels where key % 5 <> 0 union all select 'x' || id, 'none', null from hotels where key % 5 = 0")
def shard_fallback(a: Atlas) -> DataFrame:
    """Look-ups by shard; what isn't in its shard is looked for in the full index."""
    k = F.col("key")
    index = a.hotels.select("id", "city_id", F.right("id", F.lit(1)).alias("bucket"))
    wrong = F.when(k % 4 == 0, "-").otherwise(F.right("id", F.lit(1)))
    asked = a.hotels.select(F.when(k % 5 == 0, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"), wrong.alias("bucket"))
    return readers.look_up(asked, index)


# further rows -------------------------------------------------------------------------------------------------------


@query("select l_orderkey as name, min(l_returnflag) as value from lineitem group by l_orderkey having count(distinct l_returnflag) = 1 and count(*) filter (where l_linenumber = 3 and l_returnflag <> 'N') = 0", plain=True)
def agreement_values(a: Atlas) -> DataFrame:
    """An order's flag counts only if all its lines agree; third lines other than N have none, which is a disagreement."""
    value = F.when((F.col("l_linenumber") != 3) | (F.col("l_returnflag") == "N"), F.col("l_returnflag"))
    return quality.agreed(a.table("lineitem").select(F.col("l_orderkey").alias("name"), value.alias("value")), "name", "value")


@query("select poi_id as id from pois where family in ('shopping', 'food_and_drink', 'health_care', 'lifestyle_services', 'arts_and_entertainment') or leaf in ('airport', 'park', 'zoo', 'train_station', 'metro_station', 'bus_station')")
def lodging_points(a: Atlas) -> DataFrame:
    """Points with lodging in their hierarchy, and points without one, never count, whatever their leaf."""
    lodging = a.hotels.select(F.col("id").alias("poi_id"), F.lit("restaurant").alias("leaf"), F.when(F.col("key") % 7 != 0, F.array(F.lit("food_and_drink"), F.lit("lodging"))).alias("hierarchy"))
    both = a.pois.select("poi_id", "leaf", "hierarchy").union(lodging)
    return both.where(scoring.poi_of_interest(F.col("leaf"), F.col("hierarchy"))).select(F.col("poi_id").alias("id"))


@query("select id, case when name like 'Отель%' then 'Otel' || substr(name, 6) || ' (' || name || ')' when name = 'ホテル' then 'hoteru (ホテル)' when name = 'Ξενία' then 'Xenia (Ξενία)' end as display_name from hotels")
def fact_names(a: Atlas) -> DataFrame:
    """A name is shown in another form only where that differs."""
    shown = text.present_name(F.col("name")).display_name
    return a.hotels.select("id", F.when(shown != F.trim(F.coalesce("name", F.lit(""))), shown).alias("display_name"))


@query(
    """select s.id, d.dimension, s.v as value, round(m.mean, 2) as city_mean, round(s.v - round(m.mean, 2), 2) as over from (unpivot (select city_id, id, walkability_density, transit_access, food_essentials, quietness_proxy, family_convenience, nightlife_access from sc)
    on walkability_density, transit_access, food_essentials, quietness_proxy, family_convenience, nightlife_access into name dimension value v) s
    join (select distinct dimension from (select unnest(['walkability_density', 'transit_access', 'food_essentials', 'quietness_proxy', 'family_convenience', 'nightlife_access']) as dimension)) d using (dimension)
    join (select city_id, dimension, avg(v) as mean from (unpivot (select city_id, walkability_density, transit_access, food_essentials, quietness_proxy, family_convenience, nightlife_access from sc)
    on walkability_density, transit_access, food_essentials, quietness_proxy, family_convenience, nightlife_access into name dimension value v) group by all) m on m.city_id = s.city_id and m.dimension = s.dimension""",
    scores_sql("sc"),
)
def baseline_comparison(a: Atlas) -> DataFrame:
    """Each score of a hotel beside the mean of its city."""
    s = table_scores(a).drop("confidence").withColumnRenamed("score_confidence", "confidence")
    return quality.against_baseline(s, quality.baseline(s))
