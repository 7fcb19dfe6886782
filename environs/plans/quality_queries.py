"""Joins and sets, aggregates, ranks, quality checks, score versions, publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import scoring, text
from ..operators import anchors, dedupe, matching, publication, quality, ranking, ranks, statistics
from ..operators.spatial import counted, near_points, sited, sites, to_all
from ..sources.atlas import Atlas
from .dimension_queries import FACTS_SQL, pairs_sql
from .name_queries import ACCOMMODATION_SQL, FOLD, scores_sql, table_scores
from .registry import query

# joins and sets ---------------------------------------------------------------------------------------------------


@query("select id from hotels where id not in (select id from hotels where key % 10 = 3)")
def anti_excluded(a: Atlas) -> DataFrame:
    return a.hotels.select("id").join(a.hotels.where("key % 10 = 3").select("id"), "id", "left_anti")


@query("select p.poi_id from pois p where p.city_id not in (select city_id from hotels where city_country = 'GB')")
def anti_not_in(a: Atlas) -> DataFrame:
    return a.pois.join(a.hotels.where("city_country = 'GB'").select("city_id").distinct(), "city_id", "left_anti").select("poi_id")


@query("select id, name from hotels where name in (select name from hotels where key % 50 = 1)")
def semi_name_in(a: Atlas) -> DataFrame:
    return a.hotels.select("id", "name").join(a.hotels.where("key % 50 = 1").select("name"), "name", "left_semi")


COINCIDENT = "coin as (select lat, lon from hotels group by lat, lon having count(*) > 1)"


@query("select id, (lat, lon) in (select (lat, lon) from coin) as is_coincident from hotels", COINCIDENT)
def tuple_in_flag(a: Atlas) -> DataFrame:
    c = a.hotels.groupBy("lat", "lon").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("lat", "lon", F.lit(True).alias("hit"))
    return a.hotels.join(c, ["lat", "lon"], "left").select("id", F.coalesce("hit", F.lit(False)).alias("is_coincident"))


@query("select id, leaf, x.n from hotels join (select leaf, count(*) as n from hotels group by leaf) x using (leaf)")
def using_join(a: Atlas) -> DataFrame:
    return a.hotels.join(a.hotels.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")), "leaf").select("id", "leaf", "n")


@query("select id as place, 'hotel' as kind from hotels union all select poi_id, 'poi' from pois union all select green_id, 'green' from green")
def union_green(a: Atlas) -> DataFrame:
    parts = [a.hotels.select(F.col("id").alias("place"), F.lit("hotel").alias("kind")), a.pois.select(F.col("poi_id").alias("place"), F.lit("poi").alias("kind")), a.green.select(F.col("green_id").alias("place"), F.lit("green").alias("kind"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("select leaf from hotels union select leaf from pois")
def union_distinct_ids(a: Atlas) -> DataFrame:
    return a.hotels.select("leaf").union(a.pois.select("leaf")).distinct()


@query("select coalesce(o.id, n.id) as id, case when n.id is null then 'removed' when o.id is null then 'added' else 'common' end as change from (select id from hotels where key % 9 <> 0) o full join (select id from hotels where key % 8 <> 0) n on o.id = n.id")
def ids_added_removed(a: Atlas) -> DataFrame:
    return quality.ids_added_removed(a.hotels.where("key % 9 <> 0"), a.hotels.where("key % 8 <> 0"))


@query("select id, 'missing' as problem from hotels where key % 9 = 0 and key % 8 <> 0 union all select id, 'not wanted' from hotels where key % 8 = 0 and key % 9 <> 0")
def sitemap_set_check(a: Atlas) -> DataFrame:
    return publication.set_difference(a.hotels.where("key % 9 <> 0"), a.hotels.where("key % 8 <> 0"), "id")


_HAV_KM = "2 * 6371.0::double * asin(least(1.0::double, sqrt(pow(sin(radians(lat - clat) / 2), 2) + cos(radians(clat)) * cos(radians(lat)) * pow(sin(radians(lon - clon) / 2), 2))))"


# duplicates -------------------------------------------------------------------------------------------------------

_FORM = f"trim(regexp_replace(lower({FOLD.format('name')}), '[^a-z0-9]+', ' ', 'g'))"
DEDUPE_SQL = f"""formed as (select *, {_FORM} as form, floor(lat / 0.0003::double) as gy, floor(lon / 0.0003::double) as gx from hotels),
  dup as (select * from (select a.city_id, a.id as a, b.id as b, 2 * 6371000.0::double * asin(least(1.0::double, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) as d
    from formed a join formed b on a.city_id = b.city_id and a.form = b.form and a.leaf = b.leaf and a.id < b.id and abs(a.gx - b.gx) <= 1 and abs(a.gy - b.gy) <= 1 where a.form <> '') where d <= 25),
  clustered as (select h.*, least(h.id, coalesce((select min(a) from dup where b = h.id), h.id)) as cluster from hotels h)"""


def _formed(a: Atlas) -> DataFrame:
    return a.hotels.withColumn("form", text.dedupe_form(F.col("name")))


def clustered(a: Atlas) -> DataFrame:
    return dedupe.clusters(a.hotels, dedupe.links(_formed(a)))


@query("select city_id, a, b, round(d, 4) as d from dup", DEDUPE_SQL)
def dedupe_pairs(a: Atlas) -> DataFrame:
    return dedupe.candidate_pairs(_formed(a)).withColumn("d", F.round("d", 4))


@query("select id, cluster from clustered", DEDUPE_SQL)
def dedupe_components(a: Atlas) -> DataFrame:
    return clustered(a).select("id", "cluster")


@query(
    """select city_id, id, case when len(members) > 1 then 70.0 else 100.0 end::double as dedupe_confidence, case when len(members) > 1 then 'name_and_distance' else 'single_record' end as dedupe_method, array_to_string(list_filter(members, lambda m: m <> id), ',') as merged
  from (select city_id, cluster, arg_min(id, (-coalesce(confidence, 0), -n_sources, id)) as id, list(id order by id) as members from clustered group by 1, 2)""",
    DEDUPE_SQL,
)
def dedupe_canonical(a: Atlas) -> DataFrame:
    d = dedupe.canonical(clustered(a))
    return d.select("city_id", "id", "dedupe_confidence", "dedupe_method", F.array_join("merged_from", ",").alias("merged"))


CHAINS_SQL = """ch as (select key, 'c' || lpad(key::varchar, 8, '0') as id, 'chain ' || key // 5 as form, 40 + (key // 5 % 400) * 0.05::double + (key % 5) * 0.00013::double as lat, (key // 5 // 400) * 0.05::double as lon from hotels),
  cp as (select a.id as a, b.id as b from ch a join ch b on a.form = b.form and a.id < b.id
    and 2 * 6371000.0::double * asin(least(1.0::double, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)))) <= 25),
  reach(id, to_id) as (select id, id from ch union select r.id, case when p.a = r.to_id then p.b else p.a end from reach r join cp p on r.to_id in (p.a, p.b))"""


@query("select id, min(to_id) as cluster from reach group by id", CHAINS_SQL)
def dedupe_chains(a: Atlas) -> DataFrame:
    """Records in a row, each near its neighbours only: a chain is one cluster, by links over several records."""
    k = F.col("key")
    row = F.floor(k / 5)
    d = a.hotels.select(F.lit("one").alias("city_id"), F.concat(F.lit("c"), F.lpad(k.cast("string"), 8, "0")).alias("id"), F.concat(F.lit("chain "), row.cast("string")).alias("form"), F.lit("hotel").alias("leaf"),
                        (F.lit(40) + (row % 400) * F.lit(0.05) + (k % 5) * F.lit(0.00013)).alias("lat"), (F.floor(row / 400) * F.lit(0.05)).alias("lon"))
    return dedupe.clusters(d, dedupe.links(d)).select("id", "cluster")


_SIM = "case when greatest(length(l.form), length(r.form)) > 0 then 1.0::double - levenshtein(l.form, r.form) / greatest(length(l.form), length(r.form))::double else 0.0::double end"
MATCH_SQL = f"""lft as (select city_id, id, {_FORM} as form, brand_name as brand, x, y from hotels),
  rgt as (select city_id, id as other, {_FORM} as form, brand_name as brand, x + 40 + key % 4 * 70 as x, y + 30 as y from hotels),
  cand as (select l.city_id, l.id, r.other, sqrt(pow(l.x - r.x, 2) + pow(l.y - r.y, 2)) as d, {_SIM} as sim, coalesce(l.brand = r.brand, false) as same from lft l join rgt r using (city_id)),
  hits as (select *, case when sim >= 0.9 and d <= 150 then 95 when sim >= 0.85 and d <= 250 then 85 when same and sim >= 0.7 then 70 end as c from cand where d <= 400),
  top as (select * from hits where c is not null qualify row_number() over (partition by city_id, id order by c desc, sim desc, d, other) = 1)"""


@query("select l.city_id, l.id, other, case c when 95 then 'close' when 85 then 'near' when 70 then 'brand' else 'fallback' end as rule, coalesce(c, 0)::bigint as confidence, case when c >= 85 then 'accept' when c >= 60 then 'review' else 'reject' end as action from lft l left join top using (city_id, id)", MATCH_SQL)
def entity_match_cascade(a: Atlas) -> DataFrame:
    h = a.hotels.withColumn("form", text.dedupe_form(F.col("name")))
    left = h.select("city_id", "id", "form", F.col("brand_name").alias("brand"), "x", "y")
    right = h.select("city_id", F.col("id").alias("other"), F.col("form").alias("other_form"), F.col("brand_name").alias("other_brand"), (F.col("x") + 40 + F.col("key") % 4 * 70).alias("x"), (F.col("y") + 30).alias("y"))
    return matching.match(left, right)


# aggregates -------------------------------------------------------------------------------------------------------


@query("select city_id, round(lat, 6) as lat, round(lon, 6) as lon, n, array_to_string(names, '|') as names from (select city_id, lat, lon, count(*) as n, list(name order by name) filter (where name is not null) as names from hotels group by 1, 2, 3 having count(*) > 1)")
def coincident_clusters(a: Atlas) -> DataFrame:
    return quality.coincident(a.hotels).select("city_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "n", F.when(F.size("names") > 0, F.array_join("names", "|")).alias("names"))


@query("select leaf, array_to_string(list(id order by id), ',') as ids from hotels group by leaf")
def ordered_name_list(a: Atlas) -> DataFrame:
    return a.hotels.groupBy("leaf").agg(F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


_BASE = ", ".join(f"round(avg({d}), 2) as {d}_mean, round(median({d}), 2) as {d}_median" for d in C.DIMENSIONS)


@query(f"select city_id, count(*) as n_hotels, {_BASE}, round(avg(balanced_score), 2) as balanced_mean, round(median(score_confidence), 2) as confidence_median from sc group by city_id", scores_sql("sc"))
def city_baseline(a: Atlas) -> DataFrame:
    return quality.baseline(table_scores(a).drop("confidence").withColumnRenamed("score_confidence", "confidence"))


@query("select city_id, (list(balanced_score order by balanced_score))[count(*) // 2 + 1] as upper_median from sc group by city_id", scores_sql("sc"))
def upper_median(a: Atlas) -> DataFrame:
    return quality.upper_median(table_scores(a), ["city_id"], "balanced_score")


@query("select leaf, count(*) as n from hotels where leaf in ('lodging', 'campground') group by leaf")
def rejected_by_type(a: Atlas) -> DataFrame:
    return a.hotels.where(F.col("leaf").isin(C.EXCLUDED_TYPES)).groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"))


@query("select city_id, count(*) filter (where n is null) as isolated, count(*) filter (where n = 1) as single, count(*) as n_hotels from hotels left join (select city_id, id, count(*) as n from m group by 1, 2) using (city_id, id) group by city_id", pairs_sql("m", "p.leaf = 'museum'", 800))
def count_filter_isolated(a: Atlas) -> DataFrame:
    h = sited(a.hotels)
    found = near_points(sites(h), counted(a.pois.where("leaf = 'museum'")), 800.0).groupBy("city_id", "id").agg(F.sum("n").alias("n"))
    d = to_all(h, found)
    return d.groupBy("city_id").agg(F.count_if(F.col("n").isNull()).alias("isolated"), F.count_if(F.col("n") == 1).alias("single"), F.count(F.lit(1)).alias("n_hotels"))


VERSIONS = scores_sql("sc") + ", " + scores_sql("sc2", 60)
DIFF_SQL = VERSIONS + ", df as (select o.city_id, o.id, n.family_convenience - o.family_convenience as delta from sc o join sc2 n using (id))"
_DIFF = "count(*) as n_hotels, count(*) filter (where abs(delta) > 0.01) as n_changed, count(*) filter (where abs(delta) >= 15) as n_moved, round(min(delta), 6) as min_delta, round(max(delta), 6) as max_delta, round(avg(delta), 6) as avg_delta"


@query(f"select city_id, {_DIFF} from df group by city_id", DIFF_SQL)
def score_diff(a: Atlas) -> DataFrame:
    return quality.score_diff(table_scores(a), table_scores(a, 60), "family_convenience", 0.01, 15)


@query("select count(*) as n, count(*) filter (where abs(delta) >= 0.05) as changed, count(*) filter (where abs(delta) > 15) as moved from df", DIFF_SQL)
def delta_counts(a: Atlas) -> DataFrame:
    d = table_scores(a).select("id", F.col("family_convenience").alias("o")).join(table_scores(a, 60).select("id", F.col("family_convenience").alias("n")), "id").withColumn("delta", F.col("n") - F.col("o"))
    return d.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.abs("delta") >= 0.05).alias("changed"), F.count_if(F.abs("delta") > 15).alias("moved"))


@query("select * from (select city_id, id, round(delta, 6) as delta, row_number() over (partition by city_id order by round(abs(delta), 6) desc, id) as rank from df) where rank <= 5", DIFF_SQL)
def biggest_movers(a: Atlas) -> DataFrame:
    d = table_scores(a).select("city_id", "id", F.col("family_convenience").alias("o")).join(table_scores(a, 60).select("id", F.col("family_convenience").alias("n")), "id")
    d = d.select("city_id", "id", F.round(F.col("n") - F.col("o"), 6).alias("delta"))
    return ranking.top(d, 5, ["city_id"], [F.desc(F.abs("delta")), F.col("id")])


LABELS = scores_sql("sc") + ", lb as (select *, 1 + key % 5 as food_label, 1 + (key // 3) % 5 as quiet_label, 1 + (key // 7) % 5 as night_label from sc)"


def labelled(a: Atlas) -> DataFrame:
    k = F.col("key")
    d = table_scores(a)
    return d.withColumn("food_label", 1 + k % 5).withColumn("quiet_label", 1 + F.floor(k / 3) % 5).withColumn("night_label", 1 + F.floor(k / 7) % 5)


@query(
    """select city_id, 'food' as dimension, round(avg(abs((food_label - 1) / 4.0::double * 100 - food_essentials)), 6) as mae from lb group by 1 union all
  select city_id, 'quiet', round(avg(abs(100 - (quiet_label - 1) / 4.0::double * 100 - quietness_proxy)), 6) from lb group by 1""",
    LABELS,
)
def label_mae(a: Atlas) -> DataFrame:
    d = statistics.label_error(labelled(a), {"food": ("food_label", "food_essentials", False), "quiet": ("quiet_label", "quietness_proxy", True)}, ["city_id"])
    return d.withColumn("mae", F.round("mae", 6))


@query("select id, round(gap, 6) as gap from (select id, abs((food_label - 1) / 4.0::double * 100 - food_essentials) as gap from lb) order by round(gap, 6) desc, id limit 10", LABELS)
def outliers(a: Atlas) -> DataFrame:
    gap = F.round(F.abs((F.col("food_label") - 1) / 4.0 * 100 - F.col("food_essentials")), 6)
    return labelled(a).select("id", gap.alias("gap")).orderBy(F.desc("gap"), "id").limit(10)


_GAPS = ", ".join(f"('{d}', {d}_m)" for d in C.DIMENSIONS)


@query(
    "select dimension, round(max(m) - min(m), 6) as gap, max(m) - min(m) > 20 as wide from (" + " union all ".join(f"select '{d}' as dimension, city_id, avg({d}) as m from sc group by 2" for d in C.DIMENSIONS) + ") group by dimension", scores_sql("sc")
)
def city_gap(a: Atlas) -> DataFrame:
    means = table_scores(a).groupBy("city_id").agg(*[F.avg(d).alias(d) for d in C.DIMENSIONS])
    long = means.unpivot("city_id", C.DIMENSIONS, "dimension", "m")
    return long.groupBy("dimension").agg(F.round(F.max("m") - F.min("m"), 6).alias("gap"), (F.max("m") - F.min("m") > 20).alias("wide"))


@query("select city_id, leaf, count(*) as n from hotels group by rollup (city_id, leaf)")
def rollup_city_totals(a: Atlas) -> DataFrame:
    return a.hotels.rollup("city_id", "leaf").agg(F.count(F.lit(1)).alias("n"))


@query("select name, min(coalesce(brand_name, '')) as brand from hotels where name is not null group by name having count(distinct coalesce(brand_name, '')) = 1 and min(coalesce(brand_name, '')) <> ''")
def agreement_names(a: Atlas) -> DataFrame:
    """A name's alternative counts only if all records of the name agree; a missing one is a disagreement."""
    g = a.hotels.where("name is not null").groupBy("name").agg(F.collect_set(F.coalesce("brand_name", F.lit(""))).alias("b"))
    return g.where((F.size("b") == 1) & (F.get("b", 0) != "")).select("name", F.get("b", 0).alias("brand"))


@query(
    """select city_id, count(*) filter (where s = 'present') as present, count(*) filter (where s = 'absent') as absent, count(*) filter (where s = 'unknown') as unknown, count(*) filter (where n > 1) as shared
  from (select city_id, case when key % 6 = 0 then 'unknown' when key % 3 = 0 then 'absent' else 'present' end as s, count(*) over (partition by city_id, lon, lat, brand_name) as n from hotels) group by city_id"""
)
def contact_tristate(a: Atlas) -> DataFrame:
    k = F.col("key")
    contact = F.when(k % 6 == 0, F.lit(None).cast("array<string>")).when(k % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("+1")))
    state = F.when(contact.isNull(), "unknown").when(F.exists(contact, lambda c: c != ""), "present").otherwise("absent")
    shared = F.count(F.lit(1)).over(Window.partitionBy("city_id", "lon", "lat", "brand_name"))
    d = a.hotels.select("city_id", state.alias("s"), shared.alias("n"))
    return d.groupBy("city_id").agg(*[F.count_if(F.col("s") == v).alias(v) for v in ("present", "absent", "unknown")], F.count_if(F.col("n") > 1).alias("shared"))


@query("select city_id, present_hotel, present_whole_home, n from (select city_id, count(*) filter (where accommodation_type = 'hotel') as present_hotel, count(*) filter (where accommodation_type = 'whole-home') as present_whole_home, count(*) as n from hotels join (" + ACCOMMODATION_SQL + ") t using (id) group by 1)")
def accommodation_pivot(a: Atlas) -> DataFrame:
    d = a.hotels.select("city_id", text.accommodation(F.col("name"), F.col("brand_name"), F.col("leaf"))["accommodation_type"].alias("t"))
    p = d.groupBy("city_id").pivot("t", ["hotel", "whole-home"]).count().na.fill(0)
    n = d.groupBy("city_id").agg(F.count(F.lit(1)).alias("n"))
    return p.join(n, "city_id").select("city_id", F.col("hotel").alias("present_hotel"), F.col("whole-home").alias("present_whole_home"), "n")


@query("select city_id, round(100.0::double * count(*) filter (where confidence is null) / nullif(count(*), 0), 6) as pct, round(count(*) / nullif(count(*) filter (where key < 0), 0)::double, 6) as guarded from hotels group by city_id")
def guarded_percent(a: Atlas) -> DataFrame:
    n = F.count(F.lit(1))
    return a.hotels.groupBy("city_id").agg(F.round(F.try_divide(F.lit(100.0) * F.count_if(F.col("confidence").isNull()), n), 6).alias("pct"), F.round(F.try_divide(n.cast("double"), F.count_if(F.col("key") < 0).cast("double")), 6).alias("guarded"))


# ranks ------------------------------------------------------------------------------------------------------------


@query("select id, rank() over (partition by city_id order by n_sources) + (count(*) over (partition by city_id, n_sources) - 1) / 2.0::double as r from hotels")
def fractional_rank(a: Atlas) -> DataFrame:
    return ranks.with_rank(a.hotels.select("city_id", "id", "n_sources"), ["city_id"], "n_sources").select("id", ranks.average_rank().alias("r"))


PEERS_SQL = scores_sql("sc") + """, rn as (select city_id, id, row_number() over (partition by city_id order by balanced_score, id) as rn from sc),
  pr as (select a.city_id, a.id, b.id as peer, row_number() over (partition by a.city_id, a.id order by abs(b.rn - a.rn), b.rn) as place from rn a join rn b on a.city_id = b.city_id and b.rn between a.rn - 4 and a.rn + 4 and a.rn <> b.rn)"""


def score_peers(a: Atlas) -> DataFrame:
    return ranking.peers(table_scores(a).select("city_id", "id", F.col("balanced_score").alias("score")))


@query("select city_id, id, peer, place from pr where place <= 4", PEERS_SQL)
def comparable_peers(a: Atlas) -> DataFrame:
    return score_peers(a)


@query(
    "select dimension, a, b, case when a > b then 'a' when b > a then 'b' end as winner from (" + " union all ".join(f"select '{d}' as dimension, (select {d} from sc where id = 'h00000010') as a, (select {d} from sc where id = 'h00000020') as b" for d in C.DIMENSIONS) + ")", scores_sql("sc")
)
def compare_two(a: Atlas) -> DataFrame:
    long = table_scores(a).where(F.col("id").isin("h00000010", "h00000020")).unpivot("id", C.DIMENSIONS, "dimension", "v")
    both = long.groupBy("dimension").agg(F.max(F.when(F.col("id") == "h00000010", F.col("v"))).alias("a"), F.max(F.when(F.col("id") == "h00000020", F.col("v"))).alias("b"))
    return both.select("dimension", "a", "b", F.when(F.col("a") > F.col("b"), "a").when(F.col("b") > F.col("a"), "b").alias("winner"))


@query("select * from (select dimension, city_id, id, v, row_number() over (partition by dimension, city_id order by v desc, id) as rank from (" + " union all ".join(f"select '{d}' as dimension, city_id, id, {d} as v from sc" for d in C.DIMENSIONS) + ")) where rank <= 3", scores_sql("sc"))
def topk_per_dimension(a: Atlas) -> DataFrame:
    long = table_scores(a).select("city_id", "id", *C.DIMENSIONS).unpivot(["city_id", "id"], C.DIMENSIONS, "dimension", "v")
    return ranking.top(long, 3, ["dimension", "city_id"], [F.desc("v"), F.col("id")]).select("dimension", "city_id", "id", "v", "rank")


@query("select id, case when name is null or trim(name) = '' then 0 when regexp_matches(trim(name), '^[0-9]+$') then 1 else 2 end::int as bucket, score_confidence, balanced_score from sc order by bucket, score_confidence, balanced_score, id limit 10", scores_sql("sc"))
def topk_suspicious(a: Atlas) -> DataFrame:
    bucket = F.when(scoring.blank_name(F.col("name")), 0).when(scoring.numeric_name(F.col("name")), 1).otherwise(2)
    return table_scores(a).select("id", bucket.alias("bucket"), "score_confidence", "balanced_score").orderBy("bucket", "score_confidence", "balanced_score", "id").limit(10)


COHORT_SQL = (
    scores_sql("sc")
    + """, cc as (select city_id, id, key % 3 = 0 as chain, round(abs(food_essentials - 50), 1) as dist from sc where score_confidence >= 60),
  q0 as (select city_id, count(*) as n, sum(count(*)) over () as total from cc group by city_id),
  q as (select city_id, least(greatest(12, least(25, round_even(200.0::double * n / total::double, 0)::int)), n) as quota from q0),
  q1 as (select city_id, quota, round_even(quota * 0.7::double, 0)::int as ind from q),
  p1 as (select cc.*, quota, row_number() over (partition by city_id, chain order by dist desc, id) as place, ind from cc join q1 using (city_id)),
  p2 as (select *, place <= case when chain then quota - ind else ind end as first from p1),
  p3 as (select *, quota - sum(first::int) over (partition by city_id) as short, row_number() over (partition by city_id, first order by dist desc, id) as lp from p2),
  p4 as (select *, first or lp <= short as inq from p3),
  p5 as (select *, row_number() over (partition by city_id, inq order by dist desc, id) as spare, 200 - sum(inq::int) over () as room from p4),
  p6 as (select *, case when not inq and spare <= 25 - quota then row_number() over (partition by (not inq and spare <= 25 - quota) order by dist desc, id) end as turn from p5)"""
)


@query("select city_id, id, chain, dist as distinctiveness, case when first then 'quota' when inq then 'backfill' else 'top_up' end as stage from p6 where inq or turn <= room", COHORT_SQL)
def cohort_select(a: Atlas) -> DataFrame:
    c = table_scores(a).where("score_confidence >= 60").select("city_id", "id", (F.col("key") % 3 == 0).alias("chain"), F.round(F.abs(F.col("food_essentials") - 50), 1).alias("distinctiveness"))
    return ranking.cohort(c)


SUBSET_SQL = (
    PEERS_SQL
    + """, req as (select id from sc where key % 40 = 0), lnk as (select distinct peer as id from pr join req on req.id = pr.id where place <= 4 and peer not in (select id from req)),
  must as (select id, 'required' as layer from req union all select id, 'linked' from lnk),
  st as (select city_id, id, score_confidence, balanced_score, count(*) over (partition by city_id) as n, row_number() over (partition by city_id order by balanced_score, id) - 1 as place from sc),
  md as (select city_id, max(balanced_score) filter (where place = n // 2) as med from st group by city_id),
  fl as (select id, row_number() over (partition by city_id order by score_confidence desc, abs(balanced_score - med) desc, id) as rank, round_even((400 - (select count(*) from must))::double * n / (select count(*) from sc), 0) as share
    from st join md using (city_id) where id not in (select id from must))"""
)


@query("select id as slug, layer from must union all select id, 'fill' from fl where rank <= share", SUBSET_SQL)
def static_subset(a: Atlas) -> DataFrame:
    s = table_scores(a)
    pages = s.select("city_id", F.col("id").alias("slug"), F.when(F.col("key") % 40 == 0, "indexable").otherwise("draft").alias("status"), F.col("score_confidence").alias("confidence"), "balanced_score")
    links = score_peers(a).select(F.col("id").alias("slug"), F.col("peer").alias("to"))
    return ranking.static_subset(pages, links, 400, overrun=True)


# statistics -------------------------------------------------------------------------------------------------------


@query("select city_id, round(corr(rx, ry), 6) as rho, count(*) as n from (select city_id, rank() over (partition by city_id order by food_label) + (count(*) over (partition by city_id, food_label) - 1) / 2.0::double as rx, rank() over (partition by city_id order by food_essentials) + (count(*) over (partition by city_id, food_essentials) - 1) / 2.0::double as ry from lb) group by city_id", LABELS)
def spearman_labels(a: Atlas) -> DataFrame:
    return statistics.spearman(labelled(a), "food_label", "food_essentials", ["city_id"]).withColumn("rho", F.round("rho", 6))


@query("select city_id, round(corr(quiet_label, quietness_proxy), 6) as r from lb group by city_id", LABELS)
def pearson_labels(a: Atlas) -> DataFrame:
    return labelled(a).groupBy("city_id").agg(F.round(statistics.pearson(F.col("quiet_label"), F.col("quietness_proxy")), 6).alias("r"))


@query("select city_id, c as concordant, d as discordant, round((c - d) / (c + d)::double, 6) as gamma from (select a.city_id, count(*) filter (where (a.food_label < b.food_label) = (a.food_essentials < b.food_essentials)) as c, count(*) filter (where (a.food_label < b.food_label) <> (a.food_essentials < b.food_essentials)) as d from lb a join lb b on a.city_id = b.city_id and a.id < b.id and a.food_label <> b.food_label and a.food_essentials <> b.food_essentials group by 1)", LABELS)
def gamma_rank(a: Atlas) -> DataFrame:
    g = statistics.gamma(labelled(a), "food_label", "food_essentials", ["city_id"])
    return g.select("city_id", "concordant", "discordant", F.round("gamma", 6).alias("gamma"))


@query("select city_id, round(corr(rx, ry), 6) as rho, corr(rx, ry) >= 0.5 as accepted from (select city_id, rank() over (partition by city_id order by l) + (count(*) over (partition by city_id, l) - 1) / 2.0::double as rx, rank() over (partition by city_id order by quietness_proxy) + (count(*) over (partition by city_id, quietness_proxy) - 1) / 2.0::double as ry from (select *, 0.6::double * quiet_label + 0.4::double * night_label as l from lb)) group by city_id", LABELS)
def composite_label(a: Atlas) -> DataFrame:
    """The composite label 0.6 road + 0.4 nightlife and its acceptance at 0.5."""
    d = labelled(a).withColumn("l", F.lit(0.6) * F.col("quiet_label") + F.lit(0.4) * F.col("night_label"))
    return statistics.spearman(d, "l", "quietness_proxy", ["city_id"]).select("city_id", F.round("rho", 6).alias("rho"), (F.col("rho") >= 0.5).alias("accepted"))


def _scenarios_sql() -> str:
    rows = []
    for name, f, w in statistics.perturbed_weights(C.PERSONAS["balanced"]):
        total = " + ".join(f"'{v!r}'::double * {k}" for k, v in w.items())
        rows.append(f"select city_id, id, '{name}' as weight, {f}::double as factor, {total} as value from sc")
    return " union all ".join(rows)


@query(f"select weight, factor, round(avg(abs(value - balanced_score)), 4) as shift from ({_scenarios_sql()}) join sc using (city_id, id) group by 1, 2", scores_sql("sc"))
def weight_perturbation(a: Atlas) -> DataFrame:
    d = statistics.persona_scenarios(table_scores(a), C.PERSONAS["balanced"])
    # differences are decimals of twelve digits: their mean is exact, on any machine and in any order
    apart = F.round(F.abs(F.col("value") - F.col("base")), 12).cast("decimal(20, 12)")
    return d.groupBy("weight", "factor").agg(F.round(F.avg(apart), 4).cast("double").alias("shift"))


@query("select city_id, id, factor, round(sum(exp(-d / (250 * factor))), 6) as raw from n, (select unnest([0.5, 0.7, 1.0, 1.3])::double as factor) group by 1, 2, 3", pairs_sql("n", "p.leaf in ('restaurant', 'cafe')", 400))
def constant_sweep(a: Atlas) -> DataFrame:
    h = sited(a.hotels)
    near = near_points(sites(h), counted(a.pois.where(F.col("leaf").isin("restaurant", "cafe"))), 400.0)
    return to_all(h, statistics.decay_sweep(near, "food_essentials").withColumn("raw", F.round("raw", 6)), "inner")


# checks and publication -------------------------------------------------------------------------------------------


@query("select 'coordinates' as check, 0::bigint as failures union all select 'duplicate_ids', 0 union all select 'out_of_range', (select count(*) from sc where score_confidence > 100 or balanced_score > 100) union all select 'no_version', 0", scores_sql("sc"))
def qa_hard_checks(a: Atlas) -> DataFrame:
    s = table_scores(a).drop("confidence").withColumnRenamed("score_confidence", "confidence").select(F.col("id").alias("hotel_id"), *C.DIMENSIONS, "confidence", "balanced_score", F.lit("1.2.1").alias("score_version"), F.lit("local").alias("source_release"))
    return quality.hard_checks(a.hotels, s)


@query("select city_id, count(*) as n_hotels, count(*) filter (where name is null or trim(name) = '') as n_blank, count(*) filter (where regexp_matches(trim(name), '^[0-9]+$')) as n_numeric, count(*) filter (where address_country <> city_country) as n_country from hotels group by city_id")
def qa_soft_scan(a: Atlas) -> DataFrame:
    return quality.soft_scan(a.hotels)


@query("select user_id as page_id, event_id, event_type as status from (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as rn from events) where rn = 1", plain=True)
def publication_latest(a: Atlas) -> DataFrame:
    e = a.table("events").select(F.col("user_id").alias("page_id"), "event_id", F.col("event_type").alias("status"), "ts")
    return publication.latest(e, ["page_id"], "ts", "event_id").select("page_id", "event_id", "status")


@query(
    f"""select id, case when key % 31 = 0 then 'no reason' when indexable and coalesce(regexp_matches(trim(name), '^[0-9]+$'), false) then 'numeric name' when indexable and accommodation_type <> 'hotel' then 'not a hotel'
  when indexable and not (length(regexp_replace(coalesce(name, ''), '[^\\p{{L}}]', '', 'g')) >= 2 and not regexp_matches(coalesce(name, ''), '[\\p{{Han}}]')) then 'no readable name' end as refusal
  from (select *, key % 2 = 0 as indexable from hotels) join ({ACCOMMODATION_SQL}) t using (id)"""
)
def publication_gate(a: Atlas) -> DataFrame:
    k = F.col("key")
    kind = text.accommodation(F.col("name"), F.col("brand_name"), F.col("leaf"))["accommodation_type"]
    status, reason = F.when(k % 2 == 0, "indexable").otherwise("draft"), F.when(k % 31 == 0, " ").otherwise("reviewed")
    return a.hotels.select("id", publication.refusal(F.lit("hotel"), status, reason, F.col("name"), kind, text.present_name(F.col("name"))["name_index_eligible"]).alias("refusal"))


@query(
    """select h.id, case when r is null then 'noindex' else 'draft' end as status, coalesce(r, 'default') as reason from (select *, case when key % 20 = 0 then 'cohort' when coalesce(regexp_matches(trim(name), '^[0-9]+$'), false) then 'numeric name' when (lat, lon) in (select (lat, lon) from coin) then 'coincident' end as r from hotels) h
  union all select 'gone' || i, 'retired', 'vanished' from (select unnest([1, 2]) as i)""",
    "coin as (select lat, lon from hotels group by city_id, lat, lon having count(*) > 1)",
)
def publication_seed(a: Atlas) -> DataFrame:
    gone = a.spark.range(1, 3).select(F.concat(F.lit("gone"), F.col("id").cast("string")).alias("id"))
    recorded = a.hotels.where("key % 2 = 0").select("id").union(gone)
    return publication.seed(a.hotels, a.hotels.where("key % 20 = 0"), recorded)


@query("select 'scores' as tbl, count(*) as n from sc where key % 10 <> 3 union all select 'facts', count(*) from facts where hotel_id not in (select id from hotels where key % 10 = 3) union all select 'hotels', count(*) from hotels where key % 10 <> 3", scores_sql("sc") + ", " + FACTS_SQL)
def purge_cascade(a: Atlas) -> DataFrame:
    from ..operators.dimensions import nearby_facts

    out = quality.purge(a.hotels.where("key % 10 = 3").select("id"), {"hotels": (a.hotels, "id"), "scores": (table_scores(a), "id"), "facts": (nearby_facts(a.hotels, a.pois), "hotel_id")})
    counts = [t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n") for n, t in out.items()]
    return counts[0].union(counts[1]).union(counts[2])


@query("select city_id, part, '<urlset xmlns=\"http://www.sitemaps.org/schemas/sitemap/0.9\">' || string_agg('<url><loc>https://x.test/hotel/' || id || '</loc></url>', '' order by id) || '</urlset>' as xml from (select city_id, id, (row_number() over (partition by city_id order by id) - 1) // 50000 as part from hotels) group by 1, 2")
def sitemap_xml(a: Atlas) -> DataFrame:
    return publication.urlset(a.hotels.select("city_id", F.concat(F.lit("/hotel/"), "id").alias("path")), "https://x.test")


@query("select city_id, id, status from (select city_id, id, case when key % 3 = 0 and not coalesce(regexp_matches(trim(name), '^[0-9]+$'), false) and accommodation_type = 'hotel' and length(regexp_replace(coalesce(name, ''), '[^\\p{L}]', '', 'g')) >= 2 and not regexp_matches(coalesce(name, ''), '[\\p{Han}]') then 'indexable' else 'noindex' end as status from hotels join (" + ACCOMMODATION_SQL + ") t using (id))")
def export_status(a: Atlas) -> DataFrame:
    """Indexable only where it was recorded, has a real name, is a hotel and can be read."""
    kind = text.accommodation(F.col("name"), F.col("brand_name"), F.col("leaf"))["accommodation_type"]
    ok = (F.col("key") % 3 == 0) & ~scoring.numeric_name(F.col("name")) & (kind == "hotel") & text.present_name(F.col("name"))["name_index_eligible"]
    return a.hotels.select("city_id", "id", F.when(ok, "indexable").otherwise("noindex").alias("status"))


@query("select id, name, city_id, lat, lon, address_country from hotels")
def blind_projection(a: Atlas) -> DataFrame:
    """What a labeller may see: identity only, no score."""
    return table_scores(a).select("id", "name", "city_id", "lat", "lon", "address_country")


# anchors ----------------------------------------------------------------------------------------------------------

_FLOOR = "case class " + " ".join(f"when '{c}' then {f.least_area_m2 or 0}" for f in anchors.FAMILIES.values() for c in f.classes) + " end"
_NEAR_M = "case class " + " ".join(f"when '{c}' then {f.radius_m}" for f in anchors.FAMILIES.values() for c in f.classes) + " end"
_FAMILY = "case class " + " ".join(f"when '{c}' then '{n}'" for n, f in anchors.FAMILIES.items() for c in f.classes) + " end"
ANCHOR_SQL = scores_sql("sc") + f""", cand as (select *, {_FAMILY} as family, (x2 - x1) * (y2 - y1) as area, {_FLOOR} as least, {_NEAR_M} as radius from green where {_FAMILY} is not null),
  am as (select * from (select h.city_id, h.id, g.green_id, g.family, g.area, g.radius, sqrt(pow(greatest(g.x1 - h.x, 0, h.x - g.x2), 2) + pow(greatest(g.y1 - h.y, 0, h.y - g.y2), 2)) as d
    from hotels h join cand g using (city_id) where g.area >= g.least) where d <= radius)"""


def _anchored(a: Atlas) -> DataFrame:
    return anchors.matches(a.hotels, a.green, "green_id")


@query("select city_id, family, count(*) as polygons, count(*) filter (where area >= least) as above_floor, coalesce(any_value(n), 0)::bigint as hotels from cand left join (select city_id, family, count(distinct id) as n from am group by all) using (city_id, family) group by all", ANCHOR_SQL)
def anchor_families(a: Atlas) -> DataFrame:
    """Outlines of each family of anchors, those that are large enough, and the hotels near them."""
    return anchors.by_family(a.hotels, a.green, _anchored(a), "green_id")


@query(
    """select city_id, count(*) as total, count(*) filter (where walkability_density <= 55) as isolated, count(*) filter (where id in (select id from am)) as anchored,
    count(*) filter (where walkability_density <= 55 and id in (select id from am)) as isolated_anchored, count(*) filter (where walkability_density <= 55 and id not in (select id from am)) as isolated_alone from sc group by city_id""",
    ANCHOR_SQL,
)
def anchor_counts(a: Atlas) -> DataFrame:
    return anchors.by_city(table_scores(a), _anchored(a))


@query("select sc.id, walkability_density, family, green_id, round(area, 3) as area, round(d, 4) as d from sc join am on sc.id = am.id where walkability_density <= 55 qualify row_number() over (partition by sc.id order by d, green_id) = 1", ANCHOR_SQL)
def anchor_nearest(a: Atlas) -> DataFrame:
    """The nearest anchor of each isolated hotel."""
    return anchors.nearest_anchor(table_scores(a), _anchored(a), "green_id").withColumn("area", F.round("area", 3)).withColumn("d", F.round("d", 4))
