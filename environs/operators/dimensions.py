"""The six proximity dimensions, their joint score, confidence and nearby facts.

All cities are scored in one plan. Points within the largest short radius are met once by a grid join, and every dimension
is a conditional aggregate over those pairs; airports have a coarse grid of their own. Hotels are keyed by id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo, scoring
from ..storage import stash
from . import ranks
from .outlines import near_outlines
from .spatial import POINT, counted, each_pair, first_ids, near_first, near_points, near_shared, shared, sited, sites, to_all, to_all_pairs


def near_m() -> float:
    """The largest short radius."""
    return float(max(C.RADIUS_M.values()))


def pairs(hotels: DataFrame, pois: DataFrame, radius: float | None = None, digits: int | None = None) -> DataFrame:
    """city_id, id, poi_id, d: every pair within the radius. Places meet with the ids at them, which are paired after the last exchange."""
    h, p = shared(hotels, POINT, "id", "__ids"), shared(pois, POINT, "poi_id", "__poi_ids")
    near = near_shared(h, p, radius or near_m(), "__ids", "__poi_ids")
    near = near if digits is None else near.withColumn("d", F.round("d", digits))  # once for each pair of places
    return each_pair(near.drop("x", "y"), "__ids", "id", "__poi_ids", "poi_id").select("city_id", "id", "poi_id", "d")


def place_pairs(at: DataFrame, pois: DataFrame, radius: float, *columns: str) -> DataFrame:
    """city_id, id, columns, n, d: sites and the places of points within the radius; n points are alike in the columns at one place."""
    return near_points(at, counted(pois, *columns), radius)


def kind_pairs(hotels: DataFrame, pois: DataFrame, dimension: str) -> DataFrame:
    """city_id, id, leaf, n, d: n points of one dimension at one place within its radius. What doesn't count is left out before the meeting."""
    p = counted(pois.where(scoring.of_kind(dimension, F.col("leaf"), F.col("hierarchy"))), "leaf")
    return near_points(hotels.select("city_id", "id", "x", "y"), p, float(C.RADIUS_M[dimension]), copy="right")  # a part of all points


def only(condition: Column, value: Column) -> Column:
    return F.when(condition, value)


def density_of(hits: DataFrame, dimension: str) -> DataFrame:
    """hits(city_id, id, leaf, n, d) -> per hotel with a hit: decayed count, hits, distinct leaves (a set of a few dozen names at most), nearest."""
    return hits.groupBy("city_id", "id").agg(
        F.sum(F.col("n") * scoring.decay(F.col("d"), C.DECAY_M[dimension])).alias("raw"), F.sum("n").alias("poi_count"), F.size(F.collect_set("leaf")).cast("long").alias("distinct_categories"), F.min("d").alias("nearest_m")
    )


def percentiles(d: DataFrame, hotels: DataFrame, columns: list[str]) -> DataFrame:
    """d(city_id, id, columns) with {column}_percentile, 0 to 100, of each in its city. Cities beyond a task's share are ranked by ranges."""
    if ranks.fits(hotels.select("city_id"), ["city_id"]):
        return d.withColumns({f"{c}_percentile": scoring.percentile_in_city(F.col(c)) for c in columns})
    d = stash(d, "scored")
    long = d.select("city_id", "id", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns])).alias("v")).select("city_id", "id", "v.column", "v.value")
    r = ranks.with_rank(long, ["city_id", "column"], "value").withColumn("p", ranks.percent_rank() * 100)
    wide = r.groupBy("city_id", "id").agg(*[F.max(F.when(F.col("column") == c, F.col("p"))).alias(f"{c}_percentile") for c in columns])
    return d.join(wide, ["city_id", "id"])


def curve(hotels: DataFrame, found: DataFrame, dimension: str) -> DataFrame:
    """All hotels with their hybrid score, from what their sites found; hotels without a hit count 0."""
    d = to_all(hotels, found)
    raw = F.coalesce("raw", F.lit(0.0))
    n, kinds = F.coalesce("poi_count", F.lit(0)).cast("long"), F.coalesce("distinct_categories", F.lit(0)).cast("long")
    wc = scoring.diversity(raw, kinds) if dimension == "food_essentials" else raw
    d = d.select("city_id", "id", F.round(wc, 9).alias("wc"), n.alias("poi_count"), kinds.alias("distinct_categories"), "nearest_m")
    d = percentiles(d.withColumn("absolute_score", scoring.saturating(F.col("wc"), C.SATURATION[dimension])), hotels, ["wc"])
    d = d.withColumnRenamed("wc_percentile", "city_percentile")
    return d.withColumn("score", scoring.hybrid(F.col("absolute_score"), F.col("city_percentile")))


def density(hotels: DataFrame, pois: DataFrame, dimension: str) -> DataFrame:
    h = sited(hotels)
    return curve(h, density_of(kind_pairs(sites(h), pois, dimension), dimension), dimension)


#: Polygons that agree in these count for the same everywhere.
SHAPE = ["city_id", "center_lon", "metres_x", "subtype", "class", "wkt"]


def land_hits(hotels: DataFrame, green: DataFrame) -> DataFrame:
    """city_id, id, green_id, subtype, class, weight, n, d: land within 600 m. n polygons of one outline and kind are one, the smallest id stands for them."""
    parts = geo.projected(geo.rings(F.col("wkt")), F.col("center_lon"), F.col("metres_x"))
    g = green.groupBy(*SHAPE).agg(F.min("green_id").alias("green_id"), F.count(F.lit(1)).alias("n"))
    g = g.withColumn("weight", scoring.land_weight(F.col("subtype"), F.col("class"), geo.area(parts))).where("weight > 0")
    return near_outlines(hotels, g, "green_id", C.RADIUS_M["family_convenience"], True, ["subtype", "class", "weight", "n"])


def green_hits(hotels: DataFrame, green: DataFrame, digits: int | None = None) -> DataFrame:
    """Every pair of a hotel and a polygon: outlines meet sites, and what shares them is put back last."""
    h = sited(hotels)
    found = land_hits(sites(h), green).drop("n").withColumnRenamed("green_id", "__shape")
    found = found if digits is None else found.withColumn("d", F.round("d", digits))  # once for each pair of a place and an outline
    members = green.groupBy(*SHAPE).agg(F.min("green_id").alias("__shape")).join(green, SHAPE).select("city_id", "__shape", "green_id")
    return to_all_pairs(h, found, members, "__shape", "green_id").select("city_id", "id", "green_id", "subtype", "class", "weight", "d")


def family(hotels: DataFrame, pois: DataFrame, green: DataFrame) -> DataFrame:
    dim, hotels = "family_convenience", sited(hotels)
    at = sites(hotels)
    hits = kind_pairs(at, pois, dim).select("city_id", "id", "d", F.col("leaf").alias("cat"), F.lit(1.0).alias("weight"), "n").unionByName(land_hits(at, green).select("city_id", "id", "d", F.col("subtype").alias("cat"), "weight", "n"))
    found = hits.groupBy("city_id", "id").agg(
        F.sum(F.col("n") * F.col("weight") * scoring.decay(F.col("d"), C.DECAY_M[dim])).alias("raw"), F.sum("n").alias("poi_count"), F.count_distinct("cat").alias("distinct_categories"), F.min("d").alias("nearest_m")
    )
    return curve(hotels, found, dim)


def transit(hotels: DataFrame, pois: DataFrame) -> DataFrame:
    dim, h = "transit_access", sited(hotels)
    hits = kind_pairs(sites(h), pois, dim)
    by_mode = hits.groupBy("city_id", "id", "leaf").agg(F.min("d").alias("nearest_m"))
    found = by_mode.groupBy("city_id", "id").agg(F.max(F.lit(100.0) * scoring.decay(F.col("nearest_m"), C.DECAY_M[dim])).alias("best"), F.count(F.lit(1)).alias("modes"), F.min("nearest_m").alias("nearest_m"))
    d = to_all(h, found)
    n = F.coalesce("modes", F.lit(0)).cast("long")
    return d.select("city_id", "id", scoring.transit(F.col("best"), F.col("modes")).alias("score"), n.alias("poi_count"), n.alias("distinct_categories"), "nearest_m")


def lines(segments: DataFrame, kind: Column) -> DataFrame:
    """Segments of a kind, each line once however many segments repeat it."""
    return segments.withColumn("kind", kind).where("kind is not null").select("city_id", "center_lon", "metres_x", "kind", "wkt").distinct()


def nearest_line(hotels: DataFrame, segments: DataFrame, kind: str, condition: Column) -> DataFrame:
    h = sited(hotels)
    near = near_outlines(sites(h), lines(segments, F.when(condition, kind)), "kind", C.PENALTIES[kind][2], polygon=False)
    # a point lies in one cell, so it and the kind have one row
    return to_all(h, near.select("city_id", "id", F.col("d").alias(kind)), "inner")


def nearest_lines(hotels: DataFrame, segments: DataFrame) -> DataFrame:
    """city_id, id, major_road, rail: both kinds in one meeting. The key is the kind, so that the cells give the minima at once."""
    road = (F.col("subtype") == "road") & F.col("class").isin(C.ROAD_CLASSES)
    kind = F.when(road, "major_road").when(F.col("subtype") == "rail", "rail")
    radius = max(C.PENALTIES[k][2] for k in ("major_road", "rail"))
    near = near_outlines(hotels, lines(segments, kind), "kind", radius, polygon=False)
    found = [F.min(F.when((F.col("kind") == k) & (F.col("d") <= C.PENALTIES[k][2]), F.col("d"))).alias(k) for k in ("major_road", "rail")]
    return near.groupBy("city_id", "id").agg(*found)


def nearest_point(hotels: DataFrame, pois: DataFrame, kind: str, leaves: list[str]) -> DataFrame:
    """min(d) within the penalty's radius; the radius is the grid's cell, so a 5 km one doesn't share the 800 m cells.

    The points are the few of these leaves, so they are copied, not the hotels.
    """
    near = near_points(hotels.select("city_id", "id", "x", "y"), pois.where(F.col("leaf").isin(leaves)).select("city_id", "x", "y").distinct(), float(C.PENALTIES[kind][2]), copy="right")
    return near.groupBy("city_id", "id").agg(F.min("d").alias(kind))


def quiet_columns(d: DataFrame) -> DataFrame:
    """city_id, id, score and the nearest of each penalty, from a frame that has these under the penalties' names."""
    return d.select("city_id", "id", scoring.quietness({k: F.col(k) for k in C.PENALTIES}).alias("score"), *[F.col(k).alias(f"{k}_nearest_m") for k in C.PENALTIES])


def penalties(at: DataFrame, pois: DataFrame, segments: DataFrame) -> DataFrame:
    """city_id, id and the nearest of each penalty, of every site."""
    d = at.select("city_id", "id")
    for f in (nearest_lines(at, segments), nearest_point(at, pois, "nightlife", C.QUIET_NIGHTLIFE), nearest_point(at, pois, "airport", C.AIRPORTS)):
        d = d.join(f, ["city_id", "id"], "left")
    return d


def quietness(hotels: DataFrame, pois: DataFrame, segments: DataFrame) -> DataFrame:
    h = sited(hotels)
    return quiet_columns(to_all(h, penalties(sites(h), pois, segments)))


def counted_pairs(hotels: DataFrame, pois: DataFrame) -> DataFrame:
    """city_id, id, flags, food, mode, loud, n, d: hotels and the points within 800 m that count for anything, n alike at one place.

    What a point counts for is worked out before the meeting, as small numbers: points that count for nothing stay out of it, and
    neither names nor families travel. flags has a bit for each of the four counted dimensions; food and mode are places in lists, or 0;
    loud marks nightlife that disturbs.
    """
    dims = [*C.DENSITY, "family_convenience"]
    place = lambda values: F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), F.col("leaf")), F.lit(0))
    flags = sum((F.when(scoring.of_kind(d, F.col("leaf"), F.col("hierarchy")), 1 << i).otherwise(0) for i, d in enumerate(dims)), F.lit(0))
    p = pois.select("city_id", "x", "y", flags.cast("int").alias("flags"), place(C.CATEGORIES["food_essentials"]).cast("int").alias("food"), place(C.CATEGORIES["transit_access"]).cast("int").alias("mode"), F.coalesce(F.col("leaf").isin(C.QUIET_NIGHTLIFE), F.lit(False)).alias("loud"))
    p = counted(p.where("flags > 0 or mode > 0 or loud"), "flags", "food", "mode", "loud")
    return near_points(hotels.select("city_id", "id", "x", "y"), p, max(near_m(), float(C.PENALTIES["nightlife"][2])))


def short_range(hotels: DataFrame, pois: DataFrame) -> DataFrame:
    """All that the points within 800 m tell of a hotel, in one meeting and one aggregation. Distinct food leaves are a bitmap."""
    dims, modes = [*C.DENSITY, "family_convenience"], C.CATEGORIES["transit_access"]
    near = counted_pairs(hotels, pois)
    decays = {s: F.exp(-F.col("d") / F.lit(float(s))) for s in {C.DECAY_M[d] for d in dims}}
    near = near.withColumns({f"decay_{s}": e for s, e in decays.items()})
    out = []
    for i, dim in enumerate(dims):
        hit = (F.col("flags").bitwiseAND(1 << i) != 0) & (F.col("d") <= C.RADIUS_M[dim])
        out += [F.sum(only(hit, F.col("n") * F.col(f"decay_{C.DECAY_M[dim]}"))).alias(f"{dim}_raw"), F.coalesce(F.sum(only(hit, F.col("n"))), F.lit(0)).alias(f"{dim}_count")]
    kinds = only((F.col("food") > 0) & (F.col("d") <= C.RADIUS_M["food_essentials"]), F.expr("shiftleft(1, food)"))
    out.append(F.bit_count(F.bit_or(kinds)).alias("food_essentials_kinds"))
    out.append(F.min(only(F.col("loud") & (F.col("d") <= C.PENALTIES["nightlife"][2]), F.col("d"))).alias("nightlife"))
    out += [F.min(only((F.col("mode") == i) & (F.col("d") <= C.RADIUS_M["transit_access"]), F.col("d"))).alias(f"mode_{i - 1}") for i in range(1, len(modes) + 1)]
    return near.groupBy("city_id", "id").agg(*out)


def dimension_scores(hotels: DataFrame, pois: DataFrame, green: DataFrame, segments: DataFrame) -> DataFrame:
    """city_id, id, the six scores, and covered: how many of the five counted dimensions found anything."""
    key = ["city_id", "id"]
    h = sited(hotels)
    at = sites(h)
    land = land_hits(at, green).groupBy(*key).agg(
        F.sum(F.col("n") * F.col("weight") * scoring.decay(F.col("d"), C.DECAY_M["family_convenience"])).alias("land_raw"), F.sum("n").alias("land_count")
    )
    d = at.select(*key)
    for found in (short_range(at, pois), land, nearest_lines(at, segments), nearest_point(at, pois, "airport", C.AIRPORTS)):
        d = d.join(found, key, "left")
    d = to_all(h, d)
    d = d.withColumn("quietness_proxy", scoring.quietness({k: F.col(k) for k in C.PENALTIES}))
    zero = F.lit(0.0)
    for dim in [*C.DENSITY, "family_convenience"]:
        raw, n = F.coalesce(f"{dim}_raw", zero), F.coalesce(f"{dim}_count", F.lit(0))
        if dim == "family_convenience":
            raw, n = raw + F.coalesce("land_raw", zero), n + F.coalesce("land_count", F.lit(0))
        if dim == "food_essentials":
            raw = scoring.diversity(raw, F.coalesce(f"{dim}_kinds", F.lit(0)))
        d = d.withColumn(f"{dim}_wc", F.round(raw, 9)).withColumn(f"{dim}_n", n)
    modes = F.array_compact(F.array(*[F.col(f"mode_{i}") for i in range(len(C.CATEGORIES["transit_access"]))]))
    best = F.lit(100.0) * scoring.decay(F.array_min(modes), C.DECAY_M["transit_access"])
    d = d.withColumn("transit_access", scoring.transit(best, F.size(modes))).withColumn("transit_access_n", F.size(modes))
    d = percentiles(d, h, [f"{dim}_wc" for dim in [*C.DENSITY, "family_convenience"]])
    for dim in [*C.DENSITY, "family_convenience"]:
        d = d.withColumn(dim, scoring.hybrid(scoring.saturating(F.col(f"{dim}_wc"), C.SATURATION[dim]), F.col(f"{dim}_wc_percentile")))
    covered = sum((F.when(F.col(f"{dim}_n") > 0, 1).otherwise(0) for dim in C.DIMENSIONS if dim != "quietness_proxy"), F.lit(0))
    return d.withColumn("covered", covered).select(*key, *C.DIMENSIONS, "covered")


def hotel_scores(hotels: DataFrame, pois: DataFrame, green: DataFrame, segments: DataFrame, dedupe: DataFrame | None = None, release: str = "local") -> DataFrame:
    """One row for each hotel: six scores, balanced score, confidence, versions. dedupe(id, dedupe_confidence) defaults to single records."""
    d = dimension_scores(hotels, pois, green, segments)
    info = hotels.select("city_id", "id", F.col("confidence").alias("place"))
    sizes = hotels.groupBy("city_id").agg(F.count(F.lit(1)).alias("in_city"))  # a window would hold a city in a task
    d = d.join(info, ["city_id", "id"]).join(F.broadcast(sizes), "city_id")
    if dedupe is not None:
        d = d.join(dedupe.select("id", "dedupe_confidence"), "id", "left")
    else:
        d = d.withColumn("dedupe_confidence", F.lit(C.SINGLE_CONFIDENCE))
    return d.select(
        F.col("id").alias("hotel_id"), "city_id", F.lit(C.SCORE_VERSION).alias("score_version"), F.lit(release).alias("source_release"), F.current_timestamp().alias("computed_at"), *C.DIMENSIONS,
        scoring.weighted(C.PERSONAS["balanced"]).alias("balanced_score"),
        scoring.confidence(F.col("place"), F.col("covered"), F.col("in_city"), F.coalesce("dedupe_confidence", F.lit(C.SINGLE_CONFIDENCE))).alias("confidence"),
    )


def quietness_by_count(hotels: DataFrame, pois: DataFrame, segments: DataFrame, saturation: float = 3.0) -> DataFrame:
    """city_id, id, score: quietness with its nightlife penalty by a saturating count instead of the nearest venue; the others stay."""
    weight, scale, radius = C.PENALTIES["nightlife"]
    h = sited(hotels)
    at = sites(h)
    near = near_points(at, counted(pois.where(F.col("leaf").isin(C.QUIET_NIGHTLIFE))), float(radius), copy="right")
    found = near.groupBy("city_id", "id").agg(F.sum(F.col("n") * scoring.decay(F.col("d"), scale)).alias("venues"))
    d = to_all(h, penalties(at, pois, segments).join(found, ["city_id", "id"], "left"))
    lost = F.lit(float(weight)) * (F.lit(1.0) - F.exp(-F.coalesce("venues", F.lit(0.0)) / F.lit(saturation)))
    rest = [F.lit(float(C.PENALTIES[k][0])) * F.coalesce(scoring.decay(F.col(k), C.PENALTIES[k][1]), F.lit(0.0)) for k in ("major_road", "rail", "airport")]
    left = F.lit(float(C.QUIET_START)) - rest[0] - rest[1] - lost - rest[2]
    return d.select("city_id", "id", F.greatest(F.lit(0.0), F.least(F.lit(100.0), left)).alias("score"))


def nearby_facts(hotels: DataFrame, pois: DataFrame, n: int = C.FACTS) -> DataFrame:
    """The n nearest named points of each hotel, hidden kinds left out; ties by point id. Sites meet the n smallest ids of each place."""
    h = sited(hotels)
    shown = first_ids(pois.where(F.col("name").isNotNull() & ~F.col("leaf").isin(C.HIDDEN_FACTS)), "poi_id", n)
    order = Window.partitionBy("city_id", "id").orderBy("d", "poi_id")
    p = shown.select("city_id", "poi_id", "x", "y")
    near = near_first(sites(h), p, n, near_m()).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    near = near.join(shown.select("city_id", "poi_id", "name", "leaf"), ["city_id", "poi_id"])
    return to_all(h, near, "inner").select(F.col("id").alias("hotel_id"), "city_id", F.col("rank").cast("long").alias("rank"), "poi_id", F.col("leaf").alias("category"), "name", F.col("d").alias("distance_m"))
