"""Anchors: large places that explain why a hotel stands alone. A report on hotels, never an input to a score."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from .outlines import near_outlines
from .spatial import sited, sites, to_all


class Family(NamedTuple):
    radius_m: float
    least_area_m2: float | None
    classes: tuple[str, ...]


#: FIXED VALUES: how near and how large an anchor of each family must be, and the classes of its outlines.
FAMILIES = {
    "stadium_arena": Family(1000, 20_000, ("stadium",)),
    "congress": Family(750, None, ()),
    "expo": Family(750, None, ()),
    "airport": Family(1500, None, ()),
    "golf": Family(500, 300_000, ("golf_course",)),
    "beach": Family(250, 10_000, ("beach",)),
    "ski": Family(1000, 100_000, ("downhill", "nordic", "ski_jump", "snow_park")),
    "national_park": Family(500, 1_000_000, ("national_park", "nature_reserve", "state_park", "wilderness_area", "strict_nature_reserve", "protected_landscape_seascape")),
    "theme_park": Family(750, 50_000, ("theme_park", "water_park")),
    "hospital": Family(500, 20_000, ("hospital",)),
    "campus": Family(500, 100_000, ("university", "college")),
    "casino": Family(500, None, ()),
}
#: A hotel with at most this walkability is isolated.
ISOLATED = 55.0


def of_family(families: dict[str, Family], kind: Column) -> Column:
    return F.coalesce(*[F.when(kind.isin(*f.classes), name) for name, f in families.items() if f.classes])


def candidates(polygons: DataFrame, key: str, families: dict[str, Family] = FAMILIES) -> DataFrame:
    """polygons(city_id, key, class, wkt, center_lon, metres_x) with family, area, floor and radius, of the classes of a family."""
    parts = F.transform(geo.polygons(F.col("wkt")), lambda p: geo.area(geo.projected(geo.rings(p), F.col("center_lon"), F.col("metres_x"))))
    d = polygons.withColumn("family", of_family(families, F.col("class"))).where("family is not null")
    named = lambda value: reduce(lambda c, f: c.when(F.col("family") == f[0], F.lit(value(f[1]))), list(families.items())[1:], F.when(F.col("family") == next(iter(families)), F.lit(value(next(iter(families.values()))))))
    d = d.withColumn("area", F.aggregate(parts, F.lit(0.0), lambda s, v: s + v))
    return d.withColumn("floor", named(lambda f: float(f.least_area_m2 or 0))).withColumn("radius", named(lambda f: float(f.radius_m)))


def matches(hotels: DataFrame, polygons: DataFrame, key: str, families: dict[str, Family] = FAMILIES) -> DataFrame:
    """city_id, id, family, key, area, d: the nearest large enough outline of each family within its radius, ties by key; a row for each hotel and family.

    Sites meet outlines that differ; the smallest key stands for those that are the same.
    """
    h = sited(hotels)
    unlike = polygons.groupBy("city_id", "center_lon", "metres_x", "class", "wkt").agg(F.min(key).alias(key))
    large = candidates(unlike, key, families).where("area >= floor")
    furthest = max(f.radius_m for f in families.values() if f.classes)
    near = near_outlines(sites(h), large, key, float(furthest), True, ["family", "area", "radius"]).where(F.col("d") <= F.col("radius"))
    best = near.groupBy("city_id", "id", "family").agg(F.min_by(F.struct(key, "area", "d"), F.struct("d", key)).alias("a"))
    return to_all(h, best.select("city_id", "id", "family", "a.*"), "inner")


def by_family(hotels: DataFrame, polygons: DataFrame, found: DataFrame, key: str, families: dict[str, Family] = FAMILIES) -> DataFrame:
    """city_id, family, polygons, above_floor, hotels: what there is of each family, and how many hotels are near."""
    c = candidates(polygons, key, families).groupBy("city_id", "family").agg(F.count(F.lit(1)).alias("polygons"), F.count_if(F.col("area") >= F.col("floor")).alias("above_floor"))
    near = found.groupBy("city_id", "family").agg(F.count_distinct("id").alias("hotels"))
    return c.join(near, ["city_id", "family"], "left").na.fill(0, ["hotels"])


def by_city(hotels: DataFrame, found: DataFrame, limit: float = ISOLATED) -> DataFrame:
    """hotels(city_id, id, walkability_density) -> city_id, total, isolated, anchored, isolated_anchored, isolated_alone."""
    d = hotels.select("city_id", "id", (F.col("walkability_density") <= limit).alias("alone")).join(found.select("id").distinct().withColumn("near", F.lit(True)), "id", "left")
    alone, near = F.coalesce("alone", F.lit(False)), F.coalesce("near", F.lit(False))
    return d.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("total"), F.count_if(alone).alias("isolated"), F.count_if(near).alias("anchored"), F.count_if(alone & near).alias("isolated_anchored"), F.count_if(alone & ~near).alias("isolated_alone")
    )


def nearest_anchor(hotels: DataFrame, found: DataFrame, key: str, limit: float = ISOLATED) -> DataFrame:
    """The nearest anchor of each isolated hotel that has one: id, walkability_density, family, key, area, d; ties by the anchor's key."""
    best = found.groupBy("id").agg(F.min_by(F.struct("family", key, "area", "d"), F.struct("d", key)).alias("a"))
    return hotels.where(F.col("walkability_density") <= limit).select("id", "walkability_density").join(best, "id").select("id", "walkability_density", "a.*")
