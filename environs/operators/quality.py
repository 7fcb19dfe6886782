"""Checks that stop a publication, scans that are reported, baselines, and score differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo, scoring, text
from . import quantiles, ranks


class ValidationError(ValueError):
    """Data that must not be published."""


def out_of_range() -> Column:
    return reduce(lambda a, b: a | b, [(F.col(c) < 0) | (F.col(c) > 100) for c in [*C.DIMENSIONS, "confidence", "balanced_score"]])


def hard_checks(hotels: DataFrame, scores: DataFrame) -> DataFrame:
    """check, failures: one row for each rule."""
    bad = F.col("lat").isNull() | F.col("lon").isNull() | ~F.col("lat").between(-90, 90) | ~F.col("lon").between(-180, 180)
    a = hotels.agg(F.count_if(bad).alias("coordinates"))
    b = scores.agg(
        (F.count(F.lit(1)) - F.count_distinct("hotel_id")).alias("duplicate_ids"), F.count_if(out_of_range()).alias("out_of_range"), F.count_if(F.col("score_version").isNull() | F.col("source_release").isNull()).alias("no_version")
    )
    names = ["coordinates", "duplicate_ids", "out_of_range", "no_version"]
    one = a.crossJoin(b)  # two rows of one: nothing grows
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in names])).alias("c")).select("c.check", "c.failures")


def require(checks: DataFrame) -> None:
    found = [f"{r.failures} {r.check}" for r in checks.where("failures > 0").limit(10).collect()]
    if found:
        raise ValidationError("; ".join(found))


def require_unlisted(hotels: DataFrame) -> None:
    """hotels(id, name): stops if any is an institution or carries a listed brand."""
    found = hotels.select("id", text.listed(F.col("name"), F.col("id")).alias("why")).where("why is not null").limit(5).collect()
    if found:
        raise ValidationError("must not be published: " + ", ".join(f"{r.id} ({r.why})" for r in found))


def baseline(scores: DataFrame) -> DataFrame:
    """Mean and interpolated median of each dimension, by city. Cities beyond a task's share get their medians by histograms."""
    n, middle = F.count(F.lit(1)).alias("n_hotels"), [*C.DIMENSIONS, "confidence"]
    means = [F.round(F.avg(c), 2).alias(f"{m}_mean") for c, m in [*[(d, d) for d in C.DIMENSIONS], ("balanced_score", "balanced")]]
    if ranks.fits(scores.select("city_id"), ["city_id"]):
        d = scores.groupBy("city_id").agg(n, *means, *[F.round(F.median(c), 2).alias(f"{c}_median") for c in middle])
    else:
        m = quantiles.medians(scores, ["city_id"], middle)
        m = m.select(F.col("city_id").alias("__city"), *[F.round(c, 2).alias(f"{c}_median") for c in middle])
        d = scores.groupBy("city_id").agg(n, *means)
        d = d.join(m, d["city_id"].eqNullSafe(m["__city"]), "left").drop("__city")
    return d.select("city_id", "n_hotels", *[f"{c}_{k}" for c in C.DIMENSIONS for k in ("mean", "median")], "balanced_mean", "confidence_median")


def upper_median(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """by, upper_median: the middle value of each group, the upper one of two. Nulls are left out; no group is ordered or held."""
    return quantiles.order_statistics(df, by, [column], {"upper_median": F.floor(F.col("n") / 2)}).select(*by, "upper_median")


def soft_scan(hotels: DataFrame) -> DataFrame:
    """Counts by city that a report shows and nothing stops on."""
    name = F.col("name")
    return hotels.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("n_hotels"), F.count_if(scoring.blank_name(name)).alias("n_blank"), F.count_if(scoring.numeric_name(name)).alias("n_numeric"),
        F.count_if(F.col("address_country") != F.col("city_country")).alias("n_country"),
    )


def scans(hotels: DataFrame, scores: DataFrame, far_km: float = C.FAR_KM, low: float = 60.0) -> DataFrame:
    """hotels(city_id, id, name, lat, lon, addresses, centre), scores(id, six scores, confidence) -> counts by city of all that is reported.

    Nothing stops on them. Points that several records share are counted once each.
    """
    name = F.col("name")
    km = geo.haversine_m(F.col("center_lat"), F.col("center_lon"), F.col("lat"), F.col("lon")) / 1000
    h = hotels.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("n_hotels"), F.count_if(scoring.blank_name(name)).alias("n_missing_name"), F.count_if(scoring.numeric_name(name)).alias("n_numeric_name"),
        F.count_if(km > far_km).alias("n_far_from_center"),
        F.count_if(scoring.locality_mismatch(F.col("address_country"), F.col("address_region"), F.col("city_country"), F.col("expected_region"), F.col("city_name")).isNotNull()).alias("n_locality_mismatch"),
        F.count_if(F.col("leaf").isin(C.EXCLUDED_TYPES)).alias("n_excluded_type"),
    )
    points = hotels.groupBy("city_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n")).where("n > 1").groupBy("city_id").agg(F.count(F.lit(1)).alias("n_coincident"))
    zero = reduce(lambda a, b: a & b, [F.col(d) == 0 for d in C.DIMENSIONS])
    s = scores.groupBy("city_id").agg(F.count_if(F.col("confidence") < low).alias("n_low_confidence"), F.count_if(zero).alias("n_all_zero"), F.round(F.median("confidence"), 2).alias("median_confidence"))
    return h.join(points, "city_id", "left").join(s, "city_id", "left").na.fill(0, ["n_coincident", "n_low_confidence", "n_all_zero"])


def cohort_gate(confidence: Column, dedupe_confidence: Column, dimensions: list[Column], n_facts: Column, numeric: Column, shared: Column, kind: Column, readable: Column) -> Column:
    """The first gate that keeps a hotel out of the pilot cohort; null for a candidate."""
    lacking = reduce(lambda a, b: a | b, [d.isNull() for d in dimensions])
    return (
        F.when(kind != "hotel", "accommodation")
        .when(confidence < 80, "confidence")
        .when(dedupe_confidence < C.SINGLE_CONFIDENCE, "identity")
        .when(lacking, "dimension")
        .when(F.coalesce(n_facts, F.lit(0)) < 1, "facts")
        .when(numeric, "numeric_name")
        .when(shared, "coincident")
        .when(~readable, "latin_name")
    )


def coincident(hotels: DataFrame) -> DataFrame:
    """Points that several records share, with their names in order."""
    g = hotels.groupBy("city_id", "lat", "lon").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("name")).alias("names"))
    return g.where("n > 1")


def sizes(tables: dict[str, tuple[DataFrame, int]]) -> DataFrame:
    """city_id, tbl, n, estimated_bytes: rows of each table by city, and what they take at so many bytes a row."""
    counted = [t.groupBy("city_id").agg(F.count(F.lit(1)).alias("n")).select("city_id", F.lit(name).alias("tbl"), "n", (F.col("n") * F.lit(width)).alias("estimated_bytes")) for name, (t, width) in tables.items()]
    return reduce(DataFrame.union, counted)


def score_diff(old: DataFrame, new: DataFrame, dimension: str, changed: float, moved: float) -> DataFrame:
    """Counts of changes of one score by city, of the hotels that both versions have."""
    d = old.select("city_id", "id", F.col(dimension).alias("o")).join(new.select("id", F.col(dimension).alias("n")), "id").withColumn("delta", F.col("n") - F.col("o"))
    return d.groupBy("city_id").agg(
        F.count(F.lit(1)).alias("n_hotels"), F.count_if(F.abs("delta") > changed).alias("n_changed"), F.count_if(F.abs("delta") >= moved).alias("n_moved"),
        F.round(F.min("delta"), 6).alias("min_delta"), F.round(F.max("delta"), 6).alias("max_delta"), F.round(F.avg("delta"), 6).alias("avg_delta"),
    )


def ids_added_removed(old: DataFrame, new: DataFrame) -> DataFrame:
    """id and whether it is common, added or removed."""
    d = old.select("id", F.lit(True).alias("o")).join(new.select("id", F.lit(True).alias("n")), "id", "full")
    return d.select("id", F.when(F.col("o") & F.col("n"), "common").when(F.col("n"), "added").otherwise("removed").alias("change"))


def purge(excluded: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Each table without the rows of excluded(id); a table comes with the name of its id column."""
    return {n: t.join(excluded.select(F.col("id").alias(key)), key, "left_anti") for n, (t, key) in tables.items()}


def agreed(rows: DataFrame, name: str, value: str) -> DataFrame:
    """name, value of the names whose rows all have one value; a missing one is a value of its own, and disagrees with any other."""
    g = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(value).alias("a"), F.max(value).alias("z"), F.count(F.lit(1)).alias("n"), F.count(value).alias("known"))
    return g.where((F.col("a") == F.col("z")) & (F.col("n") == F.col("known"))).select(name, F.col("a").alias(value))


def against_baseline(scores: DataFrame, baselines: DataFrame) -> DataFrame:
    """id, dimension, value, city_mean, over: a row for each hotel and dimension; baselines has a row for each city."""
    means = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value"), F.col(f"{d}_mean").alias("city_mean")) for d in C.DIMENSIONS])
    d = scores.select("city_id", "id", *C.DIMENSIONS).join(baselines, "city_id").select("id", F.explode(means).alias("m"))
    return d.select("id", "m.dimension", "m.value", "m.city_mean", F.round(F.col("m.value") - F.col("m.city_mean"), 2).alias("over"))
