"""Scoring formulas as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from .. import constants as C

#: Continuous results are compared with other engines, whose exp may differ in the last bit.
DIGITS = 6


def decay(d: Column, scale: float) -> Column:
    return F.exp(-d / F.lit(float(scale)))


def saturating(count: Column, saturation: float) -> Column:
    return F.lit(100.0) * (F.lit(1.0) - F.exp(-count / F.lit(float(saturation))))


def percentile_in_city(value: Column) -> Column:
    """percent_rank * 100 in the city; values are rounded before they are ranked, so that equal ones tie on any machine."""
    return F.percent_rank().over(Window.partitionBy("city_id").orderBy(value)) * 100


def hybrid(absolute: Column, percentile: Column, weight: float | None = None) -> Column:
    weight = C.ABSOLUTE_WEIGHT if weight is None else weight
    return F.lit(weight) * absolute + F.lit(1 - weight) * percentile


def diversity(count: Column, distinct: Column) -> Column:
    return count * (F.lit(1.0) + F.lit(0.1) * F.least(distinct, F.lit(8)))


def transit(best: Column, modes: Column) -> Column:
    """least and greatest skip nulls: a hotel without any mode must be made 0 first."""
    extra = F.least(F.greatest(F.coalesce(modes, F.lit(0)) - 1, F.lit(0)), F.lit(C.TRANSIT_BONUS_MODES))
    return F.least(F.lit(100.0), F.coalesce(best, F.lit(0.0)) + F.lit(C.TRANSIT_BONUS) * extra)


def quietness(nearest: dict[str, Column]) -> Column:
    lost = [F.lit(float(C.PENALTIES[k][0])) * F.coalesce(decay(d, C.PENALTIES[k][1]), F.lit(0.0)) for k, d in nearest.items()]
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), reduce(lambda a, b: a - b, lost, F.lit(float(C.QUIET_START)))))


def weighted(weights: dict[str, float]) -> Column:
    return reduce(lambda a, b: a + b, [F.lit(w) * F.col(k) for k, w in weights.items()])


def confidence(place: Column, covered: Column, hotels_in_city: Column, dedupe: Column) -> Column:
    w = C.CONFIDENCE_WEIGHTS
    total = (
        F.lit(w["place_confidence"]) * (F.lit(100.0) * F.coalesce(place, F.lit(C.DEFAULT_PLACE_CONFIDENCE / 100)))
        + F.lit(w["poi_coverage"]) * (F.lit(100.0) * covered / 5)
        + F.lit(w["city_sample_size"]) * F.least(F.lit(100.0), F.lit(100.0) * hotels_in_city / C.CITY_SAMPLE_TARGET)
        + F.lit(w["dedupe_quality"]) * dedupe
    )
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), total))


def band(value: Column, steps: list[tuple[float, str]], otherwise: str | None) -> Column:
    out = F.lit(otherwise).cast("string")
    for at, name in reversed(steps):
        out = F.when(value >= at, name).otherwise(out)
    return out


def confidence_label(value: Column) -> Column:
    return band(value, [(80, "High"), (60, "Medium")], "Low")


def verdict_band(value: Column) -> Column:
    return band(value, [(80, "Excellent"), (65, "Good"), (50, "Decent")], None)


def of_kind(dimension: str, leaf: Column, hierarchy: Column) -> Column:
    """The predicate of a dimension: a leaf in its list, or a first family in its list."""
    tests = []
    if dimension in C.CATEGORIES:
        tests.append(leaf.isin(C.CATEGORIES[dimension]))
    if dimension in C.FAMILIES:
        tests.append(F.get(hierarchy, 0).isin(C.FAMILIES[dimension]))
    if not tests:
        raise ValueError(f"{dimension} has neither categories nor families")
    return reduce(lambda a, b: a | b, tests)


def matches(kinds: list[tuple[str, str | None]], subtype: Column, kind: Column) -> Column:
    return reduce(lambda a, b: a | b, [(subtype == s) if k is None else ((subtype == s) & (kind == k)) for s, k in kinds])


def land_weight(subtype: Column, kind: Column, area: Column) -> Column:
    """First match wins."""
    return (
        F.when(matches(C.FULL_WEIGHT, subtype, kind), 1.0)
        .when(matches(C.REDUCED_WEIGHT, subtype, kind), C.REDUCED_VALUE)
        .when(matches(C.REDUCED_WEIGHT_IF_LARGE, subtype, kind) & (area >= C.MIN_AREA_M2), C.REDUCED_VALUE)
        .otherwise(0.0)
    )


def green_source(source: str, subtype: Column, kind: Column) -> Column:
    """Which polygons of the two source themes are kept at all."""
    if source == "land_use":
        u = C.LAND_USE
        pairs = [("recreation", u["recreation"]), ("managed", u["managed"]), ("entertainment", u["entertainment"])]
        return reduce(lambda a, b: a | b, [(subtype == s) & kind.isin(k) for s, k in pairs], subtype.isin(u["subtypes"]))
    return subtype.isin(C.LAND["subtypes"]) | ((subtype == "sand") & kind.isin(C.LAND["sand"]))


def poi_of_interest(leaf: Column, hierarchy: Column) -> Column:
    """Points that any dimension, the quietness penalty or the display uses, without lodging. A null hierarchy drops the row."""
    tests = [of_kind(d, leaf, hierarchy) for d in ("food_essentials", "walkability_density", "transit_access", "nightlife_access", "family_convenience")]
    wanted = reduce(lambda a, b: a | b, [*tests, leaf.isin(C.AIRPORTS), leaf.isin(C.DISPLAY_ONLY)])
    return wanted & ~F.array_contains(hierarchy, "lodging")


def hotel_kind(leaf: Column) -> Column:
    return leaf.isin(sorted(C.HOTEL_TYPES))


def numeric_name(name: Column) -> Column:
    return F.coalesce(F.trim(name).rlike("^[0-9]+$"), F.lit(False))


def blank_name(name: Column) -> Column:
    return name.isNull() | (F.trim(name) == "")


def locality_mismatch(country: Column, region: Column, city_country: Column, expected: Column, city_name: Column) -> Column:
    def said(what: str, got: Column, want: Column) -> Column:
        return F.format_string(f"Address {what} (%s) does not match %s (%s)", got, city_name, want)

    return F.when(country != city_country, said("country", country, city_country)).when(region != expected, said("region", region, expected))
