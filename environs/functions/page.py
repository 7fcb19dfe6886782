"""What published pages must hold, as Column expressions over their HTML."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CANONICAL = r"<link[^>]*rel=[\"']canonical[\"'][^>]*>"
JSON_LD = r"<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>([\s\S]*?)</script>"
#: FIXED VALUES: keys that structured data must not hold, and the types that it may have.
FORBIDDEN = ["aggregaterating", "review", "reviews", "ratingvalue", "reviewcount", "ratingcount", "starrating"]
TYPES = ["WebSite", "BreadcrumbList", "Place", "LodgingBusiness", "Hotel", "ListItem", "GeoCoordinates", "PostalAddress", "PropertyValue"]


def title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, "<title>([^<]*)</title>", 1))


def canonicals(html: Column) -> Column:
    return F.regexp_count(html, F.lit(CANONICAL)).cast("long")


def blocks(html: Column) -> Column:
    """The texts of all JSON-LD blocks."""
    return F.regexp_extract_all(html, F.lit(JSON_LD), F.lit(1))


def keys(block: Column) -> Column:
    """Every key of a JSON text at any depth, lower-cased: strings that a colon follows."""
    return F.transform(F.regexp_extract_all(block, F.lit(r'"((?:[^"\\\\]|\\\\.)*)"\s*:'), F.lit(1)), F.lower)


def forbidden_keys(html: Column) -> Column:
    """Forbidden keys in any JSON-LD block, each once, in order."""
    found = F.flatten(F.transform(blocks(html), keys))
    return F.array_sort(F.array_distinct(F.filter(found, lambda k: k.isin(FORBIDDEN))))


def bad_type(html: Column) -> Column:
    """A block whose @type isn't allowed."""
    return F.exists(blocks(html), lambda b: F.coalesce(~F.get_json_object(b, "$['@type']").isin(TYPES), F.lit(False)))


def unreadable(html: Column) -> Column:
    """A block that isn't JSON."""
    return F.exists(blocks(html), lambda b: F.get_json_object(b, "$").isNull())


def problems(html: Column) -> Column:
    """Codes of what is wrong with a page; whether its title is its own is for the caller to join."""
    return F.array_compact(
        F.array(
            F.when(canonicals(html) != 1, "canonical"), F.when(title(html) == "", "no_title"), F.when(F.size(forbidden_keys(html)) > 0, "forbidden_key"),
            F.when(bad_type(html), "type"), F.when(unreadable(html), "json"),
        )
    )
