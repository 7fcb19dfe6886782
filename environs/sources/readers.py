"""Sources: releases, schema-checked Parquet, listed files, CSV, JSON, XML listings, and the extracts of a places release."""

from __future__ import annotations

import re
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as C
from ..config import City, city_frame
from ..functions import geo, scoring, text

#: release/YYYY-MM-DD.N/
RELEASE = r"release/(\d{4}-\d{2}-\d{2}\.\d+)/?$"

#: FIXED VALUES: the columns that each source table must have.
REQUIRED = {
    "place": ["id", "names", "confidence", "taxonomy", "brand", "addresses", "sources", "bbox"],
    "segment": ["id", "subtype", "class", "geometry", "bbox"],
    "land_use": ["id", "subtype", "class", "names", "geometry", "bbox"],
    "land": ["id", "subtype", "class", "names", "geometry", "bbox"],
}


class SchemaError(ValueError):
    """A source that lacks what is read from it."""


def releases(listing: DataFrame, column: str = "path") -> DataFrame:
    """listing(path) -> release, day, minor of the paths that name a release."""
    r = listing.select(F.regexp_extract(column, RELEASE, 1).alias("release")).where("release <> ''").distinct()
    parts = F.split("release", r"\.")
    return r.select("release", F.get(parts, 0).alias("day"), F.get(parts, 1).cast("int").alias("minor"))


def latest_release(listing: DataFrame, column: str = "path") -> str:
    """The newest release of a listing: by day, then by the number after it, as a number."""
    found = releases(listing, column).agg(F.max_by("release", F.struct("day", "minor"))).first()[0]
    if found is None:
        raise SchemaError("the listing names no release")
    return found


def bucket_listing(spark: SparkSession, path: str) -> DataFrame:
    """The prefixes of an XML bucket listing, as path."""
    whole = spark.read.text(path, wholetext=True)
    return whole.select(F.explode(F.regexp_extract_all("value", F.lit(r"<Prefix>([^<]+)</Prefix>"), F.lit(1))).alias("path"))


def local_release(names: list[str], wanted: str = "latest") -> str:
    """An explicit release, or the last local folder by name (not by number: that is how local folders have always been chosen)."""
    if wanted != "latest":
        return wanted
    found = sorted(n for n in names if re.fullmatch(r"\d{4}-\d{2}-\d{2}\.\d+", n))
    if not found:
        raise SchemaError("no local release")
    return found[-1]


def require_columns(df: DataFrame, wanted: list[str], what: str) -> DataFrame:
    """df, if it has all wanted columns; nothing is read."""
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise SchemaError(f"{what} lacks {', '.join(missing)}")
    return df


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return require_columns(spark.read.parquet(path), REQUIRED[kind], kind)


def read_listed(spark: SparkSession, manifest: DataFrame, city: City, limit: int = 100_000) -> DataFrame:
    """The Parquet files of manifest(path, minx, miny, maxx, maxy) whose boxes meet the city's. Other files aren't opened.

    Paths are named to the reader ``limit`` at a time; however many there are, all are read.
    """
    box = [F.lit(v) for v in city.box]
    rows = manifest.where(geo.boxes_overlap([F.col(c) for c in ("minx", "miny", "maxx", "maxy")], box)).select("path").orderBy("path").toLocalIterator()
    parts = []
    while paths := [r.path for r in islice(rows, limit)]:
        parts.append(spark.read.parquet(*paths))
    if not parts:
        raise SchemaError(f"no file of the manifest meets {city.id}")
    return reduce(DataFrame.unionByName, parts)


#: Files beyond this are listed by size and time only: a digest needs a file's bytes as one value.
DIGEST_BYTES = 256 << 20


def digests(spark: SparkSession, *paths: str, most: int = DIGEST_BYTES) -> DataFrame:
    """path, bytes, modified, sha256 of the files in folders and paths: of the bytes themselves. Larger files than ``most`` have a null digest."""
    names = [p for p in paths if p]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(names)
    small = files.where(F.col("length") <= most).select("path", "length", "modificationTime", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > most).select("path", "length", "modificationTime", F.lit(None).cast("string").alias("sha256"))
    return small.union(large).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"), "sha256")


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


PROBES = "timestamp_utc string, url string, status int, cf_ray string, error string"


def read_probes(spark: SparkSession, path: str) -> DataFrame:
    """A probe log as url, ts, up, event_id."""
    p = read_csv(spark, path, PROBES).withColumn("ts", F.to_timestamp("timestamp_utc", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return p.select("url", "ts", (F.coalesce("status", F.lit(0)) == 200).alias("up"), F.monotonically_increasing_id().alias("event_id"))


def _in_city(df: DataFrame, cities: DataFrame) -> DataFrame:
    """Rows whose south-west corner lies in a city's box, for every city at once; the few cities are broadcast."""
    xmin, ymin = F.col("bbox.xmin"), F.col("bbox.ymin")
    inside = xmin.between(F.col("minx"), F.col("maxx")) & ymin.between(F.col("miny"), F.col("maxy"))
    return df.join(F.broadcast(cities), inside)


def any_box(cities: dict[str, City]) -> Column:
    """The same, for the scan: a condition on nested columns that reaches the Parquet reader."""
    return reduce(lambda a, b: a | b, [geo.in_box(F.col("bbox.xmin"), F.col("bbox.ymin"), c.box) for c in cities.values()])


def _lodging(places: DataFrame, cities: dict[str, City]) -> DataFrame:
    """Lodging of the wanted kinds, with one column for each nested field that is used, and whether its name excludes it."""
    from ..rules import MISPLACED

    address = F.try_element_at("addresses", F.lit(1))
    h = _in_city(places.where(any_box(cities) & scoring.hotel_kind(F.col("taxonomy.primary"))), city_frame(places.sparkSession, cities))
    h = h.select(
        "city_id", "city_name", "city_country", "expected_region", "center_lat", "center_lon", "metres_x", "id", F.col("names.primary").alias("name"),
        F.to_json("names", {"ignoreNullFields": "false"}).alias("names_json"), F.col("brand.names.primary").alias("brand_name"), F.col("bbox.xmin").alias("lon"), F.col("bbox.ymin").alias("lat"), "confidence",
        F.col("taxonomy.primary").alias("leaf"), F.col("taxonomy.hierarchy").alias("hierarchy"), F.size("sources").cast("long").alias("n_sources"),
        *[address[c].alias(f"address_{c}") for c in ("freeform", "locality", "postcode", "region", "country")],
    )
    p = geo.project(F.col("lon"), F.col("lat"), F.col("center_lon"), F.col("metres_x"))
    h = h.withColumn("x", p.x).withColumn("y", p.y)
    return h.withColumn("excluded", text.non_hotel(F.col("name"), F.col("id")) | F.col("id").isin(MISPLACED))


def extract_hotels(places: DataFrame, cities: dict[str, City]) -> DataFrame:
    """Lodging of the wanted kinds. Excluded names go before anything is deduplicated."""
    return _lodging(places, cities).where("not excluded").drop("excluded")


def excluded_hotels(places: DataFrame, cities: dict[str, City]) -> DataFrame:
    """city_id, id, name of the lodging that its name excludes: what a manifest lists."""
    return _lodging(places, cities).where("excluded").select("city_id", "id", "name")


def extract_pois(places: DataFrame, cities: dict[str, City]) -> DataFrame:
    wanted = scoring.poi_of_interest(F.col("taxonomy.primary"), F.col("taxonomy.hierarchy"))
    d = _in_city(places.where(any_box(cities) & wanted), city_frame(places.sparkSession, cities))
    p = geo.project(F.col("bbox.xmin"), F.col("bbox.ymin"), F.col("center_lon"), F.col("metres_x"))
    return d.select("city_id", F.col("id").alias("poi_id"), F.col("names.primary").alias("name"), F.to_json("names").alias("names_json"), F.col("taxonomy.primary").alias("leaf"), F.col("taxonomy.hierarchy").alias("hierarchy"), p.x.alias("x"), p.y.alias("y"))


def extract_green(land_use: DataFrame, land: DataFrame, cities: dict[str, City]) -> DataFrame:
    """Both themes' polygons; geometry is WKT text."""
    out = []
    for name, df in (("land_use", land_use), ("land", land)):
        d = _in_city(df.where(any_box(cities) & scoring.green_source(name, F.col("subtype"), F.col("class"))), city_frame(df.sparkSession, cities))
        out.append(d.select("city_id", "center_lon", "metres_x", F.col("id").alias("green_id"), "subtype", "class", F.col("geometry").alias("wkt")))
    return out[0].unionByName(out[1])


def extract_segments(segments: DataFrame, cities: dict[str, City]) -> DataFrame:
    used = ((F.col("subtype") == "road") & F.col("class").isin(C.ROAD_CLASSES)) | (F.col("subtype") == "rail")
    d = _in_city(segments.where(any_box(cities) & used), city_frame(segments.sparkSession, cities))
    return d.select("city_id", "center_lon", "metres_x", F.col("id").alias("segment_id"), "subtype", "class", F.col("geometry").alias("wkt"))


def look_up(asked: DataFrame, index: DataFrame) -> DataFrame:
    """asked(id, bucket), index(id, bucket, city_id) -> id, found_in, city_id: a row of the index by shard and id; ids that aren't in their shard
    are looked for in all shards; found_in is shard, full or none."""
    i = index.select(F.col("id").alias("__id"), F.col("bucket").alias("__bucket"), F.col("city_id").alias("__city"))
    near = asked.join(i, (asked["id"] == i["__id"]) & (asked["bucket"] == i["__bucket"]), "left")
    hit = near.where("__id is not null").select("id", F.lit("shard").alias("found_in"), F.col("__city").alias("city_id"))
    rest = near.where("__id is null").select("id").join(index.select("id", "city_id"), "id", "left")
    return hit.union(rest.select("id", F.when(F.col("city_id").isNull(), "none").otherwise("full").alias("found_in"), "city_id"))
