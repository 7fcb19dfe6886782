"""What the site reads: hotel pages, the search index with the card of hotels without a page, and city pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C

#: The address of the card that stands for all hotels without a page.
RESERVED = "limited"
class SlugError(ValueError):
    """A hotel's address is taken by a page of the site."""


def with_pages(hotels: DataFrame, subset: DataFrame) -> DataFrame:
    """hotels(slug, comparable array of slugs) with has_static_page, and comparable as structs that say it of each peer."""
    built = subset.select("slug", F.lit(True).alias("__built")).distinct()
    d = hotels.join(built, "slug", "left").withColumn("has_static_page", F.coalesce("__built", F.lit(False))).drop("__built")
    peers = d.select("slug", F.posexplode("comparable").alias("at", "peer"))
    peers = peers.join(built.withColumnRenamed("slug", "peer"), "peer", "left")
    one = F.struct("at", F.col("peer").alias("slug"), F.coalesce("__built", F.lit(False)).alias("has_static_page"))
    peers = peers.groupBy("slug").agg(F.array_sort(F.collect_list(one)).alias("peers"))  # PEERS at most
    none = F.array().cast("array<struct<slug:string,has_static_page:boolean>>")
    listed = F.transform("peers", lambda p: F.struct(p.slug.alias("slug"), p.has_static_page.alias("has_static_page")))
    return d.join(peers, "slug", "left").withColumn("comparable", F.coalesce(listed, none)).drop("peers")


def search_index(pages: DataFrame) -> DataFrame:
    """Every hotel with what its page, its card and a comparison show; stops if a slug is the reserved one."""
    if pages.where(F.col("slug") == RESERVED).limit(1).count():
        raise SlugError(f"a hotel's slug is /hotel/{RESERVED}")
    return pages


def leaders(df: DataFrame, score: Column, n: int, by: list[str], parts: int = 64) -> DataFrame:
    """The rows of each group that can be among its n highest scores, and few others; nothing is sorted for it.

    Rows are dealt by their ids, and each part's highest score is one row's: the n-th highest of them is no more than the n-th highest of all.
    """
    tops = df.groupBy(*by, F.pmod(F.hash("id"), F.lit(parts)).alias("__deal")).agg(F.max(score).alias("__top"))
    bounds = tops.groupBy(*[F.col(b).alias(f"__{b}") for b in by]).agg(F.get(F.sort_array(F.collect_list("__top"), asc=False), F.lit(n - 1)).alias("__least"))
    on = [F.col(b).eqNullSafe(F.col(f"__{b}")) for b in by]
    kept = df.join(F.broadcast(bounds), reduce(lambda a, b: a & b, on)).where(F.col("__least").isNull() | (score >= F.col("__least")))
    return kept.select(*df.columns)


def best_named(hotels: DataFrame, score: Column, n: int, by: list[str]) -> DataFrame:
    """The n hotels with a name and the highest score of each group, ties by id, with ``rank`` and ``score``."""
    named = hotels.where(F.col("name").isNotNull() & (F.trim("name") != "")).withColumn("score", F.round(score, 1))
    order = Window.partitionBy(*by).orderBy(F.desc(score), "id")
    return leaders(named, score, n, by).withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= n)


def top_lists(hotels: DataFrame, n: int = 3) -> DataFrame:
    """city_id, dimension, rank, id, score: the best named hotels of each dimension."""
    long = hotels.select("city_id", "id", "name", *C.DIMENSIONS).unpivot(["city_id", "id", "name"], C.DIMENSIONS, "dimension", "value")
    return best_named(long, F.col("value"), n, ["city_id", "dimension"]).select("city_id", "dimension", "rank", "id", "score")


def representatives(hotels: DataFrame, n: int = 5) -> DataFrame:
    """city_id, rank, id, score: the best named hotels of all."""
    return best_named(hotels, F.col("balanced_score"), n, ["city_id"]).select("city_id", "rank", "id", "score")


def city_pages(hotels: DataFrame, pages: DataFrame, baselines: DataFrame, decided: DataFrame | None = None) -> DataFrame:
    """One row for each city: baseline, top lists and representatives with a slug where a page was built, and its recorded status.

    hotels(city_id, id, name, six scores, balanced_score), pages(id, slug, has_static_page), baselines by city, decided(city_id).
    """
    slug = pages.select("id", F.when(F.col("has_static_page"), F.col("slug")).alias("slug"))
    shown = hotels.select("id", "name").join(slug, "id")
    row = lambda *more: F.struct(*more, "rank", "id", "name", "slug", "score")
    tops = top_lists(hotels).join(shown, "id").groupBy("city_id").agg(F.array_sort(F.collect_list(row("dimension"))).alias("top_by_dimension"))
    best = representatives(hotels).join(shown, "id").groupBy("city_id").agg(F.array_sort(F.collect_list(row())).alias("representative_hotels"))
    d = baselines.join(tops, "city_id", "left").join(best, "city_id", "left")
    if decided is None:
        return d.withColumn("publication_status", F.lit("noindex"))
    yes = decided.select("city_id", F.lit("indexable").alias("__status")).distinct()
    return d.join(yes, "city_id", "left").withColumn("publication_status", F.coalesce("__status", F.lit("noindex"))).drop("__status")
