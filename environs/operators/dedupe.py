"""Duplicate places: candidate pairs, clusters, and the record that stands for each cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as C
from ..functions import geo
from ..storage import stash
from .graph import components


def candidate_pairs(hotels: DataFrame, form: str = "form") -> DataFrame:
    """hotels(city_id, id, form, leaf, lat, lon) -> pairs a < b of one city, form and leaf, in neighbouring cells, within 25 m.

    Cells are 0.0003 degrees; points two cells apart are never compared, however near. Blank and null forms aren't compared.
    The join's key holds the cell, so a chain's common name is spread over its cells.
    """
    h = hotels.where(F.col(form).isNotNull() & (F.col(form) != "")).select(
        "city_id", "id", F.col(form).alias("form"), "leaf", "lat", "lon", F.floor(F.col("lat") / C.DEDUPE_CELL_DEG).alias("gy"), F.floor(F.col("lon") / C.DEDUPE_CELL_DEG).alias("gx")
    )
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    left = h.withColumn("s", F.explode(steps)).select("city_id", "form", "leaf", F.col("id").alias("a"), F.col("lat").alias("lat_a"), F.col("lon").alias("lon_a"), (F.col("gy") + F.col("s.i")).alias("gy"), (F.col("gx") + F.col("s.j")).alias("gx"))
    right = h.select("city_id", "form", "leaf", F.col("id").alias("b"), F.col("lat").alias("lat_b"), F.col("lon").alias("lon_b"), "gy", "gx")
    d = geo.haversine_m(F.col("lat_a"), F.col("lon_a"), F.col("lat_b"), F.col("lon_b"))
    return left.join(right, ["city_id", "form", "leaf", "gy", "gx"]).where("a < b").withColumn("d", d).where(F.col("d") <= C.DEDUPE_M).select("city_id", "a", "b", "d")


def links(hotels: DataFrame, form: str = "form") -> DataFrame:
    """a, b: links that join the same records into clusters as all of ``candidate_pairs``.

    Records of one form and leaf at one point are at no distance: the smallest id stands for them and is linked with each, and only places that
    differ are compared. So links grow with the records, not with the product of those that share a point.
    """
    alike = ["city_id", "form", "leaf", "lat", "lon"]
    placed = (F.abs("lat") < float("inf")) & (F.abs("lon") < float("inf"))
    h = hotels.where(F.col(form).isNotNull() & (F.col(form) != "") & placed)
    h = stash(h.select("city_id", "id", F.col(form).alias("form"), "leaf", "lat", "lon"), "forms")  # forms are worked out once
    first = h.groupBy(*alike).agg(F.min("id").alias("id"))
    same = h.withColumnRenamed("id", "b").join(first.withColumnRenamed("id", "a"), alike).where("a < b").select("a", "b")
    return same.union(candidate_pairs(first).select("a", "b"))


def clusters(hotels: DataFrame, pairs: DataFrame) -> DataFrame:
    """Every hotel with the smallest id of its cluster."""
    found = components(pairs.select(F.col("a").alias("u"), F.col("b").alias("v")))
    return hotels.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("cluster", F.coalesce("root", "id")).drop("root")


def canonical(clustered: DataFrame) -> DataFrame:
    """One row for each cluster: the record with the highest confidence, then most sources, then smallest id, and what it absorbed."""
    best = F.min_by("id", F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("c"), (-F.col("n_sources")).alias("n"), F.col("id").alias("i")))
    g = clustered.groupBy("city_id", "cluster").agg(best.alias("id"), F.array_sort(F.collect_list("id")).alias("members"))
    several = F.size("members") > 1
    return g.select(
        "city_id", "id", F.when(several, C.MERGED_CONFIDENCE).otherwise(C.SINGLE_CONFIDENCE).alias("dedupe_confidence"),
        F.when(several, "name_and_distance").otherwise("single_record").alias("dedupe_method"), F.array_remove("members", F.col("id")).alias("merged_from"),
    )
