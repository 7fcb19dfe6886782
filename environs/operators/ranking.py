"""Rankings: fractional ranks, peers, quotas, selections under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as C
from ..storage import stash
from .ranks import numbered


def fractional_rank(value: str, *by: str) -> Column:
    """Average rank with ties."""
    return F.rank().over(Window.partitionBy(*by).orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2.0


def top(df: DataFrame, n: int, by: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """The first n rows of each group; order must be total."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).where(F.col(rank) <= n)


def peers(scored: DataFrame, n: int = C.PEERS) -> DataFrame:
    """scored(city_id, id, score) -> id, peer, place: the n neighbours in score order, below and above in turn, one-sided at the ends.

    Neighbours at distance k below come before those at distance k above. Equal scores are ordered by id.
    """
    r = numbered(scored, ["city_id"], [F.col("score").asc(), F.col("id").asc()], "rn")
    steps = F.array(*[F.lit(k) for k in range(-n, n + 1) if k])
    wanted = r.select("city_id", "id", "rn", F.explode(steps).alias("step")).withColumn("at", F.col("rn") + F.col("step"))
    met = wanted.join(r.select("city_id", F.col("id").alias("peer"), F.col("rn").alias("at")), ["city_id", "at"])
    return top(met, n, ["city_id", "id"], [F.abs("step"), F.col("step")], "place").select("city_id", "id", "peer", "place")


def half_even(x: Column) -> Column:
    """To a whole number, halves to the even one."""
    return F.bround(x, 0).cast("long")


def cohort(candidates: DataFrame, *, target: int = C.COHORT, least: int = C.CITY_MIN, most: int = C.CITY_MAX, share: float = C.INDEPENDENT_SHARE) -> DataFrame:
    """candidates(city_id, id, chain, distinctiveness) -> the chosen, with ``stage`` quota, backfill or top_up.

    Each city has a quota in proportion to its candidates; 70 % of it are independents, the rest chains, and what one pool lacks
    the other fills. If the whole is short of target, the most distinctive left over follow, within each city's cap.
    """
    city = Window.partitionBy("city_id")
    order = [F.desc("distinctiveness"), F.col("id")]
    sizes = candidates.groupBy("city_id").agg(F.count(F.lit(1)).alias("n"))
    total = max(candidates.count(), 1)
    quota = F.least(F.greatest(F.lit(least), F.least(F.lit(most), half_even(F.lit(float(target)) * F.col("n") / F.lit(float(total))))), F.col("n"))
    sizes = sizes.select("city_id", quota.alias("quota")).withColumn("independents", half_even(F.col("quota") * F.lit(share)))
    c = candidates.join(F.broadcast(sizes), "city_id")
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("city_id", "chain").orderBy(*order)))
    c = c.withColumn("first", F.col("place") <= F.when(F.col("chain"), F.col("quota") - F.col("independents")).otherwise(F.col("independents")))
    c = c.withColumn("short", F.col("quota") - F.sum(F.col("first").cast("int")).over(city))
    c = c.withColumn("left_place", F.when(~F.col("first"), F.row_number().over(Window.partitionBy("city_id", "first").orderBy(*order))))
    c = c.withColumn("in_quota", F.col("first") | F.coalesce(F.col("left_place") <= F.col("short"), F.lit(False)))
    # the cap is by city and the order is global: a city's leftovers up to its cap compete, the best of all fill the rest
    c = c.withColumn("spare", F.when(~F.col("in_quota"), F.row_number().over(Window.partitionBy("city_id", "in_quota").orderBy(*order))))
    eligible = ~F.col("in_quota") & (F.col("spare") <= F.lit(most) - F.col("quota"))
    c = stash(c.where(F.col("in_quota") | eligible), "cohort")  # at most ``most`` rows a city are left
    room = max(0, target - c.where("in_quota").count())
    kept = c.where("in_quota").withColumn("stage", F.when(F.col("first"), "quota").otherwise("backfill"))
    extra = c.where("not in_quota").orderBy(*order).limit(room).withColumn("stage", F.lit("top_up"))
    return kept.union(extra).select("city_id", "id", "chain", "distinctiveness", "stage")


class BudgetError(ValueError):
    """Pages that must exist don't fit the budget."""


def static_subset(pages: DataFrame, links: DataFrame, budget: int = C.PAGE_BUDGET, overrun: bool = False) -> DataFrame:
    """pages(city_id, slug, status, confidence, balanced_score), links(slug, to) -> slug, layer: required, linked or fill.

    Indexable pages are required and are never dropped: more of them than the budget raise BudgetError. Pages that they link to
    follow, all or none; the rest is filled by city in proportion, by confidence, then by distance from the city's upper median.
    With overrun the budget bounds only what is filled: required and linked pages stay, all of them, however many they are.
    """
    required = pages.where("status = 'indexable'").select("slug")
    sizes = pages.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "indexable").alias("required")).first()
    if sizes.required > budget and not overrun:
        raise BudgetError(f"{sizes.required} indexable pages exceed the budget of {budget}")
    linked = links.join(required, "slug", "left_semi").select(F.col("to").alias("slug")).distinct().join(pages, "slug", "left_semi").join(required, "slug", "left_anti")
    linked = stash(linked, "linked")
    n_linked = linked.count()
    if sizes.required + n_linked > budget and not overrun:
        linked, n_linked = linked.limit(0), 0
    room = budget - sizes.required - n_linked
    must = required.withColumn("layer", F.lit("required")).union(linked.select("slug", F.lit("linked").alias("layer")))
    city = Window.partitionBy("city_id")
    p = pages.withColumn("n", F.count(F.lit(1)).over(city))
    place = F.row_number().over(city.orderBy("balanced_score", "slug")) - 1
    p = p.withColumn("place", place).withColumn("median", F.max(F.when(F.col("place") == F.floor(F.col("n") / 2), F.col("balanced_score"))).over(city))
    p = p.join(must, "slug", "left_anti").withColumn("share", half_even(F.lit(float(room)) * F.col("n") / F.lit(max(sizes.n, 1))))
    order = [F.desc("confidence"), F.desc(F.abs(F.col("balanced_score") - F.col("median"))), F.col("slug")]
    fill = p.withColumn("rank", F.row_number().over(city.orderBy(*order))).where(F.col("rank") <= F.col("share"))
    return must.union(fill.select("slug", F.lit("fill").alias("layer")))
