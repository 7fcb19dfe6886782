"""Operators that spread one group over many tasks: ranks, order statistics, outlines in cells, nearest by rings."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from environs.functions import geo
from environs.operators import dimensions, outlines, quality, quantiles, ranking, ranks, statistics
from environs.operators.spatial import nearest
from environs.sources.atlas import Atlas
from environs.storage import setting

FOLDER = "/root/testdata/sf0.001"


def one_city(spark, n=4000, seed=1):
    """(g, v, id): one group has nearly all rows, a third of them with one value; a small group, a null group, null values."""
    rng = random.Random(seed)
    rows = [("a", 7.0 if rng.random() < 0.33 else float(rng.randrange(900)), i) for i in range(n)]
    rows += [("b", float(i % 3), n + i) for i in range(10)] + [(None, 1.0, n + 20), (None, None, n + 21), ("a", None, n + 22), ("c", -0.5, n + 23)]
    return spark.createDataFrame(rows, "g string, v double, id long")


# ranks ------------------------------------------------------------------------------------------------------------


def test_ranks_are_those_of_windows(spark):
    d = one_city(spark)
    w = Window.partitionBy("g").orderBy("v")
    got = ranks.with_rank(d, ["g"], "v").select("id", (F.col("less") + 1).alias("rank"), ranks.percent_rank().alias("p"), ranks.average_rank().alias("mean"))
    want = d.select("id", F.rank().over(w).cast("long").alias("rank"), F.percent_rank().over(w).alias("p"), (F.rank().over(w) + (F.count(F.lit(1)).over(Window.partitionBy("g", "v")) - 1) / 2.0).alias("mean"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("by", [["g"], []])
def test_places_are_row_numbers(spark, by):
    d, order = one_city(spark), [F.desc("v"), F.col("id").asc()]
    got = ranks.numbered(d, by, order, total="n")
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    want = d.select("*", F.row_number().over(w.orderBy(*order)).cast("long").alias("place"), F.count(F.lit(1)).over(w).alias("n"))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_no_task_has_more_than_its_share(spark):
    """One city over four ranges: no range has more than half of its values, and ties stand in one range."""
    d = one_city(spark).where("g = 'a'")
    with setting(spark, "spark.sql.adaptive.coalescePartitions.enabled", "false"):  # else a few rows are put in one task again
        r = ranks._ranged(d, ["g"], [F.col("v").asc(), F.col("id").asc()], "test")
        spread = ranks._ranged(d.groupBy("g", "v").count(), ["g"], [F.col("v").asc()], "test")
    sizes = [x.n for x in r.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 4 and max(sizes) < d.count() / 2
    assert spread.select("__part").distinct().count() == 4
    assert spread.groupBy("v").agg(F.count_distinct("__part").alias("n")).where("n > 1").count() == 0


def test_ranks_of_nothing(spark):
    d = one_city(spark).where("id < 0")
    assert ranks.with_rank(d, ["g"], "v").collect() == [] and ranks.numbered(d, [], [F.col("id").asc()]).collect() == []


def test_scores_without_windows_by_city(spark, monkeypatch):
    a = Atlas(spark, FOLDER)
    scored = lambda: sorted(tuple(r) for r in dimensions.dimension_scores(a.hotels, a.pois, a.green, a.segments).collect())
    by_window = scored()
    monkeypatch.setattr(ranks, "TASK_ROWS", 3)
    assert scored() == by_window
    plan = dimensions.density(a.hotels, a.pois, "food_essentials")._jdf.queryExecution().optimizedPlan().toString()
    assert "percent_rank" not in plan


def test_gamma_of_one_large_group(spark):
    rng = random.Random(4)
    x, y = [rng.randrange(40) for _ in range(600)], [rng.randrange(500) for _ in range(600)]
    d = spark.createDataFrame([("g", a, b) for a, b in zip(x, y)] + [("h", 1, 1), ("k", 2, 3), ("k", 2, 4)], "g string, x int, y int")
    c = sum((x[i] - x[j]) * (y[i] - y[j]) > 0 for i in range(600) for j in range(i))
    e = sum((x[i] - x[j]) * (y[i] - y[j]) < 0 for i in range(600) for j in range(i))
    got = {r.g: r for r in statistics.gamma(d, "x", "y", ["g"]).collect()}
    assert (got["g"].concordant, got["g"].discordant) == (c, e) and got["g"].gamma == pytest.approx((c - e) / (c + e))
    assert math.isnan(got["k"].gamma)


# order statistics ---------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("bound", [100_000, 0])
def test_medians_are_exact(spark, bound, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", bound)
    monkeypatch.setattr(quantiles, "BINS", 8)
    rng = random.Random(2)
    rows = [("a", rng.choice([1e-300, -1e300, 5.0, 5.0, rng.gauss(0, 1), rng.random() * 1e9]), float(i % 7) if i % 5 else None) for i in range(501)]
    rows += [("b", 2.0, None), ("b", 4.0, None), ("c", -0.0, 1.0), (None, 3.0, 9.0), (None, 3.0, 8.0), ("d", float("inf"), 1.0), ("d", 1.0, 2.0)]
    d = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r.g: (r.x, r.y) for r in quantiles.medians(d, ["g"], ["x", "y"]).collect()}

    def want(g, i):
        v = sorted(r[i] for r in rows if r[0] == g and r[i] is not None)
        return v[(len(v) - 1) // 2] + (v[len(v) // 2] - v[(len(v) - 1) // 2]) / 2 if v else None

    assert got == {g: (want(g, 1), want(g, 2)) for g in ("a", "b", "c", "d", None)}


def test_upper_median_and_other_places(spark):
    d = spark.createDataFrame([("a", float(v)) for v in (3, 1, 2, 2)] + [("b", None), ("c", float("nan")), ("c", 1.0)], "g string, v double")
    assert {r.g: r.upper_median for r in quality.upper_median(d, ["g"], "v").where("not isnan(upper_median)").collect()} == {"a": 2.0}
    found = quantiles.order_statistics(d, ["g"], ["v"], {"least": F.lit(0), "third": F.lit(2), "most": F.col("n") - 1}).where("g = 'a'").first()
    assert (found.n, found.least, found.third, found.most) == (4, 1.0, 2.0, 3.0)
    assert math.isnan(quantiles.order_statistics(d, ["g"], ["v"], {"most": F.col("n") - 1}).where("g = 'c'").first().most)
    assert quantiles.medians(d.where("g = 'z'"), ["g"], ["v"]).collect() == []


def test_baselines_by_histograms(spark, monkeypatch):
    rng = random.Random(3)
    names = ["walkability_density", "transit_access", "food_essentials", "quietness_proxy", "family_convenience", "nightlife_access", "balanced_score", "confidence"]
    d = spark.createDataFrame([(c, *[rng.random() * 100 for _ in names]) for c in ("p", "q") for _ in range(101)], "city_id string, " + ", ".join(f"{n} double" for n in names))
    by_task = sorted(quality.baseline(d).collect())
    monkeypatch.setattr(ranks, "TASK_ROWS", 3)
    assert sorted(quality.baseline(d).collect()) == by_task and by_task[0].n_hotels == 101


def test_peers_of_a_city_over_many_ranges(spark):
    rng = random.Random(6)
    rows = [("c", f"h{i:03}", float(rng.randrange(60))) for i in range(300)]
    got = ranking.peers(spark.createDataFrame(rows, "city_id string, id string, score double"), 2).collect()
    order = [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]
    by = {}
    for r in got:
        by.setdefault(r.id, set()).add(r.peer)
    assert all(by[h] == {order[i - 1], order[i + 1]} for i, h in enumerate(order) if 0 < i < len(order) - 1)
    assert by[order[0]] == set(order[1:3]) and by[order[-1]] == set(order[-3:-1])


# outlines -----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(("radius", "vertices"), [(100.0, 150), (400.0, 7), (0.0, 90), (30.0, 3)])
def test_points_inside_and_near_jagged_polygons(spark, radius, vertices):
    rng = random.Random(vertices)
    per_degree = spark.range(1).select(geo.project(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(1.0)).y.alias("y")).first().y

    def in_degrees(n, cx, cy, size, holes):
        def ring(scale):
            points = [(cx + scale * (0.6 + 0.4 * rng.random()) * math.cos(2 * math.pi * i / n), (cy + scale * (0.6 + 0.4 * rng.random()) * math.sin(2 * math.pi * i / n)) / per_degree) for i in range(n)]
            return "(" + ", ".join(f"{x!r} {y!r}" for x, y in [*points, points[0]]) + ")"

        return "POLYGON (" + ", ".join([ring(size)] + [ring(size * 0.4)] * holes) + ")"

    s = spark.createDataFrame([("c", f"g{i}", in_degrees(vertices, rng.uniform(-2000, 2000), rng.uniform(-2000, 2000), rng.choice([200, 900, 2200]), i % 2), 0.0, 1.0) for i in range(8)], "city_id string, g string, wkt string, center_lon double, metres_x double")
    p = spark.createDataFrame([("c", f"p{i}", rng.uniform(-4000, 4000), rng.uniform(-4000, 4000)) for i in range(1500)], "city_id string, id string, x double, y double")
    parsed = s.select("city_id", "g", geo.edges(geo.projected(geo.rings(F.col("wkt")), F.col("center_lon"), F.col("metres_x"))).alias("edges"))
    want = p.join(parsed, "city_id").select("id", "g", geo.polygon_distance(F.col("x"), F.col("y"), F.col("edges")).alias("d")).where(F.col("d") <= radius)
    got = outlines.near_outlines(p, s, "g", radius, polygon=True)
    a, b = {(r.id, r.g): r.d for r in got.collect()}, {(r.id, r.g): r.d for r in want.collect()}
    assert a.keys() == b.keys() and sum(d == 0 for d in a.values()) > 100 and (radius == 0 or sum(d > 0 for d in a.values()) > 20)
    assert all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_no_outline_is_shuffled(spark):
    """No array of edges passes an exchange, and grouping needs no exchange after the join."""
    a = Atlas(spark, FOLDER)
    plan = outlines.near_outlines(a.hotels, a.outlines.where("shape = 'ring'"), "outline_id", 200.0, polygon=True)._jdf.queryExecution().executedPlan().toString()
    above = plan[: plan.index("SortMergeJoin")]
    assert "Exchange" not in above
    assert "array<" not in plan and "edges" not in plan.split("SortMergeJoin")[1].split("Exchange")[1]


# nearest ------------------------------------------------------------------------------------------------------------


def test_nearest_ends_without_coordinates(spark):
    left = spark.createDataFrame([("c", "a", 0.0, 0.0), ("c", "b", None, 0.0), ("c", "n", float("nan"), 1.0), ("e", "far", 0.0, 0.0)], "city_id string, id string, x double, y double")
    right = spark.createDataFrame([("c", 1, 10.0, 0.0), ("c", 2, None, 0.0), ("c", 3, 90_000.0, 0.0), ("d", 4, 0.0, 0.0), ("c", 5, float("inf"), 0.0)], "city_id string, p int, x double, y double")
    got = sorted((r.id, r.p, r["rank"]) for r in nearest(left, right, "p", 4).collect())
    assert got == [("a", 1, 1), ("a", 3, 2)]
    assert nearest(left, right.where("x is null"), "p", 4).collect() == []
    assert nearest(left.where("x is null"), right, "p", 4).collect() == []
