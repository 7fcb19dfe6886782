"""Rows that share a point or an outline: a meeting has each once, results have all of them."""

from __future__ import annotations

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from environs.functions import scoring
from environs.operators import dedupe, dimensions, export, matching, outlines, ranking, spatial, statistics
from environs.operators.spatial import near_points, nearest, sited, sites, to_all
from environs.plans import quality_queries

SQUARE = "POLYGON ((0.0 0.0, 0.001 0.0, 0.001 0.001, 0.0 0.001, 0.0 0.0))"


def hotels(spark):
    rows = [("c", f"h{i:02}", float(i % 3) * 10, 0.0) for i in range(30)] + [("c", "none", None, 0.0)]
    return spark.createDataFrame(rows, "city_id string, id string, x double, y double")


def pois(spark):
    rows = [("c", f"p{i:02}", f"n{i}", ["restaurant", "cafe"][i % 4 == 0], ["food_and_drink", "restaurant"], 100.0 + i % 2, 0.0) for i in range(20)]
    return spark.createDataFrame(rows, "city_id string, poi_id string, name string, leaf string, hierarchy array<string>, x double, y double")


def test_a_meeting_has_each_place_once(spark):
    h = sited(hotels(spark))
    assert sorted((r.id, r.x) for r in sites(h).collect()) == [("h00", 0.0), ("h01", 10.0), ("h02", 20.0)]
    assert dimensions.kind_pairs(sites(h), pois(spark), "food_essentials").count() == 9  # 30 hotels and 20 points have 600 pairs
    spread = {r.id: r.x for r in to_all(h, sites(h)).collect()}
    assert len(spread) == 31 and spread["none"] is None and spread["h29"] == 20.0


def test_scores_of_shared_places(spark):
    h, p = hotels(spark), pois(spark)
    plain = near_points(h, p.where(scoring.of_kind("food_essentials", F.col("leaf"), F.col("hierarchy"))).select("city_id", "leaf", "x", "y"), 400.0)
    want = {r.id: r for r in plain.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.exp(-F.col("d") / 250)).alias("raw"), F.count_distinct("leaf").alias("kinds"), F.min("d").alias("d")).collect()}
    got = {r.id: r for r in dimensions.density(h, p, "food_essentials").collect()}
    assert len(got) == 31 and got["none"].poi_count == 0
    for i, w in want.items():
        assert (got[i].poi_count, got[i].distinct_categories, got[i].nearest_m) == (20, w.kinds, w.d) and got[i].wc == pytest.approx(w.raw * (1 + 0.1 * w.kinds))
    assert dimensions.pairs(h, p).count() == 600 and dimensions.pairs(h, p).distinct().count() == 600


def test_ties_at_one_place_go_by_id(spark):
    h, p = hotels(spark), pois(spark)
    facts = sorted((r.rank, r.poi_id) for r in dimensions.nearby_facts(h, p, 3).where("hotel_id = 'h04'").collect())
    assert facts == [(1, "p00"), (2, "p02"), (3, "p04")]
    got = sorted((r["rank"], r.poi_id) for r in nearest(h, p, "poi_id", 12).where("id = 'h04'").collect())
    assert got == [(i + 1, f"p{k:02}") for i, k in enumerate([*range(0, 20, 2), 1, 3])]


def test_the_nearest_are_met_without_the_crowd_beyond(spark):
    """Where points are dense, a place meets those near it, not all within the radius; where they are few, all of them."""
    rows = [("c", f"p{i:04}", float(i % 40) * 20 - 390, float(i // 40) * 20 - 390) for i in range(1600)] + [("c", f"q{i}", 5000.0 + 300 * i, 0.0) for i in range(5)]
    p = spark.createDataFrame(rows, "city_id string, poi_id string, x double, y double")
    h = spark.createDataFrame([("c", "dense", 0.0, 0.0), ("c", "edge", 700.0, 10.0), ("c", "few", 5000.0, 0.0), ("c", "none", 9000.0, 9000.0)], "city_id string, id string, x double, y double")
    met = spatial.near_first(h, p, 12, 800.0)
    assert met.columns == ["city_id", "id", "poi_id", "d"]
    by = Window.partitionBy("id").orderBy("d", "poi_id")
    first = lambda d: sorted(map(tuple, d.withColumn("r", F.row_number().over(by)).where("r <= 12").select("id", "r", "poi_id", "d").collect()))
    assert first(met) == first(near_points(h, p, 800.0)) and len(first(met)) == 27
    assert met.where("id = 'dense'").count() < 100 and met.where("id = 'few'").count() == 3


def test_outlines_that_are_the_same(spark):
    shapes = spark.createDataFrame([("c", f"g{i}", SQUARE, 0.0, 100_000.0) for i in range(5)], "city_id string, g string, wkt string, center_lon double, metres_x double")
    got = outlines.outline_pairs(hotels(spark), shapes, "g", 50.0, polygon=True, digits=4)
    assert got.count() == 150 and got.distinct().count() == 150


def test_a_crowded_cell_of_outlines_is_several_tasks(spark, monkeypatch):
    """All points and edges are in one cell: pairs are the same however many tasks they are dealt to."""
    shapes = spark.createDataFrame([("c", f"g{i}", SQUARE.replace("0.001", f"0.0007{i}"), 0.0, 100_000.0) for i in range(9)], "city_id string, g string, wkt string, center_lon double, metres_x double")
    points = spark.createDataFrame([("c", f"h{i:03}", 1.0 + i % 20 * 9, 1.0 + i // 20 * 9) for i in range(400)] + [("c", "none", None, 0.0)], "city_id string, id string, x double, y double")
    for strict in (False, True):
        plain = outlines.near_outlines(points, shapes, "g", 0.0 if strict else 20.0, polygon=True, strict=strict)
        want = sorted(map(tuple, plain.collect()))
        with monkeypatch.context() as m:
            m.setattr(outlines, "TASK_MEETINGS", 100, raising=False)
            got = outlines.near_outlines(points, shapes, "g", 0.0 if strict else 20.0, polygon=True, strict=strict)
            assert got.columns == plain.columns and sorted(map(tuple, got.collect())) == want and len(want) > 500
            assert got.groupBy(F.spark_partition_id()).count().count() > 20


def test_inside_is_not_on_the_edge(spark):
    shape = spark.createDataFrame([("c", "g", SQUARE, 0.0, 100_000.0)], "city_id string, g string, wkt string, center_lon double, metres_x double")
    top = outlines.edges_of(shape, "g").agg(F.max("by")).first()[0]
    points = [("in", 50.0, 50.0), ("left", 0.0, 50.0), ("right", 100.0, 50.0), ("below", 50.0, 0.0), ("above", 50.0, top), ("corner", 0.0, 0.0), ("out", -1.0, 50.0)]
    p = spark.createDataFrame([("c", *r) for r in points], "city_id string, id string, x double, y double")
    assert [r.id for r in outlines.near_outlines(p, shape, "g", 0, polygon=True, strict=True).collect()] == ["in"]


def test_outlines_with_a_common_corner_tie(spark):
    """The distance to an edge's end is the distance to that vertex, from whichever edge it is taken."""
    far = [(0.1 + 0.2, 0.7), (1 / 3, 0.9), (0.123456789, 0.77)]
    rows = [("c", f"g{i}", f"LINESTRING ({x!r} {y!r}, 0.1 0.1)", 0.0, 100_000.0) for i, (x, y) in enumerate(far)]
    shapes = spark.createDataFrame(rows, "city_id string, g string, wkt string, center_lon double, metres_x double")
    end = outlines.edges_of(shapes, "g").select("bx", "by").first()
    p = spark.createDataFrame([("c", "a", end.bx - 3.3, end.by - 4.7)], "city_id string, id string, x double, y double")
    assert len({r.d for r in outlines.near_outlines(p, shapes, "g", 50.0, polygon=False).collect()}) == 1


def test_static_subset_beyond_the_budget(spark):
    pages = spark.createDataFrame([("c", f"s{i}", "indexable" if i < 3 else "draft", 50.0, float(i)) for i in range(6)], "city_id string, slug string, status string, confidence double, balanced_score double")
    links = spark.createDataFrame([("s0", "s4"), ("s1", "s5")], "slug string, to string")
    got = {r.slug: r.layer for r in ranking.static_subset(pages, links, 2, overrun=True).collect()}
    assert got == {"s0": "required", "s1": "required", "s2": "required", "s4": "linked", "s5": "linked"}


def test_coincident_points_without_names(spark):
    class Two:
        hotels = spark.createDataFrame([("c", 1.0, 2.0, None), ("c", 1.0, 2.0, None), ("c", 3.0, 4.0, "b"), ("c", 3.0, 4.0, "a")], "city_id string, lat double, lon double, name string")

    assert sorted(((r.n, r.names) for r in quality_queries.coincident_clusters(Two).collect()), key=str) == [(2, "a|b"), (2, None)]


def test_gamma_counts_rows_that_are_alike(spark):
    d = spark.createDataFrame([("g", float(i % 3), float(i % 2)) for i in range(60)], "g string, x double, y double")
    r = statistics.gamma(d, "x", "y", ["g"]).first()
    want = [0, 0]
    rows = [(i % 3, i % 2) for i in range(60)]
    for i in range(60):
        for j in range(i):
            s = (rows[i][0] - rows[j][0]) * (rows[i][1] - rows[j][1])
            want[0] += s > 0
            want[1] += s < 0
    assert [r.concordant, r.discordant] == want


def test_points_on_an_edge_are_at_no_distance(spark):
    shape = spark.createDataFrame([("c", "g", SQUARE.replace("0.0 ", "0.0003 "), 0.0, 69_123.4)], "city_id string, g string, wkt string, center_lon double, metres_x double")
    right, top = outlines.edges_of(shape, "g").agg(F.max("bx"), F.max("by")).first()
    p = spark.createDataFrame([("c", f"r{i}", right, top * i / 97) for i in range(98)] + [("c", f"t{i}", 21.0 + (right - 21.0) * i / 97, top) for i in range(98)], "city_id string, id string, x double, y double")
    assert [r.d for r in outlines.near_outlines(p, shape, "g", 50.0, polygon=True).collect()] == [0.0] * 196


def test_pairs_are_made_after_the_last_exchange(spark, monkeypatch):
    """A meeting has a row for each two blocks of ids; crowds are several blocks, and every pair is there once."""
    monkeypatch.setattr(spatial, "BLOCK", 4)
    h, p = hotels(spark), pois(spark)
    blocks = spatial.shared(h, spatial.POINT, "id", "ids").collect()
    assert sorted(i for b in blocks for i in b.ids) == [f"h{i:02}" for i in range(30)] and len(blocks) > 3
    got = dimensions.pairs(h, p)
    assert got.count() == 600 and got.distinct().count() == 600
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(__poi_ids") < plan.index("Exchange")  # the root of a plan is printed first


def test_pairs_with_outlines_keep_crowds_whole(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 2)
    shapes = spark.createDataFrame([("c", f"g{i}", SQUARE, 0.0, 100_000.0) for i in range(5)], "city_id string, g string, wkt string, center_lon double, metres_x double")
    got = outlines.outline_pairs(hotels(spark), shapes, "g", 50.0, polygon=True, digits=4)
    assert got.count() == 150 and got.distinct().count() == 150
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.index("explode(__keys") < plan.index("Exchange")


def test_places_that_match_alike_meet_once(spark, monkeypatch):
    """Rows with one place, name and brand are compared once; each gets the best match, ties by id, and names that no rule holds for meet nothing."""
    met = []

    def recorded(left, right, radius):
        met.append((left.count(), right.count()))
        return near_points(left, right, radius)

    monkeypatch.setattr(matching, "near_points", recorded)
    left = [("c", f"l{i:02}", "grand hotel", None if i % 2 else "Ibis", 0.0, 0.0) for i in range(20)] + [("c", "n", None, "Ibis", 0.0, 0.0), ("c", "e", "", "Ibis", 0.0, 0.0), ("c", "far", "grand hotel", None, 5000.0, 0.0)]
    right = [("c", f"r{i:02}", "grand hotal", "Ibis", 300.0, 0.0) for i in range(20)] + [("c", "r99", "grand hotel", None, 200.0, 0.0), ("c", "a", "", "Ibis", 0.0, 0.0), ("c", "b", "bank", None, 0.0, 0.0)]
    got = {r.id: (r.other, r.rule, r.confidence) for r in matching.match(spark.createDataFrame(left, "city_id string, id string, form string, brand string, x double, y double"), spark.createDataFrame(right, "city_id string, other string, other_form string, other_brand string, x double, y double")).collect()}
    assert met == [(3, 3)] and len(got) == 23
    assert all(got[f"l{i:02}"] == ("r99", "near", 85) for i in range(20))
    assert got["n"] == got["e"] == got["far"] == (None, "fallback", 0)
    few = spark.createDataFrame(right[:20], "city_id string, other string, other_form string, other_brand string, x double, y double")
    got = {r.id: (r.other, r.rule) for r in matching.match(spark.createDataFrame(left, "city_id string, id string, form string, brand string, x double, y double"), few).collect()}
    assert got["l00"] == got["l18"] == ("r00", "brand") and got["l01"] == (None, "fallback")


def test_top_lists_sort_only_what_can_be_among_them(spark):
    rows = [("c", f"h{i:04}", float(i % 500)) for i in range(2000)] + [("few", "a", 1.0), ("few", "b", None)]
    d = spark.createDataFrame(rows, "city_id string, id string, v double")
    got = export.leaders(d, F.col("v"), 3, ["city_id"])
    kept = {(r.city_id, r.id) for r in got.collect()}
    assert {("c", f"h{i:04}") for i in (499, 999, 1499)} <= kept and len(kept) < 100
    assert {("few", "a"), ("few", "b")} <= kept


def test_records_at_one_point_are_linked_once(spark):
    """Links grow with the records at a point, not with their pairs; clusters are those of all pairs."""
    rows = [("c", f"h{i:03}", ["inn", "bar"][i % 7 == 0], ["hotel", None][i % 10 == 9], 51.5 + i % 4 * 0.0001, [0.0, -0.0][i % 3 == 0]) for i in range(120)]
    rows += [("c", "lone", "inn", "hotel", 51.6, 0.0), ("c", "blank", "", "hotel", 51.5, 0.0), ("c", "null", None, "hotel", 51.5, 0.0), ("x", "other", "inn", "hotel", 51.5, 0.0)]
    rows += [("c", f"{name}{i}", "inn", "hotel", lat, 0.0) for name, lat in (("none", None), ("nan", float("nan"))) for i in range(3)]
    h = spark.createDataFrame(rows, "city_id string, id string, form string, leaf string, lat double, lon double")
    pairs, links = dedupe.candidate_pairs(h), dedupe.links(h)
    assert pairs.count() > 3000 and links.count() < 150
    found = lambda p: sorted((r.id, r.cluster) for r in dedupe.clusters(h, p).collect())
    assert found(links) == found(pairs) and len({c for _, c in found(links)}) == 2 + 12 + 4 + 6


def test_sizes_of_cities_need_no_task_for_each(spark):
    """Confidence counts a city's hotels, however many, without a window over them."""
    h = hotels(spark).withColumn("confidence", F.lit(0.5)).union(spark.createDataFrame([("small", "s", 0.0, 0.0, 0.5)], "city_id string, id string, x double, y double, confidence double"))
    green = spark.createDataFrame([], "city_id string, green_id string, subtype string, class string, wkt string, center_lon double, metres_x double")
    segments = spark.createDataFrame([], "city_id string, subtype string, class string, wkt string, center_lon double, metres_x double")
    scores = dimensions.hotel_scores(h, pois(spark), green, segments)
    plan = scores._jdf.queryExecution().optimizedPlan().toString()
    assert "count(1) windowspecdefinition" not in plan
    got = {r.hotel_id: r.confidence for r in scores.collect()}
    by_size = lambda n, covered: scoring.confidence(F.lit(0.5), F.lit(covered), F.lit(n), F.lit(100.0))
    want = spark.range(1).select(by_size(31, 0).alias("c"), by_size(1, 0).alias("small")).first()
    assert len(got) == 32 and got["none"] == pytest.approx(want.c) and got["s"] == pytest.approx(want.small) and want.c > want.small
