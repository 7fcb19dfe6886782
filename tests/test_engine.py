"""Geometry, joins, statistics, names, selections, storage, streams and the commands, on small tables of our own."""

from __future__ import annotations

import hashlib
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from environs import cli, config
from environs import constants as C
from environs.functions import geo, scoring, text
from environs.operators import dedupe, dimensions, publication, quality, ranking, statistics
from environs.operators.graph import components
from environs.operators.spatial import near_points
from environs.pipeline import Engine
from environs.sources import readers, sinks, versions
from environs.sources.atlas import Atlas
from environs.streaming import events

FOLDER = "/root/testdata/sf0.001"


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


# geometry ---------------------------------------------------------------------------------------------------------

HOLED = "POLYGON ((0 0, 10 0, 10 10, 0 10, 0 0), (4 4, 6 4, 6 6, 4 6, 4 4))"
TWO = "MULTIPOLYGON (((0 0, 1 0, 1 1, 0 1, 0 0)), ((5 5, 8 5, 8 8, 5 8, 5 5)))"


@pytest.mark.parametrize(("wkt", "x", "y", "want"), [(HOLED, 1, 1, 0.0), (HOLED, 5, 5, 1.0), (HOLED, 13, 14, 5.0), (HOLED, -2, 5, 2.0), (TWO, 0.5, 0.5, 0.0), (TWO, 3, 0.5, 2.0), (TWO, 6, 6, 0.0), ("POLYGON ((0 0, 4 0, 0 4, 0 0))", 4, 4, math.sqrt(8))])
def test_polygon_distance(spark, wkt, x, y, want):
    e = geo.edges(geo.rings(F.lit(wkt)))
    assert value(spark, geo.polygon_distance(F.lit(float(x)), F.lit(float(y)), e)) == pytest.approx(want)


@pytest.mark.parametrize(("x", "y", "want"), [(0, 1, 1.0), (-3, 4, 5.0), (5, -2, 2.0), (12, 0, 2.0), (10, 5, 0.0)])
def test_line_distance(spark, x, y, want):
    e = geo.edges(geo.rings(F.lit("LINESTRING (0 0, 10 0, 10 1e1)")))
    assert value(spark, geo.line_distance(F.lit(float(x)), F.lit(float(y)), e)) == pytest.approx(want)


def test_area_and_parts(spark):
    assert value(spark, geo.area(geo.rings(F.lit(HOLED)))) == pytest.approx(96)
    assert value(spark, F.transform(geo.polygons(F.lit(TWO)), lambda p: geo.area(geo.rings(p)))) == [1.0, 9.0]
    assert value(spark, geo.plausible(F.lit(HOLED))) and not value(spark, geo.plausible(F.lit("POLYGON ((0 0, 1 0, 1 1))"))) and not value(spark, geo.plausible(F.lit("LINESTRING (0 0, 1 1)")))
    e = value(spark, geo.envelope(geo.rings(F.lit(TWO))))
    assert (e.xmin, e.ymin, e.xmax, e.ymax) == (0, 0, 8, 8)


def test_haversine(spark):
    assert value(spark, geo.haversine_m(F.lit(51.5), F.lit(-0.1), F.lit(51.5), F.lit(-0.1))) == 0
    assert value(spark, geo.haversine_m(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(180.0))) == pytest.approx(math.pi * C.EARTH_RADIUS_M)


def test_grid_join_is_the_band_join(spark):
    rng = random.Random(1)
    pts = [(i, "a" if i % 3 else "b", rng.uniform(-900, 900), rng.uniform(-900, 900)) for i in range(200)] + [(900, "a", 100.0, 0.0), (901, "a", 0.0, 0.0), (902, None, 0.0, 0.0), (903, "a", None, 0.0)]
    df = spark.createDataFrame(pts, "i long, city_id string, x double, y double")
    got = near_points(df, df.withColumnRenamed("i", "j"), 100.0)
    want = {(i, j) for i, c, x, y in pts for j, d, u, v in pts if c == d and c and None not in (x, u) and math.hypot(x - u, y - v) <= 100}
    rows = [(r.i, r.j) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want) and (900, 901) in want


def test_no_nested_loop(spark):
    a = Atlas(spark, FOLDER)
    plan = dimensions.hotel_scores(a.hotels, a.pois, a.green, a.segments)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan
    scan = a.hotels.select("id", "x")._jdf.queryExecution().executedPlan().toString()
    assert "c_acctbal" not in scan.split("ReadSchema", 1)[1].split("\n")[0]


def test_scores_of_simple_places(spark):
    """No point: 0. One stop, one restaurant, a hotel inside a park, and a park too far away."""
    c = config.builtin()["london"]
    place = lambda dlon, dlat: ((dlon) * c.metres_x, (51.5 + dlat) * config.METRES_Y)
    hotels = spark.createDataFrame([("london", "far", 0.9, *place(0.2, 0.1)), ("london", "near", 0.9, *place(0, 0))], "city_id string, id string, confidence double, x double, y double")
    pois = spark.createDataFrame([("london", f"p{i}", "n", leaf, [fam, leaf], *place(0.0001, 0.0001)) for i, (leaf, fam) in enumerate([("metro_station", "travel"), ("restaurant", "food_and_drink")])], "city_id string, poi_id string, name string, leaf string, hierarchy array<string>, x double, y double")
    lon = c.lon
    ring = lambda s: f"POLYGON (({lon - s} {51.5 - s}, {lon + s} {51.5 - s}, {lon + s} {51.5 + s}, {lon - s} {51.5 + s}, {lon - s} {51.5 - s}))"
    green = spark.createDataFrame([("london", lon, c.metres_x, "g", "park", "park", ring(0.001))], "city_id string, center_lon double, metres_x double, green_id string, subtype string, class string, wkt string")
    segments = spark.createDataFrame([], "city_id string, center_lon double, metres_x double, segment_id string, subtype string, class string, wkt string")
    got = {r.id: r for r in dimensions.dimension_scores(hotels, pois, green, segments).collect()}
    near, far = got["near"], got["far"]
    assert near.transit_access > 90 and near.food_essentials > 0 and near.walkability_density > 0 and near.nightlife_access == 0 and near.covered == 4
    assert all(far[d] == 0 for d in C.DIMENSIONS if d != "quietness_proxy") and far.quietness_proxy == 100 and far.covered == 0
    hit = dimensions.green_hits(hotels, green).collect()
    assert [(r.id, r.d) for r in hit] == [("near", 0.0)]


def test_predicates_need_configuration():
    with pytest.raises(ValueError):
        scoring.of_kind("nothing", F.lit("a"), F.array())
    config.check_weights()


# statistics -------------------------------------------------------------------------------------------------------


def pairs_frame(spark, x, y):
    return spark.createDataFrame([("g", float(a), float(b)) for a, b in zip(x, y)], "g string, x double, y double")


def test_spearman_and_ranks(spark):
    r = statistics.spearman(pairs_frame(spark, [1, 2, 3, 4, 5], [5, 6, 7, 8, 7]), "x", "y", ["g"]).first()
    assert r.rho == pytest.approx(0.8207826816681233, abs=1e-12)
    assert math.isnan(statistics.spearman(pairs_frame(spark, [1, 1, 1], [1, 2, 3]), "x", "y", ["g"]).first().rho)
    ranks = pairs_frame(spark, [5, 5, 1], [0, 0, 0]).select("x", ranking.fractional_rank("x", "g").alias("r")).collect()
    assert sorted((r.x, r.r) for r in ranks) == [(1, 1), (5, 2.5), (5, 2.5)]


@pytest.mark.parametrize("seed", range(4))
def test_gamma(spark, seed):
    rng = random.Random(seed)
    x, y = [rng.randrange(6) for _ in range(70)], [rng.randrange(9) for _ in range(70)]
    c = sum((x[i] - x[j]) * (y[i] - y[j]) > 0 for i in range(70) for j in range(i))
    d = sum((x[i] - x[j]) * (y[i] - y[j]) < 0 for i in range(70) for j in range(i))
    r = statistics.gamma(pairs_frame(spark, x, y), "x", "y", ["g"]).first()
    assert (r.concordant, r.discordant) == (c, d) and r.gamma == pytest.approx((c - d) / (c + d))


def test_gamma_with_ties(spark):
    assert statistics.gamma(pairs_frame(spark, [1, 1, 2], [5, 6, 7]), "x", "y", ["g"]).first().gamma == 1.0


def test_perturbed_weights():
    for _, _, w in statistics.perturbed_weights(C.PERSONAS["quiet_sleep"], (0.5, 1.5, 3.0)):
        assert sum(w.values()) == pytest.approx(1)


# names ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("name", "want"), [("Hôtel  Le  Méridien", "hotel le meridien"), ("O’Brien's", "obriens"), ("ＡＢＣ—Inn", "abc inn"), ("โรงแรม", "โรงแรม"), ("桜・ホテル", "桜 ホテル"), ("a_b.c", "a b c"), ("", ""), (None, None)]
)
def test_rule_form(name, want):
    assert text.plain(name) == want


@pytest.mark.parametrize(("name", "want"), [("Отель", "Otel"), ("ホテル", "hoteru"), ("さくら", "sakura"), ("서울", "seoul"), ("Ξενία", "Xenia"), ("桜", None), ("Café 1", "Cafe 1"), (None, None), ("きょうと", "kyouto"), ("とうきょう", "toukyou"), ("しゃしん", "shashin"), ("チョコレート", "chokoreeto"), ("サッポロ", "sapporo"), ("マッチャ", "matcha"), ("ロッジ", "rojji"), ("ビール", "biiru"), ("ジョージ", "jooji"), ("パーティー", "paatii"), ("ヴィラ", "vira"), ("フォレスト", "foresuto"), ("りょかん", "ryokan"), ("しんじゅく", "shinjuku"), ("ー", ""), ("っ", ""), ("Μπαρ", "Bar"), ("Ολυμπος", "Olympos"), ("Ντίνος", "Dinos"), ("Λουτρό", "Loutro"), ("Ευαγγελία", "Evangelia"), ("Αυγή", "Avgi"), ("ホテル 東京", None), ("Гостиница Щука", "Gostinitsa Shchuka"), ("부산", "busan")])
def test_romanised(name, want):
    assert text.romanised(name) == want


def classified(spark, rows):
    df = spark.createDataFrame(rows, "name string, brand string, leaf string")
    return [r.t for r in df.select(text.accommodation(F.col("name"), F.col("brand"), F.col("leaf"))["accommodation_type"].alias("t")).collect()]


def test_accommodation(spark):
    rows = [
        ("OYO 9 Home", None, "hotel"), ("Bright Stay", "Blueground", "hotel"), ("Ostello Bello", None, "hotel"), ("Apart-Hotel X", None, "hotel"), ("X Serviced Apartments", None, "hotel"), ("Chambres d hôtes", None, "hotel"),
        ("Appartement Rue", None, "hotel"), ("Sonder at X", None, "hotel"), ("Grand", None, "hotel"), ("Beach Hotel", None, "resort"), ("Beach", None, "resort"), (None, None, None), ("My 2br flat apartment", None, "hotel"),
    ]
    assert classified(spark, rows) == ["whole-home", "whole-home", "hostel", "aparthotel", "serviced-apartment", "guesthouse-B&B", "whole-home", "unknown", "hotel", "hotel", "unknown", "unknown", "whole-home"]


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("St Mary School", True), ("Ecole Hotel", True), ("東京大学", True), ("Marriott Consulting", False), ("Acme Consulting", True), ("Wink @ Mosque Street", False), ("City Mosque", True), ("RevenuebyDesign", True), ("Templeton", False),
        ("Hornchurch Stay", False), ("Bank Hotel", False), ("First Bank", True), ("Selina Soho", True), ("Villa Selina", False), ("Université", True), ("University Inn", False), (None, False), ("Souq Waqif", True), ("Maison Souquet", False),
    ],
)
def test_non_hotel(spark, name, want):
    df = spark.createDataFrame([(name, "id1")], "name string, id string")
    assert df.select(text.non_hotel(F.col("name"), F.col("id")).alias("v")).first().v is want


def test_quarantine_and_evidence(spark):
    df = spark.createDataFrame([("Nice Hotel", "h00000042"), ("Embassy School", "x")], "name string, id string")
    got = [r.e for r in df.select(text.institution_evidence(text.rule_form(F.col("name")), F.col("id")).alias("e")).collect()]
    assert got[0][0].reason == "quarantined" and [(e.reason, e.term) for e in got[1]] == [("school", "school"), ("government", "embassy")]


def test_source_latin(spark):
    names = {"common": {"fr": "Auberge", "en": "Inn", "ja": "宿"}, "rules": [{"variant": "official", "language": "en", "value": "A Inn"}, {"variant": "short", "language": "en", "value": "AA"}, {"variant": "common", "language": "en", "value": "A0 Inn", "between": "x"}]}
    df = spark.createDataFrame([(json.dumps(names),), ("{}",), (None,), ('{"common":{"ja":"宿"}}',)], "j string")
    assert [r.v for r in df.select(text.source_latin(F.col("j")).alias("v")).collect()] == ["A Inn", None, None, None]
    shown = df.select(text.present_name(F.lit("宿"), F.col("j")).alias("p")).collect()
    assert shown[0].p.display_name == "A Inn (宿)" and shown[0].p.name_method == "source_alternative_latin" and not shown[1].p.name_index_eligible


# duplicates, selections, decisions --------------------------------------------------------------------------------


def test_dedupe(spark):
    rows = [("c", "a", "Inn", "hotel", 51.5, -0.1, 0.5, 1), ("c", "b", "Inn", "hotel", 51.50005, -0.1, 0.9, 1), ("c", "d", "Inn", "hotel", 51.5001, -0.1, None, 3), ("c", "e", "Inn", "hostel", 51.5, -0.1, 0.9, 1), ("c", "f", "Other", "hotel", 51.5, -0.1, 0.9, 1), ("c", "g", "Inn", "hotel", 51.6, -0.1, 0.9, 1), ("x", "h", "Inn", "hotel", 51.5, -0.1, 0.9, 1)]
    h = spark.createDataFrame(rows, "city_id string, id string, form string, leaf string, lat double, lon double, confidence double, n_sources long")
    got = {r.id: r for r in dedupe.canonical(dedupe.clusters(h, dedupe.candidate_pairs(h))).collect()}
    assert set(got) == {"b", "e", "f", "g", "h"}
    assert got["b"].merged_from == ["a", "d"] and got["b"].dedupe_confidence == 70 and got["g"].dedupe_confidence == 100


def test_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        p, q = sorted((find(a), find(b)))
        up[q] = p
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_peers(spark):
    rows = [("c", f"h{i}", float(s)) for i, s in enumerate([1, 2, 2, 5, 9, 10])]
    got = ranking.peers(spark.createDataFrame(rows, "city_id string, id string, score double"), 4).orderBy("id", "place").collect()
    by = {}
    for r in got:
        by.setdefault(r.id, []).append(r.peer)
    order = [r[1] for r in sorted(rows, key=lambda r: (r[2], r[1]))]
    for pos, h in enumerate(order):
        want, lo, hi = [], pos - 1, pos + 1
        while len(want) < 4 and (lo >= 0 or hi < len(order)):
            if lo >= 0:
                want.append(order[lo])
                lo -= 1
            if len(want) < 4 and hi < len(order):
                want.append(order[hi])
                hi += 1
        assert sorted(by[h]) == sorted(want)


def test_static_subset(spark):
    pages = spark.createDataFrame([("a", f"a{i}", "indexable" if i < 2 else "draft", float(i), float(i % 5)) for i in range(10)] + [("b", f"b{i}", "draft", 1.0, 2.0) for i in range(10)], "city_id string, slug string, status string, confidence double, balanced_score double")
    links = spark.createDataFrame([("a0", "b7"), ("a1", "a9"), ("a5", "b1"), ("a0", "gone")], "slug string, to string")
    got = {r.slug: r.layer for r in ranking.static_subset(pages, links, 8).collect()}
    assert {s for s, v in got.items() if v == "required"} == {"a0", "a1"} and {s for s, v in got.items() if v == "linked"} == {"b7", "a9"} and len(got) == 8
    few = {r.slug: r.layer for r in ranking.static_subset(pages, links, 3).collect()}
    assert "linked" not in few.values() and {"a0", "a1"} <= set(few)
    with pytest.raises(ranking.BudgetError):
        ranking.static_subset(pages, links, 1)


def test_cohort_invariants(spark):
    rng = random.Random(3)
    rows = [(f"c{rng.randrange(9)}", f"h{i}", rng.random() < 0.4, round(rng.uniform(0, 50), 1)) for i in range(400)]
    got = ranking.cohort(spark.createDataFrame(rows, "city_id string, id string, chain boolean, distinctiveness double")).collect()
    n = {}
    for r in got:
        n[r.city_id] = n.get(r.city_id, 0) + 1
    assert len(got) == 200 and max(n.values()) <= C.CITY_MAX and len({r.id for r in got}) == 200


def test_hard_checks(spark):
    hotels = spark.createDataFrame([("a", 95.0, 0.0), ("b", 1.0, None)], "id string, lat double, lon double")
    dims = ", ".join(f"{d} double" for d in C.DIMENSIONS)
    good, bad = [50.0] * 6, [50.0] * 5 + [101.0]
    scores = spark.createDataFrame([("a", *good, 1.0, 1.0, "v", "r"), ("a", *bad, 1.0, 1.0, None, "r")], f"hotel_id string, {dims}, confidence double, balanced_score double, score_version string, source_release string")
    checks = quality.hard_checks(hotels, scores)
    assert {r.check: r.failures for r in checks.collect()} == {"coordinates": 2, "duplicate_ids": 1, "out_of_range": 1, "no_version": 1}
    with pytest.raises(quality.ValidationError):
        quality.require(checks)


def test_upsert(spark):
    old = spark.createDataFrame([("a", 1, "x"), ("b", 5, "x")], "k string, at long, v string")
    new = spark.createDataFrame([("a", 1, "y"), ("b", 4, "y"), ("c", 0, "y")], "k string, at long, v string")
    assert sorted(map(tuple, publication.upsert(old, new, ["k"], "at").collect())) == [("a", 1, "y"), ("b", 5, "x"), ("c", 0, "y")]


# sources, sinks, commands, streams --------------------------------------------------------------------------------


def test_releases(spark):
    paths = [("release/2026-08-19.0/",), ("release/2026-08-19.10/",), ("release/2026-08-19.9/",), ("release/2025-12-01.3/",), ("other/",)]
    assert readers.latest_release(spark.createDataFrame(paths, "path string")) == "2026-08-19.10"
    with pytest.raises(readers.SchemaError):
        readers.latest_release(spark.createDataFrame([("x",)], "path string"))
    assert readers.local_release(["2026-08-19.0", "2026-08-19.9", "2026-08-19.10"]) == "2026-08-19.9" and readers.local_release([], "r") == "r"


def test_listing_and_manifest(spark, tmp_path):
    (tmp_path / "l.xml").write_text("<L><Prefix>release/2026-01-01.0/</Prefix>\n<Prefix>release/2026-02-01.0/</Prefix></L>")
    assert readers.latest_release(readers.bucket_listing(spark, str(tmp_path / "l.xml"))) == "2026-02-01.0"
    for n in ("p1", "p2"):
        spark.createDataFrame([(n,)], "v string").write.parquet(str(tmp_path / n))
    manifest = spark.createDataFrame([(str(tmp_path / "p1"), -1.0, 51.0, 1.0, 52.0), (str(tmp_path / "p2"), 10.0, 10.0, 11.0, 11.0)], "path string, minx double, miny double, maxx double, maxy double")
    assert [r.v for r in readers.read_listed(spark, manifest, config.builtin()["london"]).collect()] == ["p1"]
    everywhere = manifest.select("path", F.lit(-180.0).alias("minx"), F.lit(-90.0).alias("miny"), F.lit(180.0).alias("maxx"), F.lit(90.0).alias("maxy"))
    assert sorted(r.v for r in readers.read_listed(spark, everywhere, config.builtin()["london"], limit=1).collect()) == ["p1", "p2"]
    with pytest.raises(readers.SchemaError):
        readers.read_listed(spark, manifest, config.builtin()["tokyo"])
    with pytest.raises(readers.SchemaError):
        readers.require_columns(manifest, ["path", "nothing"], "manifest")


def test_digests_and_counts_on_the_way(spark, tmp_path):
    """Digests are of the bytes; a write counts its own rows; sizes are those of the files."""
    df = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "city_id string, v long")
    assert sinks.write_parquet(df, str(tmp_path / "t"), total=F.sum("v")) == {"rows": 3, "total": 6}
    assert sinks.write_parquet(df.limit(0), str(tmp_path / "e"), None) == {"rows": 0}
    files = {p: p.read_bytes() for p in (tmp_path / "t").rglob("*.parquet")}
    got = {r.path.removeprefix("file:"): (r.bytes, r.sha256) for r in readers.digests(spark, str(tmp_path / "t")).collect()}
    assert {p: got[str(p)] for p in files} == {p: (len(b), hashlib.sha256(b).hexdigest()) for p, b in files.items()}
    assert all(r.sha256 is None for r in readers.digests(spark, str(tmp_path / "t"), most=10).where("bytes > 10").collect())
    sizes = {r.city_id: (r.files, r.bytes) for r in sinks.file_sizes(spark.read.parquet(str(tmp_path / "t"))).collect()}
    assert sizes == {c: (len(own), sum(own)) for c in "ab" for own in [[len(b) for p, b in files.items() if f"city_id={c}" in str(p)]]}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "s-1f", 1), ("b", "s-2f", 2), ("b", "s-30", 3)], "city_id string, slug string, v long")
    sinks.write_parquet(df, str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).where("city_id = 'b'").count() == 2
    sinks.write_shards(df, str(tmp_path / "s"))
    assert (tmp_path / "s" / "city_id=b" / "bucket=f").is_dir() and spark.read.json(str(tmp_path / "s")).count() == 3
    for n in (1, 2, 3):
        sinks.replace(df.limit(n), str(tmp_path / "r"))
    replaced = versions.Table(spark, str(tmp_path / "r"))
    assert replaced.read().count() == 3 and replaced.read(1).count() == 1 and replaced.versions() == [1, 2, 3]
    sinks.append_log(df, str(tmp_path / "log"))
    sinks.append_log(df, str(tmp_path / "log"))
    assert readers.read_csv(spark, str(tmp_path / "log"), "city_id string, slug string, v long").count() == 6
    sinks.write_manifest(spark, {"n": 1}, str(tmp_path / "m.json"))
    assert readers.read_json(spark, str(tmp_path / "m.json"), "n long").first().n == 1
    (tmp_path / "p.csv").write_text("timestamp_utc,url,status,cf_ray,error\n2026-01-01T00:00:00Z,u,200,,\n2026-01-01T00:00:30Z,u,,,timeout\n")
    assert [r.up for r in readers.read_probes(spark, str(tmp_path / "p.csv")).orderBy("ts").collect()] == [True, False]


@pytest.mark.parametrize("form", ["json", "yml"])
def test_config_file(tmp_path, form):
    city = {"id": "x", "name": "X", "country": "XX", "center": {"lat": 1, "lon": 2}, "bbox": {"minx": 1, "miny": 0, "maxx": 3, "maxy": 2}}
    path = tmp_path / f"c.{form}"
    path.write_text(json.dumps({"cities": [city]}))  # JSON is YAML
    assert config.load(str(path))["x"].lat == 1.0
    for wrong in ({"cities": [city | {"center": {"lat": 9, "lon": 2}}]}, {"cities": [city, city]}, {"cities": [{"id": "x"}]}, {}):
        path.write_text(json.dumps(wrong))
        with pytest.raises(config.ConfigError):
            config.load(str(path))


def small_source(spark, root):
    c = config.builtin()["london"]
    place = "id string, names struct<primary:string,common:map<string,string>,rules:array<struct<variant:string,language:string,value:string>>>, confidence double, taxonomy struct<primary:string,hierarchy:array<string>>, brand struct<names:struct<primary:string>>, addresses array<struct<freeform:string,locality:string,postcode:string,region:string,country:string>>, sources array<string>, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>"
    at = lambda dx, dy: (c.lon + dx, c.lon + dx, c.lat + dy, c.lat + dy)
    hotel = lambda i, n, dx, dy, conf=0.9, country="GB": (i, (n, {"en": n}, []), conf, ("hotel", ["lodging", "hotel"]), ((None,),), [("1 St", "London", "N1", None, country)] if country else [], ["s"], at(dx, dy))
    poi = lambda i, leaf, fam, dx, dy: (i, (i, None, None), 0.8, (leaf, [fam, leaf]), None, [], ["s"], at(dx, dy))
    rows = [hotel("h0000001", "Grand Hotel", 0, 0), hotel("h0000002", "Grand Hotel", 0.0001, 0, 0.5), hotel("h0000003", "City School", 0, 0.001), hotel("h0000004", "12345", 0.01, 0.01, 0.7, "FR"), hotel("h0000005", "Far Away Hotel", 60, 0), hotel("h0000006", "Harbour Inn", 0.02, 0, 0.6, None)]
    rows += [poi("p1", "restaurant", "food_and_drink", 0.0005, 0), poi("p2", "metro_station", "travel", 0, 0.0005), poi("p3", "campground", "lodging", 0, 0), poi("p4", "bar", "food_and_drink", 0, 0.0002)]
    spark.createDataFrame(rows, place).write.parquet(f"{root}/source/place")
    shape = "id string, subtype string, class string, names struct<primary:string>, geometry string, bbox struct<xmin:double,xmax:double,ymin:double,ymax:double>"
    box = f"POLYGON (({c.lon - 0.001} {c.lat - 0.001}, {c.lon + 0.001} {c.lat - 0.001}, {c.lon + 0.001} {c.lat + 0.001}, {c.lon - 0.001} {c.lat + 0.001}, {c.lon - 0.001} {c.lat - 0.001}))"
    spark.createDataFrame([("g1", "park", "park", None, box, at(0, 0)), ("g2", "horticulture", "garden", None, box, at(0, 0))], shape).write.parquet(f"{root}/source/land_use")
    spark.createDataFrame([("l1", "sand", "beach", None, box, at(0, 0)), ("l2", "sand", "sand", None, box, at(0, 0))], shape).write.parquet(f"{root}/source/land")
    line = f"LINESTRING ({c.lon - 0.01} {c.lat + 0.0005}, {c.lon + 0.01} {c.lat + 0.0005})"
    spark.createDataFrame([("s1", "road", "primary", None, line, at(0, 0)), ("s2", "road", "service", None, line, at(0, 0))], shape).write.parquet(f"{root}/source/segment")


def test_commands(spark, tmp_path, capsys):
    root = str(tmp_path)
    small_source(spark, root)
    cli.main(["all", "--root", root, "--city", "london,paris", "--release", "2026-08-19.0"], spark)
    e = Engine.open(spark, root, "2026-08-19.0", "london")
    hotels = {r.id: r for r in e.table("hotels").collect()}
    assert set(hotels) == {"h0000001", "h0000004", "h0000006"} and hotels["h0000001"].merged_from == ["h0000002"] and hotels["h0000001"].dedupe_confidence == 70
    assert {r.poi_id for r in e.table("pois").collect()} == {"p1", "p2", "p4"} and {r.green_id for r in e.table("green").collect()} == {"g1", "l1"} and e.table("segments").count() == 1
    scores = {r.hotel_id: r for r in e.table("hotel_scores").collect()}
    assert scores["h0000001"].food_essentials > 0 and scores["h0000001"].quietness_proxy < 100 and scores["h0000006"].food_essentials == 0
    assert e.table("nearby_facts").where("hotel_id = 'h0000001'").count() == 3
    out = {r.id: r for r in spark.read.json(f"{root}/etl/2026-08-19.0/search").collect()}
    assert out["h0000004"].slug == "hotel-12345-h0000004"[:12] + out["h0000004"].slug[12:] and out["h0000004"].locality_mismatch.startswith("Address country (FR)")
    assert out["h0000001"].verdict and len(out["h0000001"].comparable) == 2
    assert "| london | 3 |" in e.report()
    assert e.webdata(spark.createDataFrame([("h0000001",), ("h0000004",)], "id string")) == 3
    status = {r.id: r.publication_status for r in spark.read.json(f"{root}/etl/2026-08-19.0/search").collect()}
    assert status == {"h0000001": "indexable", "h0000004": "noindex", "h0000006": "noindex"}
    with pytest.raises(ValueError):
        Engine.open(spark, root, "r", "atlantis")
    assert "score" in capsys.readouterr().out


def test_export_and_diff(spark, tmp_path):
    """Pages of recorded decisions, linked peers, city pages, and a report of what changed."""
    root, release = str(tmp_path), "2026-08-19.0"
    small_source(spark, root)
    cli.main(["all", "--root", root, "--city", "london,paris", "--release", release], spark)
    e = Engine.open(spark, root, release, "london")
    name = e.table("hotels").where("id = 'h0000001'").first().name
    e.store().set_status("hotel", "h0000001", "indexable", "reviewed", "owner", name=name, accommodation_type="hotel", readable=True)
    e.store().set_status("city", "london", "indexable", "reviewed", "owner")
    assert e.table("excluded").count() == len(json.loads((tmp_path / "etl" / release / "manifest.json").read_text())["excluded_names"]) > 0
    e.validate()
    e.report()
    assert e.webdata() == 3
    pages = {r.id: r for r in spark.read.json(f"{root}/etl/{release}/hotel_pages").collect()}
    assert pages["h0000001"].publication_status == "indexable" and {c.has_static_page for c in pages["h0000001"].comparable} == {True}
    city = spark.read.json(f"{root}/etl/{release}/city_pages").first()
    assert city.publication_status == "indexable" and city.n_hotels == 3 and len(city.representative_hotels) >= 1
    best = [t for t in city.top_by_dimension if t.dimension == "food_essentials"]
    assert [t.rank for t in best] == list(range(1, len(best) + 1)) and all(t.slug for t in best)
    old = e.table("hotel_scores").withColumn("balanced_score", F.col("balanced_score") + F.when(F.col("hotel_id") == "h0000001", 20).otherwise(0))
    old.write.partitionBy("city_id").parquet(f"{root}/etl/older/hotel_scores")
    cli.main(["diff", "--root", root, "--city", "london", "--release", release, "--against", "older"], spark)
    text_ = (tmp_path / "etl" / release / "diff.md").read_text()
    assert "| london | 3 | 1 | 1 |" in text_ and f"| london | {name} |" in text_
    with pytest.raises(SystemExit):
        cli.main(["diff", "--root", root], spark)


@pytest.mark.parametrize("plan", [events.tumbling, events.sliding, events.zero_results])
def test_stream_equals_batch(spark, tmp_path, plan):
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    got = events.run_once(events.read_events(spark, str(tmp_path / "in")), f"t_{plan.__name__}", plan)
    rounded = lambda df: sorted(tuple(round(v, 6) if isinstance(v, float) else str(v) for v in r) for r in df.collect())
    assert rounded(got) == rounded(plan(e))


def test_stream_sessions_and_once(spark, tmp_path):
    e = spark.read.parquet(f"{FOLDER}/events.parquet")
    e.write.parquet(str(tmp_path / "in"))
    e.limit(100).write.mode("append").parquet(str(tmp_path / "in"))
    got = events.run_once(events.read_events(spark, str(tmp_path / "in"), 100), "t_once", lambda s: events.first_seen(s).select("event_id"), "append")
    assert got.count() == e.count()


def test_stream_upsert(spark, tmp_path):
    rows = [(i % 7, i, f"v{i}") for i in range(40)]
    for k in range(4):
        spark.createDataFrame(rows[k * 10 : k * 10 + 10], "k long, at long, v string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k long, at long, v string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    events.upsert_stream(stream, str(tmp_path / "store"), ["k"], "at", str(tmp_path / "cp")).awaitTermination()
    got = versions.Table(spark, str(tmp_path / "store")).read().collect()
    assert {r.k: r.at for r in got} == {k: max(a for b, a, _ in rows if b == k) for k in range(7)}


def test_registered_for_sql(spark):
    text.register(spark)
    assert spark.sql("select ascii_fold('Hôtel') a, rule_form('Hôtel-X') b, romanise('Отель') c").first() == ("Hotel", "hotel x", "Otel")


# publication store, pages, labels ---------------------------------------------------------------------------------


def test_store(spark, tmp_path):
    """Decisions add up, the newest holds, and one that may not be recorded stops."""
    store = publication.Store(spark, f"file://{tmp_path}/store")
    assert store.get_status("hotel", "h1") is None and not store.is_indexable("hotel", "h1")
    store.set_status("hotel", "h1", "draft", "cohort", "owner")
    assert store.get_status("hotel", "h1")["status"] == "draft"
    store.set_status("hotel", "h1", "indexable", "reviewed", "owner", name="Grand Canal Hotel", accommodation_type="hotel", readable=True, score_version="1.2.1")
    store.set_status("city", "london", "indexable", "reviewed", "owner")
    assert store.is_indexable("hotel", "h1") and store.is_indexable("city", "london") and not store.is_indexable("hotel", "h2")
    for bad in (
        dict(page_type="room", page_id="x", status="draft", reason="r"), dict(page_type="hotel", page_id="x", status="gone", reason="r"), dict(page_type="hotel", page_id="x", status="draft", reason=" "),
        dict(page_type="hotel", page_id="x", status="indexable", reason="r", name="8468671", accommodation_type="hotel", readable=True),
        dict(page_type="hotel", page_id="x", status="indexable", reason="r", name="Hotel One", accommodation_type="hostel", readable=True),
        dict(page_type="hotel", page_id="x", status="indexable", reason="r", name="Hotel One", accommodation_type="hotel"),
        dict(page_type="hotel", page_id="x", status="draft", reason="r", name="Embassy of Aurora"),
    ):
        with pytest.raises(publication.DecisionError):
            store.set_status(decided_by="owner", **bad)
    store.compact()
    store.set_status("hotel", "h2", "noindex", "default", "owner")
    store.compact()
    assert {(r.page_type, r.page_id) for r in store.list_by_status("indexable").collect()} == {("hotel", "h1"), ("city", "london")}
    assert [r.page_id for r in store.list_by_status("indexable", "hotel").collect()] == ["h1"]
    assert store.get_status("hotel", "h1")["score_version"] == "1.2.1" and store.generation() == 2


def test_listed_names_stop_a_publication(spark):
    rows = spark.createDataFrame([("h1", "Grand Canal Hotel"), ("h2", None)], "id string, name string")
    quality.require_unlisted(rows)
    with pytest.raises(quality.ValidationError):
        quality.require_unlisted(rows.union(spark.createDataFrame([("h3", "Embassy of Aurora")], rows.schema)))


PAGE = '<html><head><title> One </title><link rel="canonical" href="/a">{}</head></html>'
LD = '<script type="application/ld+json">{}</script>'


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (PAGE.format(""), []), ("<html></html>", ["canonical", "no_title"]), (PAGE.format("<link href='/b' rel='canonical'>"), ["canonical"]),
        (PAGE.format(LD.format('{"@type": "Hotel", "name": "x", "address": {"@type": "PostalAddress"}}')), []),
        (PAGE.format(LD.format('{"@type": "Hotel", "offers": [{"AggregateRating": 3}]}')), ["forbidden_key"]),
        (PAGE.format(LD.format('{"@type": "Review"}')), ["type"]), (PAGE.format(LD.format('{"@type": "Hotel", "name": "review"}')), []), (PAGE.format(LD.format("{not json")), ["json"]),
    ],
)
def test_page_problems(spark, html, want):
    from environs.functions import page

    assert value(spark, page.problems(F.lit(html))) == want


def test_nearest_finds_far_ones(spark):
    """Rings grow until each point has its n, or all of its city; a city without any gives nothing."""
    from environs.operators.spatial import nearest

    rng = random.Random(3)
    left = [("a", i, rng.uniform(0, 9000), rng.uniform(0, 9000)) for i in range(40)] + [("b", 100, 0.0, 0.0), ("c", 101, 5.0, 5.0)]
    right = [("a", f"r{i}", rng.uniform(0, 3000), rng.uniform(0, 3000)) for i in range(12)] + [("b", "far", 80_000.0, 1.0), ("b", "near", 3.0, 4.0)]
    got = nearest(spark.createDataFrame(left, "city_id string, id long, x double, y double"), spark.createDataFrame(right, "city_id string, r string, x double, y double"), "r", 3).collect()
    want = {}
    for c, i, x, y in left:
        near = sorted((math.hypot(x - u, y - v), r) for d, r, u, v in right if d == c)[:3]
        want |= {(i, k + 1): r for k, (_, r) in enumerate(near)}
    assert {(r.id, r["rank"]): r.r for r in got} == want


def test_sitemaps_are_split(spark):
    paths = spark.createDataFrame([("a", f"/p{i:03}") for i in range(7)] + [("b", "/q")], "city_id string, path string")
    got = publication.urlset(paths, "https://x.test", most=3)
    assert sorted((r.city_id, r.part, r.xml.count("<loc>")) for r in got.collect()) == [("a", 0, 3), ("a", 1, 3), ("a", 2, 1), ("b", 0, 1)]
    assert publication.sitemap_index(got, "https://x.test").first().xml.count("<sitemap>") == 4


def test_wkt_is_printed(spark):
    text_ = "POLYGON ((0.0 0.0, 4.0 0.0, 0.0 4.0, 0.0 0.0), (1.0 1.0, 2.0 1.0, 1.0 2.0, 1.0 1.0))"
    assert value(spark, geo.to_wkt("POLYGON", geo.rings(F.lit(text_)))) == text_


@pytest.mark.parametrize(("wkt", "want"), [("POLYGON ((0 0, 4 4, 4 0, 0 4, 0 0))", False), ("POLYGON ((0 0, 4 0, 4 4, 0 4, 0 0))", True), (HOLED, True), ("POLYGON ((0 0, 9 0, 9 9, 5 -3, 0 9, 0 0))", False)])
def test_rings_that_cross_themselves(spark, wkt, want):
    assert value(spark, geo.plausible(F.lit(wkt))) is want
