"""A deterministic world of places made from the TPC-H-like tables, in DataFrame code and as SQL.

customer gives hotels, part points of interest, supplier green rectangles, orders road and rail lines. All
coordinates come from integer arithmetic, so both versions hold the same doubles. The engine itself only knows the frames.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config

#: region key -> city
REGIONS = ["london", "bangkok", "paris", "sydney", "new_york"]
#: leaf, family
POI_KINDS = [
    ("restaurant", "food_and_drink"), ("cafe", "food_and_drink"), ("bakery", "food_and_drink"), ("grocery_store", "shopping"), ("pharmacy", "health_care"),
    ("train_station", "travel_and_transportation"), ("metro_station", "travel_and_transportation"), ("bus_station", "travel_and_transportation"), ("bar", "food_and_drink"), ("pub", "food_and_drink"),
    ("dance_club", "arts_and_entertainment"), ("wine_bar", "food_and_drink"), ("aquarium", "arts_and_entertainment"), ("park", "active_life"), ("zoo", "arts_and_entertainment"),
    ("airport", "travel_and_transportation"), ("life_coach", "lifestyle_services"), ("veterinarian", "pets"), ("museum", "arts_and_entertainment"), ("clothing_store", "shopping"),
]
LEAVES = ["hotel", "hotel", "resort", "inn", "guest_house", "hostel", "service_apartment", "bed_and_breakfast", "lodging", "campground", "hotel", "motel"]
NAMES = [
    "Grand {w} Hotel", "Hôtel {w}", "8468671", "{w} Bank Street Inn", "St Mary {w} University", "Ostello {w}", "OYO 12 Home {w}", "Отель {w}",
    "桜ホテル", "ホテル", "Sonder {w}", "{w} Serviced Apartments", "Marriott {w}", "First National Bank", "RevenuebyDesign", "Embassy of {w}",
    "Selina {w}", " ", "Ξενία", "Blueground {w}", "{w} Guest House", "Church {w}", "The {w} 2br apartment", "Château {w} Café",
]
WORDS = ["Aurora", "Bellevue", "Canal", "Dolphin", "Esplanade", "Falcon", "Garden", "Harbour", "Ivory", "Jade", "Kestrel"]
GREEN_KINDS = [("park", "park"), ("protected", "nature_reserve"), ("recreation", "playground"), ("recreation", "pitch"), ("managed", "grass"), ("forest", "wood"), ("sand", "beach"), ("entertainment", "zoo"), ("horticulture", "garden"), ("grass", "meadow")]
#: Rings of the drawn polygons, in units of their half-widths: (part, ring, points), and whether the shape is one MULTIPOLYGON.
_BOX, _SMALL = [(-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1)], lambda x, y, r: [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
DRAWN = [
    [(0, 0, _BOX)],
    [(0, 0, _BOX), (0, 1, _SMALL(-0.5, -0.5, 0.25)), (0, 2, _SMALL(0.5, 0.5, 0.25))],
    [(0, 0, [(-1, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)])],
    [(0, 0, _BOX), (0, 1, _SMALL(3, 0, 0.5))],
    [(0, 0, _BOX), (0, 1, _SMALL(1, 0, 0.5))],
    [(0, 0, _BOX), (0, 1, _SMALL(0, 0, 0.75)), (0, 2, _SMALL(0, 0, 0.25))],
    [(0, 0, _BOX), (1, 0, _SMALL(0, 0, 0.5))],
    [(0, 0, _BOX), (0, 1, _SMALL(0, 0, 0.75)), (1, 0, _SMALL(0, 0, 0.5)), (2, 0, _SMALL(4, 4, 1))],
    [(0, 0, _BOX[:-1])],
    [(0, 0, [(-1, -1), (1, -1), (-1, -1)])],
    [(0, 0, [(-1, -1), (1, -1), (1, 1), (0, 1), (0, 3), (0, 1), (-1, 1), (-1, -1)])],
]
#: Vertices of an outline.
VERTICES = 1000
ROAD_KINDS = [("road", "motorway"), ("road", "primary"), ("road", "residential"), ("rail", "standard_gauge"), ("road", "trunk"), ("road", "service")]


def pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


class Atlas:
    """The frames over one folder of tables; each is a lazy plan."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def cities(self) -> DataFrame:
        """city_key and the configured columns of the five cities in use: always five rows."""
        known = config.builtin()
        found = config.city_frame(self.spark, {c: known[c] for c in REGIONS})
        keys = self.spark.createDataFrame(list(enumerate(REGIONS)), "city_key int, city_id string")
        return found.join(F.broadcast(keys), "city_id")

    def _placed(self, df: DataFrame, key: Column, mul: tuple[int, int], add: tuple[int, int]) -> DataFrame:
        lon = F.col("center_lon") + ((key * mul[0] + add[0]) % 6000 - 3000) / F.lit(1e5)
        lat = F.col("center_lat") + ((key * mul[1] + add[1]) % 4000 - 2000) / F.lit(1e5)
        df = df.join(F.broadcast(self.cities), "city_key").withColumn("lon", lon).withColumn("lat", lat)
        x = (F.col("lon") - F.col("center_lon")) * F.col("metres_x")
        return df.withColumn("x", x).withColumn("y", F.col("lat") * F.lit(config.METRES_Y))

    @cached_property
    def hotels(self) -> DataFrame:
        k = F.col("c_custkey")
        c = self.table("customer").join(F.broadcast(self.table("nation").select("n_nationkey", F.col("n_regionkey").alias("city_key"))), F.col("c_nationkey") == F.col("n_nationkey"))
        placed = F.when(k % 19 == 0, k - 1).otherwise(k)
        d = self._placed(c, placed, (7919, 104729), (13, 7))
        name = F.replace(pick(NAMES, placed % len(NAMES)), F.lit("{w}"), pick(WORDS, F.floor(placed / 24) % len(WORDS)))
        return d.select(
            "city_id", "city_name", "city_country", "expected_region", "center_lat", "center_lon", "metres_x",
            F.concat(F.lit("h"), F.lpad(k.cast("string"), 8, "0")).alias("id"),
            k.alias("key"),
            F.when(k % 29 != 0, name).alias("name"),
            F.when(k % 5 == 0, pick(["Marriott", "Ibis", "Blueground"], k % 3)).alias("brand_name"),
            "lon", "lat", "x", "y",
            F.when(k % 11 != 0, (k % 100) / F.lit(100.0)).alias("confidence"),
            (k % 4 + 1).cast("long").alias("n_sources"),
            pick(LEAVES, placed % len(LEAVES)).alias("leaf"),
            F.when(k % 17 != 0, F.when(k % 23 == 0, "XX").otherwise(F.col("city_country"))).alias("address_country"),
            F.when(k % 13 != 0, F.when(k % 2 == 0, "NY").otherwise("NJ")).alias("address_region"),
            "c_acctbal", "c_mktsegment",
        )

    @cached_property
    def pois(self) -> DataFrame:
        k = F.col("p_partkey")
        d = self._placed(self.table("part").withColumn("city_key", (k % 5).cast("int")), k, (6151, 92821), (101, 977))
        kind = (k * 31 + F.col("p_size")) % len(POI_KINDS)
        leaf = pick([a for a, _ in POI_KINDS], kind)
        return d.select(
            "city_id", F.concat(F.lit("p"), F.lpad(k.cast("string"), 8, "0")).alias("poi_id"), k.alias("key"), F.when(k % 13 != 0, F.col("p_name")).alias("name"),
            "lon", "lat", "x", "y", leaf.alias("leaf"), F.array(pick([b for _, b in POI_KINDS], kind), leaf).alias("hierarchy"),
        )

    @cached_property
    def green(self) -> DataFrame:
        """Rectangles as WKT in degrees, with their boxes."""
        k = F.col("s_suppkey")
        d = self._placed(self.table("supplier").withColumn("city_key", (k % 5).cast("int")), k, (3571, 52361), (29, 311))
        w, h = (F.lit(20) + (k * 7) % 180) / F.lit(1e5), (F.lit(15) + (k * 11) % 120) / F.lit(1e5)
        d = d.select("*", (F.col("lon") - w).alias("xmin"), (F.col("lon") + w).alias("xmax"), (F.col("lat") - h).alias("ymin"), (F.col("lat") + h).alias("ymax"))
        corners = [("xmin", "ymin"), ("xmax", "ymin"), ("xmax", "ymax"), ("xmin", "ymax"), ("xmin", "ymin")]
        ring = F.concat_ws(", ", *[F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")) for a, b in corners])
        return d.select(
            "city_id", "center_lon", "metres_x", F.concat(F.lit("g"), k.cast("string")).alias("green_id"), k.alias("key"),
            pick([a for a, _ in GREEN_KINDS], k % len(GREEN_KINDS)).alias("subtype"), pick([b for _, b in GREEN_KINDS], k % len(GREEN_KINDS)).alias("class"),
            F.concat(F.lit("POLYGON (("), ring, F.lit("))")).alias("wkt"), "xmin", "ymin", "xmax", "ymax",
        )

    @cached_property
    def segments(self) -> DataFrame:
        """Two-point lines as WKT in degrees."""
        k = F.col("o_orderkey")
        d = self._placed(self.table("orders").withColumn("city_key", (F.floor(k / 10) % 5).cast("int")), k, (4421, 65537), (5, 499))
        ends = [("lon", "lat"), ("lon2", "lat2")]
        d = d.withColumn("lon2", F.col("lon") + ((k * 17) % 400 - 200) / F.lit(1e5)).withColumn("lat2", F.col("lat") + ((k * 23) % 400 - 200) / F.lit(1e5))
        line = F.concat_ws(", ", *[F.concat_ws(" ", F.col(a).cast("string"), F.col(b).cast("string")) for a, b in ends])
        return d.select(
            "city_id", "center_lon", "metres_x", F.concat(F.lit("s"), k.cast("string")).alias("segment_id"), k.alias("key"),
            pick([a for a, _ in ROAD_KINDS], F.floor(k / 10) % len(ROAD_KINDS)).alias("subtype"), pick([b for _, b in ROAD_KINDS], F.floor(k / 10) % len(ROAD_KINDS)).alias("class"),
            F.concat(F.lit("LINESTRING ("), line, F.lit(")")).alias("wkt"),
        )

    @cached_property
    def outlines(self) -> DataFrame:
        """A jagged ring and a jagged line of VERTICES vertices for each supplier, as WKT in degrees."""
        k, n = F.col("s_suppkey"), VERTICES
        tasks = 8 * self.spark.sparkContext.defaultParallelism  # a few bytes of a supplier make a long text: the work isn't left to the few tasks that read the table
        suppliers = self.table("supplier").select("s_suppkey").repartition(tasks, "s_suppkey")
        d = self._placed(suppliers.withColumn("city_key", (k % 5).cast("int")), k, (3571, 52361), (29, 311))
        wide = (200 + k % 7 * 100) / F.lit(1e5)

        def pair(lon: Column, lat: Column) -> Column:
            return F.concat_ws(" ", lon.cast("string"), lat.cast("string"))

        def on_ring(i: Column) -> Column:
            t, side = (i % (n // 4)) / F.lit(n / 8) - 1, F.floor(i / (n // 4))
            east = F.when(side == 0, t).when(side == 1, F.lit(1.0)).when(side == 2, -t).otherwise(F.lit(-1.0))
            north = F.when(side == 0, F.lit(-1.0)).when(side == 1, t).when(side == 2, F.lit(1.0)).otherwise(-t)
            jag = (F.lit(60) + (i * 37 + k * 11) % 40) / F.lit(100.0)
            return pair(F.col("lon") + wide * jag * east, F.col("lat") + wide * jag * north)

        def on_line(i: Column) -> Column:
            return pair(F.col("lon") + (i - n // 2) * 3 / F.lit(1e5), F.col("lat") + ((i * 37 + k * 11) % 40 - 20) * 5 / F.lit(1e5))

        ring = F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: on_ring(i % n))
        line = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), on_line)
        # the text comes last, so that it is made for the rows that are asked for
        d = d.select("*", k.alias("key"), F.explode(F.array(F.lit("ring"), F.lit("line"))).alias("shape"))
        wkt = F.when(F.col("shape") == "ring", F.concat(F.lit("POLYGON (("), F.array_join(ring, ", "), F.lit("))"))).otherwise(F.concat(F.lit("LINESTRING ("), F.array_join(line, ", "), F.lit(")")))
        return d.select("city_id", "center_lon", "metres_x", F.concat_ws("-", "shape", F.col("key").cast("string")).alias("outline_id"), "key", "shape", wkt.alias("wkt"))

    @cached_property
    def drawn(self) -> DataFrame:
        """Polygons of every kind of DRAWN around the suppliers, valid and invalid ones, as WKT in degrees."""
        k = F.col("s_suppkey")
        d = self._placed(self.table("supplier").withColumn("city_key", (k % 5).cast("int")), k, (3571, 52361), (29, 311))
        w, h = (F.lit(20) + (k * 7) % 180) / F.lit(1e5), (F.lit(15) + (k * 11) % 120) / F.lit(1e5)

        def ring(points: list[tuple]) -> Column:
            at = [F.concat_ws(" ", (F.col("lon") + w * float(u)).cast("string"), (F.col("lat") + h * float(v)).cast("string")) for u, v in points]
            return F.concat(F.lit("("), F.concat_ws(", ", *at), F.lit(")"))

        def text(rings: list[tuple]) -> Column:
            parts = sorted({p for p, _, _ in rings})
            polygons = [F.concat(F.lit("("), F.concat_ws(", ", *[ring(points) for q, _, points in rings if q == p]), F.lit(")")) for p in parts]
            return F.concat(F.lit("POLYGON "), polygons[0]) if len(parts) == 1 else F.concat(F.lit("MULTIPOLYGON ("), F.concat_ws(", ", *polygons), F.lit(")"))

        kind = k % len(DRAWN)
        wkt = F.coalesce(*[F.when(kind == i, text(r)) for i, r in enumerate(DRAWN)])
        return d.select(F.concat(F.lit("d"), k.cast("string")).alias("shape_id"), wkt.alias("wkt"))


def number(x: float) -> str:
    """A double in SQL, read from text so that no decimal type comes between."""
    return f"'{x!r}'::double"


def _list(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _place(key: str, mul: tuple[int, int], add: tuple[int, int]) -> str:
    lon = f"(clon + (({key} * {mul[0]} + {add[0]}) % 6000 - 3000) / 1e5)"
    lat = f"(clat + (({key} * {mul[1]} + {add[1]}) % 4000 - 2000) / 1e5)"
    return f"{lon} as lon, {lat} as lat"


_KNOWN = config.builtin()
_CITY = ", ".join(
    f"({i}, '{c}', '{_KNOWN[c].name}', '{_KNOWN[c].country}', {'null' if _KNOWN[c].expected_region is None else repr(_KNOWN[c].expected_region)}, {number(_KNOWN[c].lat)}, {number(_KNOWN[c].lon)}, {number(_KNOWN[c].metres_x)})"
    for i, c in enumerate(REGIONS)
)
_KY = number(config.METRES_Y)
_PK = "(case when c_custkey % 19 = 0 then c_custkey - 1 else c_custkey end)"

CTES = f"""
city(city_key, city_id, city_name, city_country, expected_region, clat, clon, kx) as (values {_CITY}),
hotels as (select *, (lon - clon) * kx as x, lat * {_KY} as y from (
  select city_id, city_name, city_country, expected_region, clat, clon, kx, 'h' || lpad(c_custkey::varchar, 8, '0') as id, c_custkey as key,
    case when c_custkey % 29 <> 0 then replace(({_list(NAMES)})[{_PK} % {len(NAMES)} + 1], '{{w}}', ({_list(WORDS)})[({_PK} // 24) % {len(WORDS)} + 1]) end as name,
    case when c_custkey % 5 = 0 then (['Marriott', 'Ibis', 'Blueground'])[c_custkey % 3 + 1] end as brand_name,
    {_place(_PK, (7919, 104729), (13, 7))},
    case when c_custkey % 11 <> 0 then (c_custkey % 100) / 100.0::double end as confidence, (c_custkey % 4 + 1)::bigint as n_sources,
    ({_list(LEAVES)})[{_PK} % {len(LEAVES)} + 1] as leaf,
    case when c_custkey % 17 <> 0 then case when c_custkey % 23 = 0 then 'XX' else city_country end end as address_country,
    case when c_custkey % 13 <> 0 then case when c_custkey % 2 = 0 then 'NY' else 'NJ' end end as address_region, c_acctbal, c_mktsegment
  from customer join nation on c_nationkey = n_nationkey join city on city_key = n_regionkey)),
pois as (select *, (lon - clon) * kx as x, lat * {_KY} as y from (
  select city_id, clon, kx, 'p' || lpad(p_partkey::varchar, 8, '0') as poi_id, p_partkey as key, case when p_partkey % 13 <> 0 then p_name end as name,
    {_place("p_partkey", (6151, 92821), (101, 977))},
    ({_list([a for a, _ in POI_KINDS])})[(p_partkey * 31 + p_size) % {len(POI_KINDS)} + 1] as leaf,
    ({_list([b for _, b in POI_KINDS])})[(p_partkey * 31 + p_size) % {len(POI_KINDS)} + 1] as family
  from part join city on city_key = p_partkey % 5)),
green as (select *, (xmin - clon) * kx as x1, (xmax - clon) * kx as x2, ymin * {_KY} as y1, ymax * {_KY} as y2 from (
  select *, lon - w as xmin, lon + w as xmax, lat - h as ymin, lat + h as ymax from (
    select city_id, clon, kx, 'g' || s_suppkey as green_id, s_suppkey as key, {_place("s_suppkey", (3571, 52361), (29, 311))},
      ({_list([a for a, _ in GREEN_KINDS])})[s_suppkey % {len(GREEN_KINDS)} + 1] as subtype, ({_list([b for _, b in GREEN_KINDS])})[s_suppkey % {len(GREEN_KINDS)} + 1] as class,
      (20 + (s_suppkey * 7) % 180) / 1e5 as w, (15 + (s_suppkey * 11) % 120) / 1e5 as h
    from supplier join city on city_key = s_suppkey % 5))),
segments as (select *, (lon - clon) * kx as x1, lat * {_KY} as y1, (lon2 - clon) * kx as x2, lat2 * {_KY} as y2 from (
  select *, lon + ((key * 17) % 400 - 200) / 1e5 as lon2, lat + ((key * 23) % 400 - 200) / 1e5 as lat2 from (
    select city_id, clon, kx, 's' || o_orderkey as segment_id, o_orderkey as key, {_place("o_orderkey", (4421, 65537), (5, 499))},
      ({_list([a for a, _ in ROAD_KINDS])})[(o_orderkey // 10) % {len(ROAD_KINDS)} + 1] as subtype, ({_list([b for _, b in ROAD_KINDS])})[(o_orderkey // 10) % {len(ROAD_KINDS)} + 1] as class
    from orders join city on city_key = (o_orderkey // 10) % 5)))"""

#: Edges of the outlines: shape, outline_id, city_id, ax, ay, bx, by.
OUTLINE_EDGES = f"""ov as (select city_id, clon, kx, s_suppkey as key, i, lon, lat, (200 + s_suppkey % 7 * 100) / 1e5 as wide, (60 + (i * 37 + s_suppkey * 11) % 40) / 100.0::double as jag,
    (i % {VERTICES // 4}) / {number(VERTICES / 8)} - 1 as t, i // {VERTICES // 4} as side
  from (select *, {_place("s_suppkey", (3571, 52361), (29, 311))} from supplier join city on city_key = s_suppkey % 5), (select unnest(range({VERTICES})) as i)),
ring as (select city_id, key, i, (lon + wide * jag * (case side when 0 then t when 1 then 1.0 when 2 then -t else -1.0 end) - clon) * kx as x, (lat + wide * jag * (case side when 0 then -1.0 when 1 then t when 2 then 1.0 else -t end)) * {_KY} as y from ov),
line as (select city_id, key, i, (lon + (i - {VERTICES // 2}) * 3 / 1e5 - clon) * kx as x, (lat + ((i * 37 + key * 11) % 40 - 20) * 5 / 1e5) * {_KY} as y from ov),
ring_edges as (select a.city_id, 'ring-' || a.key as outline_id, a.x as ax, a.y as ay, b.x as bx, b.y as by from ring a join ring b on a.key = b.key and b.i = (a.i + 1) % {VERTICES}),
line_edges as (select a.city_id, 'line-' || a.key as outline_id, a.x as ax, a.y as ay, b.x as bx, b.y as by from line a join line b on a.key = b.key and b.i = a.i + 1)"""

#: Vertices of the drawn polygons: shape_id, part, ring, i, n, x, y.
DRAWN_VERTICES = f"""tpl(kind, part, ring, i, n, u, v) as (values {", ".join(f"({k}, {p}, {r}, {i}, {len(points)}, {number(float(u))}, {number(float(v))})" for k, rings in enumerate(DRAWN) for p, r, points in rings for i, (u, v) in enumerate(points))}),
dv as (select 'd' || s_suppkey as shape_id, part, ring, i, n, lon + w * u as x, lat + h * v as y from (
  select s_suppkey, {_place("s_suppkey", (3571, 52361), (29, 311))}, (20 + (s_suppkey * 7) % 180) / 1e5 as w, (15 + (s_suppkey * 11) % 120) / 1e5 as h from supplier join city on city_key = s_suppkey % 5) join tpl on kind = s_suppkey % {len(DRAWN)})"""


def over_atlas(query: str, more: str = "") -> str:
    """A SQL query over the atlas; more holds further CTEs."""
    return f"with recursive {CTES}{', ' + more if more else ''} {query}"


