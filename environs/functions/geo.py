"""Geometry as Catalyst expressions: points and vertex arrays in local metres, no UDF."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import config
from .. import constants as C

_NUMBER = r"(-?[0-9.]+(?:[eE]-?[0-9]+)?)"


def project(lon: Column, lat: Column, center_lon: Column, metres_x: Column) -> Column:
    """Degrees to the city's equirectangular metres, as struct(x, y)."""
    return F.struct(((lon - center_lon) * metres_x).alias("x"), (lat * F.lit(config.METRES_Y)).alias("y"))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def rings(wkt: Column) -> Column:
    """All coordinate lists of a LINESTRING, POLYGON or MULTIPOLYGON: an array of arrays of struct(x, y) in degrees.

    Holes and parts are further lists: parity over all their edges says what is inside.
    """
    lists = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), F.lit(1))

    def point(pair: Column) -> Column:
        at = F.split(F.trim(pair), r"\s+")
        return F.struct(F.get(at, 0).cast("double").alias("x"), F.get(at, 1).cast("double").alias("y"))

    return F.transform(lists, lambda one: F.transform(F.split(one, ","), point))


def projected(parts: Column, center_lon: Column, metres_x: Column) -> Column:
    return F.transform(parts, lambda ring: F.transform(ring, lambda p: project(p.x, p.y, center_lon, metres_x)))


def edges(parts: Column) -> Column:
    """Every pair of neighbouring vertices: an array of struct(a, b)."""

    def of(ring: Column) -> Column:
        n = F.size(ring)
        return F.transform(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), lambda p, i: F.struct(p.alias("a"), F.get(ring, i + 1).alias("b")))

    return F.flatten(F.transform(parts, of))


def edge_distance(x: Column, y: Column, e: Column) -> Column:
    """From a point to an edge, the foot of the perpendicular held to the edge."""
    dx, dy = e.b.x - e.a.x, e.b.y - e.a.y
    length = dx * dx + dy * dy
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - e.a.x) * dx + (y - e.a.y) * dy) / length))).otherwise(F.lit(0.0))
    return distance(x, y, e.a.x + t * dx, e.a.y + t * dy)


def line_distance(x: Column, y: Column, all_edges: Column) -> Column:
    return F.array_min(F.transform(all_edges, lambda e: edge_distance(x, y, e)))


def inside(x: Column, y: Column, all_edges: Column) -> Column:
    """Ray casting: an odd number of edges is crossed to the right."""

    def crossed(e: Column) -> Column:
        straddles = (e.a.y > y) != (e.b.y > y)
        at = e.a.x + (y - e.a.y) / F.when(e.b.y == e.a.y, F.lit(1.0)).otherwise(e.b.y - e.a.y) * (e.b.x - e.a.x)
        return F.when(straddles & (x < at), 1).otherwise(0)

    return F.aggregate(F.transform(all_edges, crossed), F.lit(0), lambda s, v: s + v) % 2 == 1


def polygon_distance(x: Column, y: Column, all_edges: Column) -> Column:
    """0 inside, else the distance to the boundary."""
    return F.when(inside(x, y, all_edges), F.lit(0.0)).otherwise(line_distance(x, y, all_edges))


def ring_area(ring: Column) -> Column:
    n = F.size(ring)
    first = F.get(ring, 0)  # vertices are taken from the first one: the products stay small
    terms = F.transform(F.slice(ring, 1, F.greatest(n - 1, F.lit(0))), lambda p, i: (p.x - first.x) * (F.get(ring, i + 1).y - first.y) - (F.get(ring, i + 1).x - first.x) * (p.y - first.y))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, v: s + v)) / 2


def area(parts: Column) -> Column:
    """Shoelace area of a POLYGON: its first ring less the others. A MULTIPOLYGON is split into POLYGONs first."""
    areas = F.transform(parts, ring_area)
    return F.coalesce(F.get(areas, 0), F.lit(0.0)) * 2 - F.aggregate(areas, F.lit(0.0), lambda s, v: s + v)


def polygons(wkt: Column) -> Column:
    """The POLYGON texts of a POLYGON or MULTIPOLYGON."""
    one = F.regexp_extract_all(wkt, F.lit(r"\((?:\s*\([^()]+\)\s*,?)+\)"), F.lit(0))
    return F.transform(one, lambda p: F.concat(F.lit("POLYGON "), p))


def envelope(parts: Column) -> Column:
    points = F.flatten(parts)
    xs, ys = F.transform(points, lambda p: p.x), F.transform(points, lambda p: p.y)
    return F.struct(F.array_min(xs).alias("xmin"), F.array_min(ys).alias("ymin"), F.array_max(xs).alias("xmax"), F.array_max(ys).alias("ymax"))


def _side(a: Column, b: Column, c: Column) -> Column:
    """On which side of a-b lies c: 1, 0 or -1."""
    return F.signum((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x))


def crosses_itself(ring: Column) -> Column:
    """Two edges of a ring that aren't neighbours cross. Pairs of edges are tried: for rings of moderate size."""
    e = edges(F.array(ring))
    n = F.size(e)

    def crossed(p: Column, i: Column) -> Column:
        rest = F.slice(e, i + 3, F.greatest(n - i - 2, F.lit(0)))
        return F.exists(rest, lambda q: (_side(p.a, p.b, q.a) * _side(p.a, p.b, q.b) < 0) & (_side(q.a, q.b, p.a) * _side(q.a, q.b, p.b) < 0))

    return F.exists(F.transform(e, crossed), lambda x: x)


def plausible(wkt: Column) -> Column:
    """A polygon whose rings are closed, have four points or more and don't cross themselves. Rings aren't compared with each other."""
    ok = F.forall(rings(wkt), lambda r: (F.size(r) >= 4) & (F.get(r, 0) == F.element_at(r, -1)) & ~crosses_itself(r))
    return wkt.rlike(r"^\s*(MULTI)?POLYGON\s*\(") & ok


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    def half(d: Column) -> Column:
        s = F.sin(F.radians(d) / 2)
        return s * s

    a = half(lat2 - lat1) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon2 - lon1)
    return F.lit(2 * C.EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def estimate_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Equirectangular distance with the scale at the first point's latitude: a quick estimate for short ways."""
    dx = (lon2 - lon1) * F.lit(C.METRES_PER_DEGREE) * F.cos(F.radians(lat1))
    dy = (lat2 - lat1) * F.lit(C.METRES_PER_DEGREE)
    return F.sqrt(dx * dx + dy * dy)


def estimate_m2(square_degrees: Column, lat: Column) -> Column:
    """Square degrees at a latitude in square metres."""
    return square_degrees * F.lit(C.METRES_PER_DEGREE) * F.lit(C.METRES_PER_DEGREE) * F.cos(F.radians(lat))


def margin(radius_m: Column, lat: Column) -> Column:
    """struct(dlat, dlon): half-widths in degrees that enclose a radius for certain."""
    d = radius_m * F.lit(C.MARGIN_FACTOR) / F.lit(C.METRES_PER_DEGREE)
    return F.struct(d.alias("dlat"), (d / F.greatest(F.cos(F.radians(lat)), F.lit(0.01))).alias("dlon"))


def to_wkt(kind: str, parts: Column) -> Column:
    """The text of coordinate lists that ``rings`` gives: kind is LINESTRING (one list) or POLYGON."""
    listed = F.transform(parts, lambda r: F.concat(F.lit("("), F.array_join(F.transform(r, lambda p: F.concat_ws(" ", p.x.cast("string"), p.y.cast("string"))), ", "), F.lit(")")))
    return F.concat(F.lit("LINESTRING "), F.get(listed, 0)) if kind == "LINESTRING" else F.concat(F.lit("POLYGON ("), F.array_join(listed, ", "), F.lit(")"))


def in_box(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def boxes_overlap(a: list[Column], b: list[Column]) -> Column:
    """Each box is xmin, ymin, xmax, ymax."""
    return (a[0] <= b[2]) & (a[2] >= b[0]) & (a[1] <= b[3]) & (a[3] >= b[1])


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
