"""Whether polygons are valid: rings closed and long enough, no two edges that cross, holes within their shells, rings not within each other.

Edges of a shape meet each other in cells of a grid of the shape's own, about one edge wide, so that the work follows the outline's length and not its
square. What lies inside what is decided by parity: a ring's test point meets the edges that cross its height.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..storage import drop, stash
from .outlines import edge_cells

#: In the order in which they are reported.
PROBLEMS = ["not a polygon", "too few points", "ring not closed", "rings cross", "hole outside its shell", "rings nest"]


def _ring_edges(shapes: DataFrame, key: str) -> DataFrame:
    """key, part, ring, points, closed, i and the edge's ends in degrees: one row for each edge; ring 0 is a part's shell."""
    one = F.posexplode(geo.polygons(F.col("wkt"))).alias("part", "text")
    rings = shapes.select(key, one).select(key, "part", F.posexplode(geo.rings(F.col("text"))).alias("ring", "points"))
    closed = F.coalesce(F.get("points", 0) == F.element_at("points", -1), F.lit(False))
    e = rings.select(key, "part", "ring", F.size("points").alias("n"), closed.alias("closed"), F.posexplode_outer(geo.edges(F.array("points"))).alias("i", "e"))
    return e.select(key, "part", "ring", "n", "closed", "i", F.col("e.a.x").alias("ax"), F.col("e.a.y").alias("ay"), F.col("e.b.x").alias("bx"), F.col("e.b.y").alias("by"))


def _side(ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    return F.signum((bx - ax) * (y - ay) - (by - ay) * (x - ax))


def crossings(edges: DataFrame, key: str) -> DataFrame:
    """key of the shapes of which two edges cross, or lie along each other for some way. Touching in a point is no crossing."""
    extent = F.greatest(F.max(F.greatest("ax", "bx")) - F.min(F.least("ax", "bx")), F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by")))
    sizes = edges.groupBy(key).agg(F.greatest(extent / F.ceil(F.sqrt(F.count(F.lit(1)))), F.lit(1e-7)).alias("size"))
    named = edges.join(sizes, key).withColumn("edge", F.struct("part", "ring", "i"))
    cells = edge_cells(named.select(key, "edge", "size", "ax", "ay", "bx", "by"), 0.0, F.col("size")).drop("size")
    p, q = cells, cells.select(key, "gx", "gy", F.col("edge").alias("edge2"), *[F.col(c).alias(f"{c}2") for c in ("ax", "ay", "bx", "by")])
    met = p.join(q.hint("merge"), [key, "gx", "gy"]).where("edge < edge2")
    a, b = [F.col(c) for c in ("ax", "ay", "bx", "by")], [F.col(f"{c}2") for c in ("ax", "ay", "bx", "by")]
    s1, s2, s3, s4 = _side(*a, b[0], b[1]), _side(*a, b[2], b[3]), _side(*b, a[0], a[1]), _side(*b, a[2], a[3])
    across = (s1 * s2 < 0) & (s3 * s4 < 0)
    overlap = lambda i: F.least(F.greatest(a[i], a[i + 2]), F.greatest(b[i], b[i + 2])) - F.greatest(F.least(a[i], a[i + 2]), F.least(b[i], b[i + 2]))
    along = (s1 == 0) & (s2 == 0) & (F.greatest(overlap(0), overlap(1)) > 0) & (F.least(overlap(0), overlap(1)) >= 0)
    return met.where(across | along).select(key).distinct()


def enclosing(edges: DataFrame, key: str) -> DataFrame:
    """key, part, ring, part2, ring2: the first edge's middle of (part, ring) is inside the ring (part2, ring2) of the same shape."""
    sizes = edges.groupBy(key).agg(F.greatest((F.max(F.greatest("ay", "by")) - F.min(F.least("ay", "by"))) / F.ceil(F.sqrt(F.count(F.lit(1)))), F.lit(1e-7)).alias("size"))
    several = edges.groupBy(key).agg(F.count_if(F.col("i") == 0).alias("rings")).where("rings > 1")  # one ring encloses nothing
    e = edges.join(several.select(key), key, "left_semi").join(sizes, key)
    row = lambda y: F.floor(y / F.col("size"))
    bands = e.select(key, F.col("part").alias("part2"), F.col("ring").alias("ring2"), "ax", "ay", "bx", "by", F.explode(F.sequence(row(F.least("ay", "by")), row(F.greatest("ay", "by")))).alias("gy"))
    x, y = (F.col("ax") + F.col("bx")) / 2, (F.col("ay") + F.col("by")) / 2
    points = e.where("i = 0").select(key, "part", "ring", x.alias("x"), y.alias("y"), row(y).alias("gy"))
    met = points.join(bands.hint("merge"), [key, "gy"]).where((F.col("part") != F.col("part2")) | (F.col("ring") != F.col("ring2")))
    at = F.col("ax") + (F.col("y") - F.col("ay")) / F.when(F.col("by") == F.col("ay"), F.lit(1.0)).otherwise(F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    crossed = ((F.col("ay") > F.col("y")) != (F.col("by") > F.col("y"))) & (F.col("x") < at)
    g = met.groupBy(key, "part", "ring", "part2", "ring2").agg((F.count_if(crossed) % 2 == 1).alias("inside"))
    return g.where("inside").drop("inside")


def polygon_problems(shapes: DataFrame, key: str) -> DataFrame:
    """shapes(key, wkt) -> key, problem: the first of PROBLEMS that a shape has, null for a valid one.

    Keys must be distinct. A hole must lie in its shell and not in another hole; a part may lie in a hole of another part, not in its inside.
    Null texts and other geometries are no polygons. Points that aren't numbers make a ring unclosed.
    """
    edges = stash(_ring_edges(shapes.select(key, "wkt"), key), "ring-edges")
    rings = edges.groupBy(key).agg(F.min("n").alias("least"), F.min("closed").alias("closed"))
    whole = edges.where("i is not null and ax is not null and ay is not null and bx is not null and by is not null")
    cross = crossings(whole, key).withColumn("cross", F.lit(True))
    within = enclosing(whole, key)
    own_shell = (F.col("part") == F.col("part2")) & (F.col("ring2") == 0) & (F.col("ring") > 0)
    in_hole = (F.col("part") == F.col("part2")) & (F.col("ring2") > 0) & (F.col("ring") > 0)
    by_part = within.groupBy(key, "part", "ring", "part2").agg(F.max(own_shell).alias("home"), F.max(in_hole).alias("hole"), F.max(F.col("ring2") == 0).alias("shell"), F.max(F.col("ring2") > 0).alias("gap"))
    other = (F.col("part") != F.col("part2")) & (F.col("ring") == 0) & F.col("shell") & ~F.col("gap")
    nests = by_part.groupBy(key).agg(F.max(F.col("hole") | other).alias("nests"), F.count_if("home").alias("at_home"))
    holes = edges.where("ring > 0").groupBy(key).agg(F.count_distinct("part", "ring").alias("holes"))
    d = shapes.select(key, F.coalesce(F.col("wkt").rlike(r"^\s*(MULTI)?POLYGON\s*\("), F.lit(False)).alias("polygon"))
    for more in (rings, cross, nests, holes):
        d = d.join(more, key, "left")
    tests = [
        ~F.col("polygon") | F.col("least").isNull(), F.col("least") < 4, ~F.col("closed"), F.coalesce("cross", F.lit(False)),
        F.coalesce("holes", F.lit(0)) > F.coalesce("at_home", F.lit(0)), F.coalesce("nests", F.lit(False)),
    ]
    problem = F.coalesce(*[F.when(t, p) for t, p in zip(tests, PROBLEMS)])
    out = stash(d.select(key, problem.alias("problem")), "problems")
    drop(edges)
    return out
