"""Points in polygons and touching polygons.

A polygon is one ring of (x, y) structs, or an array of rings: outer ones, holes and further parts
alike. A point is inside if a ray from it crosses the sides of all rings an odd number of times, so
holes and parts need no marks. Rings may be closed or not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType


def with_rings(polygons: DataFrame, polygon: str, ring: str) -> DataFrame:
    """polygon and _rings, an array of rings."""
    many = isinstance(polygons.schema[ring].dataType.elementType, ArrayType)
    return polygons.select(polygon, (F.col(ring) if many else F.array(ring)).alias("_rings"))


def ring_edges(polygons: DataFrame, polygon: str, ring: str) -> DataFrame:
    """polygon, x1, y1, x2, y2 of each side of each ring."""
    each = with_rings(polygons, polygon, ring).select(polygon, F.explode("_rings").alias("_ring"))
    n = F.size("_ring")
    at = lambda i: F.get(F.col("_ring"), i)
    side = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(at(i)["x"].alias("x1"), at(i)["y"].alias("y1"), at((i + 1) % n)["x"].alias("x2"), at((i + 1) % n)["y"].alias("y2")))
    return each.where(n > 0).select(polygon, F.inline(side)).where("x1 <> x2 or y1 <> y2")


def _cells(lo: Column, hi: Column, cell: float) -> Column:
    return F.sequence(F.floor(lo / cell), F.floor(hi / cell))


def hits(points: DataFrame, polygons: DataFrame, item: str, polygon: str, ring: str, cell: float) -> DataFrame:
    """item, polygon and boundary for each polygon that holds a point or has it on a side.

    Polygons are dealt to the grid cells of their bounding boxes and a point meets those of its cell. Sides are cut
    into rows of cells, and a point meets the sides of its own row alone: the ones that a level ray from it can cross."""
    vertices = F.flatten("_rings")
    x, y = F.transform(vertices, lambda p: p["x"]), F.transform(vertices, lambda p: p["y"])
    boxes = with_rings(polygons, polygon, ring).where(F.size(vertices) > 0).select(polygon, F.array_min(x).alias("_x0"), F.array_max(x).alias("_x1"), F.array_min(y).alias("_y0"), F.array_max(y).alias("_y1"))
    boxes = boxes.select(polygon, "_y0", "_y1", F.explode(_cells(F.col("_x0"), F.col("_x1"), cell)).alias("_cx")).select(polygon, "_cx", F.explode(_cells(F.col("_y0"), F.col("_y1"), cell)).alias("_cy"))
    p = points.select(item, "x", "y", F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"))
    candidates = p.join(boxes, ["_cx", "_cy"]).select(item, "x", "y", "_cy", polygon)
    rows = ring_edges(polygons, polygon, ring).withColumn("_cy", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), cell)))
    sides = candidates.join(rows, [polygon, "_cy"])
    cross = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) * (F.col("x2") - F.col("x1"))
    on = _on_side()
    found = sides.groupBy(item, polygon).agg(F.sum(F.when(cross & (F.col("x") < at), 1).otherwise(0)).alias("_c"), F.max(on).alias("boundary"))
    return found.where((F.col("_c") % 2 == 1) | F.col("boundary")).select(item, polygon, "boundary")


def _on_side() -> Column:
    turn = (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) - (F.col("y2") - F.col("y1")) * (F.col("x") - F.col("x1"))
    return (turn == 0) & F.col("x").between(F.least("x1", "x2"), F.greatest("x1", "x2")) & F.col("y").between(F.least("y1", "y2"), F.greatest("y1", "y2"))


def assign_points(points: DataFrame, polygons: DataFrame, item: str, polygon: str, ring: str, cell: float) -> DataFrame:
    """item, polygon (the first by id that holds the point; boundaries count), n_hits. Points outside all have none."""
    found = hits(points, polygons, item, polygon, ring, cell).groupBy(item).agg(F.min(polygon).alias(polygon), F.count("*").alias("n_hits"))
    return points.select(item).join(found, item, "left").withColumn("n_hits", F.coalesce("n_hits", F.lit(0)))


def ambiguous_points(points: DataFrame, polygons: DataFrame, item: str, polygon: str, ring: str, cell: float) -> DataFrame:
    """item, polygon, boundary and n_hits of the points that several polygons claim, a row for each claim."""
    found = hits(points, polygons, item, polygon, ring, cell)
    several = found.groupBy(item).agg(F.count("*").alias("n_hits")).where("n_hits > 1")
    return found.join(several, item)


def queen_adjacency(polygons: DataFrame, polygon: str, ring: str, cell: float) -> DataFrame:
    """a < b of the polygons that share a vertex, or of which one has a vertex on a side of the other; holes and all parts count."""
    vertices = with_rings(polygons, polygon, ring).select(polygon, F.inline(F.flatten("_rings"))).distinct()
    equal = vertices.select(F.col(polygon).alias("a"), "x", "y").join(vertices.select(F.col(polygon).alias("b"), "x", "y"), ["x", "y"]).where("a < b").select("a", "b")
    sides = ring_edges(polygons, polygon, ring).select(F.col(polygon).alias("p"), "x1", "y1", "x2", "y2", F.explode(_cells(F.least("x1", "x2"), F.greatest("x1", "x2"), cell)).alias("_cx"))
    sides = sides.select("*", F.explode(_cells(F.least("y1", "y2"), F.greatest("y1", "y2"), cell)).alias("_cy"))
    v = vertices.select(F.col(polygon).alias("q"), "x", "y", F.floor(F.col("x") / cell).alias("_cx"), F.floor(F.col("y") / cell).alias("_cy"))
    touch = v.join(sides, ["_cx", "_cy"]).where(_on_side() & (F.col("p") != F.col("q"))).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))
    return equal.unionByName(touch).distinct()
