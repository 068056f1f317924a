"""Points in polygons through an index of quad-tree cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import table

#: Finest level of cells (2 ** LEVELS a side), and cells a side that a polygon's box is cut into at most.
LEVELS, SIDE = 16, 8
RINGS = "array<array<array<double>>>"


def rings(kind: Column, coordinates: Column) -> Column:
    """The rings of GeoJSON polygons and multipolygons, given as text; null for other kinds."""
    return F.when(kind == "Polygon", F.from_json(coordinates, RINGS)).when(kind == "MultiPolygon", F.flatten(F.from_json(coordinates, f"array<{RINGS}>")))


def edges_of(shape: Column) -> Column:
    """The edges (x1, y1, x2, y2) of an array of rings of [x, y, ...]; a ring need not repeat its first point."""
    turned = lambda ring: F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    edge = lambda a, b: F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2"))
    return F.flatten(F.transform(shape, lambda ring: F.zip_with(ring, turned(ring), edge)))


def within(edges: Column, x: Column, y: Column) -> Column:
    """Whether a point is in a shape or on its border: rays to the right meet an odd number of edges."""
    crosses = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    on = lambda e: (
        ((e["x2"] - e["x1"]) * (y - e["y1"]) == (e["y2"] - e["y1"]) * (x - e["x1"]))
        & y.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"])) & x.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
    )
    odd = F.aggregate(edges, F.lit(0), lambda n, e: n + F.when(crosses(e), 1).otherwise(0)) % 2 == 1
    return odd | F.exists(edges, on)


def place(v: Column, low: float, span: float, level: Column) -> Column:
    """The number of the cell of a level that a coordinate is in; the upper end belongs to the last cell."""
    many = F.pow(F.lit(2.0), level)
    return F.least(F.floor((v - low) / span * many), many.cast("long") - 1)


def covered(polygons: DataFrame, id_col: str, rings_col: str) -> DataFrame:
    """(id, level, i, j, sure, edges): the cells that polygons(id, rings) meet.

    A polygon's level is the finest at which its box has SIDE cells a side at most, so it has SIDE ** 2 at most. Cells that
    no edge touches are wholly in (sure) or out (left out), by their middle; the others keep the edges that a ray
    from them can meet.
    """
    p = polygons.select(F.col(id_col).alias("id"), edges_of(F.col(rings_col)).alias("edges")).where(F.size("edges") > 0)
    ends = lambda f, g, a, b: f(F.transform("edges", lambda e: g(e[a], e[b])))
    p = p.select(
        "*", ends(F.array_min, F.least, "x1", "x2").alias("x0"), ends(F.array_max, F.greatest, "x1", "x2").alias("x9"),
        ends(F.array_min, F.least, "y1", "y2").alias("y0"), ends(F.array_max, F.greatest, "y1", "y2").alias("y9"),
    )
    p = p.where("x0 >= -180 and x9 <= 180 and y0 >= -90 and y9 <= 90")
    room = F.greatest((F.col("x9") - F.col("x0")) / 360, (F.col("y9") - F.col("y0")) / 180, F.lit(2.0**-40))
    level = F.least(F.greatest(F.floor(F.log2(F.lit(SIDE - 1.0) / room)), F.lit(0)), F.lit(LEVELS))
    p = p.withColumn("level", level.cast("int"))
    at = lambda c, low, span: place(F.col(c), low, span, F.col("level"))
    p = p.withColumn("i", F.explode(F.sequence(at("x0", -180, 360), at("x9", -180, 360)))).withColumn("j", F.explode(F.sequence(at("y0", -90, 180), at("y9", -90, 180))))
    edge = lambda c, low, span: F.lit(float(low)) + F.col(c) * span / F.pow(F.lit(2.0), F.col("level"))
    p = p.select("*", edge("i", -180, 360).alias("xl"), edge("j", -90, 180).alias("yl"))
    p = p.select("*", (F.col("xl") + 360 / F.pow(F.lit(2.0), F.col("level"))).alias("xh"), (F.col("yl") + 180 / F.pow(F.lit(2.0), F.col("level"))).alias("yh"))
    level_with = lambda e: (F.greatest(e["y1"], e["y2"]) >= F.col("yl")) & (F.least(e["y1"], e["y2"]) <= F.col("yh")) & (F.greatest(e["x1"], e["x2"]) >= F.col("xl"))
    side = lambda e: [(e["x2"] - e["x1"]) * (F.col(py) - e["y1"]) - (e["y2"] - e["y1"]) * (F.col(px) - e["x1"]) for px in ("xl", "xh") for py in ("yl", "yh")]
    apart = lambda e: (F.least(*side(e)) > 1e-9) | (F.greatest(*side(e)) < -1e-9)  # noqa: E731  all corners on one side of the edge
    touched = F.exists("edges", lambda e: level_with(e) & (F.least(e["x1"], e["x2"]) <= F.col("xh")) & ~apart(e))
    p = p.withColumn("sure", ~touched).where(~F.col("sure") | within(F.col("edges"), (F.col("xl") + F.col("xh")) / 2, (F.col("yl") + F.col("yh")) / 2))
    return p.select("id", "level", "i", "j", "sure", F.when(~F.col("sure"), F.filter("edges", level_with)).alias("edges"))


def points_in_polygons(points: DataFrame, polygons: DataFrame, x: str = "lon", y: str = "lat", id_col: str = "polygon", rings_col: str = "rings") -> DataFrame:
    """points and the id of each polygon that has them, a row a pair.

    Shapes are arrays of rings of [lon, lat], outer ones and holes alike: in is what an odd number of rings surround, and a
    border, that of a hole too, is in. Edges are straight in degrees; shapes across the 180th meridian have to be cut
    there, and those beyond the degrees' range are left out, as are points with null coordinates. Points and cells meet by
    equality, a place once for each level that polygons have; only places in cells with a border are tested. Points at one
    place are tested once, and so are polygons of one shape; their rows meet by joins on places and shapes, which Spark
    splits where they are skewed. A point or polygon without a partner gives no row. Repeated rows stay.
    """
    named = polygons.select(F.col(id_col).alias("id"), F.col(rings_col).alias("rings"))
    shapes = table(named.select("rings").distinct().select(F.monotonically_increasing_id().alias("shape"), "rings"), "shapes")
    cells = table(covered(shapes, "shape", "rings"), "cells")
    levels = sorted(r.level for r in cells.select("level").distinct().collect())  # LEVELS + 1 at most
    if not levels:
        return points.crossJoin(polygons.select(id_col)).limit(0)
    row = F.struct(*[F.col(f"`{c}`") for c in points.columns])
    at = points.select(row.alias("row"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x between -180 and 180 and y between -90 and 90")
    p = table(at.select("x", "y").distinct(), "places").withColumn("level", F.explode(F.array(*[F.lit(n) for n in levels])))
    p = p.select("*", place(F.col("x"), -180, 360, F.col("level")).alias("i"), place(F.col("y"), -90, 180, F.col("level")).alias("j"))
    found = p.join(cells, ["level", "i", "j"]).where(F.col("sure") | within(F.col("edges"), F.col("x"), F.col("y"))).select("x", "y", F.col("id").alias("shape"))
    of = table(named.join(shapes, "rings").select("shape", "id"), "members")
    found = table(found.join(of, "shape").select("x", "y", "id"), "found")
    return at.join(found, ["x", "y"]).select("row.*", F.col("id").alias(id_col))
