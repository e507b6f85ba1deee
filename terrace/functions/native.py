"""Geometry as native columns.

RING is array<struct<x,y>>, closed; GEOM is a struct of polygons (shell and holes), lines, envelope and area; an empty one
has empty arrays and no envelope. Envelope and area are kept with the shapes, so filters and joins on them never read the
points.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PT = "struct<x:double,y:double>"
RING = f"array<{PT}>"
POLY = f"struct<shell:{RING},holes:array<{RING}>>"
ENV = "struct<minx:double,miny:double,maxx:double,maxy:double>"
GEOM = f"struct<polys:array<{POLY}>,lines:array<{RING}>,env:{ENV},area:double>"


def ring_area(ring: Column) -> Column:
    """Signed area of a closed ring, about its first point."""
    o = ring[0]
    terms = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: (F.get(ring, i - 1)["x"] - o["x"]) * (F.get(ring, i)["y"] - o["y"]) - (F.get(ring, i)["x"] - o["x"]) * (F.get(ring, i - 1)["y"] - o["y"]))
    return F.when(F.size(ring) < 4, 0.0).otherwise(F.aggregate(terms, F.lit(0.0), lambda s, x: s + x) / 2)


def ring_length(ring: Column) -> Column:
    parts = F.transform(F.sequence(F.lit(1), F.size(ring) - 1), lambda i: F.hypot(F.get(ring, i)["x"] - F.get(ring, i - 1)["x"], F.get(ring, i)["y"] - F.get(ring, i - 1)["y"]))
    return F.when(F.size(ring) < 2, 0.0).otherwise(F.aggregate(parts, F.lit(0.0), lambda s, x: s + x))


def ring_env(ring: Column) -> Column:
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("minx"), F.array_min(ys).alias("miny"), F.array_max(xs).alias("maxx"), F.array_max(ys).alias("maxy"))


def closed_kind(ring: Column, flag: Column, tolerance: float = 1e-6) -> Column:
    """How a polyline is closed: by its flag, by its end points, or not (null)."""
    a, b = ring[0], F.element_at(ring, -1)
    met = (F.abs(a["x"] - b["x"]) <= tolerance) & (F.abs(a["y"] - b["y"]) <= tolerance)
    return F.when(F.size(ring) < 3, None).when(flag, "closed_flag").when(met, "closed_coordinates")


def affine(ring: Column, a: Column, b: Column, c: Column, d: Column, dx: Column, dy: Column) -> Column:
    return F.transform(ring, lambda p: F.struct((a * p["x"] + b * p["y"] + dx).alias("x"), (c * p["x"] + d * p["y"] + dy).alias("y")))


def box_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    return F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0))


def ring_geom(ring: Column) -> Column:
    return F.struct(F.array(F.struct(ring.alias("shell"), F.array().cast(f"array<{RING}>").alias("holes"))).alias("polys"), F.array().cast(f"array<{RING}>").alias("lines"), ring_env(ring).alias("env"), F.abs(ring_area(ring)).alias("area"))


def env_of_box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.cast("double").alias("minx"), y0.cast("double").alias("miny"), x1.cast("double").alias("maxx"), y1.cast("double").alias("maxy"))


def env_area(e: Column) -> Column:
    return (e["maxx"] - e["minx"]) * (e["maxy"] - e["miny"])


def env_meets(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["maxx"]) & (b["minx"] <= a["maxx"]) & (a["miny"] <= b["maxy"]) & (b["miny"] <= a["maxy"])


def env_covers(a: Column, b: Column) -> Column:
    return (a["minx"] <= b["minx"]) & (a["miny"] <= b["miny"]) & (a["maxx"] >= b["maxx"]) & (a["maxy"] >= b["maxy"])


def env_common_area(a: Column, b: Column) -> Column:
    w = F.least(a["maxx"], b["maxx"]) - F.greatest(a["minx"], b["minx"])
    h = F.least(a["maxy"], b["maxy"]) - F.greatest(a["miny"], b["miny"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def env_line_distance(e: Column, x: Column, y: Column) -> Column:
    """Distance from a point to the outline of a box, inside or outside."""
    dx = F.greatest(e["minx"] - x, F.lit(0.0), x - e["maxx"])
    dy = F.greatest(e["miny"] - y, F.lit(0.0), y - e["maxy"])
    within = F.least(x - e["minx"], e["maxx"] - x, y - e["miny"], e["maxy"] - y)
    return F.when((dx == 0) & (dy == 0), within).otherwise(F.sqrt(dx * dx + dy * dy))


def ring_line_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance from a point to a closed ring's line."""

    def one(i):
        a, b = F.get(ring, i - 1), F.get(ring, i)
        dx, dy = b["x"] - a["x"], b["y"] - a["y"]
        n = F.greatest(dx * dx + dy * dy, F.lit(1e-300))
        t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((x - a["x"]) * dx + (y - a["y"]) * dy) / n))
        return F.hypot(x - a["x"] - t * dx, y - a["y"] - t * dy)

    return F.array_min(F.transform(F.sequence(F.lit(1), F.size(ring) - 1), one))
