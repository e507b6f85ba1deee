"""Spatial joins as equi-joins.

Boxes are filed in a grid whose cell size depends on the box: at level L cells are 2^L wide, and a box is filed at the
level that it fits in, in at most four cells. The other side looks in its cells at each level in use from its own on. So
neither large nor small boxes multiply rows, nothing is broadcast, and a project of any size is joined by hash. A pair
that meets in several cells is kept in the one with the upper right of both lower left corners.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions.native import env_covers, env_line_distance, env_meets

from .graph import checkpointed


def box_level(env: Column) -> Column:
    side = F.greatest(env["maxx"] - env["minx"], env["maxy"] - env["miny"], F.lit(1e-6))
    return F.ceil(F.log2(side)).cast("int")


def _cells(lo: Column, hi: Column, level: Column) -> Column:
    size = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(lo / size), F.floor(hi / size))


def _filed(df: DataFrame, env: str, level: Column) -> DataFrame:
    e = F.col(env)
    out = df.withColumn("level", level)
    out = out.withColumn("cx", F.explode(_cells(e["minx"], e["maxx"], F.col("level"))))
    return out.withColumn("cy", F.explode(_cells(e["miny"], e["maxy"], F.col("level"))))


def _top_level(df: DataFrame, env: str) -> int:
    return df.agg(F.max(box_level(F.col(env))).alias("n")).first()["n"] or 0


def pair_boxes(a: DataFrame, b: DataFrame, condition: Column | None = None, key: str = "project") -> DataFrame:
    """Pairs of rows (columns a and b, structs) with one key whose boxes ``env`` meet; a's level is at least b's, or any
    with both=True in self-joins by calling it once per order."""
    top = _top_level(a, "env")
    left = _filed(a.select(F.col(key).alias("key"), F.struct(*a.columns).alias("a"), "env"), "env", box_level(F.col("env"))).drop("env")
    every = F.explode(F.sequence(box_level(F.col("env")), F.greatest(F.lit(top), box_level(F.col("env")))))
    right = b.select(F.col(key).alias("key"), F.struct(*b.columns).alias("b"), "env").withColumn("at", every)
    right = _filed(right, "env", F.col("at")).drop("env", "at")
    pairs = left.join(right, ["key", "level", "cx", "cy"])
    size = F.pow(F.lit(2.0), F.col("level"))
    e, f = F.col("a.env"), F.col("b.env")
    own = (F.col("cx") == F.floor(F.greatest(e["minx"], f["minx"]) / size)) & (F.col("cy") == F.floor(F.greatest(e["miny"], f["miny"]) / size))
    pairs = pairs.filter(env_meets(e, f) & own)
    return (pairs.filter(condition) if condition is not None else pairs).select("key", "a", "b")


def self_pairs(df: DataFrame, ident: str = "id", key: str = "project") -> DataFrame:
    """Unordered pairs of one relation whose boxes meet: a.id < b.id."""
    la, lb = box_level(F.col("a.env")), box_level(F.col("b.env"))
    once = (la > lb) | ((la == lb) & (F.col(f"a.{ident}") < F.col(f"b.{ident}")))
    pairs = pair_boxes(df, df, once, key)
    swap = F.col(f"a.{ident}") > F.col(f"b.{ident}")
    return pairs.select("key", F.when(swap, F.col("b")).otherwise(F.col("a")).alias("a"), F.when(swap, F.col("a")).otherwise(F.col("b")).alias("b"))


def kind_pairs(df: DataFrame, measures, schema: str, ident: str = "id", key: str = "project", grow: float = 0.0, condition=None) -> DataFrame:
    """Unordered pairs of one relation's boxes, grown by ``grow``, that meet (key, a, b with a < b), and what ``measures``
    tells of a pair. Only distinct boxes are paired. Measures must not depend on where a pair lies: they are taken once for
    each two sizes and the way from one box's corner to the other's, and in both orders: ``measures(w, h, dx, dy, w2, h2)``
    gives a row of ``schema``. condition: of two boxes (columns), before anything is measured."""
    e = F.col("env")
    kinds = df.groupBy(key, "env").agg(F.min(ident).alias("kind"))
    wide = kinds.withColumn("tight", e).withColumn("env", F.struct(*[(e[n] + g).alias(n) for n, g in (("minx", -grow), ("miny", -grow), ("maxx", grow), ("maxy", grow))]))
    wide = checkpointed(wide)
    pairs = self_pairs(wide, "kind", key).unionByName(wide.select(F.col(key).alias("key"), *[F.struct(*wide.columns).alias(s) for s in "ab"]))
    if condition is not None:
        pairs = pairs.filter(condition(F.col("a.tight"), F.col("b.tight")))
    x, y = F.col("a.tight"), F.col("b.tight")
    side = lambda t, c: t[f"max{c}"] - t[f"min{c}"]
    way = {"w": side(x, "x"), "h": side(x, "y"), "dx": y["minx"] - x["minx"], "dy": y["miny"] - x["miny"], "w2": side(y, "x"), "h2": side(y, "y")}
    pairs = checkpointed(pairs.select(F.col("key").alias(key), F.col("a.kind").alias("ka"), F.col("b.kind").alias("kb"), *[c.alias(n) for n, c in way.items()]))

    @F.pandas_udf(f"struct<ab:struct<{schema}>,ba:struct<{schema}>>")
    def measured(w: pd.Series, h: pd.Series, dx: pd.Series, dy: pd.Series, w2: pd.Series, h2: pd.Series) -> pd.DataFrame:
        names = [c.split(":")[0] for c in schema.split(",")]
        rows = [(measures(*r), measures(r[4], r[5], -r[2], -r[3], r[0], r[1])) for r in zip(*(c.tolist() for c in (w, h, dx, dy, w2, h2)), strict=True)]
        return pd.DataFrame([[dict(zip(names, m, strict=True)) for m in r] for r in rows], columns=["ab", "ba"])

    ways = [*way]
    # a number of tasks is named, as few rows would be one task, and the kernel takes far longer than reading
    found = checkpointed(pairs.select(*ways).distinct().repartition(DEALT, *ways).withColumn("m", measured(*ways)).select(*ways, "m.ab", "m.ba"))
    pairs = pairs.join(found, ways).drop(*ways)
    rows = df.select(F.col(key), F.col(ident).alias("id"), "env").join(kinds, [key, "env"]).select(key, "id", "kind")
    of = lambda s: rows.select(key, F.col("id").alias(s), F.col("kind").alias(f"k{s}"))
    every = pairs.join(of("a"), [key, "ka"]).join(of("b"), [key, "kb"]).filter("ka <> kb OR a < b")
    return every.select(key, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("ab")).otherwise(F.col("ba")).alias("m")).select(key, "a", "b", "m.*")


def containment(df: DataFrame, ident: str = "id", key: str = "project") -> DataFrame:
    """Each box's direct parent: the smallest box of greater area that covers it; of equals the one with the least id.
    Equal boxes have the same parent, and only the one with the least id is one, so pairs are of distinct boxes."""
    area = lambda e: (e["maxx"] - e["minx"]) * (e["maxy"] - e["miny"])
    e, f = F.col("a.env"), F.col("b.env")
    kinds = df.groupBy(key, "env").agg(F.min(ident).alias("id"))
    pairs = pair_boxes(kinds, kinds, env_covers(e, f) & (area(e) > area(f)), key)
    best = pairs.groupBy(F.col("key").alias(key), F.col("b.env").alias("env")).agg(F.min(F.struct(area(e).alias("area"), F.col("a.id").alias("id"))).alias("best"))
    rows = df.select(key, F.col(ident).alias("child"), "env").join(best, [key, "env"])
    return rows.groupBy(key, "child").agg(F.min("best").alias("best")).select(key, "child", F.col("best.id").alias("parent"))


def polygon_containment(df: DataFrame, ident: str = "id", key: str = "project") -> DataFrame:
    """Each shape's direct parent: the smallest shape of greater area that covers it, shared edges allowed; of equals the
    one with the least id. df: key, ident, env, geom. Distinct shapes are paired by their boxes; the kernel takes a shape's
    pairs from the smallest other one on, up to the first that covers it."""
    from terrace.functions import polygon as P
    from terrace.functions.shapes import from_row

    kinds = checkpointed(df.groupBy(key, "env", "geom").agg(F.min(ident).alias("id")).withColumn("who", F.sha2(F.to_json(F.struct(key, "env", "geom")), 256)))
    x, y = F.col("a.geom"), F.col("b.geom")
    pairs = pair_boxes(kinds, kinds, env_covers(F.col("a.env"), F.col("b.env")) & (x["area"] > y["area"]), key)
    offers = pairs.select(F.col("b.who").alias("who"), x["area"].alias("area"), F.col("a.id").alias("id"), F.struct(x["polys"].alias("polys")).alias("x"), F.struct(y["polys"].alias("polys")).alias("y"))

    def first(batches):
        done = None
        for b in batches:
            rows = []
            for who, area, i, over, own in zip(b["who"], b["area"], b["id"], b["x"], b["y"], strict=True):
                if who != done and P.covers(from_row(over), from_row(own)):
                    done = who
                    rows.append((who, area, i))
            yield pd.DataFrame(rows, columns=["who", "area", "parent"])

    # a number of tasks is named, as few rows would be one task; batches follow each other in order
    offers = offers.repartition(DEALT, "who").sortWithinPartitions("who", "area", "id")
    best = kinds.join(offers.mapInPandas(first, f"who string, area double, parent {kinds.schema['id'].dataType.simpleString()}"), "who").select(key, "env", "geom", F.struct("area", F.col("parent").alias("id")).alias("best"))
    rows = df.select(key, F.col(ident).alias("child"), "env", "geom").join(best, [key, "env", "geom"])
    return rows.groupBy(key, "child").agg(F.min("best").alias("best")).select(key, "child", F.col("best.id").alias("parent"))


def polygon_adjacency(df: DataFrame, tolerance: float = 1e-6, ident: str = "id", key: str = "project") -> DataFrame:
    """Shapes with a common boundary longer than the tolerance: key, u, v (u < v), shared."""
    from terrace.functions.shapes import g_shared_length

    pairs = self_pairs(df, ident, key).withColumn("shared", g_shared_length("a.geom", "b.geom"))
    return pairs.filter(F.col("shared") > tolerance).select(F.col("key").alias(key), F.col(f"a.{ident}").alias("u"), F.col(f"b.{ident}").alias("v"), "shared")


#: Regions a side, and cells a side of a region, by which the nearest-band join finds a project's points.
REGIONS, CELLS = 8, 8
#: A project's shapes that meet one copy of its regions and cells, the most copies, and the tasks that they are dealt to.
SHAPES_A_COPY, MOST_COPIES, DEALT = 256, 256, 64


def once(value: Column, f) -> Column:
    """f of a value that is worked out once, however often f uses it."""
    return F.transform(F.array(value), f)[0]


def places(points: DataFrame, *values: str, key: str = "project") -> DataFrame:
    """Points that stand in one place (and share the values): key, x, y, values, n, n_z and sum_z, the number of points,
    that of their z, and the sum."""
    return points.groupBy(key, "x", "y", *values).agg(F.count("*").alias("n"), F.count("z").alias("n_z"), F.sum("z").alias("sum_z"))


def near_points(shapes: DataFrame, points: DataFrame, reach: float | None = None, outline=None, key: str = "project", ident: str = "id", both: bool = False) -> DataFrame:
    """Points of a shape's project by distance from its outline: within ``reach``, or (None) in the band of the nearest,
    up to max(t, 2.5 * least distance + t) with t a millionth of the shape's size. Rows: key, id, point, z, distance. With
    ``both`` points of either kind, and flags in_band and in_reach. The search is for places; their points follow."""
    found = near_places(shapes, points.select(key, "x", "y").distinct(), reach, outline, key, ident, both)
    flags = ("in_band", "in_reach") if both else ()
    return points.select(key, "x", "y", "point", "z").join(found, [key, "x", "y"]).select(key, ident, "point", "z", "distance", *flags)


def near_places(shapes: DataFrame, points: DataFrame, reach: float | None = None, outline=None, key: str = "project", ident: str = "id", both: bool = False) -> DataFrame:
    """As ``near_points``, for rows with x and y and whatever other columns, which are kept.

    A project's points are gathered in regions and cells of a fixed number, each known by its tight box and one of its
    points; these are one row of bounded size a project. A shape is joined with that row alone, of which a project with
    many shapes has several copies, so that they are dealt to several tasks. Within it the distance of a box's middle, less
    half its diagonal, bounds its points' distances from below, and the known point's distance bounds the least one from
    above: regions that the bounds close are dropped, then cells of the others. Only the cells that are left meet their
    points, by an equi-join on the cell, so no pair of shape and cell is ever a row but those."""
    kept = [c for c in points.columns if c != key]
    outline = outline or (lambda row, x, y: env_line_distance(row["env"], x, y))
    side = REGIONS * CELLS
    span = points.groupBy(key).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"), F.lit(1e-9)).alias("side"))
    placed = points.join(span, key)
    cell = lambda c, c0: F.least(F.lit(side - 1), F.floor((F.col(c) - F.col(c0)) / F.col("side") * side)).cast("int")
    placed = placed.select(key, *kept, cell("x", "x0").alias("cx"), cell("y", "y0").alias("cy"))
    tight = [F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("y0").alias("y0"), F.max("y1").alias("y1"), F.min("one").alias("one")]
    known = placed.groupBy(key, "cx", "cy").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.min(F.struct("x", "y")).alias("one"))
    region = [F.floor(F.col(c) / CELLS).alias(r) for c, r in (("cx", "rx"), ("cy", "ry"))]
    regions = known.groupBy(key, *region).agg(*tight, F.collect_list(F.struct("cx", "cy", "x0", "x1", "y0", "y1", "one")).alias("cells"))
    maps = regions.groupBy(key).agg(F.collect_list(F.struct("x0", "x1", "y0", "y1", "one", "cells")).alias("regions"))

    e = F.col("env")
    t = F.greatest(F.greatest(e["maxx"] - e["minx"], e["maxy"] - e["miny"], F.lit(1.0)) * 1e-6, F.lit(1e-6))
    slack = 1e-6
    # the shape as plain columns, of which the outline takes what it needs
    corners = ("minx", "miny", "maxx", "maxy")
    plain = [c for c in shapes.columns if c not in (key, "env")]
    shape = {c: F.col(c) for c in plain} | {"env": {n: F.col(f"env_{n}") for n in corners}}
    bounded = lambda c, *more: F.struct(
        (outline(shape, (c["x0"] + c["x1"]) / 2, (c["y0"] + c["y1"]) / 2) - F.hypot(c["x1"] - c["x0"], c["y1"] - c["y0"]) / 2).alias("low"), outline(shape, c["one"]["x"], c["one"]["y"]).alias("high"), *[c[m] for m in more]
    )
    far = (lambda least: F.lit(reach + slack)) if reach is not None and not both else (lambda least: F.greatest(least * 2.5 + 2 * F.col("t") + slack, F.lit((reach or 0.0) + slack)))
    least = lambda boxes: F.array_min(F.transform(boxes, lambda b: b["high"]))

    def fine(open_: Column) -> Column:
        cells = F.transform(F.flatten(F.transform(open_, lambda r: r["cells"])), lambda c: bounded(c, "cx", "cy"))
        return once(cells, lambda b: once(far(least(b)), lambda limit: F.filter(b, lambda c: c["low"] <= limit)))

    def coarse() -> Column:
        made = F.transform("regions", lambda r: bounded(r, "cells"))
        return once(made, lambda b: once(far(least(b)), lambda limit: F.filter(b, lambda r: r["low"] <= limit)))

    flat = shapes.select(key, *plain, t.alias("t"), *[e[n].alias(f"env_{n}") for n in corners])
    names = [*plain, "t", *[f"env_{n}" for n in corners]]
    copies = shapes.groupBy(key).agg(F.least(F.lit(MOST_COPIES), F.ceil(F.count("*") / SHAPES_A_COPY)).cast("int").alias("copies"))
    flat = flat.join(copies, key).withColumn("copy", F.pmod(F.xxhash64(ident), F.col("copies")).cast("int"))
    maps = maps.join(copies, key).withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    # a number of tasks is named, as small tables would be taken together in one
    met = flat.drop("copies").repartition(DEALT, key, "copy").join(maps.drop("copies").repartition(DEALT, key, "copy"), [key, "copy"]).select(key, *names, F.explode(fine(coarse())).alias("c")).select(key, *names, "c.cx", "c.cy")
    exact = met.join(placed, [key, "cx", "cy"]).select(key, ident, "t", *kept, outline(shape, F.col("x"), F.col("y")).alias("distance"))
    if reach is not None and not both:
        return exact.filter(F.col("distance") <= reach).drop("t")
    limit = F.greatest(F.col("t"), F.min("distance").over(Window.partitionBy(key, ident)) * 2.5 + F.col("t"))
    out = exact.withColumn("in_band", F.col("distance") <= limit)
    if both:
        out = out.withColumn("in_reach", F.col("distance") <= (reach or 0.0)).filter("in_band or in_reach")
        return out.drop("t")
    return out.filter("in_band").drop("t", "in_band")
