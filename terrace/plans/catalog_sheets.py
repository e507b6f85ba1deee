"""Queries of nesting and cutting files on axis-parallel pieces, with SQL for what a closed form has: areas, counts, places."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import polygon as P
from terrace.functions.native import box_ring, env_of_box, ring_geom
from terrace.functions.shapes import g_distance
from terrace.operators import spatial
from terrace.operators.graph import checkpointed

from . import adapters as A
from . import export as X
from . import nesting as N
from .catalog import query

BED, MARGIN = (120.0, 80.0), 2.0


def box_geom(x0, y0, x1, y1):
    return ring_geom(box_ring(x0, y0, x1, y1))


def parcels(spark, d) -> DataFrame:
    """Twelve pieces a project."""
    k = F.col("p_partkey")
    w, h = (F.col("p_size") + 10).cast("double"), (k % 30 + 5).cast("double")
    return A.read(spark, d, "part").select(F.floor(k / 12).cast("string").alias("project"), k.cast("string").alias("id"), box_geom(F.lit(0.0), F.lit(0.0), w, h).alias("geom"), (w * h).alias("area"))


_LAYOUT = """SELECT CAST(p_partkey // 12 AS VARCHAR) AS project, count(*) AS pieces, sum((p_size + 10e0) * (p_partkey % 30 + 5)) AS area, 0 AS outside, 0 AS too_near, 0 AS cut,
  true AS enough FROM part GROUP BY p_partkey // 12"""


def layout_facts(placed: DataFrame, bed=BED, margin: float = MARGIN) -> DataFrame:
    """Per project: pieces, area, pieces outside of the margins, pairs of a sheet nearer than the margin, pieces of cut ones,
    and whether the sheets can hold the area."""
    placed = checkpointed(placed)  # the layouts are used twice
    e = F.col("geom.env")
    out = (e["minx"] < margin - 1e-6) | (e["miny"] < margin - 1e-6) | (e["maxx"] > bed[0] - margin + 1e-6) | (e["maxy"] > bed[1] - margin + 1e-6)
    facts = placed.groupBy("project").agg(
        F.count("*").alias("pieces"), F.round(F.sum("geom.area"), 4).alias("area"), F.count_if(out).alias("outside"), F.count_if(F.col("split").isNotNull()).alias("cut"),
        (F.max("sheet") + 1 >= F.ceil(F.sum("geom.area") / ((bed[0] - 2 * margin) * (bed[1] - 2 * margin)) - 1e-9)).alias("enough"),
    )
    half = margin / 2
    grown = placed.select(F.concat_ws("/", "project", F.col("sheet").cast("string")).alias("project"), F.col("project").alias("of"), "id", "geom", F.struct((e["minx"] - half).alias("minx"), (e["miny"] - half).alias("miny"), (e["maxx"] + half).alias("maxx"), (e["maxy"] + half).alias("maxy")).alias("env"))
    # shapes are no nearer than their boxes, so the kernel measures only where these are too near
    x, y = F.col("a.geom.env"), F.col("b.geom.env")
    gap = [F.greatest(x[f"min{c}"] - y[f"max{c}"], y[f"min{c}"] - x[f"max{c}"], F.lit(0.0)) for c in "xy"]
    near = spatial.self_pairs(grown).filter(F.hypot(*gap) < margin - 1e-6).repartition(spatial.DEALT).withColumn("gap", g_distance("a.geom", "b.geom")).filter(F.col("gap") < margin - 1e-6)
    bad = near.groupBy(F.col("a.of").alias("project")).agg(F.count("*").alias("bad"))
    return facts.join(bad, "project", "left").select("project", "pieces", "area", "outside", F.coalesce("bad", F.lit(0)).alias("too_near"), "cut", "enough")


@query("nested_sheets", _LAYOUT)
def nested_sheets(spark, d):
    """Layouts that keep pieces whole: all pieces, within the margins, apart from each other."""
    return layout_facts(N.nest_projects(parcels(spark, d), BED, MARGIN, effort=40))


@query("nested_sheets_for_usage", _LAYOUT)
def nested_sheets_for_usage(spark, d):
    """Layouts for the use of material, by more orders and rotations."""
    return layout_facts(N.nest_projects(parcels(spark, d), BED, MARGIN, priority="maximize_usage", effort=50))


@query("required_splits", "SELECT CAST(s_suppkey AS VARCHAR) AS project, CASE WHEN 150 + s_suppkey % 80 <= 192 THEN 2 ELSE 4 END AS parts, (150 + s_suppkey % 80) * 30e0 AS area, 'required' AS split, 0 AS outside FROM supplier")
def required_splits(spark, d):
    """Strips too long for the sheet are cut in halves until all parts fit."""
    k = F.col("s_suppkey")
    strips = A.read(spark, d, "supplier").select(k.cast("string").alias("project"), F.lit("s").alias("id"), box_geom(F.lit(0.0), F.lit(0.0), 150 + k % 80, F.lit(30.0)).alias("geom"))
    placed = checkpointed(N.nest_projects(strips, (100.0, 60.0), MARGIN))
    facts = layout_facts(placed, (100.0, 60.0)).select("project", F.col("pieces").alias("parts"), "area", "outside")
    return facts.join(placed.groupBy("project").agg(F.max("split").alias("split")), "project")


@query("exploded_pieces", "SELECT CAST(s_suppkey AS VARCHAR) AS project, 'm_' || k AS id, CASE k WHEN 0 THEN 100e0 ELSE 5e0 * (4 + s_suppkey % 9) END AS area FROM supplier, (SELECT unnest([0, 2]) AS k)")
def exploded_pieces(spark, d):
    """Parts of a piece are pieces; numbers count the tiny one that is dropped."""
    k = F.col("s_suppkey")
    ring = lambda x, w, h: F.struct(box_ring(F.lit(x), F.lit(0.0), F.lit(x) + w, h).alias("shell"), F.array().cast("array<array<struct<x:double,y:double>>>").alias("holes"))
    polys = F.array(ring(0.0, F.lit(10.0), F.lit(10.0)), ring(30.0, F.lit(0.1), F.lit(0.1)), ring(40.0, F.lit(5.0), (4 + k % 9).cast("double")))
    lines = F.array().cast("array<array<struct<x:double,y:double>>>")
    geom = F.struct(polys.alias("polys"), lines.alias("lines"), env_of_box(F.lit(0.0), F.lit(0.0), F.lit(45.0), F.lit(20.0)).alias("env"), (100 + 5.0 * (4 + k % 9) + 0.01).alias("area"))
    rows = A.read(spark, d, "supplier").select(k.cast("string").alias("project"), F.lit("m").alias("id"), geom.alias("geom"))
    return N.nest_projects(rows, BED, MARGIN).select("project", "id", F.round("geom.area", 6).alias("area"))


@query("plate_places", """SELECT CAST(id AS VARCHAR) AS project, 'base_' || (i + 1) AS plate, i // (cols * lines) AS sheet, 2 + i % (cols * lines) % cols * (w + 2e0) AS x, 2 + i % (cols * lines) // cols * (h + 2e0) AS y, round(1 + i * 0.5e0, 3) AS elevation
FROM (SELECT *, CAST(floor(118e0 / (w + 2)) AS BIGINT) AS cols, CAST(floor(78e0 / (h + 2)) AS BIGINT) AS lines, unnest(range(0, 3 + id % 9)) AS i FROM (SELECT s_suppkey AS id, 30e0 + s_suppkey % 20 AS w, 30e0 + s_suppkey % 20 AS h FROM supplier))""")
def plate_places(spark, d):
    """Plates of a run-length base go on sheets of their own, in a grid."""
    k = F.col("s_suppkey")
    side = (30 + k % 20).cast("double")
    rows = A.read(spark, d, "supplier").select(
        k.cast("string").alias("project"), F.lit("base").alias("id"), box_geom(F.lit(0.0), F.lit(0.0), side, side).alias("geom"), F.lit(True).alias("zero_base"), (3 + k % 9).cast("int").alias("repeat_count"),
        F.lit(1.0).alias("repeat_start"), F.lit(0.5).alias("repeat_interval"),
    )
    placed = N.nest_projects(rows, BED, MARGIN)
    return placed.select("project", F.col("id").alias("plate"), F.col("sheet").cast("long").alias("sheet"), F.round("geom.env.minx", 6).alias("x"), F.round("geom.env.miny", 6).alias("y"), "elevation")


@query("label_areas", "SELECT CAST(s_suppkey AS VARCHAR) AS id, CASE s_suppkey % 5 WHEN 0 THEN 16e0 WHEN 1 THEN 50e0 WHEN 2 THEN 30e0 WHEN 3 THEN 9e0 ELSE 0e0 END AS area FROM supplier")
def label_areas(spark, d):
    """Where a label may go: a stated area, else the support, else what is hidden, else a closed engraving; within the piece."""

    @F.pandas_udf("double")
    def area(ident: pd.Series) -> pd.Series:
        out = []
        for i in ident:
            kind = i % 5
            piece = N.Piece(str(i), str(i), P.box(0, 0, 20, 20), [], [])
            ring = P.rings(P.box(3, 3, 6, 6))[0]
            piece.labels = P.box(2, 2, 6, 6) + P.box(9, 9, 9.1, 9.1) if kind == 0 else P.box(9, 9, 9.1, 9.1)
            piece.support = P.box(10, 0, 30, 5) if kind <= 1 else []
            piece.hidden = P.box(0, 0, 5, 6) if kind <= 2 else []
            piece.engraving = [np.vstack([ring, ring[:1]])] if kind <= 3 else [ring]
            out.append(round(P.area(N.label_areas(piece)), 6))
        return pd.Series(out)

    return A.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("id"), area("s_suppkey").alias("area"))


# --- cutting files


def one_piece_sheets(spark, d, label: bool = False) -> DataFrame:
    """Placed rows: a box in the lower left corner of each sheet, within a margin of 5."""
    k = F.col("s_suppkey")
    w, h = (20 + k % 11).cast("double"), (10 + k % 7).cast("double")
    lines = F.array().cast("array<array<struct<x:double,y:double>>>")
    none = F.struct(F.array().cast("array<struct<shell:array<struct<x:double,y:double>>,holes:array<array<struct<x:double,y:double>>>>>").alias("polys"), lines.alias("lines"), F.lit(None).cast("struct<minx:double,miny:double,maxx:double,maxy:double>").alias("env"), F.lit(0.0).alias("area"))
    return A.read(spark, d, "supplier").select(
        (k % 5).cast("string").alias("project"), F.floor(k / 5).cast("int").alias("sheet"), F.lit(0).alias("seq"), k.cast("string").alias("id"), (F.lit(7.25) if label else F.lit(None)).cast("double").alias("elevation"), F.lit(None).cast("double").alias("source_elevation"),
        box_geom(F.lit(5.0), F.lit(5.0), w + 5, h + 5).alias("geom"), none.alias("engraving"), none.alias("labels"),
    )


_ROLES = """(SELECT CAST(s_suppkey % 5 AS VARCHAR) AS project, CAST(s_suppkey // 5 AS INT) AS sheet, role, CASE role WHEN 'bed' THEN 400e0 WHEN 'cut' THEN 2e0 * (20 + s_suppkey % 11 + 10 + s_suppkey % 7)
  ELSE 360e0 - (21e0 + s_suppkey % 11) - (11e0 + s_suppkey % 7) END AS length FROM supplier, (SELECT unnest(['bed', 'cut', 'margin']) AS role))"""


@query("sheet_linework", f"SELECT project, sheet, role, round(length, 4) AS length FROM {_ROLES}")
def sheet_linework(spark, d):
    """Lengths of a sheet's lines by role: the margin gives way around the piece, and no line is drawn twice."""
    segs = X.linework(one_piece_sheets(spark, d), BED, 5.0)
    return segs.groupBy("project", "sheet", "role").agg(F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 4).alias("length"))


@query("sheet_labels", "SELECT CAST(s_suppkey % 5 AS VARCHAR) AS project, CAST(s_suppkey // 5 AS INT) AS sheet, round(5e0 + 20 + s_suppkey % 11 + 3 + 3 * 0.08e0, 4) AS minx, round(5e0 + (10 + s_suppkey % 7) / 2e0 - 1.5e0, 4) AS miny FROM supplier")
def sheet_labels(spark, d):
    """A label beside a piece that has no room below: a gap after it, level with its middle; its first glyph is a seven."""
    segs = X.linework(one_piece_sheets(spark, d, True), BED, 5.0).filter("role = 'mark'")
    return segs.groupBy("project", "sheet").agg(F.round(F.min(F.least("x0", "x1")), 4).alias("minx"), F.round(F.min(F.least("y0", "y1")), 4).alias("miny"))


def exported(spark, d, units: str = "auto") -> DataFrame:
    """Drawings of the sheets: file, dxf."""
    out = X.to_dxf(X.linework(one_piece_sheets(spark, d), BED, 5.0), units=units)
    return out.select(F.concat_ws("/", "project", F.col("sheet").cast("string")).alias("file"), "dxf")


_NAMES = "CASE role WHEN 'bed' THEN 'Placa' WHEN 'cut' THEN 'CORTE' ELSE 'MargemSeguranca' END"


@query("exported_drawings", f"SELECT project || '/' || sheet AS file, {_NAMES} AS layer, round(length * 0.1e0, 4) AS length FROM {_ROLES}")
def exported_drawings(spark, d):
    """Lines of the drawings, in centimetres, as they are read back."""
    segs = X.drawing_segments(X.reread(exported(spark, d, "centímetros (cm)")))
    return segs.groupBy("file", "layer").agg(F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 4).alias("length"))


@query("exported_issues", "SELECT '-' AS file, '-' AS type WHERE false")
def exported_issues(spark, d):
    """Exported drawings have no issues."""
    sheets = checkpointed(exported(spark, d))
    return X.verify(checkpointed(X.reread(sheets)), X.defined_layers(sheets)).select("file", "type")


@query("spoilt_drawings", "SELECT CAST(s_suppkey AS VARCHAR) AS file, 'invalid_dxf' AS type FROM supplier")
def spoilt_drawings(spark, d):
    """Text that is no drawing gives one issue and no entities."""
    sheets = A.read(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("file"), F.col("s_name").alias("dxf"))
    return X.verify(X.reread(sheets), sheets.select("file", F.lit("x").alias("layer")).limit(0)).select("file", "type")


@query("pictured_sheets", """SELECT CAST(s_suppkey % 5 AS VARCHAR) AS project, CAST(s_suppkey // 5 AS INT) AS sheet, 5 AS groups, true AS labelled, '0 0 120 80' AS view FROM supplier""")
def pictured_sheets(spark, d):
    """Pictures of the sheets: a group for each role and the label as a comment."""
    placed = one_piece_sheets(spark, d, True)
    rows = X.to_svg(X.linework(placed, BED, 5.0), BED, placed=placed)
    return rows.select("project", "sheet", F.regexp_count("svg", F.lit("<g ")).alias("groups"), F.col("svg").contains("<!-- 7.25 -->").alias("labelled"), F.regexp_extract("svg", 'viewBox="([^"]*)"', 1).alias("view"))


@query("combined_drawings", f"SELECT project, {_NAMES} AS layer, round(sum(length), 3) AS length FROM {_ROLES} GROUP BY project, role")
def combined_drawings(spark, d):
    """All sheets of a project in one drawing."""
    out = X.combined_dxf(X.linework(one_piece_sheets(spark, d), BED, 5.0), BED).select(F.col("project").alias("file"), "dxf")
    segs = X.drawing_segments(X.reread(out))
    return segs.groupBy(F.col("file").alias("project"), "layer").agg(F.round(F.sum(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))), 3).alias("length"))


@query("touching_sheets", "SELECT CAST(s_suppkey % 5 AS VARCHAR) AS project, count(*) AS sheets, 1 AS drawn FROM supplier GROUP BY s_suppkey % 5")
def touching_sheets(spark, d):
    """Without a gap between sheets their common edges are drawn once: no two lines of the drawing lie on each other."""
    placed = one_piece_sheets(spark, d)
    out = X.combined_dxf(X.linework(placed, BED, 5.0), BED, gap=0.0).select(F.col("project").alias("file"), "dxf")
    met = X.overlapping(X.drawing_segments(X.reread(out))).groupBy("file").agg(F.count("*").alias("n"))
    sheets = placed.groupBy("project").agg(F.count_distinct("sheet").alias("sheets"))
    return sheets.join(met.withColumnRenamed("file", "project"), "project", "left").select("project", "sheets", (1 + F.coalesce("n", F.lit(0))).cast("int").alias("drawn"))
