"""Queries of scalar rules, override maps, layer rules and tables of edits, with SQL that states the rules once more."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import scalars as S
from terrace.operators import rules as R

from . import adapters as A
from . import export as X
from . import nesting as N
from .adapters import CONTOURS, SEGMENTS
from .catalog import query, texts, _TEXTS

_UNITS = ["auto", "automatico", "automático", "Automatico (mm)", "automático (mm)", "mm", "milimetros", "milímetros", "milimetros (mm)", "Milímetros (mm)", " CM ", "centimetros", "centímetros", "centimetros (cm)", "centímetros (cm)", "m", "METROS", "metros (m)", "inch", "", None]
_UNIT_LIST = ", ".join("NULL" if u is None else f"'{u}'" for u in _UNITS)


def _pick(values: list, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


@query("unit_names", f"""SELECT id, CASE WHEN u IN ('cm', 'centimetros', 'centímetros', 'centimetros (cm)', 'centímetros (cm)') THEN 'cm' WHEN u IN ('m', 'metros', 'metros (m)') THEN 'm'
  WHEN u IN ('mm', 'milimetros', 'milímetros', 'milimetros (mm)', 'milímetros (mm)') THEN 'mm' ELSE 'auto' END AS unit,
  CASE WHEN u IN ('cm', 'centimetros', 'centímetros', 'centimetros (cm)', 'centímetros (cm)') THEN 0.1e0 WHEN u IN ('m', 'metros', 'metros (m)') THEN 0.001e0 ELSE 1e0 END AS factor
FROM (SELECT p_partkey AS id, lower(trim([{_UNIT_LIST}][p_partkey % {len(_UNITS)} + 1])) AS u FROM part)""")
def unit_names(spark, d):
    """Every alias of the export units, in odd cases, unknown names and null."""
    name = _pick(_UNITS, F.col("p_partkey"))
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), S.unit_name(name).alias("unit"), S.unit_factor(name).alias("factor"))


_FLOAT = "try_cast(replace(trim(t), ',', '.') AS DOUBLE)"


@query("loose_numbers", f"SELECT id, CASE WHEN NOT isnan(v) THEN v END AS number, v IS NOT NULL AND isnan(v) AS odd, CASE WHEN isfinite(v) AND v = floor(v) THEN CAST(v AS BIGINT) END AS whole FROM (SELECT id, {_FLOAT} AS v FROM {_TEXTS})")
def loose_numbers(spark, d):
    """Numbers with a comma or a point, finite or not."""
    v = S.to_float(F.col("t"))
    return texts(spark, d).select("id", F.when(~F.isnan(v), v).alias("number"), (v.isNotNull() & F.isnan(v)).alias("odd"), S.to_int(F.col("t")).alias("whole"))


@query("lattice_angles", """SELECT id, count(*) AS n, round(sum(a), 4) AS total, max(a) AS most FROM (SELECT DISTINCT id, (round(((a % 360) + 360) % 360, 6)) % 360 AS a FROM (
  SELECT p_partkey AS id, unnest(range(0, CAST(ceil(360e0 / (10 + p_size % 7 * 5)) AS BIGINT))) * (10e0 + p_size % 7 * 5) AS a FROM part
  UNION ALL SELECT p_partkey, unnest([0, 90, 180, 270]) - p_size * 1.5e0 FROM part)) GROUP BY id""")
def lattice_angles(spark, d):
    """Rotations of a lattice with those that fit a shape."""
    fitted = F.transform(F.array(*map(F.lit, (0, 90, 180, 270))), lambda q: q - F.col("p_size") * 1.5)
    angles = S.rotation_angles(10.0 + F.col("p_size") % 7 * 5, fitted)
    total = F.aggregate(angles, F.lit(0.0), lambda s, x: s + x)
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.size(angles).cast("long").alias("n"), F.round(total, 4).alias("total"), F.array_max(angles).alias("most"))


_PRIORITIES = ["maximize_usage", " Usage ", "AREA", "ocupacao", "ocupação", "maximize", "preserve_shapes", "", None]
_PRIORITY_LIST = ", ".join("NULL" if u is None else f"'{u}'" for u in _PRIORITIES)


@query("effort_limits", f"""SELECT id, u AS usage, CASE WHEN u THEN CASE WHEN e >= 85 THEN 40 WHEN e >= 65 THEN 32 WHEN e >= 45 THEN 24 WHEN e >= 25 THEN 16 ELSE 10 END
    ELSE CASE WHEN e >= 75 THEN 24 WHEN e >= 40 THEN 16 ELSE 10 END END AS axis,
  CASE WHEN u THEN CASE WHEN e >= 85 THEN 180 WHEN e >= 65 THEN 120 WHEN e >= 45 THEN 80 WHEN e >= 25 THEN 48 ELSE 24 END
    ELSE CASE WHEN e >= 75 THEN 80 WHEN e >= 40 THEN 48 ELSE 24 END END AS positions,
  CASE WHEN u THEN CASE WHEN n > 60 OR e < 35 THEN 0 WHEN e < 70 THEN least(1, n) ELSE least(2, n) END ELSE least(2, n, CAST(floor(n * (100 - w) / 100e0) AS BIGINT)) END AS splits
FROM (SELECT p_partkey AS id, coalesce(lower(trim([{_PRIORITY_LIST}][p_partkey % {len(_PRIORITIES)} + 1])) IN ('maximize_usage', 'usage', 'area', 'ocupacao', 'ocupação'), false) AS u,
  p_partkey * 7 % 101 AS e, p_partkey % 70 AS n, p_partkey * 13 % 101 AS w FROM part)""")
def effort_limits(spark, d):
    """How far a search goes, by priority and effort, and how many pieces may be cut on trial."""
    k = F.col("p_partkey")
    usage = S.layout_priority(F.coalesce(_pick(_PRIORITIES, k), F.lit(""))) == "maximize_usage"
    most = N.limits_column(k * 7 % 101, usage)
    splits = N.budget_column(usage, k % 70, k * 7 % 101, k * 13 % 101)
    return A.read(spark, d, "part").select(k.alias("id"), usage.alias("usage"), most["axis"].alias("axis"), most["positions"].alias("positions"), splits.cast("long").alias("splits"))


@query("scale_calculator", """SELECT id, round(real / mm[1 + id % 3], 6) AS in_file, round(real / (250e0 / (1 + id % 2)) / CASE id % 4 WHEN 0 THEN 1 WHEN 1 THEN 10 WHEN 2 THEN 1000 ELSE 1 END, 6) AS on_model,
  round(greatest((1 + id % 2) * real / 40e0, 0.0001), 6) AS denominator
FROM (SELECT p_partkey AS id, [1e0, 10e0, 1000e0] AS mm, greatest(p_size - 10e0, 0e0) * CASE p_partkey % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 10e0 ELSE 1000e0 END AS real FROM part)""")
def scale_calculator(spark, d):
    """Measures in the drawing, in nature and on the model, whose unit may be unknown."""
    k = F.col("p_partkey")
    unit = _pick(["mm", "cm", "m", "?"], k)
    real = S.measure_mm(F.col("p_size") - 10.0, unit)
    left = (1 + k % 2).cast("double")
    return A.read(spark, d, "part").select(
        k.alias("id"), S.file_measure(real, F.lit(1.0), F.lit(1.0), _pick(["mm", "cm", "m"], k)).alias("in_file"), S.model_measure(real, left, F.lit(250.0), unit).alias("on_model"),
        S.scale_denominator(real, F.lit(40.0), left).alias("denominator"),
    )


@query("relief_heights", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 4 > 0 THEN p_size * 0.5e0 END, p_partkey % 9) * 2.5e0 AS z, greatest(0e0, least(30e0, p_size * 1e0)) AS clamped, p_size + 3e0 AS right_edge FROM part")
def relief_heights(spark, d):
    """Heights of layers in a relief; those without an elevation stand at their number."""
    from terrace.functions.native import env_of_box

    s, zero = F.col("p_size"), F.lit(0.0)
    env = S.offset_bounds(env_of_box(zero, zero, s, s), F.lit(3.0), F.lit(-1.0))
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), S.relief_height(F.when(s % 4 > 0, s * 0.5), F.col("p_partkey") % 9, F.lit(2.5)).alias("z"), S.clamp(s.cast("double"), 0.0, 30.0).alias("clamped"), env["maxx"].alias("right_edge"))


@query("precision_and_costs", """SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN 0.5e0 WHEN p_size % 3 = 1 THEN 2e0 ELSE CASE WHEN p_partkey % 2 = 0 THEN 5e0 ELSE 0e0 END END AS step,
  abs(p_size * 1e-7) <= 1e-6 AS same, CASE abs(p_size % 5 - p_partkey % 5) WHEN 1 THEN 0e0 WHEN 0 THEN 2e0 ELSE 80e0 * (abs(p_size % 5 - p_partkey % 5) - 1) ** 2 END AS edge_cost,
  CASE WHEN p_size % 4 = 0 THEN 0e0 ELSE 0.25e0 * (p_size % 5 - p_partkey % 5) ** 2 END AS node_cost FROM part""")
def precision_and_costs(spark, d):
    """The step that levels are taken to, equal elevations, and the costs of labels."""
    s, k = F.col("p_size"), F.col("p_partkey")
    step = S.topographic_step(F.when(s % 3 == 0, 0.5).otherwise(-1.0), F.when(s % 3 == 1, 2.0).otherwise(0.0), F.when(k % 2 == 0, 5.0))
    return A.read(spark, d, "part").select(
        k.alias("id"), step.alias("step"), S.same_elevation(s * 1e-7, F.lit(0.0)).alias("same"),
        S.level_edge_cost(s % 5, k % 5).cast("double").alias("edge_cost"), S.node_level_cost(s % 5, F.when(s % 4 > 0, k % 5), F.lit(0.25)).cast("double").alias("node_cost"),
    )


# --- overrides


def override_rows(spark, d, shift: int = 0) -> DataFrame:
    """Raw rows of a table of overrides: ids with blanks around, blank and null values, ids that are one when trimmed."""
    k = F.col("c_custkey") + shift
    ident = F.concat(F.lit("  ").substr(F.lit(1), (k % 3).cast("int")), F.when(k % 11 == 0, "").otherwise((k - k % 2 * (k % 4 % 3)).cast("string")))
    value = F.when(k % 5 == 0, None).when(k % 5 == 1, " ").otherwise(F.col("c_mktsegment"))
    field = _pick(["keep", "forced_source", "forced_layer"], k)
    return A.read(spark, d, "customer").select(ident.alias("id"), field.alias("field"), value.alias("value"), F.col("c_custkey").alias("ord"))


def _override_sql(shift: int) -> str:
    k = f"(c_custkey + {shift})"
    return f"""(SELECT substr('  ', 1, {k} % 3) || CASE WHEN {k} % 11 = 0 THEN '' ELSE CAST({k} - {k} % 2 * ({k} % 4 % 3) AS VARCHAR) END AS id, ['keep', 'forced_source', 'forced_layer'][{k} % 3 + 1] AS field,
  CASE WHEN {k} % 5 = 0 THEN NULL WHEN {k} % 5 = 1 THEN ' ' ELSE c_mktsegment END AS value, c_custkey AS ord FROM customer)"""


def _normal_sql(name: str, shift: int) -> str:
    return f"""{name}_own AS (SELECT *, trim(id) AS k FROM {_override_sql(shift)} WHERE trim(id) <> '' AND (field = 'keep' OR trim(value) <> '')),
{name} AS (SELECT k AS id, field, value FROM (SELECT *, row_number() OVER (PARTITION BY k, field ORDER BY ord DESC) AS r FROM {name}_own
   WHERE (k, id) IN (SELECT k, id FROM (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY ord DESC) AS r FROM {name}_own) WHERE r = 1)) WHERE r = 1)"""


@query("override_normalized", f"WITH {_normal_sql('o', 0)} SELECT * FROM o")
def override_normalized(spark, d):
    return R.normalized_overrides(override_rows(spark, d))


@query("override_effective", f"""WITH {_normal_sql('p', 0)}, {_normal_sql('s', 2)} SELECT coalesce(s.id, p.id) AS id, coalesce(s.field, p.field) AS field, CASE WHEN s.id IS NOT NULL THEN s.value ELSE p.value END AS value
FROM p FULL JOIN s ON p.id = s.id AND p.field = s.field""")
def override_effective(spark, d):
    """The summary's overrides were applied last, so they win field by field."""
    return R.effective_overrides(override_rows(spark, d), override_rows(spark, d, 2), "summary")


@query("edited_rows", """SELECT e.id, source, layer, source IS NOT NULL AND (o.s IS NULL OR abs(source - o.s) > 1e-9) AS changed_source, layer IS NOT NULL AND (o.l IS NULL OR abs(layer - o.l) > 1e-9) AS changed_layer
FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 > 0 THEN round(o_totalprice, 0) + CASE WHEN o_orderkey % 8 = 5 THEN 1 ELSE 0 END END AS source, CASE WHEN o_orderkey % 3 > 0 THEN o_custkey % 10 + CASE WHEN o_orderkey % 7 = 2 THEN 1 ELSE 0 END END AS layer FROM orders) e
LEFT JOIN (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 > 0 THEN round(o_totalprice, 0) END AS s, o_custkey % 10 AS l FROM orders WHERE o_orderkey % 10 > 0) o USING (id)
WHERE (source IS NOT NULL AND (o.s IS NULL OR abs(source - o.s) > 1e-9)) OR (layer IS NOT NULL AND (o.l IS NULL OR abs(layer - o.l) > 1e-9))""")
def edited_rows(spark, d):
    """Rows of an edited table that differ from the original, with what differs."""
    k, price, layer = F.col("o_orderkey"), F.round("o_totalprice", 0), F.col("o_custkey") % 10
    orders = A.read(spark, d, "orders")
    was = orders.filter(k % 10 > 0).select(k.alias("id"), F.when(k % 9 > 0, price).alias("source"), layer.alias("layer"))
    now = orders.select(k.alias("id"), F.when(k % 4 > 0, price + F.when(k % 8 == 5, 1).otherwise(0)).alias("source"), F.when(k % 3 > 0, layer + F.when(k % 7 == 2, 1).otherwise(0)).alias("layer"))
    return R.changed_rows(was, now, "id", ["source", "layer"])


# --- layers of drawings

_LAYERS = ["Casa", "topo", "0", "boundary", "LIMITE", "camadas"]
DRAWN = """(SELECT s_suppkey % 5 AS project, s_suppkey AS id, ['Casa', 'topo', '0', 'boundary', 'LIMITE', 'camadas'][(s_suppkey // 5) % (s_suppkey % 5 + 2) + 1] AS layer,
  CAST((20 + s_suppkey % 60) * (20 + s_suppkey % 45) AS DOUBLE) AS area FROM supplier)"""
DRAWN_POINTS = "(SELECT event_id % 5 AS project, event_id AS point, value AS z, CASE event_id % 5 WHEN 0 THEN 'only' WHEN 3 THEN ['3D_Pontos', 'casa'][event_id // 5 % 2 + 1] ELSE event_type END AS layer FROM events)"


def drawn(spark, d) -> DataFrame:
    k = F.col("s_suppkey")
    layer = F.element_at(F.array(*map(F.lit, _LAYERS)), (F.floor(k / 5) % (k % 5 + 2) + 1).cast("int"))
    return A.read(spark, d, "supplier").select((k % 5).alias("project"), k.alias("id"), layer.alias("layer"), ((20 + k % 60) * (20 + k % 45)).cast("double").alias("area"))


def drawn_points(spark, d) -> DataFrame:
    k = F.col("event_id")
    other = F.element_at(F.array(F.lit("3D_Pontos"), F.lit("casa")), (F.floor(k / 5) % 2 + 1).cast("int"))
    return A.read(spark, d, "events").select((k % 5).alias("project"), k.alias("point"), F.col("value").alias("z"), F.when(k % 5 == 0, "only").when(k % 5 == 3, other).otherwise(F.col("event_type")).alias("layer"))


_SUGGESTED = f"""l AS (SELECT project, list_sort(list(DISTINCT layer)) AS layers FROM {DRAWN} GROUP BY project), pl AS (SELECT project, list_sort(list(DISTINCT layer)) AS points FROM {DRAWN_POINTS} GROUP BY project),
b AS (SELECT *, list_filter(layers, lambda x: lower(x) IN ('boundary', 'limite', 'perimetro', 'contorno'))[1] AS boundary_layer FROM l LEFT JOIN pl USING (project)),
o AS (SELECT *, list_filter(layers, lambda x: boundary_layer IS NULL OR x <> boundary_layer) AS options FROM b),
c AS (SELECT *, list_filter(options, lambda x: lower(x) IN ('topografia', 'topography', 'topo')) AS named, list_filter(options, lambda x: lower(x) NOT IN ('boundary', 'camadas', '3d_pontos', '0') AND (boundary_layer IS NULL OR lower(x) <> lower(boundary_layer))) AS plain FROM o),
suggested AS (SELECT project, boundary_layer, CASE WHEN len(named) > 0 THEN named WHEN len(plain) > 0 THEN plain ELSE options END AS contour_layers,
  coalesce(list_filter(points, lambda x: lower(x) IN ('3d_pontos', '3dpoints', 'pontos_3d', 'topografia_pontos'))[1], CASE WHEN len(points) = 1 THEN points[1] END) AS point_layer FROM c)"""


@query("suggested_layers", f"WITH {_SUGGESTED} SELECT project, boundary_layer, array_to_string(contour_layers, ',') AS contours, point_layer FROM suggested")
def suggested_layers(spark, d):
    """Which layers of a drawing are the boundary, the contours and the points, by their names."""
    rows = R.suggested_layers(drawn(spark, d), drawn_points(spark, d))
    return rows.select("project", "boundary_layer", F.array_join("contour_layers", ",").alias("contours"), "point_layer")


@query("active_polygons", f"WITH {_SUGGESTED} SELECT p.project, p.id, p.layer FROM {DRAWN} p JOIN suggested s USING (project) WHERE list_contains(contour_layers, layer) OR layer = boundary_layer OR (boundary_layer IS NULL AND lower(layer) = 'boundary')")
def active_polygons(spark, d):
    shapes = drawn(spark, d)
    return R.active_polygons(shapes, R.suggested_layers(shapes, drawn_points(spark, d))).select("project", "id", "layer")


@query("active_points", f"WITH {_SUGGESTED} SELECT p.project, p.point, p.z FROM {DRAWN_POINTS} p JOIN suggested s ON p.project = s.project AND p.layer = s.point_layer")
def active_points(spark, d):
    """Points of the point layer; without one there are none."""
    points = drawn_points(spark, d)
    chosen = R.suggested_layers(drawn(spark, d), points).select("project", F.col("point_layer").alias("layer"))
    return points.join(chosen, ["project", "layer"]).select("project", "point", "z")


def _boundary_sql(name: str) -> str:
    return f"""WITH n AS (SELECT p.*, coalesce(CASE WHEN b.bl IS NOT NULL THEN layer = b.bl ELSE lower(layer) = 'boundary' END, false) AS is_b FROM {DRAWN} p LEFT JOIN (SELECT 4 AS project, '{name}' AS bl) b USING (project)),
m AS (SELECT *, max(is_b) OVER (PARTITION BY project) AS has, first_value(id) OVER (PARTITION BY project ORDER BY is_b DESC, area DESC, id) AS one, first_value(id) OVER (PARTITION BY project ORDER BY area DESC, id) AS any_one FROM n)
SELECT project, id, layer, CASE WHEN has THEN one ELSE any_one END AS boundary_id, is_b AND id = one AS outer_shape,
  CASE WHEN NOT (is_b AND id = one) THEN row_number() OVER (PARTITION BY project, is_b AND id = one ORDER BY is_b AND id <> one, id) END AS place FROM m"""


@query("boundary_and_contours", _boundary_sql("Casa"))
def boundary_and_contours(spark, d):
    """The boundary of each drawing, by the named layer (one drawing has one) or by its name, and the order of the contours."""
    named = spark.createDataFrame([(4, "Casa")], "project long, boundary_layer string")
    rows = R.boundary_and_contours(drawn(spark, d), named)
    place = F.row_number().over(Window.partitionBy("project", "outer").orderBy("late", "id"))
    return rows.select("project", "id", "layer", "boundary_id", F.col("outer").alias("outer_shape"), F.when(~F.col("outer"), place).cast("long").alias("place"))


@query("excluded_layers", f"SELECT project, id, CASE WHEN lower(layer) <> 'camadas' THEN area END AS elevation FROM {DRAWN}")
def excluded_layers(spark, d):
    """Shapes of excluded layers stay, without an elevation."""
    return R.without_layers(drawn(spark, d).withColumnRenamed("area", "elevation"), "elevation").select("project", "id", "elevation")


@query("repeat_groups", "SELECT p_partkey AS id, p_size % 3 = 0 AND coalesce(CASE WHEN p_partkey % 5 > 0 THEN p_size % 4 END, 1) > 1 AS repeated FROM part")
def repeat_groups(spark, d):
    """Run-length layers of the base, which are laid out as plates."""
    zero, count = F.when(F.col("p_size") % 3 == 0, True), F.when(F.col("p_partkey") % 5 > 0, F.col("p_size") % 4)
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), R.is_repeat_group(zero, count).alias("repeated"))


@query("split_sources", "SELECT CAST(l_orderkey AS VARCHAR) AS source, count(*) AS parts, sum(l_linenumber) AS numbers FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")
def split_sources(spark, d):
    """Pieces of sources that were cut."""
    pieces = A.read(spark, d, "lineitem").select(F.lit(0).alias("project"), F.col("l_orderkey").cast("string").alias("source"), "l_linenumber")
    return R.split_sources(pieces).groupBy("source").agg(F.first("parts").alias("parts"), F.sum("l_linenumber").cast("long").alias("numbers"))


@query("sampled_vertices", "SELECT id, n, CASE WHEN n <= 600 THEN n ELSE (n - 1) // k + 1 + CASE WHEN (n - 1) % k > 0 THEN 1 ELSE 0 END END AS kept FROM (SELECT p_partkey AS id, p_partkey * 3 % 2500 + 1 AS n, greatest((p_partkey * 3 % 2500 + 1) // 600, 1) AS k FROM part)")
def sampled_vertices(spark, d):
    """Of long lines every k-th point and the last."""
    n = F.col("p_partkey") * 3 % 2500 + 1
    points = F.transform(F.sequence(F.lit(1).cast("long"), n), lambda i: F.struct(i.cast("double").alias("x"), F.lit(0.0).alias("y")))
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), n.alias("n"), F.size(R.sampled(points)).cast("long").alias("kept"))


@query("thinned_axis", """WITH v AS (SELECT DISTINCT s_nationkey AS id, CAST(s_suppkey * 37 % 100 AS DOUBLE) AS v FROM supplier WHERE s_suppkey * 37 % 100 <= 80),
r AS (SELECT id, v, row_number() OVER (PARTITION BY id ORDER BY v) - 1 AS i, count(*) OVER (PARTITION BY id) AS n FROM v),
w AS (SELECT id, n, unnest(CASE WHEN n <= 4 THEN range(0, n) ELSE list_slice(list_sort(list_distinct([0, n - 1, 0, CAST(round_even((n - 1) * 1e0, 0) AS BIGINT)])), 1, 4) END) AS i FROM (SELECT DISTINCT id, n FROM r))
SELECT id, count(*) AS kept, sum(v) AS total FROM w JOIN r USING (id, i, n) GROUP BY id""")
def thinned_axis(spark, d):
    """Candidates of an axis: the ends and evenly spaced ones."""
    k = F.col("s_suppkey")
    rows = A.read(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("id")).agg(F.collect_list((k * 37 % 100).cast("double")).alias("v"))
    kept = R.thinned(F.col("v"), F.lit(0.0), F.lit(80.0), 4)
    return rows.withColumn("kept_values", kept).filter(F.size("kept_values") > 0).select("id", F.size("kept_values").cast("long").alias("kept"), F.aggregate("kept_values", F.lit(0.0), lambda s, x: s + x).alias("total"))


@query("engraving_changes", f"SELECT layer, id // 10 AS part, bool_or(id % 7 = 0) AS changed FROM {SEGMENTS} GROUP BY layer, id // 10")
def engraving_changes(spark, d):
    """Rows whose engraving is another after it was made anew: lines are compared as sets, whatever their order."""
    pt = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    segs = A.segments(spark, d).withColumn("part", F.floor(F.col("id") / 10))
    line = F.array(pt(F.col("x0"), F.col("y0")), pt(F.col("x1"), F.col("y1")))
    moved = F.array(pt(F.col("x0"), F.col("y0")), pt(F.col("x1") + F.when(F.col("id") % 7 == 0, 0.5).otherwise(0.0), F.col("y1") + F.when(F.col("id") % 7 == 0, 0.5).otherwise(0.0)))
    rows = segs.groupBy("layer", "part").agg(F.collect_list(line).alias("old"), F.reverse(F.collect_list(moved)).alias("new"))
    return rows.select("layer", "part", (R.line_signature(F.col("old")) != R.line_signature(F.col("new"))).alias("changed"))


# --- drawings and issues


def entities(spark, d) -> DataFrame:
    """Rows of ``read_drawings`` made from a table: some of another kind, on an unknown layer, or with a colour of its own."""
    k = F.col("p_partkey")
    pt = lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), F.lit(0.0).alias("z"))
    points = F.array(pt(k * 13, k * 0), pt(k * 13 + 5, k * 0))
    return A.read(spark, d, "part").select(
        (k % 7).cast("string").alias("file"), k.cast("int").alias("entity"), F.when(k % 10 == 3, "CIRCLE").otherwise("LINE").alias("kind"), F.when(k % 9 == 4, "Casa").otherwise("MANCHA").alias("layer"),
        F.lit(False).alias("closed"), F.when(k % 8 == 5, 3).otherwise(256).cast("int").alias("color"), F.when(k % 16 == 2, "DASHED").otherwise("BYLAYER").alias("linetype"), F.lit(-1).alias("lineweight"), points.alias("points"), F.lit(None).cast("string").alias("error"),
    )


_ENTITIES = "(SELECT CAST(p_partkey % 7 AS VARCHAR) AS file, p_partkey AS k, CASE WHEN p_partkey % 10 = 3 THEN 'CIRCLE' ELSE 'LINE' END AS kind, CASE WHEN p_partkey % 9 = 4 THEN 'Casa' ELSE 'MANCHA' END AS layer, p_partkey % 8 = 5 AS colored, p_partkey % 16 = 2 AS dashed FROM part)"


@query("entity_counts", f"SELECT file, kind, layer, count(*) AS n FROM {_ENTITIES} GROUP BY GROUPING SETS ((file, kind), (file, layer), (file))")
def entity_counts(spark, d):
    """Entities of each drawing by kind, by layer and in total."""
    return R.entity_counts(entities(spark, d))


_CONFIG = "(SELECT unnest(['CORTE', 'GRAVAÇÃO', 'MANCHA', 'Placa', 'MargemSeguranca']) AS layer)"


@query("drawing_issues", f"""SELECT file, type, count(*) AS n FROM (SELECT file, 'unsupported_entity' AS type FROM {_ENTITIES} WHERE kind <> 'LINE' UNION ALL SELECT file, 'unexpected_layer' FROM {_ENTITIES} WHERE layer = 'Casa'
UNION ALL SELECT file, 'not_bylayer' FROM {_ENTITIES} WHERE colored UNION ALL SELECT file, 'not_bylayer' FROM {_ENTITIES} WHERE dashed
UNION ALL SELECT f.file, 'missing_layer_definition' FROM (SELECT DISTINCT file FROM {_ENTITIES}) f CROSS JOIN {_CONFIG} c WHERE c.layer <> 'MANCHA') GROUP BY ALL""")
def drawing_issues(spark, d):
    """Issues of exported drawings: entities, layers, properties that are not by layer, layers that are not defined."""
    rows = entities(spark, d)
    return X.verify(rows, rows.select("file", "layer").distinct()).groupBy("file", "type").agg(F.count("*").alias("n"))


@query("issue_summary", f"""WITH i AS (SELECT file, k AS ord, 'unsupported_entity' AS type, layer FROM {_ENTITIES} WHERE kind <> 'LINE' AND k % 7 <> 3)
SELECT f.file, count(i.ord) = 0 AS ok, count(i.ord) AS n_issues, min_by(i.type, i.ord) AS first_type, min_by(i.layer, i.ord) AS first_layer FROM (SELECT DISTINCT file FROM {_ENTITIES}) f LEFT JOIN i USING (file) GROUP BY f.file""")
def issue_summary(spark, d):
    """Per drawing whether it is in order, how many issues there are, and the first."""
    rows = entities(spark, d)
    issues = rows.filter("kind <> 'LINE' and file <> '3'").select("file", F.col("entity").alias("ord"), F.lit("unsupported_entity").alias("type"), F.lit("only LINE entities are cut").alias("message"), "layer")
    return R.issue_summary(rows, issues).select("file", "ok", "n_issues", "first_type", "first_layer")


@query("problem_places", "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN p_size * 0.5e0 WHEN 1 THEN 7e0 WHEN 2 THEN 9e0 ELSE 0e0 END AS x, CASE p_partkey % 4 WHEN 0 THEN -1e0 WHEN 1 THEN 8e0 WHEN 2 THEN 10e0 ELSE 0e0 END AS y FROM part")
def problem_places(spark, d):
    """Where a shape is invalid: stated by the reason, else inside, else at its first point, else nowhere."""
    k = F.col("p_partkey")
    pt = lambda x, y: F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"))
    reason = F.when(k % 4 == 0, F.concat(F.lit("Self-intersection["), (F.col("p_size") * 0.5).cast("string"), F.lit(" -1]"))).otherwise("Too few points [. e]")
    place = R.problem_place(reason, F.when(k % 4 == 1, pt(7.0, 8.0)), F.when(k % 4 == 2, pt(9.0, 10.0)))
    return A.read(spark, d, "part").select(k.alias("id"), place["x"].alias("x"), place["y"].alias("y"))


@query("stroke_labels", """SELECT id, label, round(greatest(w, 0.1e0), 6) AS width, strokes FROM (SELECT id, label, list_sum(list_transform(string_split(label, ''), lambda c: CASE WHEN c = ' ' THEN 0.45e0 WHEN c IN ('.', ':') THEN 0.35e0 WHEN c IN ('l', 'L') THEN 0.45e0 ELSE 0.75e0 END)) * 3 AS w,
  CAST(list_sum(list_transform(string_split(label, ''), lambda c: CASE WHEN c = ' ' THEN 0 WHEN c IN ('1', 'E', ':') THEN 2 WHEN c = '4' THEN 3 WHEN c IN ('0', '2', '3', '5', '6', '7', '8', '9', 'e', 'l', 'L', 'v', '.', '-', '_') THEN 1 ELSE 2 END)) AS BIGINT) AS strokes
  FROM (SELECT p_partkey AS id, ['El. 12', 'v:', 'Lx_', '-4', 'e9', 'ñ'][p_partkey % 6 + 1] || p_size AS label FROM part))""")
def stroke_labels(spark, d):
    """Width and strokes of labels in the stroke font."""

    @F.pandas_udf("struct<width:double,strokes:long>")
    def drawn_text(label: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(round(X.text_size(x)[0], 6), len(X.text_lines(x, 0.0, 0.0))) for x in label], columns=["width", "strokes"])

    label = F.concat(_pick(["El. 12", "v:", "Lx_", "-4", "e9", "ñ"], F.col("p_partkey")), F.col("p_size").cast("string"))
    rows = A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), label.alias("label"))
    return rows.withColumn("t", drawn_text("label")).select("id", "label", "t.width", "t.strokes")


@query("layer_configs", "SELECT p_partkey AS id, coalesce(CASE WHEN p_size % 3 = 0 THEN 'C' || p_size END, 'CORTE') AS name, CASE WHEN p_size % 4 = 0 THEN 255 WHEN p_size % 4 = 1 THEN 1 ELSE p_size END AS color FROM part")
def layer_configs(spark, d):
    """Names and colours of a layer: custom ones over the defaults, colours within 1 to 255."""
    s = F.col("p_size")
    color = S.safe_color(F.when(s % 4 == 0, 400).when(s % 4 == 1, -3).otherwise(s))
    name = F.coalesce(F.when(s % 3 == 0, F.concat(F.lit("C"), s.cast("string"))), F.lit(X.CONFIG["cut"]["name"]))
    return A.read(spark, d, "part").select(F.col("p_partkey").alias("id"), name.alias("name"), color.alias("color"))


@query("boxes_inside_sheet", f"SELECT id, x0 >= 50 - 1e-6 AND y0 >= 50 - 1e-6 AND x1 <= 950 + 1e-6 AND y1 <= 700 + 1e-6 AS inside FROM {CONTOURS}")
def boxes_inside_sheet(spark, d):
    """Boxes within the margins of a sheet, up to a tolerance."""
    from terrace.functions.native import env_covers, env_of_box

    room = env_of_box(F.lit(50 - 1e-6), F.lit(50 - 1e-6), F.lit(950 + 1e-6), F.lit(700 + 1e-6))
    return A.contours(spark, d).select("id", env_covers(room, F.col("env")).alias("inside"))
