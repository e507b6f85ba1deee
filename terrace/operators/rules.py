"""Rules about overrides, layers and tables of edits, as joins and combining aggregations.

Overrides are long rows (id, field, value), so that a field that is absent differs from one that is there and empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spatial import once

#: Layer names that tell what a layer is, in lower case.
BOUNDARY_NAMES = ("boundary", "limite", "perimetro", "contorno")
CONTOUR_NAMES = ("topografia", "topography", "topo")
OTHER_NAMES = ("boundary", "camadas", "3d_pontos", "0")
POINT_NAMES = ("3d_pontos", "3dpoints", "pontos_3d", "topografia_pontos")
EXCLUDED = ("camadas",)


def normalized_overrides(rows: DataFrame) -> DataFrame:
    """(id, field, value, ord) without blank ids and blank values; ``keep`` stays even if it is null. Ids are trimmed; of
    several raw ids that are one then, the last that has a field left is taken, whole."""
    ident = F.trim(F.col("id").cast("string"))
    blank = F.col("value").isNull() | (F.trim("value") == "")
    own = rows.withColumn("key", ident).filter((F.col("key") != "") & ((F.col("field") == "keep") | ~blank))
    last = own.groupBy("key").agg(F.max_by(F.col("id").cast("string"), F.col("ord")).alias("raw"))
    kept = own.join(last, "key").filter(F.col("id").cast("string") == F.col("raw"))
    return kept.groupBy(F.col("key").alias("id"), "field").agg(F.max_by("value", "ord").alias("value"))


def merged_overrides(low: DataFrame, high: DataFrame) -> DataFrame:
    """Field by field; the second one wins."""
    both = low.select("id", "field", "value", F.lit(0).alias("rank")).unionByName(high.select("id", "field", "value", F.lit(1).alias("rank")))
    return both.groupBy("id", "field").agg(F.max_by("value", "rank").alias("value"))


def effective_overrides(points: DataFrame, summary: DataFrame, last_source: str) -> DataFrame:
    """What was applied last wins: the table of the summary, or that of the points."""
    p, s = normalized_overrides(points), normalized_overrides(summary)
    return merged_overrides(p, s) if last_source == "summary" else merged_overrides(s, p)


def changed_rows(original: DataFrame, edited: DataFrame, key: str, fields: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Edited rows with the fields that are given and differ from the original's; rows without an original differ in
    every field that is given."""
    was = original.select(key, *[F.col(f).alias(f"was_{f}") for f in fields])
    out = edited.join(was, key, "left")
    differs = lambda f: F.col(f).isNotNull() & (F.col(f"was_{f}").isNull() | (F.abs(F.col(f) - F.col(f"was_{f}")) > tolerance))
    out = out.withColumns({f"changed_{f}": differs(f) for f in fields})
    some = F.lit(False)
    for f in fields:
        some = some | F.col(f"changed_{f}")
    return out.filter(some).drop(*[f"was_{f}" for f in fields])


def suggested_layers(polygons: DataFrame, points: DataFrame, key: str = "project") -> DataFrame:
    """Per project: boundary_layer (the first by name that hints at one; else null: the largest polygon), contour_layers
    (named so; else all that no hint rules out; else all), point_layer (named so; else the only one)."""
    names = polygons.groupBy(key).agg(F.array_sort(F.collect_set("layer")).alias("layers"))
    at = points.groupBy(key).agg(F.array_sort(F.collect_set("layer")).alias("point_layers"))
    first = lambda array, hints: F.get(F.filter(array, lambda x: F.lower(x).isin(*hints)), F.lit(0))
    rows = names.join(at, key, "left").withColumn("boundary_layer", first(F.col("layers"), BOUNDARY_NAMES))
    options = F.filter("layers", lambda x: F.col("boundary_layer").isNull() | (x != F.col("boundary_layer")))
    rows = rows.withColumn("options", options)
    named = F.filter("options", lambda x: F.lower(x).isin(*CONTOUR_NAMES))
    left = F.filter("options", lambda x: ~F.lower(x).isin(*OTHER_NAMES) & (F.col("boundary_layer").isNull() | (F.lower(x) != F.lower(F.col("boundary_layer")))))
    contour = F.when(F.size(named) > 0, named).when(F.size(left) > 0, left).otherwise(F.col("options"))
    point = F.coalesce(first(F.col("point_layers"), POINT_NAMES), F.when(F.size("point_layers") == 1, F.col("point_layers")[0]))
    return rows.select(key, "boundary_layer", contour.alias("contour_layers"), point.alias("point_layer"))


def is_boundary(layer: Column, name: Column) -> Column:
    """Whether a layer is the named boundary layer, or, without a name, called so."""
    return F.when(name.isNotNull(), layer == name).otherwise(F.lower(layer) == "boundary")


def active_polygons(polygons: DataFrame, chosen: DataFrame, key: str = "project") -> DataFrame:
    """Polygons of the chosen contour layers and of the boundary layer. chosen: key, boundary_layer, contour_layers."""
    rows = polygons.join(chosen.select(key, "boundary_layer", "contour_layers"), key)
    return rows.filter(F.array_contains("contour_layers", F.col("layer")) | is_boundary(F.col("layer"), F.col("boundary_layer"))).select(polygons.columns)


def boundary_and_contours(polygons: DataFrame, named: DataFrame | None = None, key: str = "project") -> DataFrame:
    """Per polygon (key, id, layer, area): boundary_id (the largest of the boundary layer; without one the largest of
    all), outer (it is the boundary and no contour), late (a further polygon of the boundary layer: a contour that comes
    after the others). named: key, boundary_layer."""
    rows = polygons.select(key, "id", "layer", "area")
    rows = rows.join(named.select(key, "boundary_layer"), key, "left") if named is not None else rows.withColumn("boundary_layer", F.lit(None).cast("string"))
    rows = rows.withColumn("is_b", F.coalesce(is_boundary(F.col("layer"), F.col("boundary_layer")), F.lit(False)))
    order = F.struct((-F.col("area")).alias("a"), F.col("id"))
    best = rows.groupBy(key).agg(F.min_by("id", F.when(F.col("is_b"), order)).alias("of_layer"), F.max("is_b").alias("has"), F.min_by("id", order).alias("of_all"))
    found = rows.join(best, key)
    outer = F.col("is_b") & (F.col("id") == F.col("of_layer"))
    return found.select(key, "id", "layer", F.when(F.col("has"), F.col("of_layer")).otherwise(F.col("of_all")).alias("boundary_id"), outer.alias("outer"), (F.col("is_b") & ~outer).alias("late"))


def without_layers(rows: DataFrame, value: str, layers: tuple[str, ...] = EXCLUDED) -> DataFrame:
    """Rows of excluded layers stay, their value null."""
    return rows.withColumn(value, F.when(~F.lower("layer").isin(*layers) | F.col("layer").isNull(), F.col(value)))


def is_repeat_group(zero_base: Column, count: Column) -> Column:
    """Run-length layers that are laid out as a grid of equal plates."""
    return F.coalesce(zero_base, F.lit(False)) & (F.coalesce(count, F.lit(1)) > 1)


def line_signature(lines: Column) -> Column:
    """Of an array of lines (arrays of points), whatever their order: length and bounds, rounded."""
    xs, ys = (lambda r: F.transform(r, lambda p: p["x"])), (lambda r: F.transform(r, lambda p: p["y"]))
    length = lambda r: F.aggregate(F.sequence(F.lit(1), F.size(r) - 1), F.lit(0.0), lambda s, i: s + F.hypot(F.get(r, i)["x"] - F.get(r, i - 1)["x"], F.get(r, i)["y"] - F.get(r, i - 1)["y"]))
    some = F.filter(F.coalesce(lines, F.array().cast("array<array<struct<x:double,y:double>>>")), lambda r: F.size(r) >= 2)
    one = lambda r: F.struct(F.round(length(r), 6).alias("n"), F.round(F.array_min(xs(r)), 4).alias("a"), F.round(F.array_min(ys(r)), 4).alias("b"), F.round(F.array_max(xs(r)), 4).alias("c"), F.round(F.array_max(ys(r)), 4).alias("d"))
    return F.array_sort(F.transform(some, one))


def sampled(points: Column, most: int = 600) -> Column:
    """Every k-th of a long line's points, and its last."""

    def every(p: Column, step: Column) -> Column:
        some = F.filter(p, lambda x, i: i % step == 0)
        return F.when((F.size(p) - 1) % step == 0, some).otherwise(F.concat(some, F.slice(p, -1, 1)))

    return once(points, lambda p: F.when(F.size(p) <= most, p).otherwise(once(F.greatest(F.floor(F.size(p) / most).cast("int"), F.lit(1)), lambda step: every(p, step))))


def thinned(values: Column, low: Column, high: Column, most: int, slack: float = 1e-6) -> Column:
    """Distinct values between bounds, six digits; of more than ``most`` the ends and evenly spaced ones."""
    kept = F.array_sort(F.array_distinct(F.transform(F.filter(values, lambda v: (v >= low - slack) & (v <= high + slack)), lambda v: F.round(v, 6))))
    slots = max(most - 2, 1)

    def spread(v: Column) -> Column:
        last = F.size(v) - 1
        even = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: F.rint(i * last / max(slots - 1, 1)).cast("int"))
        at = F.slice(F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0), last), even))), 1, most)
        return F.transform(at, lambda i: F.get(v, i))

    return once(kept, lambda v: F.when(F.size(v) <= most, v).otherwise(spread(v)))


def split_sources(pieces: DataFrame, key: str = "project") -> DataFrame:
    """Pieces of sources that were cut in two or more."""
    many = pieces.groupBy(key, "source").agg(F.count("*").alias("parts")).filter("parts > 1")
    return pieces.join(many, [key, "source"])


def issue_summary(checked: DataFrame, issues: DataFrame, key: str = "file") -> DataFrame:
    """Per checked drawing: ok, n_issues, and the first issue's type, message and layer. issues: key, ord, type, message, layer."""
    found = issues.groupBy(key).agg(F.count("*").alias("n"), F.min(F.struct("ord", "type", "message", "layer")).alias("one"))
    out = checked.select(key).distinct().join(found, key, "left")
    return out.select(key, F.col("n").isNull().alias("ok"), F.coalesce("n", F.lit(0)).alias("n_issues"), F.col("one.type").alias("first_type"), F.col("one.message").alias("first_message"), F.col("one.layer").alias("first_layer"))


def entity_counts(drawings: DataFrame, key: str = "file") -> DataFrame:
    """Entities of each drawing by kind and by layer, and in total (both null)."""
    return drawings.groupingSets([[key, "kind"], [key, "layer"], [key]], key, "kind", "layer").agg(F.count("*").alias("n"))


def problem_place(reason: Column, inner: Column, first: Column) -> Column:
    """Where a shape is invalid: the place in the reason's text, else a point inside, else its first point."""
    number = r"[\-0-9.eE]+"
    x, y = (F.regexp_extract(reason, rf"\[({number})\s+({number})\]", k).try_cast("double") for k in (1, 2))
    stated = F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))
    return F.coalesce(stated, inner, first, F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y")))
