"""Geometry between Spark's nested columns and the polygon kernel, and kernel functions as vectorised columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import polygon as P
from .native import GEOM

_DOUBLE = T.DoubleType()
_PT = T.StructType([T.StructField("x", _DOUBLE), T.StructField("y", _DOUBLE)])
_RING = T.ArrayType(_PT)
_POLY = T.StructType([T.StructField("shell", _RING), T.StructField("holes", T.ArrayType(_RING))])
_ENV = T.StructType([T.StructField(n, _DOUBLE) for n in ("minx", "miny", "maxx", "maxy")])
#: GEOM as a type, for functions that are declared before there is a session.
GEOM_TYPE = T.StructType([T.StructField("polys", T.ArrayType(_POLY)), T.StructField("lines", T.ArrayType(_RING)), T.StructField("env", _ENV), T.StructField("area", _DOUBLE)])


def from_row(g) -> P.Geometry:
    """A GEOM value (dict, Row or None) as kernel polygons."""
    if g is None:
        return []
    out = []
    for p in g["polys"] if g["polys"] is not None else []:
        pts = lambda r: [(q["x"], q["y"]) for q in r]
        poly = P.polygon(pts(p["shell"]), [pts(h) for h in (p["holes"] if p["holes"] is not None else [])])
        if poly:
            out.append(poly)
    return out


def plain(row) -> dict:
    """A struct of an array (dict or Row) as a dict."""
    return row if isinstance(row, dict) else row.asDict()


def lines_of(g) -> list[np.ndarray]:
    return [np.array([(q["x"], q["y"]) for q in r], float) for r in g["lines"]] if g is not None and g["lines"] is not None else []


def _closed(r: np.ndarray) -> list[dict]:
    return [{"x": float(x), "y": float(y)} for x, y in np.vstack([r, r[:1]])]


def to_row(geom: P.Geometry, lines=()) -> dict:
    pts = [r for p in geom for r in p] + list(lines)
    env = None
    if pts:
        a = np.concatenate(pts)
        env = dict(zip(("minx", "miny", "maxx", "maxy"), (*map(float, a.min(axis=0)), *map(float, a.max(axis=0))), strict=True))
    return {
        "polys": [{"shell": _closed(p[0]), "holes": [_closed(h) for h in p[1:]]} for p in geom],
        "lines": [[{"x": float(x), "y": float(y)} for x, y in r] for r in lines], "env": env, "area": float(P.area(geom)) if geom else 0.0,
    }


def _rows(s) -> list:
    """A struct column in a pandas UDF is a frame; its rows."""
    return s.to_dict("records") if isinstance(s, pd.DataFrame) else list(s)


def _frame(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["polys", "lines", "env", "area"])


def _binary(f, name: str):
    @F.pandas_udf(GEOM_TYPE)
    def g(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _frame([to_row(f(from_row(x), from_row(y))) for x, y in zip(_rows(a), _rows(b), strict=True)])

    g.__name__ = name
    return g


g_intersection = _binary(P.intersection, "g_intersection")
g_difference = _binary(P.difference, "g_difference")
g_union = _binary(P.union, "g_union")
g_symdiff = _binary(P.symmetric_difference, "g_symdiff")


@F.pandas_udf(T.BooleanType())
def g_covers(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    return pd.Series([P.covers(from_row(x), from_row(y)) for x, y in zip(_rows(a), _rows(b), strict=True)], dtype=bool)


@F.pandas_udf(_DOUBLE)
def g_distance(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    return pd.Series([P.distance(from_row(x), from_row(y)) for x, y in zip(_rows(a), _rows(b), strict=True)], dtype=float)


@F.pandas_udf(_DOUBLE)
def g_shared_length(a: pd.DataFrame, b: pd.DataFrame) -> pd.Series:
    return pd.Series([P.shared_length(from_row(x), from_row(y)) for x, y in zip(_rows(a), _rows(b), strict=True)], dtype=float)


@F.pandas_udf(GEOM_TYPE)
def g_offset(a: pd.DataFrame, d: pd.Series) -> pd.DataFrame:
    """Mitred, limit 2."""
    return _frame([to_row(P.offset(from_row(x), float(k), limit=2.0)) for x, k in zip(_rows(a), d, strict=True)])


@F.pandas_udf(GEOM_TYPE)
def g_clean(a: pd.DataFrame, tolerance: pd.Series) -> pd.DataFrame:
    return _frame([to_row(P.cleaned(from_row(x), float(k))) for x, k in zip(_rows(a), tolerance, strict=True)])


@F.pandas_udf(GEOM_TYPE)
def g_simplify(a: pd.DataFrame, tolerance: pd.Series) -> pd.DataFrame:
    return _frame([to_row([[P.simplified(r, float(k)) for r in p] for p in from_row(x)]) for x, k in zip(_rows(a), tolerance, strict=True)])


@F.pandas_udf(T.StructType([T.StructField("ok", T.BooleanType()), T.StructField("reason", T.StringType()), T.StructField("x", _DOUBLE), T.StructField("y", _DOUBLE)]))
def g_validity(ring: pd.Series) -> pd.DataFrame:
    """Of an array of points."""
    out = [P.validity(np.array([(q["x"], q["y"]) for q in r], float).reshape(-1, 2)) for r in ring]
    return pd.DataFrame(out, columns=["ok", "reason", "x", "y"])


@F.pandas_udf(_PT)
def g_inner_point(a: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame([P.inner_point(g) if g else (None, None) for g in map(from_row, _rows(a))], columns=["x", "y"])


#: Slots that a group's shapes are dealt to before their unions are merged.
SLOTS = 16


def union_by(df, by: list[str], geom: str = "geom", slots: int = SLOTS):
    """The union of each group's shapes, in two steps: per key and slot first, so that no group is gathered whole before it
    is merged. Shapes of a stretch share a slot, as these merge to little."""
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in by) + f", slot int, {geom} {GEOM}"

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        shapes = [from_row(g) for g in pdf[geom]]
        while len(shapes) > 1:
            shapes = [P.union(*shapes[i : i + 8]) for i in range(0, len(shapes), 8)]
        head = pdf.iloc[:1][[*by, "slot"]].copy()
        head[geom] = [to_row(shapes[0] if shapes else [])]
        return head

    e = F.col(geom)["env"]
    side = F.greatest(e["maxx"] - e["minx"], F.lit(1e-6))
    slot = F.coalesce(F.pmod(F.floor(e["minx"] / (4 * side)), F.lit(slots)), F.lit(0)).cast("int")
    part = df.select(*by, slot.alias("slot"), geom).groupBy(*by, "slot").applyInPandas(merge, schema)
    return part.withColumn("slot", F.lit(0)).groupBy(*by, "slot").applyInPandas(merge, schema).drop("slot")
