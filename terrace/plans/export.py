"""Cutting files from placed pieces, their verification, and diagnostics of drawings.

A sheet's linework is prepared over the kernel, sheet by sheet (group-map per project and sheet); everything that counts,
compares or orders segments afterwards is native: verification reads segments back and joins them.
"""

from __future__ import annotations

import html
import json
import zipfile
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from terrace.functions import polygon as P
from terrace.functions.native import env_covers, ring_area, ring_env
from terrace.functions.scalars import UNIT_FACTORS, UNIT_NAMES, piece_label
from terrace.functions.shapes import from_row, g_intersection, g_validity, lines_of, plain
from terrace.operators import spatial
from terrace.operators.graph import FEW, checkpointed, components
from terrace.operators.kinds import DEALT, by_kind
from terrace.sources import dxf

#: Fixed values of the export rules.
CONFIG = {
    "cut": {"name": "CORTE", "dxf_color": 1, "svg_color": "#ff0000"}, "engrave": {"name": "GRAVAÇÃO", "dxf_color": 5, "svg_color": "#0057ff"},
    "mark": {"name": "MANCHA", "dxf_color": 7, "svg_color": "#000000"}, "bed": {"name": "Placa", "dxf_color": 8, "svg_color": "#333333"},
    "margin": {"name": "MargemSeguranca", "dxf_color": 8, "svg_color": "#777777"},
}
PRIORITY = ("cut", "engrave", "mark", "margin", "bed")
DRAW_ORDER = ("bed", "margin", "cut", "engrave", "mark")
CLEAN, SIMPLIFY, CLEARANCE, SHORTEST = 0.5, 0.05, 1.0, 0.01
TEXT, GAP, TEXT_CLEARANCE, ISSUES = 3.0, 3.0, 1.0, 20
#: Strokes of the characters of labels, in a cell of one by one; a character without strokes takes those of its
#: upper case, else a cross.
GLYPHS = {
    "0": [((0.1, 0.0), (0.65, 0.0), (0.65, 1.0), (0.1, 1.0), (0.1, 0.0))],
    "1": [((0.35, 0.0), (0.35, 1.0)), ((0.18, 0.82), (0.35, 1.0), (0.52, 1.0))],
    "2": [((0.1, 0.82), (0.25, 1.0), (0.58, 1.0), (0.68, 0.82), (0.1, 0.0), (0.68, 0.0))],
    "3": [((0.1, 1.0), (0.65, 1.0), (0.38, 0.52), (0.65, 0.52), (0.65, 0.0), (0.1, 0.0))],
    "4": [((0.62, 0.0), (0.62, 1.0)), ((0.1, 0.42), (0.68, 0.42)), ((0.1, 1.0), (0.1, 0.42))],
    "5": [((0.68, 1.0), (0.12, 1.0), (0.12, 0.55), (0.58, 0.55), (0.68, 0.42), (0.68, 0.0), (0.1, 0.0))],
    "6": [((0.65, 0.9), (0.52, 1.0), (0.15, 0.75), (0.1, 0.25), (0.28, 0.0), (0.65, 0.0), (0.65, 0.52), (0.12, 0.52))],
    "7": [((0.08, 1.0), (0.68, 1.0), (0.22, 0.0))],
    "8": [((0.15, 0.52), (0.1, 0.78), (0.25, 1.0), (0.55, 1.0), (0.68, 0.78), (0.58, 0.52), (0.15, 0.52), (0.1, 0.25), (0.28, 0.0), (0.55, 0.0), (0.68, 0.25), (0.58, 0.52))],
    "9": [((0.65, 0.48), (0.12, 0.48), (0.12, 1.0), (0.55, 1.0), (0.68, 0.75), (0.62, 0.25), (0.18, 0.0))],
    "E": [((0.65, 1.0), (0.1, 1.0), (0.1, 0.0), (0.65, 0.0)), ((0.1, 0.52), (0.55, 0.52))],
    "e": [((0.65, 0.18), (0.5, 0.0), (0.18, 0.0), (0.08, 0.2), (0.08, 0.55), (0.25, 0.75), (0.58, 0.75), (0.68, 0.55), (0.1, 0.42))],
    "l": [((0.18, 1.0), (0.18, 0.08), (0.38, 0.0))],
    "L": [((0.12, 1.0), (0.12, 0.0), (0.65, 0.0))],
    "v": [((0.08, 0.75), (0.35, 0.0), (0.65, 0.75))],
    ":": [((0.16, 0.68), (0.19, 0.68)), ((0.16, 0.25), (0.19, 0.25))],
    ".": [((0.16, 0.0), (0.19, 0.0))],
    "-": [((0.12, 0.48), (0.6, 0.48))],
    "_": [((0.08, 0.0), (0.65, 0.0))],
}
CROSS = [((0.1, 0.0), (0.65, 1.0)), ((0.65, 0.0), (0.1, 1.0))]
#: Widths of characters that are not 0.75 wide.
WIDTHS = {" ": 0.45, ".": 0.35, ":": 0.35, "l": 0.45, "L": 0.45}
#: Where a label is tried inside an area, as shares of its box, and beside a piece: (across, up), -1 before, 0 level, 1 after.
SHARES = (0.5, 0.35, 0.65, 0.2, 0.8)
BESIDE = ((1, -1), (0, -1), (1, 0), (1, 1), (-1, -1), (0, 1), (-1, 0))


def config_with(custom: dict | None) -> dict:
    return {k: {**v, **{n: x for n, x in (custom or {}).get(k, {}).items() if x not in (None, "")}} for k, v in CONFIG.items()}


def advance(char: str) -> float:
    return WIDTHS.get(char, 0.75)


def text_size(label: str, size: float = TEXT) -> tuple[float, float]:
    return max(sum(map(advance, label)) * size, 0.1), size


def text_lines(label: str, x: float, y: float, size: float = TEXT) -> list[np.ndarray]:
    """Strokes of a label."""
    out = []
    for c in label:
        strokes = [] if c == " " else GLYPHS.get(c) or GLYPHS.get(c.upper(), CROSS)
        out += [np.array(stroke) * size + (x, y) for stroke in strokes]
        x += advance(c) * size
    return out


def label_of(source_elevation, elevation) -> str:
    value = source_elevation if source_elevation is not None and not pd.isna(source_elevation) else elevation
    if value is None or pd.isna(value):
        return ""
    return str(round(value)) if abs(value - round(value)) <= 1e-6 else f"{value:.2f}".rstrip("0").rstrip(".")


def prepared(geom: P.Geometry, clean: float = CLEAN, simplify: float = SIMPLIFY) -> P.Geometry:
    """Closed up small notches, simplified; the shape as it was where that would lose parts."""
    out = geom
    if clean > 0:
        closed = P.offset(P.offset(geom, clean / 2), -clean / 2)
        out = closed if closed and len(closed) == len(geom) and abs(P.area(closed) - P.area(geom)) <= 0.05 * P.area(geom) else geom
    if simplify > 0:
        slim = [[r for r in (P.simplified(r, simplify) for r in p) if len(r) >= 3] for p in out]
        out = slim if all(P.validity(r)[0] for p in slim for r in p) else out
    return P.cleaned(out, 1e-6)


def _inner_anchors(poly: P.Polygon) -> np.ndarray:
    """Middles at which a label is tried inside a polygon, best first."""
    low, high = np.array(P.bounds([poly])).reshape(2, 2)
    grid = np.array([(a, b) for a in SHARES for b in SHARES])
    return np.vstack([P.inner_point([poly]), P.centroid([poly]), low + (high - low) * grid])


def _beside(box: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Lower left corners of a label beside a box, best first: a gap after it or before it, or level with its middle."""
    low, high = box
    steps = np.stack([low - GAP - size, (low + high - size) / 2, high + GAP])
    return np.array([(steps[across + 1, 0], steps[up + 1, 1]) for across, up in BESIDE])


def label_place(piece: dict, label: str, bed: tuple[float, float], obstacles: list[P.Geometry], margin: float) -> tuple[float, float]:
    """Inside the piece's label area if it fits, else beside the piece where nothing is nearer than the gap, else on it."""
    size = np.array(text_size(label))
    at = lambda corner: P.box(*corner, *(corner + size))
    room = (P.offset(piece["labels"], -TEXT_CLEARANCE) or piece["labels"]) if piece["labels"] else []
    for poly in sorted(room, key=lambda p: -P.area([p])):
        low, high = np.array(P.bounds([poly])).reshape(2, 2)
        if (high - low >= size).all():
            inner = (corner for corner in _inner_anchors(poly) - size / 2 if P.covers([poly], at(corner)))
            found = next(inner, None)
            if found is not None:
                return tuple(map(float, found))
    lowest, highest = np.full(2, margin), np.array(bed, float) - margin - size
    corners = _beside(np.array(P.bounds(piece["geom"])).reshape(2, 2), size)
    on_sheet = ((corners >= lowest - 1e-6) & (corners <= highest + 1e-6)).all(axis=1)
    for corner in corners[on_sheet]:
        if all(P.distance(at(corner), o) >= GAP - 1e-6 for o in obstacles):
            return tuple(map(float, corner))
    return tuple(map(float, np.clip(P.inner_point(piece["geom"]) - size / 2, lowest, np.maximum(lowest, highest))))


def _rect(x: float, y: float, w: float, h: float) -> list[np.ndarray]:
    return [np.array([(x, y), (x + w, y), (x + w, y + h), (x, y + h), (x, y)])]


def sheet_linework(pieces: list[dict], bed: tuple[float, float], margin: float = 0.0, clean: float = CLEAN, simplify: float = SIMPLIFY, clearance: float = CLEARANCE) -> dict[str, list[np.ndarray]]:
    """Lines of a sheet by role, no line twice: each role gives way to those before it."""
    margin = max(0.0, min(margin, min(bed) / 2 - 1e-6))
    out: dict[str, list[np.ndarray]] = {r: [] for r in PRIORITY}
    shapes = [prepared(p["geom"], clean, simplify) for p in pieces]
    out["cut"] = [np.vstack([r, r[:1]]) for g in shapes for r in P.rings(g)]
    for p, g in zip(pieces, shapes, strict=True):
        lines = [part for line in p["engraving"] for part in P.clip_line(line, g)]
        out["engrave"] += [P.simplified_line(x, simplify) if simplify > 0 else x for x in lines]
        label = label_of(p.get("source_elevation"), p.get("elevation"))
        if label:
            x, y = label_place({**p, "geom": g}, label, bed, [s for s in shapes], margin)
            out["mark"] += text_lines(label, x, y)
    out["bed"] = _rect(0, 0, *bed)
    if margin > 1e-6 and min(bed) > 2 * margin + 1e-6:
        out["margin"] = _rect(margin, margin, bed[0] - 2 * margin, bed[1] - 2 * margin)
    if shapes and clearance > 0:
        around = P.union(*[P.offset(g, clearance) for g in shapes if g])
        for role in ("bed", "margin"):
            out[role] = [part for line in out[role] for part in P.clip_line(line, around, inside=False)]
    return no_line_twice(out)


def no_line_twice(roles: dict[str, list[np.ndarray]]) -> dict[str, list[np.ndarray]]:
    """Lines cut at their crossings and joined, without repeats; each role gives way to those before it."""
    taken: list[np.ndarray] = []
    out = {}
    for role in PRIORITY:
        lines = P.merged_lines(roles.get(role, []))
        if taken:
            lines = without_lines(lines, taken)
        out[role] = [x for x in P.merged_lines(lines) if P.line_length(x) >= SHORTEST]
        taken += out[role]
    return out


def segment_rows(head: tuple, roles: dict[str, list[np.ndarray]]) -> pd.DataFrame:
    rows = [
        (*head, role, k, s, *map(float, (a[0], a[1], b[0], b[1])))
        for role, lines in roles.items() for k, line in enumerate(lines) for s, (a, b) in enumerate(zip(line[:-1], line[1:], strict=True))
    ]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in SEGMENTS.split(", ")][2 - len(head) :])


def without_lines(lines: list[np.ndarray], others: list[np.ndarray]) -> list[np.ndarray]:
    """The parts of lines that don't lie on other lines."""
    if not lines or not others:
        return lines
    a, b = (np.concatenate([x[k] for x in lines]) for k in (slice(None, -1), slice(1, None)))
    p, q = (np.concatenate([x[k] for x in others]) for k in (slice(None, -1), slice(1, None)))
    d = b - a
    n = np.hypot(*d.T)
    u = d / np.maximum(n, 1e-300)[:, None]
    # only a segment that is by another one, and in its direction, can lie on it
    found = []
    for i, j in P.near_boxes(np.minimum(a, b) - 1e-5, np.maximum(a, b) + 1e-5, np.minimum(p, q), np.maximum(p, q)):
        off = [np.abs(u[i, 0] * (x[j] - a[i])[:, 1] - u[i, 1] * (x[j] - a[i])[:, 0]) for x in (p, q)]
        on = (off[0] <= 1e-6) & (off[1] <= 1e-6)
        found.append((i[on], j[on]))
    i, j = (np.concatenate([x[k] for x in found] or [np.zeros(0, np.int64)]) for k in (0, 1))
    order = np.lexsort((j, i))
    j, starts = j[order], np.searchsorted(i[order], np.arange(len(a) + 1)).tolist()
    far = a + n[:, None] * u
    out: list[np.ndarray] = []
    own = iter(range(len(a)))
    for line in lines:
        parts: list[list] = []
        for k in islice(own, len(line) - 1):
            if n[k] <= 1e-9:
                continue
            by = j[starts[k] : starts[k + 1]]
            open_ = _open_stretches(a[k], u[k], float(n[k]), p[by], q[by]) if len(by) else [(a[k], far[k])]
            for u0, u1 in open_:
                # as a distance, not as a share of the coordinates: far out that would bridge what is covered
                if parts and abs(parts[-1][-1][0] - u0[0]) <= 1e-9 and abs(parts[-1][-1][1] - u0[1]) <= 1e-9:
                    parts[-1].append(u1)
                else:
                    parts.append([u0, u1])
        out += [np.array(x) for x in parts]
    return out


def _open_stretches(a: np.ndarray, u: np.ndarray, n: float, p: np.ndarray, q: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Stretches of the segment from a, n long in direction u, that no segment p-q of the same direction covers."""
    out = []
    t0, t1 = (p - a) @ u, (q - a) @ u
    at = 0.0
    for s, e in sorted(zip(np.minimum(t0, t1), np.maximum(t0, t1), strict=True)) + [(n, n)]:
        if s > at + 1e-6 and at < n:
            out.append((a + at * u, a + min(s, n) * u))
        at = max(at, e)
    return out


SEGMENTS = "project string, sheet int, role string, line int, segment int, x0 double, y0 double, x1 double, y1 double"


def linework(placed: DataFrame, bed: tuple[float, float], margin: float = 0.0, **how) -> DataFrame:
    """Segments of every sheet of ``nest_projects``' rows (elevation columns, if there, label the pieces). Sheets of the same
    pieces are drawn once."""
    names = [c for c in ("seq", "geom", "engraving", "labels", "elevation", "source_elevation") if c in placed.columns]
    own = placed.groupBy("project", "sheet").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("own"))

    def run(sheet: dict) -> pd.DataFrame:
        own = [
            {"geom": from_row(r["geom"]), "engraving": lines_of(r["engraving"]), "labels": from_row(r["labels"]), "elevation": r.get("elevation"), "source_elevation": r.get("source_elevation")}
            for r in map(plain, sheet["own"])
        ]
        return segment_rows((), sheet_linework(own, bed, margin, **how))

    drawn = by_kind(own, ["project", "sheet"], run, SEGMENTS.removeprefix("project string, sheet int, "))
    return drawn.select(F.col("project").cast("string"), F.col("sheet").cast("int"), *[c.split()[0] for c in SEGMENTS.split(", ")[2:]])


def unit_of(name) -> str:
    return UNIT_NAMES.get(str(name).strip().lower(), "auto")


def scaled_segments(segments: DataFrame, units: str = "auto") -> DataFrame:
    k = UNIT_FACTORS[unit_of(units)]
    return segments.withColumns({c: F.col(c) * k for c in ("x0", "y0", "x1", "y1")})


def _by_sheet(segments: DataFrame, out: str, render) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["role", "line", "segment"])
        lines = [(r.role, (r.x0, r.y0), (r.x1, r.y1)) for r in pdf.itertuples()]
        more = [list(pdf["labels"].iloc[0])] if "labels" in pdf else []
        return pd.DataFrame([(pdf["project"].iloc[0], int(pdf["sheet"].iloc[0]), render(lines, *more))], columns=["project", "sheet", out])

    return segments.groupBy("project", "sheet").applyInPandas(run, f"project string, sheet int, {out} string")


def to_dxf(segments: DataFrame, layer_config: dict | None = None, units: str = "auto") -> DataFrame:
    """One drawing per sheet, LINE entities by layer: project, sheet, dxf."""
    cfg = config_with(layer_config)
    layers = {cfg[r]["name"]: cfg[r]["dxf_color"] for r in DRAW_ORDER}
    return _by_sheet(scaled_segments(segments, units), "dxf", lambda lines: dxf.drawing(layers, [(cfg[r]["name"], a, b) for r, a, b in lines], units=unit_of(units)))


def sheet_labels(placed: DataFrame) -> DataFrame:
    """The labels of each sheet's pieces in their order: project, sheet, labels."""
    one = F.struct("seq", piece_label(F.col("source_elevation"), F.col("elevation")).alias("label"))
    return placed.groupBy("project", "sheet").agg(F.transform(F.array_sort(F.collect_list(one)), lambda x: F.coalesce(x["label"], F.lit(""))).alias("labels"))


def to_svg(segments: DataFrame, bed: tuple[float, float], layer_config: dict | None = None, units: str = "auto", placed: DataFrame | None = None) -> DataFrame:
    """One picture per sheet: project, sheet, svg. With the placed pieces their labels are comments."""
    if placed is not None:
        segments = segments.join(sheet_labels(placed), ["project", "sheet"])
    cfg = config_with(layer_config)
    k = UNIT_FACTORS[unit_of(units)]
    unit = unit_of(units).replace("auto", "mm")
    fmt = lambda v: f"{v:.3f}".rstrip("0").rstrip(".") or "0"

    def render(lines, labels=()) -> str:
        w, h = fmt(bed[0] * k), fmt(bed[1] * k)
        out = [f'<svg xmlns="http://www.w3.org/2000/svg" width="{w}{unit}" height="{h}{unit}" viewBox="0 0 {w} {h}">']
        for role in DRAW_ORDER:
            own = [x for x in lines if x[0] == role]
            out.append(f'<g id="{html.escape(cfg[role]["name"], quote=True)}" fill="none" stroke="{html.escape(cfg[role]["svg_color"], quote=True)}" stroke-width="{fmt(0.1 * k)}">')
            # the sheet's y axis goes up, the picture's down
            out += [f'<line x1="{fmt(a[0])}" y1="{fmt(bed[1] * k - a[1])}" x2="{fmt(b[0])}" y2="{fmt(bed[1] * k - b[1])}" />' for _, a, b in own]
            out.append("</g>")
        out += [f"<!-- {html.escape(label)} -->" for label in labels]
        return "\n".join([*out, "</svg>"])

    return _by_sheet(scaled_segments(segments, units), "svg", render)


#: Sheets of a combined drawing whose lines are compared in one task, unless more of them touch.
SHEETS_A_DEAL = 256


def sheet_deals(placed: DataFrame) -> DataFrame:
    """Deals of a project's sheets (project, k from 0, box env): project, k, deal. Sheets that touch, over others too, are of
    one deal; else a deal is of neighbours in order."""
    wide = placed.select("project", "k", F.struct(*[(F.col("env")[n] + g).alias(n) for n, g in (("minx", -SHORTEST), ("miny", -SHORTEST), ("maxx", SHORTEST), ("maxy", SHORTEST))]).alias("env"))
    met = spatial.self_pairs(wide, "k").select(F.col("key").alias("project"), F.col("a.k").alias("u"), F.col("b.k").alias("v"))
    first = components(met, few=FEW).select("project", F.col("id").alias("k"), "component")
    return placed.select("project", "k").join(first, ["project", "k"], "left").select("project", "k", F.floor(F.coalesce("component", "k") / SHEETS_A_DEAL).cast("int").alias("deal"))


def combined_dxf(segments: DataFrame, bed: tuple[float, float], gap: float = 20.0, layer_config: dict | None = None, units: str = "auto") -> DataFrame:
    """All sheets of a project in one drawing, on a grid: project, sheet (0), dxf. No segment is drawn twice. Lines of sheets
    that don't touch have nothing in common, so they are compared and written in deals, which are put together at the end."""
    segments = checkpointed(segments.filter("project is not null and sheet is not null"))  # used three times
    x, y = (F.array(F.col(f"{c}0"), F.col(f"{c}1")) for c in "xy")
    own = F.struct(F.min(F.array_min(x)).alias("minx"), F.min(F.array_min(y)).alias("miny"), F.max(F.array_max(x)).alias("maxx"), F.max(F.array_max(y)).alias("maxy"))
    sheets = segments.groupBy("project", "sheet").agg(own.alias("own"))
    w = Window.partitionBy("project")
    k, n = F.row_number().over(w.orderBy("sheet")) - 1, F.count("*").over(w)
    cols = F.greatest(F.lit(1), F.ceil(F.sqrt(n * bed[1] / bed[0])))
    spots = sheets.withColumns({"k": k, "cols": cols}).withColumns({"dx": F.col("k") % F.col("cols") * (bed[0] + gap), "dy": F.floor(F.col("k") / F.col("cols")) * (bed[1] + gap)})
    moved = F.struct(*[(F.col("own")[c] + F.col(f"d{c[-1]}")).alias(c) for c in ("minx", "miny", "maxx", "maxy")])
    spots = checkpointed(spots.select("project", "sheet", "k", "dx", "dy", moved.alias("env")))
    deals = spots.drop("env").join(sheet_deals(spots.select("project", "k", "env")), ["project", "k"]).drop("k")
    all_ = segments.join(deals, ["project", "sheet"])
    all_ = all_.withColumns({"x0": F.col("x0") + F.col("dx"), "x1": F.col("x1") + F.col("dx"), "y0": F.col("y0") + F.col("dy"), "y1": F.col("y1") + F.col("dy")}).drop("dx", "dy")
    cfg, unit = config_with(layer_config), unit_of(units)
    scale = UNIT_FACTORS[unit]

    def once(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["sheet", "role", "line", "segment"])
        ends = lambda own: own[["x0", "y0", "x1", "y1"]].to_numpy().reshape(-1, 2, 2)
        drawn = no_line_twice({role: [*ends(own)] for role, own in pdf.groupby("role")})
        rows = [
            (pdf["project"].iloc[0], int(pdf["deal"].iloc[0]), role, dxf.line_entities((cfg[role]["name"], a, b) for x in lines for a, b in zip(x[:-1] * scale, x[1:] * scale, strict=True)))
            for role, lines in drawn.items() if lines
        ]
        return pd.DataFrame(rows, columns=["project", "deal", "role", "body"])

    # a number of tasks is named, as small tables would be taken together in one
    dealt = all_.repartition(DEALT, "project", "deal").groupBy("project", "deal").applyInPandas(once, "project string, deal int, role string, body string")
    bodies = dealt.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("role", "deal", "body"))).alias("bodies"))
    head = dxf.head({cfg[r]["name"]: cfg[r]["dxf_color"] for r in DRAW_ORDER}, unit)
    text = F.concat(F.lit(head), F.concat_ws("", F.transform("bodies", lambda x: x["body"])), F.lit(dxf.TAIL))
    return bodies.select("project", F.lit(0).alias("sheet"), text.alias("dxf"))


def drawing_segments(drawings: DataFrame) -> DataFrame:
    """LINE entities of ``read_drawings`` rows as segments: file, id, layer, x0, y0, x1, y1."""
    d = drawings.filter((F.col("kind") == "LINE") & (F.size("points") == 2))
    p, q = F.col("points")[0], F.col("points")[1]
    return d.select("file", F.col("entity").alias("id"), "layer", p["x"].alias("x0"), p["y"].alias("y0"), q["x"].alias("x1"), q["y"].alias("y1"))


def verify(drawings: DataFrame, defined: DataFrame, layer_config: dict | None = None, tolerance: float = 1e-5) -> DataFrame:
    """Issues of exported drawings: file, type, layer, entity, message. defined: file, layer (names in the layer table).

    A drawing without a row is in order. Overlapping segments are reported up to 20 a drawing."""
    cfg = config_with(layer_config)
    names = [c["name"] for c in cfg.values()]
    issue = lambda df, kind, message: df.select("file", F.lit(kind).alias("type"), F.col("layer"), F.col("entity"), F.lit(message).alias("message"))
    good = drawings.filter("error is null")
    none = F.lit(None).cast("int")
    out = [drawings.filter("error is not null").select("file", F.lit("invalid_dxf").alias("type"), F.lit(None).cast("string").alias("layer"), none.alias("entity"), F.col("error").alias("message"))]
    wanted = good.select("file").distinct().withColumn("layer", F.explode(F.array(*map(F.lit, names))))
    out.append(issue(wanted.join(defined, ["file", "layer"], "left_anti").withColumn("entity", none), "missing_layer_definition", "layer is not defined"))
    out.append(issue(good.filter("kind <> 'LINE'"), "unsupported_entity", "only LINE entities are cut"))
    out.append(issue(good.filter(~F.col("layer").isin(names)), "unexpected_layer", "layer is not in the configuration"))
    bad = F.filter(F.array(F.when(F.col("color") != dxf.BYLAYER_COLOR, "color"), F.when(F.upper("linetype") != dxf.BYLAYER, "linetype"), F.when(F.col("lineweight") != dxf.BYLAYER_WEIGHT, "lineweight")), lambda x: x.isNotNull())
    by = good.select("file", "layer", "entity", F.explode(bad).alias("what"))
    out.append(by.select("file", F.lit("not_bylayer").alias("type"), "layer", "entity", F.concat("what", F.lit(" is not by layer")).alias("message")))
    open_ = good.filter((F.col("layer") == cfg["cut"]["name"]) & F.col("kind").isin("LWPOLYLINE", "POLYLINE") & ~F.col("closed"))
    out.append(issue(open_, "open_cut_polyline", "cut line is open"))
    segs = drawing_segments(good)
    grid = lambda c: F.rint(F.col(c) / tolerance).cast("long")
    ends = segs.filter(F.col("layer") == cfg["cut"]["name"]).select("file", "layer", F.explode(F.array(F.struct(grid("x0").alias("x"), grid("y0").alias("y")), F.struct(grid("x1").alias("x"), grid("y1").alias("y")))).alias("p"))
    odd = ends.groupBy("file", "layer", "p.x", "p.y").count().filter("count % 2 = 1").groupBy("file", "layer").agg(F.count("*").alias("n"))
    out.append(odd.select("file", F.lit("open_cut_linework").alias("type"), "layer", none.alias("entity"), F.concat(F.col("n").cast("string"), F.lit(" open ends")).alias("message")))
    met = overlapping(segs, tolerance).withColumn("k", F.row_number().over(Window.partitionBy("file").orderBy("a", "b"))).filter(F.col("k") <= ISSUES)
    out.append(met.select("file", F.col("kind").alias("type"), F.lit(None).cast("string").alias("layer"), F.col("a").alias("entity"), F.concat(F.lit("overlaps entity "), F.col("b").cast("string")).alias("message")))
    total = out[0]
    for o in out[1:]:
        total = total.unionByName(o)
    return total


def overlapping(segs: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Pairs of a drawing's segments that lie on each other: file, a, b, kind."""
    from terrace.plans.catalog import segment_pairs

    one = segs.withColumn("id", F.struct("file", F.col("id").alias("n")))
    pairs = segment_pairs(one, tolerance, ("file",))
    return pairs.select("a.file", F.col("a.n").alias("a"), F.col("b.n").alias("b"), "kind")


def defined_layers(sheets: DataFrame, text: str = "dxf") -> DataFrame:
    """Names in the layer tables of drawings (file, dxf)."""

    @F.pandas_udf("array<string>")
    def names(s: pd.Series) -> pd.Series:
        return s.map(dxf.layer_names)

    return sheets.select("file", F.explode(names(text)).alias("layer"))


ENTITIES_A_BATCH = 10_000


def reread(sheets: DataFrame, text: str = "dxf") -> DataFrame:
    """Entities of drawings held in a column (file, dxf)."""

    def run(batches):
        columns = [c.split()[0] for c in dxf.SCHEMA.replace("struct<x:double,y:double,z:double>", "s").split(", ")]
        for b in batches:
            rows: list[tuple] = []
            for f, t in zip(b["file"], b[text], strict=True):
                for r in dxf.parsed(f, t.encode()):
                    rows.append(r)
                    if len(rows) >= ENTITIES_A_BATCH:  # a drawing may be large, a batch is not
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
            yield pd.DataFrame(rows, columns=columns)

    return sheets.select("file", text).mapInPandas(run, dxf.SCHEMA)


def diagnose(drawings: DataFrame, area_tolerance: float = 1e-6, duplicate_tolerance: float = 1e-4, examples: int = 500) -> dict[str, DataFrame]:
    """Of drawings: ``shapes`` (ids from 1 over all closed ones, validity), ``layers`` (counters with totals per drawing),
    ``overlaps`` (all pairs with their class), ``examples`` (the first pairs of each drawing)."""
    number = F.row_number().over(Window.partitionBy("file").orderBy("entity"))
    shapes = dxf.closed_shapes(drawings).withColumn("id", number).withColumn("v", g_validity("ring")).withColumn("area", F.abs(ring_area(F.col("ring"))))
    shapes = shapes.withColumn("valid", F.col("v.ok") & (F.col("area") > 0))
    layers = shapes.rollup("file", "layer").agg(F.count("*").alias("closed"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid")).filter("file is not null")
    from terrace.functions.native import ring_geom

    ok = shapes.filter("valid").select(F.col("file").alias("project"), "id", "layer", ring_env(F.col("ring")).alias("env"), ring_geom(F.col("ring")).alias("geom"))
    pairs = spatial.self_pairs(ok).withColumn("common", g_intersection("a.geom", "b.geom")["area"]).filter(F.col("common") > area_tolerance)
    a, b = F.col("a.geom.area"), F.col("b.geom.area")
    inside = (F.least(a, b) - F.col("common") <= duplicate_tolerance) & (env_covers(F.col("a.env"), F.col("b.env")) | env_covers(F.col("b.env"), F.col("a.env")))
    kind = F.when(a + b - 2 * F.col("common") <= duplicate_tolerance, "duplicate").when(inside, "nested").otherwise("overlap")
    overlaps = pairs.select(F.col("key").alias("file"), F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("common").alias("area"), kind.alias("relation"))
    first = F.row_number().over(Window.partitionBy("file").orderBy("a", "b"))
    return {"shapes": shapes.select("file", "id", "layer", "closed_type", "valid", F.col("v.reason").alias("reason"), F.col("v.x").alias("x"), F.col("v.y").alias("y"), "area"), "layers": layers, "overlaps": overlaps, "examples": overlaps.withColumn("k", first).filter(F.col("k") <= examples).drop("k")}


def import_reports(parts: dict[str, DataFrame]) -> DataFrame:
    """What ``diagnose`` found, one JSON text per drawing: file, report (totals, layers, invalid shapes without their points,
    counts of overlaps by class, the first examples)."""
    layers = parts["layers"]
    total = layers.filter("layer is null").select("file", F.struct("closed", "valid", "invalid").alias("totals"))
    of = lambda df, name, *cols: df.groupBy("file").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias(name))
    out = total.join(of(layers.filter("layer is not null"), "layers", "layer", "closed", "valid", "invalid"), "file", "left")
    out = out.join(of(parts["shapes"].filter(~F.col("valid")), "invalid_shapes", "id", "layer", "reason", "x", "y"), "file", "left")
    out = out.join(of(parts["overlaps"].groupBy("file", "relation").agg(F.count("*").alias("n")), "overlaps", "relation", "n"), "file", "left")
    out = out.join(of(parts["examples"], "examples", "a", "b", "relation", "area"), "file", "left")
    return out.select("file", F.to_json(F.struct("totals", "layers", "invalid_shapes", "overlaps", "examples")).alias("report"))


def zipped(sheets: list[tuple[int, str]], path: str, suffix: str) -> None:
    """An archive of a project's few sheet files, numbered from 1."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for k, text in sheets:
            z.writestr(f"folha_corte_{k + 1}.{suffix}", text)


def report_json(issues: list[dict]) -> str:
    return json.dumps({"ok": not issues, "issue_count": len(issues), "issues": issues}, ensure_ascii=False, indent=2)
