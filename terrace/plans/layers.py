"""Stacked layers from contours, survey points and a boundary.

Elevations are worked out as DataFrame operators (nearest-band join, bucketed mode, overrides). What follows depends on
order within a project (merging of duplicates, levels along neighbours, layers that repeat the one before), so it is one
group-map per project, the unit of parallelism, over the polygon kernel.
"""

from __future__ import annotations

from collections import Counter, deque
from dataclasses import dataclass, field
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrace.functions import polygon as P
from terrace.functions import scalars as S
from terrace.functions.native import GEOM, ring_line_distance
from terrace.functions.shapes import from_row, lines_of, plain, to_row
from terrace.operators import spatial, survey
from terrace.operators.kinds import by_kind

#: Fixed values of the layer rules.
AREA_TOLERANCE = 0.1
MITRE_LIMIT = 2.0
SHORTEST_ENGRAVING = 2.0
CONTACT_LEAST, CONTACT_SHARE = 0.25, 0.05
WIDTH_LEAST, WIDTH_SHARE = 0.2, 0.15
SUPPORT_SHARE = 0.05


def sort_key(value) -> tuple:
    text = str(value).strip()
    body = text.lstrip("+-")
    return (0, int(text), "") if body.isdigit() and len(text) - len(body) < 2 else (1, 0, text.lower())


def bucket(value: float, step: float, base: float | None = None) -> float:
    if step <= 0:
        return round(value, 6)
    low = round(floor((value + 1e-9) / step) * step, 6)
    return low if base is None else max(low, round(base, 6))


def snap(value: float, step: float) -> float:
    return value if step <= 0 else round(float(np.sign(value)) * floor(abs(value) / step + 0.5) * step, 6)


def mode(values) -> float:
    """The most frequent value, of equals the least."""
    counts = Counter(round(float(v), 6) for v in values)
    return min(counts, key=lambda v: (-counts[v], v)) if counts else 0.0


@dataclass
class Contour:
    id: str
    layer: str | None
    geom: P.Geometry
    elevation: float
    estimated: float
    source: str | None = "point"
    distance: float | None = None
    ids: list = field(default_factory=list)
    layers: list = field(default_factory=list)

    def __post_init__(self):
        self.ids = self.ids or [self.id]
        self.layers = self.layers or [self.layer]


@dataclass
class Layer:
    elevation: float
    source_elevation: float
    geom: P.Geometry
    ids: list = field(default_factory=list)
    layers: list = field(default_factory=list)
    estimated: list = field(default_factory=list)
    removed: float | None = None
    visible: P.Geometry = field(default_factory=list)
    hidden: P.Geometry = field(default_factory=list)
    support: P.Geometry = field(default_factory=list)
    engraving: list = field(default_factory=list)
    repeat: int = 1
    step: float | None = None
    zero_base: bool = False


def same_shape(a: P.Geometry, b: P.Geometry, tolerance: float, share: float = 1e-6) -> bool:
    if not a or not b:
        return not a and not b
    least = min(P.area(a), P.area(b))
    limit = max(tolerance, least * share)
    return abs(P.area(a) - P.area(b)) <= limit and P.area(P.symmetric_difference(a, b)) <= limit


def neighbours(contours: list[Contour], tolerance: float) -> dict[str, set[str]]:
    """Contours with a common boundary."""
    out: dict[str, set[str]] = {}
    envs = [P.bounds(c.geom) for c in contours]
    for i, a in enumerate(contours):
        for j in range(i + 1, len(contours)):
            e, f = envs[i], envs[j]
            if e[0] > f[2] or f[0] > e[2] or e[1] > f[3] or f[1] > e[3]:
                continue
            if P.shared_length(a.geom, contours[j].geom) > max(tolerance, 1e-6):
                out.setdefault(a.id, set()).add(contours[j].id)
                out.setdefault(contours[j].id, set()).add(a.id)
    return out


def infer_levels(contours: list[Contour], base: float, step: float, tolerance: float) -> None:
    """Levels along chains of neighbours: on a spanning tree of each chain of three or more, the labels with the least
    sum of costs; neighbours one level apart cost nothing, observations pull by their weight."""
    if step <= 0 or len(contours) < 2:
        return
    near = neighbours(contours, tolerance)
    by = {c.id: c for c in contours}
    seen: set[str] = set()
    for start in (c.id for c in contours):
        if start in seen or start not in near:
            continue
        part, todo = {start}, [start]
        while todo:
            for n in near[todo.pop()] - part:
                part.add(n)
                todo.append(n)
        seen |= part
        if len(part) < 3:
            continue
        observed = {}
        for k in part:
            c = by[k]
            level = int(np.rint((c.elevation - base) / step))
            if level < 0:
                continue
            if c.source == "forced":
                weight = 1000.0
            elif c.source in ("direct", "point"):
                weight = 1.0 if c.distance is None else min(8.0, max(0.5, 0.25 / (c.distance + 0.02)))
            else:
                weight = 0.25 if c.source == "nearest" else 0.5
            observed[k] = (level, weight)
        if not observed:
            continue
        root = min(part, key=lambda k: (observed[k][0] if k in observed else 10**9, sort_key(k)))
        up: dict[str, str | None] = {root: None}
        order, queue = [], deque([root])
        while queue:
            k = queue.popleft()
            order.append(k)
            for n in sorted(near[k], key=sort_key):
                if n not in up:
                    up[n] = k
                    queue.append(n)
        levels = [v for v, _ in observed.values()]
        labels = np.arange(max(0, min(levels) - len(part)), max(levels) + len(part) + 1)
        gap = np.abs(labels[:, None] - labels[None])
        edge = np.where(gap == 1, 0.0, np.where(gap == 0, 2.0, 80.0 * (gap - 1.0) ** 2))
        cost = {k: observed[k][1] * (labels - observed[k][0]) ** 2.0 if k in observed else np.zeros(len(labels)) for k in order}
        choice = {}
        for k in reversed(order[1:]):
            total = cost[k][None] + edge  # rows: the parent's label
            choice[k] = total.argmin(axis=1)
            cost[up[k]] = cost[up[k]] + total.min(axis=1)
        top = cost[root] + (1000.0 * (labels - observed[root][0]) ** 2 if root in observed else 0.0)
        at = {root: int(top.argmin())}
        for k in order[1:]:
            at[k] = int(choice[k][at[up[k]]])
        for k, i in at.items():
            c = by[k]
            value = round(base + float(labels[i]) * step, 6)
            if c.source != "forced" and abs(value - c.elevation) > 1e-9:
                c.elevation, c.source = value, "topology"


def merge_duplicates(contours: list[Contour], tolerance: float) -> list[Contour]:
    """Contours of one elevation and shape as one; each is compared with the first of a group."""
    out, used = [], set()
    for i, c in enumerate(contours):
        if i in used:
            continue
        group = [c]
        for j in range(i + 1, len(contours)):
            o = contours[j]
            if j not in used and abs(c.elevation - o.elevation) <= 1e-6 and same_shape(c.geom, o.geom, tolerance, 1e-3):
                used.add(j)
                group.append(o)
        if len(group) > 1:
            sources = [g.source for g in group if g.source]
            source = next((s for s in ("forced", "direct") if s in sources), sources[0] if sources else None)
            ids = [x for g in group for x in g.ids]
            c = Contour(ids[0], c.layer, P.union(*[g.geom for g in group]), mode(g.elevation for g in group), mode(g.estimated for g in group), source, None, ids, [x for g in group for x in g.layers])
        out.append(c)
    return out


def forest(contours: list[Contour]) -> dict[str, str]:
    """Direct parents: the smallest larger contour that covers each."""
    areas = [P.area(c.geom) for c in contours]
    order = sorted(range(len(contours)), key=lambda i: -areas[i])
    out = {}
    for i in order:
        over = [j for j in order if areas[j] > areas[i] and P.covers(contours[j].geom, contours[i].geom)]
        if over:
            out[contours[i].id] = contours[min(over, key=lambda j: (areas[j], order.index(j)))].id
    return out


def cells(contours: list[Contour], parents: dict[str, str], boundary: P.Geometry, base: float, tolerance: float) -> list[tuple[P.Geometry, float]]:
    """The bands between contours and their elevations."""
    by = {c.id: c for c in contours}
    kids: dict[str, list[Contour]] = {}
    for child, parent in parents.items():
        kids.setdefault(parent, []).append(by[child])
    tops = [c for c in contours if c.id not in parents]
    lower = lambda c: [k.elevation for k in kids.get(c.id, []) if k.elevation < c.elevation]
    outside = P.cleaned(P.difference(boundary, P.union(*[c.geom for c in tops])) if tops else boundary, tolerance)
    out = []
    if P.area(outside) > tolerance:
        out.append((outside, max((c.elevation for c in tops if lower(c)), default=base)))
    for c in contours:
        shape = P.intersection(c.geom, boundary)
        if kids.get(c.id):
            shape = P.difference(shape, P.union(*[k.geom for k in kids[c.id]]))
        shape = P.cleaned(shape, tolerance)
        if P.area(shape) > tolerance:
            down = lower(c)
            up = any(k.elevation > c.elevation for k in kids.get(c.id, []))
            out.append((shape, max(down) if down and not up else c.elevation))
    return out


def _pairs(ids: list, layers: list) -> tuple[list, list]:
    first = dict(zip(reversed(ids), reversed(layers), strict=True))
    order = list(dict.fromkeys(ids))
    return order, [first[i] for i in order]


def stack_layers(contours: list[Contour], boundary: P.Geometry, base: float, step: float, tolerance: float = AREA_TOLERANCE, adjacency: float = 1e-6) -> list[Layer]:
    """Layers bottom up; a level that changes nothing joins the layer before."""
    infer_levels(contours, base, step, adjacency)
    contours = merge_duplicates(contours, tolerance)
    groups: dict[float, list[Contour]] = {}
    for c in contours:
        c.elevation = snap(c.elevation, step)
        groups.setdefault(c.elevation, []).append(c)
    bands = cells(contours, forest(contours), boundary, base, tolerance)
    out = [Layer(0.0, base, boundary)]
    for level in sorted(groups):
        group = groups[level]
        above = [g for g, z in bands if z >= level - 1e-9]
        shape = P.cleaned(P.intersection(P.union(*above), boundary), tolerance) if above else []
        if P.area(shape) <= tolerance:
            continue
        ids, layers = [x for c in group for x in c.ids], [x for c in group for x in c.layers]
        estimated = [round(c.estimated, 3) for c in group]
        last = out[-1]
        if same_shape(last.geom, shape, tolerance):
            last.ids, last.layers = _pairs(last.ids + ids, last.layers + layers)
            last.estimated += estimated
            continue
        ids, layers = _pairs(ids, layers)
        out.append(Layer(round(level - base, 3), round(level, 3), shape, ids, layers, estimated, round(P.area(last.geom) - P.area(shape), 3)))
    home: dict = {}
    wanted = {i: c.elevation for c in contours for i in c.ids}
    for k, layer in enumerate(out[1:], 1):
        for i, name in zip(layer.ids, layer.layers, strict=True):
            cost = (abs(layer.source_elevation - wanted[i]), k)
            if i not in home or cost < home[i][0]:
                home[i] = (cost, k, name)
    for k, layer in enumerate(out[1:], 1):
        own = sorted((i for i, h in home.items() if h[1] == k), key=sort_key)
        layer.ids, layer.layers = own, [home[i][2] for i in own]
    return out


def support_strip(visible: P.Geometry, hidden: P.Geometry, margin: float, tolerance: float) -> P.Geometry:
    """The part of what the next layer hides that lies within the margin of what stays visible, without parts that touch
    it too little or are too thin."""
    if margin <= 0 or not visible or not hidden:
        return []
    near = P.intersection(P.offset(visible, margin, limit=MITRE_LIMIT), hidden)
    out = []
    for part in near:
        contact = P.shared_length([part], visible)
        if contact < max(CONTACT_LEAST, CONTACT_SHARE * margin) or P.area([part]) <= max(tolerance, SUPPORT_SHARE * margin * margin):
            continue
        if P.area([part]) / max(contact, 1e-9) < min(max(WIDTH_LEAST, WIDTH_SHARE * margin), margin):
            continue
        out.append(part)
    return out


def make_solid(layers: list[Layer], tolerance: float = AREA_TOLERANCE) -> list[Layer]:
    """Marks of each layer what the next one hides."""
    shapes = [P.cleaned(P.union(x.visible, x.hidden) if x.visible and x.hidden else x.geom, tolerance) for x in layers]
    out = []
    for k, x in enumerate(layers):
        if not shapes[k]:
            continue
        nxt = shapes[k + 1] if k + 1 < len(shapes) else []
        x.geom = shapes[k]
        x.hidden = P.cleaned(P.intersection(shapes[k], nxt), tolerance) if nxt else []
        x.visible = P.cleaned(P.difference(shapes[k], nxt), tolerance) if nxt else shapes[k]
        x.support = x.hidden
        out.append(x)
    return out


def make_hollow(layers: list[Layer], margin: float = 0.0, limit: P.Geometry | None = None, tolerance: float = AREA_TOLERANCE) -> list[Layer]:
    """Layers cut out under the next one but for a strip to glue on."""
    shapes = [x.geom for x in layers]
    limit = limit or next((s for s in shapes if s), [])
    out = []
    for k, x in enumerate(layers):
        if not shapes[k]:
            continue
        own = P.intersection(shapes[k], limit) if limit else shapes[k]
        nxt = shapes[k + 1] if k + 1 < len(shapes) else []
        nxt = P.intersection(nxt, limit) if nxt and limit else nxt
        hidden = P.cleaned(P.intersection(own, nxt), tolerance) if nxt else []
        visible = P.cleaned(P.difference(own, nxt), tolerance) if nxt else P.cleaned(own, tolerance)
        support = P.cleaned(support_strip(visible, hidden, margin, tolerance), tolerance)
        ring = P.cleaned(P.union(visible, support), tolerance) if support else visible
        if P.area(ring) <= tolerance:
            continue
        x.geom, x.visible, x.hidden, x.support = ring, visible, hidden, support
        out.append(x)
    return out


def prepend_zero_base(layers: list[Layer], boundary: P.Geometry, base: float, step: float, tolerance: float = AREA_TOLERANCE) -> list[Layer]:
    """A run-length layer from zero up to the base; the others then stand at their true elevations."""
    shape = P.cleaned(boundary, tolerance)
    if not layers or step <= 0 or base <= step / 2 or P.area(shape) <= tolerance:
        return layers
    n = int(np.ceil((base - 1e-9) / step))
    for x in layers:
        x.elevation = round(x.source_elevation, 3)
    return [Layer(0.0, 0.0, shape, repeat=n, step=round(step, 6), zero_base=True), *layers]


def engrave(layers: list[Layer], mode_: str, offset: float, tolerance: float = AREA_TOLERANCE) -> None:
    """Lines that show where the next layer goes."""
    for k, x in enumerate(layers):
        lines: list[np.ndarray] = []
        if mode_ == "hollow":
            if x.support and x.visible:
                lines = P.boundary_within(x.visible, x.support)
        elif k + 1 < len(layers):
            nxt = layers[k + 1].geom
            inner = P.offset(nxt, -offset, limit=5.0) if offset > 0 else nxt
            lines = [part for line in P.boundary_within(inner, x.geom) for part in P.clip_line(line, nxt)] if inner else []
        x.engraving = x.engraving + [line for line in P.merged_lines(lines) if P.line_length(line) >= SHORTEST_ENGRAVING]


def floating_parts_removed(layers: list[Layer]) -> list[Layer]:
    """Parts that don't touch the layer below go."""
    for k in range(1, len(layers)):
        under = layers[k - 1].geom
        layers[k].geom = [p for p in layers[k].geom if P.area(P.intersection([p], under)) > 1e-9 or P.shared_length([p], under) > 1e-9]
    return [x for x in layers if x.geom]


def tin_layers(points: np.ndarray, boundary: P.Geometry, step: float, tolerance: float = AREA_TOLERANCE) -> list[Layer]:
    """Layers from triangulated points: of a place's points the last counts."""
    last = {(round(x, 8), round(y, 8)): (x, y, z) for x, y, z in points}
    p = np.array(list(last.values()), float).reshape(-1, 3)
    if len(p) < 3:
        return []
    low = p[:, 2].min()
    out = [Layer(0.0, float(low), boundary)]
    tri = P.triangles(p[:, :2])
    level = float(np.ceil(low / step) * step + step)
    while level <= p[:, 2].max() + 1e-9:
        parts = [c for t in tri if (c := P.clipped_above(p[t], level))]
        shape = P.intersection(P.union(*[[c] for c in parts]), boundary) if parts else []
        if P.area(shape) > tolerance:
            out.append(Layer(round(level - low, 3), round(level, 3), shape))
        level += step
    return make_solid(out, tolerance)


def ring_layers(nodes: list[dict], parents: dict, boundary: P.Geometry, mode_: str = "solid", changes=(), offset: float = 1.0, margin: float = 0.0, tolerance: float = AREA_TOLERANCE) -> list[Layer]:
    """Layers of a containment forest with known elevations. nodes: id, geom, elevation, descending."""
    kids: dict = {}
    by = {n["id"]: n for n in nodes}
    for c, p in parents.items():
        kids.setdefault(p, []).append(by[c])
    out = []
    for n in sorted(nodes, key=lambda n: n["elevation"]):
        inner = P.union(*[k["geom"] for k in kids[n["id"]]]) if kids.get(n["id"]) else []
        layer = Layer(n["elevation"], n["elevation"], [], [n["id"]])
        if mode_ == "hollow":
            ring, hole = P.difference(n["geom"], inner), P.intersection(n["geom"], inner) if inner else []
            layer.visible, layer.hidden = (hole, ring) if n["id"] in changes and hole else (ring, hole)
            layer.support = support_strip(layer.visible, layer.hidden, margin, tolerance)
            layer.geom = P.union(layer.visible, layer.support) if layer.support else layer.visible
        elif n.get("descending") or same_shape(n["geom"], boundary, tolerance):
            layer.geom = boundary
        else:
            layer.geom = P.difference(boundary, n["geom"])
        for k in kids.get(n["id"], []):
            shell = P.offset([[k["geom"][0][0]]], -offset, "round") if offset > 0 else k["geom"]
            layer.engraving += [np.vstack([r, r[:1]]) for r in P.rings(shell)]
        if layer.geom:
            out.append(layer)
    return make_solid(out, tolerance) if mode_ == "solid" else out


LAYER = (
    "project string, ord int, layer_id string, elevation double, source_elevation double, source_ids array<string>, source_layers array<string>, estimated array<double>, removed_area double,"
    f" geom {GEOM}, visible {GEOM}, hidden {GEOM}, support {GEOM}, engraving {GEOM}, repeat_count int, repeat_interval double, zero_base boolean"
)


def layer_rows(project: str, layers: list[Layer]) -> pd.DataFrame:
    rows = [
        (
            project, k, "base" if k == 0 else f"level_{k}", float(x.elevation), float(x.source_elevation), [str(i) for i in x.ids], [None if v is None else str(v) for v in x.layers], [float(v) for v in x.estimated], x.removed,
            to_row(x.geom), to_row(x.visible), to_row(x.hidden), to_row(x.support), to_row([], x.engraving), x.repeat, x.step, x.zero_base,
        )
        for k, x in enumerate(layers)
    ]
    return pd.DataFrame(rows, columns=[c.split()[0] for c in "project ord layer_id elevation source_elevation source_ids source_layers estimated removed_area geom visible hidden support engraving repeat_count repeat_interval zero_base".split()])


def estimate(contours: DataFrame, points: DataFrame, step: float = 0.0, interval: float = 1.0, reach: float | None = 0.2, overrides: DataFrame | None = None, target: int = 0) -> DataFrame:
    """Contours with elevation, estimated, source, distance, base and step. contours: project, id, layer, geom; points:
    project, point, x, y, z; overrides: project, id, keep, forced_source, forced_absolute, forced_relative, forced_layer."""
    shapes = contours.filter((F.size("geom.polys") > 0) & (F.col("geom.area") > AREA_TOLERANCE)).withColumn("ring", F.col("geom.polys")[0]["shell"]).withColumn("env", F.col("geom.env"))
    outline = lambda s, x, y: ring_line_distance(s["ring"], x, y)
    slim = shapes.select("project", "id", "ring", "env")
    wanted = reach if reach and reach > 0 else None
    near = spatial.near_points(slim, points, wanted, outline, both=True)
    inferred = F.lit(None).cast("double")
    if not (step > 0 or interval > 0):
        rough = near.filter("in_band").groupBy("project", "id").agg(F.avg("z").alias("z"))
        guess = survey.infer_interval(rough, ["project"], F.col("z"), target)
        bases = points.groupBy("project").agg(F.min("z").alias("low")).join(guess, "project", "left")
        inferred = F.col("interval")
    else:
        bases = points.groupBy("project").agg(F.min("z").alias("low"))
    bases = bases.withColumn("step", S.topographic_step(F.lit(float(step)), F.lit(float(interval)), inferred))
    bases = bases.select("project", "step", S.bucket_elevation(F.col("low"), F.col("step")).alias("base"))

    level = S.bucket_elevation(F.col("z"), F.col("step"), F.col("base"))
    samples = near.join(bases, "project").select("project", "id", level.alias("level"), "distance", "in_band", "in_reach", F.lit(1).alias("n"), F.col("z").alias("sum_z"))
    votes = survey.bucketed_votes(samples, ["project", "id"], {"nearest": "in_band", "direct": "in_reach"})
    out = shapes.drop("ring", "env").join(bases, "project").join(votes.drop("mean_z"), ["project", "id"], "left")
    direct = F.col("direct") if wanted is not None else F.lit(None).cast("double")
    forced = F.lit(None).cast("double")
    if overrides is not None:
        names = ["keep", "forced_source", "forced_absolute", "forced_relative", "forced_layer"]
        out = out.join(overrides.select("project", "id", *names), ["project", "id"], "left").filter(F.coalesce("keep", F.lit(True)))
        forced = S.override_elevation(*[F.col(n) for n in names[1:]], F.col("base"), F.lit(float(interval)))
    fallback = F.lit("nearest" if reach and reach > 0 else "point")
    out = out.withColumn("forced", forced)
    level = F.coalesce(F.when(F.col("forced").isNotNull(), S.bucket_elevation(F.col("forced"), F.col("step"), F.col("base"))), direct, F.col("nearest"))
    source = F.when(F.col("forced").isNotNull(), "forced").when(direct.isNotNull(), "direct").otherwise(fallback)
    out = out.select(
        "project", "id", "layer", "geom", level.alias("elevation"), F.coalesce("forced", level).alias("estimated"), source.alias("source"),
        F.when(F.col("forced").isNull(), F.col("nearest_distance")).alias("distance"), "base", "step",
    )
    return out.filter("elevation is not null")


def terrain_layers(contours: DataFrame, points: DataFrame, boundaries: DataFrame, slicing: str = "solid", offset: float = 5.0, glue_margin: float = 0.0, zero_base: bool = False, tolerance: float = AREA_TOLERANCE, **how) -> DataFrame:
    """Layers of every project. boundaries: project, geom. contours may have ``ord``, their order in the drawing."""
    known = estimate(contours, points, **how)
    if "ord" in contours.columns:
        known = known.join(contours.select("project", "id", "ord"), ["project", "id"])

    def build(site: dict) -> pd.DataFrame:
        left = pd.DataFrame(map(plain, site["own"]))
        boundary = from_row(plain(site["outline"]))
        left = left.sort_values("ord", kind="stable") if "ord" in left else left.iloc[sorted(range(len(left)), key=lambda i: sort_key(left.iloc[i]["id"]))]
        own = [
            Contour(r.id, r.layer, from_row(r.geom), float(r.elevation), float(r.estimated), r.source, None if pd.isna(r.distance) else float(r.distance))
            for r in left.itertuples()
        ]
        base, step = float(left.iloc[0]["base"]), float(left.iloc[0]["step"])
        out = stack_layers(own, boundary, base, step, tolerance)
        if slicing == "hollow":
            out = make_hollow(out, glue_margin, boundary, tolerance)
        if zero_base:
            out = prepend_zero_base(out, boundary, base, step, tolerance)
        if slicing == "solid":
            out = make_solid(out, tolerance)
        engrave(out, slicing, offset, tolerance)
        return layer_rows("", out).drop(columns="project")

    # projects of the same contours, elevations and outline are stacked once
    names = [c for c in ("ord", "id", "layer", "geom", "elevation", "estimated", "source", "distance", "base", "step") if c in known.columns]
    own = known.groupBy("project").agg(F.array_sort(F.collect_list(F.struct(*names))).alias("own"))
    outlines = boundaries.groupBy(F.col("project").alias("place")).agg(F.first("geom").alias("outline"))
    sites = own.join(outlines, F.col("project").eqNullSafe(F.col("place"))).drop("place")
    made = by_kind(sites, ["project"], build, LAYER.removeprefix("project string, "))
    return made.withColumn("project", F.col("project").cast("string"))


def triangulated_layers(points: DataFrame, boundaries: DataFrame, step: float, tolerance: float = AREA_TOLERANCE) -> DataFrame:
    """Layers of every project from its survey points alone (project, point, x, y, z), in the order of their numbers."""

    def build(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return layer_rows("", [])
        xyz = left.sort_values("point", kind="stable")[["x", "y", "z"]].to_numpy(float)
        return layer_rows(left.iloc[0]["project"], tin_layers(xyz, from_row(right.iloc[0]["outline"]), step, tolerance))

    outlines = boundaries.select(F.col("project").alias("place"), F.col("geom").alias("outline"))
    return points.groupBy("project").cogroup(outlines.groupBy("place")).applyInPandas(build, LAYER)


def forest_layers(nodes: DataFrame, boundaries: DataFrame, slicing: str = "solid", changes: tuple = (), offset: float = 1.0, glue_margin: float = 0.0, tolerance: float = AREA_TOLERANCE) -> DataFrame:
    """Layers of every project's containment forest. nodes: project, id, parent, geom, elevation, descending."""

    def build(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return layer_rows("", [])
        own = [{"id": r.id, "geom": from_row(r.geom), "elevation": float(r.elevation), "descending": bool(r.descending)} for r in left.sort_values("id", kind="stable").itertuples()]
        parents = {r.id: r.parent for r in left.itertuples() if r.parent is not None and not pd.isna(r.parent)}
        out = ring_layers(own, parents, from_row(right.iloc[0]["outline"]), slicing, changes, offset, glue_margin, tolerance)
        return layer_rows(left.iloc[0]["project"], out)

    outlines = boundaries.select(F.col("project").alias("place"), F.col("geom").alias("outline"))
    return nodes.groupBy("project").cogroup(outlines.groupBy("place")).applyInPandas(build, LAYER)


def expanded_repeats(layers: DataFrame) -> DataFrame:
    """Run-length layers, one row each."""
    return layers.select("*", F.explode(S.repeat_elevations(F.col("elevation"), F.coalesce("repeat_interval", F.lit(0.0)), F.col("repeat_count"))).alias("at")).withColumn("elevation", F.col("at")).drop("at")


def scaled(layers: DataFrame, factor: float) -> DataFrame:
    """All shapes of layers scaled about the origin, natively."""
    ring = lambda r: F.transform(r, lambda p: F.struct((p["x"] * factor).alias("x"), (p["y"] * factor).alias("y")))
    out = layers
    for c in ("geom", "visible", "hidden", "support", "engraving"):
        g = F.col(c)
        polys = F.transform(g["polys"], lambda p: F.struct(ring(p["shell"]).alias("shell"), F.transform(p["holes"], ring).alias("holes")))
        env = F.when(g["env"].isNotNull(), F.struct(*[(g["env"][n] * factor).alias(n) for n in ("minx", "miny", "maxx", "maxy")]))
        out = out.withColumn(c, F.struct(polys.alias("polys"), F.transform(g["lines"], ring).alias("lines"), env.alias("env"), (g["area"] * factor * factor).alias("area")))
    return out


__all__ = ["Contour", "Layer", "estimate", "terrain_layers", "ring_layers", "tin_layers", "lines_of"]
