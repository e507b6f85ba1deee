import numpy as np
import pytest

from terrace.functions import polygon as P
from terrace.functions.shapes import to_row
from terrace.functions.native import GEOM
from terrace.plans import layers as L


def contour(spark, rows):
    return spark.createDataFrame([("p", str(i), layer, to_row(g), k) for k, (i, layer, g) in enumerate(rows)], f"project string, id string, layer string, geom {GEOM}, ord int")


def points(spark, rows):
    return spark.createDataFrame([("p", k, float(x), float(y), float(z)) for k, (x, y, z) in enumerate(rows)], "project string, point long, x double, y double, z double")


def boundary(spark, g):
    return spark.createDataFrame([("p", to_row(g))], f"project string, geom {GEOM}")


TERRACES = {"lower": P.box(6, 4, 60, 44), "bench": P.box(16, 12, 48, 36), "knoll": P.box(26, 18, 38, 30)}
SITE = P.box(0, 0, 64, 48)


def nest(spark, zs):
    """Terraces of one site with survey points on the middles of their upper and lower sides; zs: site, then terraces."""
    pts = [(64, 0, zs[0])]
    for g, z in zip(TERRACES.values(), zs[1:], strict=True):
        x0, y0, x1, y1 = P.bounds(g)
        pts += [((x0 + x1) / 2, y0, z), ((x0 + x1) / 2, y1, z)]
    return contour(spark, [(n, "lines", g) for n, g in TERRACES.items()]), points(spark, pts), boundary(spark, SITE)


def test_ascending_nest(spark):
    rows = L.terrain_layers(*nest(spark, [12, 13, 14, 15]), interval=0.0).orderBy("ord").collect()
    assert [r.source_elevation for r in rows] == [12, 13, 14, 15]
    assert [r.geom.area for r in rows] == pytest.approx([64 * 48, 54 * 40, 32 * 24, 12 * 12])
    assert [r.source_ids for r in rows] == [[], ["lower"], ["bench"], ["knoll"]]
    assert [r.layer_id for r in rows] == ["base", "level_1", "level_2", "level_3"]
    assert rows[0].visible.area == pytest.approx(64 * 48 - 54 * 40) and rows[-1].visible.area == pytest.approx(144)


def test_descending_nest(spark):
    c, p, b = nest(spark, [15, 15, 14, 13])
    rows = L.terrain_layers(c, p, b, interval=1.0).orderBy("ord").collect()
    assert [r.source_elevation for r in rows] == [13, 14, 15]
    assert [r.geom.area for r in rows] == pytest.approx([64 * 48, 64 * 48 - 32 * 24, 64 * 48 - 54 * 40])


def test_neighbouring_strips_take_levels_in_turn(spark):
    edges = [0, 7, 15, 21, 30]
    strips = [(n, "lines", P.box(edges[k], 0, edges[k + 1], 6)) for k, n in enumerate("pqrs")]
    rows = L.terrain_layers(contour(spark, strips), points(spark, [(0, 3, 0), (30, 3, 1.5)]), boundary(spark, P.box(0, 0, 30, 6)), interval=0.5).orderBy("ord").collect()
    assert [r.source_elevation for r in rows] == [0, 0.5, 1, 1.5]
    assert [r.source_ids for r in rows][1:] == [["q"], ["r"], ["s"]]
    assert [r.geom.area for r in rows] == pytest.approx([180, 138, 90, 54])


def test_overrides_and_zero_base(spark):
    c = contour(spark, [("1", "t", P.box(3, 3, 9, 11)), ("2", "t", P.box(15, 3, 22, 10))])
    p = points(spark, [(3, 3, 40), (15, 3, 41)])
    o = spark.createDataFrame([("p", "2", True, None, None, None, 3)], "project string, id string, keep boolean, forced_source double, forced_absolute double, forced_relative double, forced_layer int")
    got = {r.id: r for r in L.estimate(c, p, overrides=o).collect()}
    assert got["2"].elevation == 43 and got["2"].source == "forced"
    o = spark.createDataFrame([("p", "2", True, None, None, 2.5, None)], "project string, id string, keep boolean, forced_source double, forced_absolute double, forced_relative double, forced_layer int")
    assert {r.id: r.elevation for r in L.estimate(c, p, overrides=o).collect()}["2"] == 42
    two = contour(spark, [("1", "t", P.box(8, 8, 30, 20))])
    rows = L.terrain_layers(two, points(spark, [(0, 0, 2), (8, 8, 2.5)]), boundary(spark, P.box(0, 0, 40, 25)), interval=0.5, zero_base=True).orderBy("ord").collect()
    assert [r.elevation for r in rows] == [0, 2, 2.5] and rows[0].repeat_count == 4
    assert L.expanded_repeats(spark.createDataFrame(rows, L.LAYER)).count() == 6


def test_solid_and_hollow_areas():
    def stack():
        return [L.Layer(float(k), float(k), P.box(k * 3, k * 2, 18 - k * 3, 14 - k * 2)) for k in range(3)]

    solid = L.make_solid(stack())
    assert [P.area(x.geom) for x in solid] == pytest.approx([252, 120, 36])
    assert [P.area(x.visible) for x in solid] == pytest.approx([132, 84, 36])
    hollow = L.make_hollow(stack(), 0.5)
    assert [P.area(x.geom) for x in hollow] == pytest.approx([252 - 99, 120 - 25, 36])
    assert [P.area(x.support) for x in hollow[:2]] == pytest.approx([21, 11])
    L.engrave(hollow, "hollow", 0.0)
    assert sum(map(P.line_length, hollow[0].engraving)) == pytest.approx(44)
    far = [L.Layer(0, 0, P.box(0, 0, 10, 10)), L.Layer(1, 1, P.box(2, 2, 4, 4) + P.box(20, 20, 25, 25))]
    assert P.area(L.floating_parts_removed(far)[1].geom) == pytest.approx(4)


def test_rings_and_triangles():
    nodes = [{"id": 0, "geom": P.box(0, 0, 9, 9), "elevation": 0.0}, {"id": 1, "geom": P.box(3, 1, 8, 7), "elevation": 1.0}]
    out = L.ring_layers(nodes, {1: 0}, P.box(0, 0, 9, 9), "hollow")
    assert [P.area(x.geom) for x in out] == pytest.approx([51, 30])
    pts = np.array([(0, 0, 0), (8, 0, 0), (8, 8, 0), (0, 8, 0), (4, 4, 3.0)])
    out = L.tin_layers(pts, P.box(0, 0, 8, 8), 0.75)
    assert [x.source_elevation for x in out] == [0, 0.75, 1.5, 2.25, 3][: len(out)]
    assert P.area(out[2].geom) == pytest.approx(16)


def test_projects_of_the_same_contours_are_stacked_once(spark, monkeypatch):
    from terrace.plans import catalog_shapes

    seen, whole = [], L.by_kind
    monkeypatch.setattr(L, "by_kind", lambda groups, *more: seen.append(groups) or whole(groups, *more))
    assert catalog_shapes.merged_duplicates(spark, "/root/testdata/sf0.001").count() == 10
    assert seen[0].count() == 10 and seen[0].select("own", "outline").distinct().count() == 1
