import xml.etree.ElementTree as ET

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.functions import polygon as P
from terrace.functions.native import GEOM
from terrace.functions.shapes import to_row
from terrace.plans import export as X
from terrace.plans import nesting as N
from terrace.sources import dxf

BED = (100.0, 100.0)


def sheet(geom, engraving=(), **more):
    return {"geom": geom, "engraving": list(engraving), "labels": [], "elevation": None, "source_elevation": None} | more


def total(lines):
    return sum(map(P.line_length, lines))


def test_roles_don_t_share_lines():
    two = [sheet(P.box(10, 10, 40, 40), [np.array([(0, 20), (60, 20.0)]), np.array([(10, 10), (40, 10.0)])]), sheet(P.box(40, 10, 70, 40))]
    out = X.sheet_linework(two, BED, 5.0)
    assert total(out["cut"]) == pytest.approx(210)  # the common side once
    assert total(out["engrave"]) == pytest.approx(30)  # clipped to the piece, not on the cut
    assert total(out["bed"]) == pytest.approx(400) and total(out["margin"]) == pytest.approx(360)


def test_labels():
    assert X.label_of(82.0, None) == "82" and X.label_of(None, 1.5) == "1.5" and X.label_of(None, None) == ""
    assert X.text_size("10")[0] == pytest.approx(4.5)
    area = P.box(20, 20, 60, 60)
    x, y = X.label_place(sheet(P.box(10, 10, 90, 90), labels=area), "82", BED, [], 0)
    assert P.covers(area, P.box(x, y, x + X.text_size("82")[0], y + 3))
    out = X.sheet_linework([sheet(P.box(10, 10, 40, 40), elevation=3.0)], BED)
    assert out["mark"]


def test_notches_close_and_lines_straighten():
    notch = [P.polygon([(0, 0), (10, 0), (10, 10), (5.4, 10), (5.4, 9.2), (5, 9.2), (5, 10), (0, 10)])]
    assert P.area(X.prepared(notch, 0.5, 0.05)) == pytest.approx(100, abs=0.05)


def placed(spark):
    rows = [("p", str(k), to_row(P.box(0, 0, 30 + k, 30)), to_row([], [np.array([(5, 5), (25, 5.0)])])) for k in range(12)]
    return N.nest_projects(spark.createDataFrame(rows, f"project string, id string, geom {GEOM}, engraving {GEOM}"), BED, 5)


def test_export_reads_back_in_order(spark):
    segments = X.linework(placed(spark), BED, 5.0).cache()
    sheets = X.to_dxf(segments, units="cm").withColumn("file", F.concat_ws("/", "project", F.col("sheet").cast("string"))).cache()
    back = X.reread(sheets)
    assert X.verify(back, X.defined_layers(sheets)).collect() == []
    assert back.count() == segments.count()
    svg = X.to_svg(segments, BED).first().svg
    assert all(e.tag.endswith(("svg", "g", "line")) for e in ET.fromstring(svg).iter())
    one = X.combined_dxf(segments, BED).collect()
    assert len(one) == 1 and len(dxf.entities(one[0].dxf)) > 0
    # a line drawn twice, a foreign layer and an own colour are found
    text = sheets.first().dxf
    lines = [("CORTE", (0, 0), (5, 0)), ("CORTE", (0, 0), (5, 0)), ("OTHER", (0, 1), (5, 1))]
    bad = dxf.drawing({"CORTE": 1}, lines).replace("62\n256\n", "62\n3\n", 1)
    df = spark.createDataFrame([("bad", bad), ("worse", "nothing\n"), ("good", text)], "file string, dxf string")
    kinds = {(r.file, r.type) for r in X.verify(X.reread(df), X.defined_layers(df.filter("file <> 'worse'"))).collect()}
    assert kinds == {("bad", "overlapping_segments"), ("bad", "unexpected_layer"), ("bad", "not_bylayer"), ("bad", "missing_layer_definition"), ("worse", "invalid_dxf")}


def test_diagnostics(spark):
    rings = [("a", [(0, 0), (10, 0), (10, 10), (0, 10)]), ("a", [(2, 2), (4, 2), (4, 4), (2, 4)]), ("b", [(8, 8), (12, 8), (12, 12), (8, 12)]), ("b", [(8, 8), (12, 8), (12, 12), (8, 12)]), ("b", [(0, 0), (2, 2), (2, 0), (0, 2)])]
    df = spark.createDataFrame([("f", dxf.drawing({"a": 1, "b": 2}, (), rings))], "file string, dxf string")
    got = X.diagnose(X.reread(df))
    assert {(r.layer, r.closed, r.valid, r.invalid) for r in got["layers"].collect()} == {("a", 2, 2, 0), ("b", 3, 2, 1), (None, 5, 4, 1)}
    assert {(r.a, r.b, r.relation) for r in got["overlaps"].collect()} == {(1, 2, "nested"), (1, 3, "overlap"), (1, 4, "overlap"), (3, 4, "duplicate")}
    assert [r.reason for r in got["shapes"].filter("not valid").collect()] == ["Self-intersection"]


def test_archives_and_issue_reports(tmp_path):
    import json
    import zipfile

    X.zipped([(0, "first"), (1, "secönd")], f"{tmp_path}/a.zip", "dxf")
    with zipfile.ZipFile(f"{tmp_path}/a.zip") as z:
        assert {n: z.read(n).decode() for n in z.namelist()} == {"folha_corte_1.dxf": "first", "folha_corte_2.dxf": "secönd"}
        assert all(i.compress_type == zipfile.ZIP_DEFLATED for i in z.infolist())
    assert json.loads(X.report_json([])) == {"ok": True, "issue_count": 0, "issues": []}
    assert json.loads(X.report_json([{"type": "x", "message": "ç"}]))["issue_count"] == 1


def test_segments_of_other_drawings_are_not_paired(spark):
    segs = spark.sql("SELECT CAST(f AS STRING) AS file, k AS id, 'CORTE' AS layer, 0D AS x0, 0D AS y0, 5D AS x1, 0D AS y1 FROM (SELECT explode(sequence(1, 200)) AS f), (SELECT explode(array(1, 2)) AS k)")
    found = X.overlapping(segs)
    assert found.count() == 200
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "file#" in next(line for line in plan.splitlines() if "Join Inner" in line)


def squares(spark, n: int):
    """Segments of sheets with a frame all round and a cut square, one project."""
    from terrace.plans.export import SEGMENTS

    rows = []
    for k in range(n):
        for role, (x0, y0, x1, y1) in (("bed", (0, 0, 100, 100)), ("cut", (10, 10, 30 + k % 7, 40))):
            ring = [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]
            rows += [("p", k, role, 0, s, *map(float, (*a, *b))) for s, (a, b) in enumerate(zip(ring[:-1], ring[1:], strict=True))]
    return spark.createDataFrame(rows, SEGMENTS)


def drawn(text: str) -> list[tuple]:
    return sorted((e["layer"], *sorted(e["points"])) for e in dxf.entities(text))


def test_sheets_of_a_combined_drawing_are_dealt_unless_they_touch(spark, monkeypatch):
    monkeypatch.setattr(X, "SHEETS_A_DEAL", 4)
    segments = squares(spark, 23)
    boxes = lambda step: spark.createDataFrame([("p", k, ((k * step) % 900 * 1.0, 0.0, (k * step) % 900 + 100.0, 100.0)) for k in range(23)], "project string, k int, env struct<minx:double,miny:double,maxx:double,maxy:double>")
    assert {r.k: r.deal for r in X.sheet_deals(boxes(100)).collect()} == dict.fromkeys(range(23), 0)
    apart = boxes(100).withColumn("env", F.struct(*[(F.col("env")[c] + (F.col("k") * 1000 if c[-1] == "x" else 0)).alias(c) for c in ("minx", "miny", "maxx", "maxy")]))
    assert {r.k: r.deal for r in X.sheet_deals(apart).collect()} == {k: k // 4 for k in range(23)}
    many = {gap: X.combined_dxf(segments, BED, gap).first().dxf for gap in (0.0, 5.0)}
    monkeypatch.setattr(X, "SHEETS_A_DEAL", 1000)
    for gap, text in many.items():
        assert drawn(text) == drawn(X.combined_dxf(segments, BED, gap).first().dxf)
        lines = [(np.array(p), np.array(q)) for layer, p, q in drawn(text) if layer == "Placa"]
        assert sum(np.hypot(*(q - p)[:2]) for p, q in lines) == pytest.approx(23 * 400 if gap else 56 * 100)  # common edges once
        assert sum(layer == "CORTE" for layer, *_ in drawn(text)) == 23 * 4


def test_a_covered_stretch_far_from_the_origin_is_not_bridged():
    """A tolerance that grows with the coordinates took 0.05 for nothing at 20,000."""
    out = X.no_line_twice({"cut": [np.array([(20040, 0), (20040.05, 0)])], "bed": [np.array([(20000, 0), (20100, 0.0)])]})
    assert total(out["cut"]) == pytest.approx(0.05) and total(out["bed"]) == pytest.approx(99.95)


def test_lines_of_many_sheets_are_compared_with_near_ones_only(monkeypatch):
    seen = []
    every = P.near_boxes

    def counted(*boxes):
        for i, j in every(*boxes):
            seen.append(len(i))
            yield i, j

    monkeypatch.setattr(P, "near_boxes", counted)
    monkeypatch.setattr(P, "_every_pair", lambda *_: pytest.fail("all pairs"))
    at = [np.array([(k % 40 * 105, k // 40 * 105)]) for k in range(800)]
    square = np.array([(0, 0), (100, 0), (100, 100), (0, 100), (0, 0.0)])
    out = X.no_line_twice({"cut": [square[:3] + o for o in at], "bed": [square + o for o in at]})
    assert total(out["cut"]) == pytest.approx(800 * 200) and total(out["bed"]) == pytest.approx(800 * 200)
    assert 0 < sum(seen) < 800 * 60
