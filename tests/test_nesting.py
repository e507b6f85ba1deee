import itertools
from uuid import uuid4

import pandas as pd
import pytest

from terrace.functions import polygon as P
from terrace.functions.native import GEOM
from terrace.functions.shapes import to_row
from terrace.operators import kinds
from terrace.plans import nesting as N


def piece(i, geom):
    return N.Piece(str(i), str(i), geom, [], [])


def valid(sheets, bed, margin):
    for s in sheets:
        for p in s:
            x0, y0, x1, y1 = p.bounds
            assert x0 >= margin - 1e-6 and y0 >= margin - 1e-6 and x1 <= bed[0] - margin + 1e-6 and y1 <= bed[1] - margin + 1e-6
        for a, b in itertools.combinations(s, 2):
            assert P.distance(a.geom, b.geom) >= margin - 1e-6


@pytest.mark.parametrize("priority", ["preserve_shapes", "maximize_usage"])
def test_layout_is_valid_and_whole(priority):
    pieces = [piece(k, P.box(0, 0, 10 + 7 * (k % 4), 8 + 5 * (k % 3))) for k in range(9)]
    sheets = N.nest(pieces, (100, 60), 2, priority=priority, effort=50)
    valid(sheets, (100, 60), 2)
    assert sorted(p.id for s in sheets for p in s) == sorted(p.id for p in pieces)
    assert sum(P.area(p.geom) for s in sheets for p in s) == pytest.approx(sum(P.area(p.geom) for p in pieces))


def test_too_large_is_cut_and_kept_whole_otherwise():
    sheets = N.nest([piece(1, P.box(0, 0, 150, 30))], (100, 60), 2)
    valid(sheets, (100, 60), 2)
    placed = [p for s in sheets for p in s]
    assert len(placed) > 1 and {p.source for p in placed} == {"1"} and {p.split for p in placed} == {"required"}
    assert sum(P.area(p.geom) for p in placed) == pytest.approx(4500)
    turned = P.rotated(P.box(0, 0, 100, 60), 30)
    assert len([p for s in N.nest([piece(1, turned)], (110, 70), 5) for p in s]) == 1


def test_holes_are_used_and_parts_are_pieces():
    ring = P.difference(P.box(0, 0, 70, 70), P.box(19, 19, 51, 51))
    sheets = N.nest([piece("ring", ring), piece("small", P.box(0, 0, 20, 20))], (80, 80), 5)
    assert len(sheets) == 1
    two = piece("m", P.box(0, 0, 10, 10) + P.box(20, 0, 30, 10))
    assert sorted(p.id for s in N.nest([two], (50, 50), 2) for p in s) == ["m_0", "m_1"]


def test_limits_and_budget():
    assert N.limits(90, "maximize_usage") == (40, 180) and N.limits(10, "preserve_shapes") == (10, 24)
    assert [N.budget("maximize_usage", n, e, 100) for n, e in ((61, 90), (10, 30), (10, 50), (10, 80))] == [0, 0, 1, 2]
    assert N.priority_of(" Area ") == N.priority_of("ocupação") == "maximize_usage" and N.priority_of("maximize") == N.priority_of(None) == "preserve_shapes"
    assert N.budget("preserve_shapes", 10, 90, 100) == 0 and N.budget("preserve_shapes", 10, 90, 50) == 2
    with pytest.raises(ValueError):
        N.pack([piece(1, P.box(0, 0, 100, 100))], (50, 50), 5, 65, "preserve_shapes")


def test_projects(spark):
    rows = [(f"p{k % 2}", str(k), to_row(P.box(0, 0, 10 + k, 10))) for k in range(6)]
    got = N.nest_projects(spark.createDataFrame(rows, f"project string, id string, geom {GEOM}"), (60, 40), 2).collect()
    assert sorted(r.id for r in got) == sorted(r[1] for r in rows) and {r.sheet for r in got} == {0}


def test_a_long_strip_is_cut_until_all_parts_fit():
    parts = N.split_to_bed(piece("s", P.box(0, 0, 90, 5)), 6, 6)
    assert len(parts) >= 15 and sum(P.area(p.geom) for p in parts) == pytest.approx(450)
    assert all(N.fits(p.geom, 6, 6) for p in parts) and {p.split for p in parts} == {"required"}
    thin = N.cut_parts(P.box(0, 0, 0.5, 0.5), 0.2, 0.2)
    assert [P.area(p) for p in thin] == pytest.approx([0.125, 0.125])


def test_plates_come_last_on_sheets_of_their_own():
    group = N.Piece("base", "base", P.box(0, 0, 20, 10), [], [], zero_base=True, repeat=5, repeat_start=1.0, repeat_step=0.25)
    sheets = N.nest([group, piece("a", P.box(0, 0, 8, 8))], (60, 30), 2)
    assert [[p.id for p in s] for s in sheets] == [["a"], ["base_1", "base_2", "base_3", "base_4"], ["base_5"]]
    assert [p.elevation for p in sheets[1]] == [1.0, 1.25, 1.5, 1.75] and [p.bounds[:2] for p in sheets[1]] == [(2, 2), (24, 2), (2, 14), (24, 14)]
    assert sorted(p.id for s in N.plate_sheets(group, (12, 24), 1) for p in s) == [f"base_{k}" for k in range(1, 6)]


def test_optional_cuts_only_if_asked_and_if_they_save():
    pieces = [piece(k, P.box(0, 0, 60, 52)) for k in range(3)]
    assert len(N.nest(pieces, (100, 68), 2, whole_percent=0)) == 3
    asked = N.nest(pieces, (100, 68), 2, whole_percent=0, split_from=2)
    valid(asked, (100, 68), 2)
    assert len(asked) == 2 and sum(P.area(p.geom) for s in asked for p in s) == pytest.approx(3 * 60 * 52)
    assert {p.split for s in asked for p in s} == {None, "optional"}


def test_out_of_place_layouts_are_refused():
    good = [[piece(1, P.box(2, 2, 10, 10)), piece(2, P.box(12, 2, 20, 10))]]
    assert N.validated(good, (30, 30), 2) is good
    for bad in (P.box(1, 2, 9, 10), P.box(11, 2, 19, 10), P.box(12, 2, 29, 10)):
        with pytest.raises(ValueError):
            N.validated([[piece(1, P.box(2, 2, 10, 10)), piece(2, bad)]], (30, 30), 2)


def test_spots_are_free_of_full_boxes():
    sheet = [piece(1, P.box(2, 2, 12, 12))]
    spots = N.positions(5, 5, sheet, (40, 30), 2, 24, 80)
    assert len(spots) and not ((spots[:, 0] > -5) & (spots[:, 0] < 14 - 1e-6) & (spots[:, 1] > -5) & (spots[:, 1] < 14 - 1e-6)).any()
    assert [14.0, 2.0] in spots.tolist() and [2.0, 14.0] in spots.tolist() and spots[:, 1].tolist() == sorted(spots[:, 1])


def test_projects_of_the_same_pieces_are_laid_out_once(spark):
    groups = spark.sql("SELECT id AS project, array(id % 3, NULL) AS own FROM range(30)")
    rows = kinds.by_kind(groups, ["project"], lambda r: pd.DataFrame({"text": [f"{list(r['own'])} {uuid4()}"]}), "text string").collect()
    assert len(rows) == 30 and len({r.text for r in rows}) == 3 and len({(r.project % 3, r.text) for r in rows}) == 3


def test_ids_come_back_to_pieces_of_equal_projects(spark):
    rows = [(p, f"{p}{k}", to_row(P.box(0, 0, 10 + 60 * k, 8))) for p in ("a", "b") for k in range(2)]
    got = N.nest_projects(spark.createDataFrame(rows, f"project string, id string, geom {GEOM}"), (60, 40), 2).collect()
    assert sorted((r.project, r.source, r.id) for r in got) == sorted((p, f"{p}{k}", f"{p}{k}{end}") for p in "ab" for k, end in ((0, ""), (1, "_0"), (1, "_1")))
