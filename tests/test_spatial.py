from pyspark.sql import functions as F

from terrace.functions.native import box_ring, ring_geom
from terrace.operators import spatial


def test_points_of_one_place_are_searched_once(spark):
    shapes = spark.sql("SELECT 0 AS project, 1L AS id, named_struct('minx', 0D, 'miny', 0D, 'maxx', 4D, 'maxy', 4D) AS env")
    points = spark.sql("SELECT 0 AS project, id AS point, CAST(5 + 9 * (id % 2) AS DOUBLE) AS x, 2D AS y, CAST(id AS DOUBLE) AS z FROM range(100)")
    found = spatial.near_places(shapes, spatial.places(points)).collect()
    assert [(r.x, r.n, r.n_z, r.sum_z, r.distance) for r in found] == [(5.0, 50, 50, float(sum(range(0, 100, 2))), 1.0)]
    every = spatial.near_points(shapes, points).collect()
    assert sorted(r.point for r in every) == list(range(0, 100, 2)) and {r.distance for r in every} == {1.0}


def test_shapes_of_a_large_project_are_dealt(spark):
    shapes = spark.sql("SELECT 0 AS project, id, named_struct('minx', id * 10D, 'miny', 0D, 'maxx', id * 10D + 4, 'maxy', 4D) AS env FROM range(600)")
    points = spark.sql("SELECT 0 AS project, id AS point, id * 10D + 5 AS x, 2D AS y, 0D AS z FROM range(600)")
    found = spatial.near_points(shapes, points)
    assert sorted((r.id, r.point, r.distance) for r in found.collect()) == [(k, k, 1.0) for k in range(600)]


def test_equal_boxes_make_no_pairs(spark, monkeypatch):
    boxes = spark.sql("SELECT 0 AS project, id, named_struct('minx', 0D, 'miny', 0D, 'maxx', 1D + id % 2, 'maxy', 4D) AS env FROM range(50)")
    met, whole = [], spatial.pair_boxes
    monkeypatch.setattr(spatial, "pair_boxes", lambda a, *more: met.append(a.count()) or whole(a, *more))
    found = spatial.containment(boxes).collect()
    assert met == [2] and sorted((r.child, r.parent) for r in found) == [(k, 1) for k in range(0, 50, 2)]


def test_pairs_of_boxes_are_measured_once_for_a_way(spark, monkeypatch):
    boxes = spark.sql("SELECT 0 AS project, id, named_struct('minx', id % 3 * 3D, 'miny', 0D, 'maxx', id % 3 * 3D + 4 + id % 2, 'maxy', 4D) AS env FROM range(60)")
    seen, whole = [], spatial.checkpointed
    monkeypatch.setattr(spatial, "checkpointed", lambda df: seen.append(whole(df)) or seen[-1])
    rows = spatial.kind_pairs(boxes, lambda w, h, dx, dy, w2, h2: (w, dx), "w:double,dx:double").collect()
    box = {k: (k % 3 * 3.0, k % 3 * 3.0 + 4 + k % 2) for k in range(60)}
    want = {(a, b): (box[a][1] - box[a][0], box[b][0] - box[a][0]) for a in box for b in box if a < b and box[a][0] <= box[b][1] and box[b][0] <= box[a][1]}
    assert {(r.a, r.b): (r.w, r.dx) for r in rows} == want and len(rows) == len(want)
    assert seen[0].count() == 6 and seen[-1].count() < 20


def test_equal_shapes_make_no_pairs(spark, monkeypatch):
    sides = spark.sql("SELECT 0 AS project, id, 1D + id % 3 AS s FROM range(60)")
    shapes = sides.select("project", "id", ring_geom(box_ring(F.lit(0), F.lit(0), F.col("s"), F.lit(4))).alias("geom")).withColumn("env", F.col("geom.env"))
    met, whole = [], spatial.pair_boxes
    monkeypatch.setattr(spatial, "pair_boxes", lambda a, *more: met.append(a.count()) or whole(a, *more))
    found = spatial.polygon_containment(shapes).collect()
    assert met == [3] and sorted((r.child, r.parent) for r in found) == [(k, k % 3 + 1) for k in range(60) if k % 3 < 2]
