from terrace.plans import layers as L
from terrace.sources import dxf
from terrace.streaming import drawings as D
from pyspark.sql import functions as F


def folder(tmp_path):
    (tmp_path / "a.dxf").write_text(dxf.sample_drawing())
    (tmp_path / "bad.dxf").write_text("this is no drawing\n")
    return str(tmp_path)


def test_reader_and_filters(spark, tmp_path):
    dxf.register(spark)
    d = folder(tmp_path)
    df = spark.read.format("dxf").load(d)
    assert df.filter("error is not null").count() == 1
    assert dxf.polygons(df).count() == 5 and dxf.survey_points(df, "3d_pontos").count() == 13
    assert spark.read.format("dxf").option("layer", "boundary").load(d).filter("error is null").count() == 1
    assert spark.read.format("dxf").load(f"{d}/none.dxf").first().error
    other = dxf.read_drawings(spark, d)
    assert other.count() == df.count()
    ids = sorted((r.id, r.layer) for r in dxf.polygons(other).collect())
    assert [i for i, _ in ids] == list(range(5)) and ids[0][1] == "boundary"


def test_polyline_with_vertices_and_open_ones():
    old = "0\nSECTION\n2\nENTITIES\n0\nPOLYLINE\n8\nx\n70\n1\n0\nVERTEX\n10\n0\n20\n0\n0\nVERTEX\n10\n4\n20\n0\n0\nVERTEX\n10\n4\n20\n4\n0\nSEQEND\n0\nENDSEC\n0\nEOF\n"
    (e,) = dxf.entities(old)
    assert e["closed"] and len(e["points"]) == 3


def test_writer_round_trip(spark, tmp_path):
    dxf.register(spark)
    rows = spark.createDataFrame([("cut", 0.0, 0.0, 5.0, 0.0), ("mark", 1.0, 1.0, 2.0, 2.5)], "layer string, x0 double, y0 double, x1 double, y1 double").coalesce(1)
    rows.write.format("dxf").mode("append").option("layers", "cut:1,mark:2").save(f"{tmp_path}/out")
    back = spark.read.format("dxf").load(f"{tmp_path}/out").collect()
    assert sorted((r.layer, r.points[0].x, r.points[1].y) for r in back) == [("cut", 0, 0), ("mark", 1, 2.5)]
    assert {(r.color, r.linetype, r.lineweight) for r in back} == {(256, "BYLAYER", -1)}


def test_drawing_to_layers_as_batch_and_stream(spark, tmp_path):
    d = folder(tmp_path)

    def pipeline(df):
        polys = dxf.polygons(df)
        rings = polys.filter("layer <> 'boundary'").withColumn("id", F.col("id").cast("string"))
        return L.terrain_layers(rings, dxf.survey_points(df), polys.filter("layer = 'boundary'"), interval=0.5)

    levels = [r.source_elevation for r in pipeline(dxf.read_drawings(spark, d)).orderBy("ord").collect()]
    assert levels == [0, 0.5, 1, 1.5, 2]
    q = D.run_pipeline(D.drawing_stream(spark, d), pipeline, f"{tmp_path}/t", f"{tmp_path}/c")
    q.awaitTermination(120)
    assert sorted(r.source_elevation for r in spark.read.parquet(f"{tmp_path}/t").collect()) == levels


def test_drawings_written_and_read_by_spark(spark, tmp_path):
    sheets = spark.createDataFrame([("a", dxf.sample_drawing()), ("b/1", dxf.drawing({"cut": 1}, [("cut", (0, 0), (5, 1))])), ("c", "no drawing")], "file string, dxf string")
    dxf.write_drawings(sheets, f"{tmp_path}/out")
    polygons, points, entities = dxf.ingest(dxf.read_drawings(spark, f"{tmp_path}/out/*"))
    assert polygons.count() == 5 and points.count() == 13
    assert entities.filter("kind = 'LINE'").count() == 1 and entities.filter("error is not null").count() == 1
    entities.unpersist()


def test_sections_are_read_as_a_stream():
    text = dxf.drawing({"a": 1}, [("a", (0, 0), (1, 1))] * 3)
    assert not isinstance(dxf.tags(text), list)
    assert len(dxf.entities(text + text)) == 3 and len(dxf.entities(text.replace("\n", "\r\n"))) == 3  # the last section of a name counts
    assert dxf.layer_names(text) == ["a"]
    (bad,) = dxf.parse("f", (text + "x\n1\n").encode())
    assert bad[-1]
    assert dxf.parse("f", b"0\nSECTION\n")[0][-1]
