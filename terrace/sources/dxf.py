"""DXF drawings as a Spark data source, reader and writer.

``spark.read.format("dxf").load(path)`` gives one row per entity of model space: file, entity (its number), kind, layer,
closed (flag), points (x, y, z), color, linetype, lineweight, error. A file that can't be read is one row with an error.
The option ``layer`` reads one layer only. Files are the unit of parallelism.

The format's reader and writer open files themselves, so they are for folders that the driver and all executors mount. On
any other store use ``read_drawings`` and ``write_drawings``, which go through Spark's own readers and writers.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = (
    "file string, entity int, kind string, layer string, closed boolean, points array<struct<x:double,y:double,z:double>>,"
    " color int, linetype string, lineweight int, error string"
)
#: Group codes of the format.
KIND, LAYER, LINETYPE, COLOR, FLAGS, WEIGHT = 0, 8, 6, 62, 70, 370
BYLAYER_COLOR, BYLAYER, BYLAYER_WEIGHT = 256, "BYLAYER", -1
SHAPES = ("LWPOLYLINE", "POLYLINE", "POINT", "LINE")


def tags(text: str) -> Iterator[tuple[int, str]]:
    """Group codes and values, one after the other, so that a large drawing is not held as pairs."""
    text = text.replace("\r\n", "\n").replace("\r", "\n")
    at = 0
    while (mid := text.find("\n", at)) >= 0:
        end = text.find("\n", mid + 1)
        end = len(text) if end < 0 else end
        yield int(text[at:mid].strip()), text[mid + 1 : end].strip()
        at = end + 1


def groups(pairs: Iterable[tuple[int, str]], name: str) -> Iterator[list[tuple[int, str]] | None]:
    """What a section holds, a list of pairs from each kind on; None where a section of the name begins: the last one counts."""
    inside = opened = False
    group: list[tuple[int, str]] = []
    for pair in pairs:
        if opened:
            inside, opened = pair[1] == name, False
            if inside:
                yield None
        if pair in ((0, "SECTION"), (0, "ENDSEC")):
            if group:
                yield group
            inside, opened, group = False, pair[1] == "SECTION", []
        elif inside and pair[0] == KIND:
            if group:
                yield group
            group = [pair]
        elif group:
            group.append(pair)
    if opened:
        raise ValueError("section without a name")
    if group:
        yield group


def _number(pairs, code: int, default):
    return next((type(default)(float(v)) for c, v in pairs if c == code), default)


def _text(pairs, code: int, default: str) -> str:
    return next((v for c, v in pairs if c == code), default)


def _points(pairs, x=10, y=20, z=30) -> list[tuple[float, float, float]]:
    out: list[list[float]] = []
    for c, v in pairs:
        if c == x:
            out.append([float(v), 0.0, 0.0])
        elif c == y and out:
            out[-1][1] = float(v)
        elif c == z and out:
            out[-1][2] = float(v)
    return [tuple(p) for p in out]


def entities(text: str) -> list[dict]:
    """Entities of model space that have geometry; a drawing without an entity section is an error."""
    out: list[dict] | None = None
    chain: dict | None = None
    for e in groups(tags(text), "ENTITIES"):
        if e is None:
            out, chain = [], None
            continue
        kind = e[0][1]
        if kind == "VERTEX" and chain is not None:
            chain["points"] += _points(e)
            continue
        if kind == "SEQEND":
            chain = None
            continue
        if _number(e, 67, 0) == 1:  # paper space
            continue
        row = {
            "kind": kind, "layer": _text(e, LAYER, "0"), "closed": bool(_number(e, FLAGS, 0) & 1) if kind in ("LWPOLYLINE", "POLYLINE") else False,
            "color": _number(e, COLOR, BYLAYER_COLOR), "linetype": _text(e, LINETYPE, BYLAYER), "lineweight": _number(e, WEIGHT, BYLAYER_WEIGHT), "points": [],
        }
        if kind == "LWPOLYLINE":
            row["points"] = _points([p for p in e if p[0] in (10, 20)])
        elif kind == "POINT":
            row["points"] = _points(e)[:1]
        elif kind == "LINE":
            row["points"] = _points(e)[:1] + _points(e, 11, 21, 31)[:1]
        elif kind == "POLYLINE":
            chain = row
        out.append(row)
    if out is None:
        raise ValueError("no ENTITIES section")
    return out


def layer_names(text: str) -> list[str]:
    out: list[str] = []
    for t in groups(tags(text), "TABLES"):
        if t is None:
            out = []
        elif t[0][1] == "LAYER":
            out.append(_text(t, 2, "0"))
    return out


def parsed(name: str, data: bytes) -> Iterator[tuple]:
    """Rows of the schema."""
    try:
        found = entities(data.decode("utf-8", errors="ignore"))
    except (ValueError, IndexError) as e:
        yield (name, None, None, None, None, None, None, None, None, str(e) or "not a drawing")
        return
    for k, e in enumerate(found):
        yield (name, k, e["kind"], e["layer"], e["closed"], [{"x": x, "y": y, "z": z} for x, y, z in e["points"]], e["color"], e["linetype"], e["lineweight"], None)


def parse(name: str, data: bytes) -> list[tuple]:
    return list(parsed(name, data))


def read_drawings(spark: SparkSession, path: str) -> DataFrame:
    """Drawings of a folder or pattern, read by Spark."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in SCHEMA.replace("struct<x:double,y:double,z:double>", "s").split(", ")]
        for b in batches:
            yield pd.DataFrame([r for path_, data in zip(b["path"], b["content"], strict=True) for r in parse(path_, bytes(data))], columns=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, SCHEMA)


def write_drawings(sheets: DataFrame, path: str, text: str = "dxf") -> None:
    """Drawings (file, dxf), one text file each in a folder ``file=...``, which ``read_drawings(path + "/*")`` reads. Written
    by Spark, so it works on every store and a lost task leaves nothing behind."""
    body = F.regexp_replace(F.col(text), r"\n$", "")  # the writer ends the last line
    sheets.select("file", body.alias("value")).write.partitionBy("file").mode("error").text(path)


def ingest(drawings: DataFrame, layer: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Polygons, survey points and the entities they come from, which are parsed once and kept for all that read them."""
    kept = drawings.cache()
    return polygons(kept), survey_points(kept, layer), kept


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.layer: str | None = options.get("layer")

    def partitions(self):
        root = self.path.removeprefix("file://")
        found = sorted(glob.glob(f"{root}/*.dxf")) if os.path.isdir(root) else sorted(glob.glob(root)) or [root]
        return [_File(p) for p in found]

    def read(self, partition):
        try:
            with open(partition.path, "rb") as f:
                data = f.read()
        except OSError as e:
            yield (partition.path, None, None, None, None, None, None, None, None, str(e))
            return
        for row in parse(partition.path, data):
            if self.layer is None or row[-1] is not None or (row[3] or "") == self.layer:
                yield row


class _Commit(WriterCommitMessage):
    def __init__(self, path: str | None):
        self.path = path


class _Writer(DataSourceWriter):
    """Rows (layer, x0, y0, x1, y1) to one drawing per partition, under a temporary name until the job commits."""

    def __init__(self, options: dict, overwrite: bool):
        self.path = options["path"].removeprefix("file://")
        self.layers = options.get("layers", "")
        self.overwrite = overwrite

    def write(self, rows):
        from pyspark import TaskContext

        lines = [(r.layer, (r.x0, r.y0), (r.x1, r.y1)) for r in rows]
        if not lines:
            return _Commit(None)
        names = {x.split(":")[0]: int(x.split(":")[1]) for x in self.layers.split(",") if x} or {name: 7 for name, *_ in lines}
        os.makedirs(self.path, exist_ok=True)
        at = f"{self.path}/.part-{TaskContext.get().partitionId():05d}.dxf.tmp"
        with open(at, "w") as f:
            f.write(drawing(names, lines))
        return _Commit(at)

    def commit(self, messages):
        if self.overwrite:
            for old in glob.glob(f"{self.path}/*.dxf"):
                os.remove(old)
        for m in messages:
            if m is not None and m.path:
                folder, name = os.path.split(m.path)
                os.replace(m.path, f"{folder}/{name[1:-4]}")

    def abort(self, messages):
        for m in messages:
            if m is not None and m.path and os.path.exists(m.path):
                os.remove(m.path)


class DxfSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "dxf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool):
        return _Writer(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DxfSource)


def closed_shapes(drawings: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Closed polylines: file, entity, layer, closed_type, ring (closed array of points)."""
    d = drawings.filter(F.col("kind").isin("LWPOLYLINE", "POLYLINE") & (F.size("points") >= 3))
    ring = F.transform("points", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    d = d.withColumn("ring", ring)
    a, b = F.col("ring")[0], F.element_at("ring", -1)
    met = (F.abs(a["x"] - b["x"]) <= tolerance) & (F.abs(a["y"] - b["y"]) <= tolerance)
    kind = F.when(F.col("closed"), "closed_flag").when(met, "closed_coordinates")
    d = d.withColumn("closed_type", kind).filter("closed_type is not null")
    return d.select("file", "entity", "layer", "closed_type", F.when(met, F.col("ring")).otherwise(F.concat("ring", F.array(a))).alias("ring"))


def polygons(drawings: DataFrame) -> DataFrame:
    """Valid closed polylines: project (file), id (from 0 over valid ones), layer, geom, elevation."""
    from pyspark.sql import Window

    from terrace.functions.native import ring_geom
    from terrace.functions.shapes import g_validity

    ok = closed_shapes(drawings).withColumn("v", g_validity("ring")).filter("v.ok")
    number = F.row_number().over(Window.partitionBy("file").orderBy("entity")) - 1
    return ok.select(F.col("file").alias("project"), number.cast("long").alias("id"), "layer", ring_geom(F.col("ring")).alias("geom"), F.lit(0.0).alias("elevation"))


def survey_points(drawings: DataFrame, layer: str | None = "3D_PONTOS") -> DataFrame:
    """POINT entities of a layer, whatever its case; None takes all."""
    d = drawings.filter((F.col("kind") == "POINT") & (F.size("points") > 0))
    if layer is not None:
        d = d.filter(F.lower("layer") == layer.lower())
    p = F.col("points")[0]
    return d.select(F.col("file").alias("project"), F.col("entity").cast("long").alias("point"), p["x"].alias("x"), p["y"].alias("y"), p["z"].alias("z"), "layer")


def _tag(code: int, value) -> str:
    return f"{code:>3}\n{value}\n"


def fmt(value: float) -> str:
    text = f"{value:.6f}".rstrip("0").rstrip(".")
    return "0" if text in ("-0", "") else text


#: $INSUNITS of the format.
UNITS = {"mm": 4, "cm": 5, "m": 6, "auto": 4}


def head(layers: dict[str, int], units: str = "mm") -> str:
    """What comes before a drawing's entities."""
    out = [_tag(0, "SECTION"), _tag(2, "HEADER"), _tag(9, "$ACADVER"), _tag(1, "AC1024"), _tag(9, "$INSUNITS"), _tag(70, UNITS.get(units, 4)), _tag(0, "ENDSEC")]
    out += [_tag(0, "SECTION"), _tag(2, "TABLES"), _tag(0, "TABLE"), _tag(2, "LAYER"), _tag(70, len(layers))]
    for name, color in layers.items():
        out += [_tag(0, "LAYER"), _tag(100, "AcDbSymbolTableRecord"), _tag(100, "AcDbLayerTableRecord"), _tag(2, name), _tag(70, 0), _tag(62, max(1, min(255, int(color)))), _tag(6, "Continuous")]
    return "".join([*out, _tag(0, "ENDTAB"), _tag(0, "ENDSEC"), _tag(0, "SECTION"), _tag(2, "ENTITIES")])


#: What comes after them.
TAIL = _tag(0, "ENDSEC") + _tag(0, "EOF")


def _by_layer(name: str) -> list[str]:
    return [_tag(8, name), _tag(6, BYLAYER), _tag(62, BYLAYER_COLOR), _tag(370, BYLAYER_WEIGHT)]


def line_entities(lines) -> str:
    """LINE entities: (layer, (x, y), (x, y))."""
    out: list[str] = []
    for name, a, b in lines:
        out += [_tag(0, "LINE"), _tag(100, "AcDbEntity"), *_by_layer(name), _tag(100, "AcDbLine")]
        out += [_tag(10, fmt(a[0])), _tag(20, fmt(a[1])), _tag(30, 0), _tag(11, fmt(b[0])), _tag(21, fmt(b[1])), _tag(31, 0)]
    return "".join(out)


def drawing(layers: dict[str, int], lines=(), polylines=(), points=(), units: str = "mm") -> str:
    """An R2010 drawing. lines: (layer, (x, y), (x, y)); polylines: (layer, points), closed; points: (layer, (x, y, z))."""
    out = [head(layers, units), line_entities(lines)]
    for name, pts in polylines:
        out += [_tag(0, "LWPOLYLINE"), _tag(100, "AcDbEntity"), *_by_layer(name), _tag(100, "AcDbPolyline"), _tag(90, len(pts)), _tag(70, 1)]
        out += [t for x, y in pts for t in (_tag(10, fmt(x)), _tag(20, fmt(y)))]
    for name, (x, y, z) in points:
        out += [_tag(0, "POINT"), _tag(100, "AcDbEntity"), *_by_layer(name), _tag(100, "AcDbPoint"), _tag(10, fmt(x)), _tag(20, fmt(y)), _tag(30, fmt(z))]
    return "".join([*out, TAIL])


def sample_drawing() -> str:
    """Nested rings and survey points on their corners: one boundary, four contours, thirteen points."""
    import numpy as np

    def ring(n: int, r: float) -> list[tuple[float, float]]:
        t = np.arange(n) * 2 * np.pi / n
        return [(round(100 + r * float(np.cos(a)), 3), round(100 + r * float(np.sin(a)), 3)) for a in t]

    rings = [ring(12, 90), ring(12, 70), ring(10, 50), ring(8, 32), ring(6, 16)]
    pts = [(*rings[k][i * len(rings[k]) // n], 0.5 * k) for k, n in enumerate((3, 3, 3, 2, 2)) for i in range(n)]
    lines = [("boundary", rings[0]), *(("topografia", r) for r in rings[1:])]
    return drawing({"boundary": 1, "topografia": 3, "3D_PONTOS": 5}, (), lines, [("3D_PONTOS", p) for p in pts])
