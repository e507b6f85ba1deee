"""Scalar rules as native columns: elevations, numbers and flags from text, ids, labels, units."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the data model.
RING_TOLERANCE = 1e-6
INTERVALS = (0.1, 0.25, 0.5, 1.0, 2.0, 5.0, 10.0)
FALSE_WORDS = ("0", "false", "f", "no", "n", "nao")
TRUE_WORDS = ("1", "true", "t", "yes", "y", "sim")
#: Names of export units and the units they stand for; other names stand for auto.
UNIT_NAMES = {
    "auto": "auto", "automatico": "auto", "automático": "auto", "automatico (mm)": "auto", "automático (mm)": "auto",
    "mm": "mm", "milimetros": "mm", "milímetros": "mm", "milimetros (mm)": "mm", "milímetros (mm)": "mm",
    "cm": "cm", "centimetros": "cm", "centímetros": "cm", "centimetros (cm)": "cm", "centímetros (cm)": "cm",
    "m": "m", "metros": "m", "metros (m)": "m",
}
UNIT_FACTORS = {"auto": 1.0, "mm": 1.0, "cm": 0.1, "m": 0.001}
#: Millimetres of the units that measures are given in.
UNIT_MM = {"mm": 1.0, "cm": 10.0, "m": 1000.0}
#: Names of the priorities of a layout that mean the most use of the material.
USAGE_NAMES = ("maximize_usage", "usage", "area", "ocupacao", "ocupação")


def snap_elevation(value: Column, step: Column) -> Column:
    """To the nearest multiple, halves away from zero; a step up to 0 changes nothing."""
    k = F.signum(value) * F.floor(F.abs(value) / step + 0.5)
    return F.when(step > 0, F.round(k * step, 6)).otherwise(value)


def bucket_elevation(value: Column, step: Column, base: Column | None = None) -> Column:
    """The multiple below, not below the base; without a step six digits."""
    floored = F.round(F.floor((value + 1e-9) / step) * step, 6)
    if base is not None:
        floored = F.greatest(floored, F.round(base, 6))
    return F.when(step > 0, floored).otherwise(F.round(value, 6))


def topographic_step(step: Column, interval: Column, inferred: Column) -> Column:
    return F.coalesce(F.when(step > 0, step), F.when(interval > 0, interval), inferred, F.lit(0.0))


def same_elevation(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-6


def override_elevation(source: Column, absolute: Column, relative: Column, layer: Column, base: Column, interval: Column) -> Column:
    """A forced elevation, by precedence: source, absolute, relative to the base, layer number."""
    return F.coalesce(source, absolute, base + relative, F.when((layer >= 0) & (interval > 0), base + layer * interval))


def observation_weight(distance: Column) -> Column:
    return F.when(distance.isNull(), 1.0).otherwise(F.greatest(F.lit(0.5), F.least(F.lit(8.0), F.lit(0.25) / (distance + 0.02))))


def level_edge_cost(a: Column, b: Column) -> Column:
    d = F.abs(a - b)
    return F.when(d == 1, 0.0).when(d == 0, 2.0).otherwise(80.0 * (d - 1) * (d - 1))


def node_level_cost(label: Column, observed: Column, weight: Column) -> Column:
    return F.coalesce(weight * (label - observed) * (label - observed), F.lit(0.0))


def _plain_number(text: Column) -> Column:
    return F.replace(F.trim(text.cast("string")), F.lit(","), F.lit("."))


def parse_float(text: Column) -> Column:
    """A finite number, comma or point; else null."""
    value = F.try_cast(_plain_number(text), "double") if hasattr(F, "try_cast") else _plain_number(text).try_cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def parse_int(text: Column) -> Column:
    """A number that is whole within 1e-9."""
    value = parse_float(text)
    return F.when(F.abs(value - F.rint(value)) <= 1e-9, F.rint(value).cast("long"))


def to_float(text: Column) -> Column:
    """A number, comma or point, finite or not; else null."""
    return _plain_number(text).try_cast("double")


def to_int(text: Column) -> Column:
    """A number that is exactly whole."""
    value = to_float(text)
    return F.when(value == F.rint(value), value.try_cast("long"))


def parse_bool(text: Column, default: bool = True) -> Column:
    """False only for the words for no; other text is true, null the default."""
    return F.coalesce(~F.lower(F.trim(text.cast("string"))).isin(*FALSE_WORDS), F.lit(default))


def to_bool(text: Column, default: bool) -> Column:
    """True and false words; what is neither gets the default."""
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin(*FALSE_WORDS, "não"), False).when(t.isin(*TRUE_WORDS), True).otherwise(F.lit(default))


def parse_id_list(text: Column) -> Column:
    """Comma-parted whole numbers; blanks are skipped, a bad one makes it null."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.forall(parts, lambda x: x.rlike(r"^[+-]?[0-9]{1,18}$")), F.transform(parts, lambda x: x.try_cast("long")))


def id_sort_key(value: Column) -> Column:
    """Whole numbers first, by value; then other text in lower case."""
    text = F.trim(value.cast("string"))
    number = F.when(text.rlike(r"^[+-]?[0-9]{1,18}$"), text.try_cast("long"))
    return F.struct(F.when(number.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(number, F.lit(0)).alias("number"), F.when(number.isNull(), F.lower(text)).otherwise("").alias("text"))


def format_number(value: Column, digits: int = 3) -> Column:
    """Fixed digits without trailing zeros."""
    text = F.format_string(f"%.{digits}f", value)
    short = F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(short == "-0", "0").otherwise(short)


def piece_label(source_elevation: Column, elevation: Column) -> Column:
    value = F.coalesce(source_elevation, elevation)
    return F.when(F.abs(value - F.rint(value)) <= 1e-6, F.rint(value).cast("long").cast("string")).otherwise(format_number(value, 2))


def _looked_up(table: dict, key: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def unit_name(name: Column) -> Column:
    """The export unit that a name stands for."""
    return F.coalesce(_looked_up(UNIT_NAMES, F.lower(F.trim(name))), F.lit("auto"))


def unit_factor(name: Column) -> Column:
    """Export units a millimetre."""
    return _looked_up(UNIT_FACTORS, unit_name(name))


def safe_color(value: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(255), F.coalesce(value.cast("int"), F.lit(7))))


def safe_margin(margin: Column, width: Column, height: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(margin, F.least(width, height) / 2 - 1e-6))


def repeat_count(value: Column) -> Column:
    return F.greatest(F.coalesce(value.cast("int"), F.lit(1)), F.lit(1))


def repeat_elevations(start: Column, step: Column, count: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), repeat_count(count) - 1), lambda i: F.round(start + i * step, 3))


def sheet_columns(n: Column, width: Column, height: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n * height / width)).cast("int"))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def offset_bounds(env: Column, dx: Column, dy: Column) -> Column:
    return F.struct((env["minx"] + dx).alias("minx"), (env["miny"] + dy).alias("miny"), (env["maxx"] + dx).alias("maxx"), (env["maxy"] + dy).alias("maxy"))


def rotation_angles(step: Column, fitted: Column | None = None) -> Column:
    """Angles of a lattice, with those that fit a shape, in [0, 360), six digits, each once."""
    lattice = F.transform(F.sequence(F.lit(0), F.ceil(F.lit(360.0) / step).cast("int") - 1), lambda i: i * step)
    every = lattice if fitted is None else F.concat(lattice, fitted)
    return F.array_sort(F.array_distinct(F.transform(every, lambda a: F.pmod(F.round(F.pmod(a, F.lit(360.0)), 6), F.lit(360.0)))))


def layout_priority(name: Column) -> Column:
    return F.when(F.lower(F.trim(name.cast("string"))).isin(*USAGE_NAMES), "maximize_usage").otherwise("preserve_shapes")


def relief_height(elevation: Column, index: Column, factor: Column) -> Column:
    """Height in a scaled model; layers without an elevation stand at their number."""
    return F.coalesce(elevation, index.cast("double")) * factor


def measure_mm(value: Column, unit: Column, fallback: str = "m") -> Column:
    """A measure, 0 at least, in millimetres."""
    return F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(0.0)) * F.coalesce(_looked_up(UNIT_MM, unit), F.lit(UNIT_MM[fallback]))


def ratio(left: Column, right: Column) -> Column:
    """Of a scale left : right, each a positive number."""
    positive = lambda c: F.greatest(c, F.lit(1e-9))
    return positive(right) / positive(left)


def model_measure(real_mm: Column, left: Column, right: Column, unit: Column) -> Column:
    """A real measure on the model of a scale left : right, in a unit."""
    return F.round(F.greatest(real_mm / ratio(left, right), F.lit(0.0)) / F.coalesce(_looked_up(UNIT_MM, unit), F.lit(1.0)), 6)


def file_measure(real_mm: Column, left: Column, right: Column, unit: Column) -> Column:
    """A real measure in a drawing whose unit stands for left : right of a unit."""
    return F.round(real_mm / F.greatest(ratio(left, right) * F.coalesce(_looked_up(UNIT_MM, unit), F.lit(1000.0)), F.lit(1e-9)), 6)


def scale_denominator(real_mm: Column, model_mm: Column, left: Column) -> Column:
    """The right side of the scale left : right at which a real measure has a given size on the model."""
    return F.round(F.greatest(F.greatest(left, F.lit(1e-9)) * real_mm / F.greatest(model_mm, F.lit(1e-9)), F.lit(0.0001)), 6)
