"""Elevations from survey points: means, modes, bucketed modes, bases, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace.functions.scalars import INTERVALS, bucket_elevation, snap_elevation


def mode_least(df: DataFrame, by: list[str], value: Column, name: str = "value") -> DataFrame:
    """The most frequent value, six digits; of equals the least. Two combining aggregations, no window."""
    counts = df.groupBy(*by, F.round(value, 6).alias("v")).count()
    return counts.groupBy(*by).agg(F.min_by("v", F.struct((-F.col("count")).alias("n"), "v")).alias(name))


def bucketed_mode(samples: DataFrame, by: list[str]) -> DataFrame:
    """A level for each group of samples (level, distance, and n, how many they are): the bucket with the most samples,
    then the least distance, the least mean distance, the highest level."""
    mean = F.sum(F.col("distance") * F.col("n")) / F.sum("n")
    buckets = samples.groupBy(*by, "level").agg(F.sum("n").alias("n"), F.min("distance").alias("near"), mean.alias("mean"))
    order = F.struct((-F.col("n")).alias("n"), F.col("near"), F.col("mean"), (-F.col("level")).alias("l"))
    return buckets.groupBy(*by).agg(F.min_by("level", order).alias("level"), F.min_by("n", order).alias("votes"))


def bucketed_votes(samples: DataFrame, by: list[str], flags: dict[str, str]) -> DataFrame:
    """Levels as ``bucketed_mode`` finds them, for several sets of samples in one pass: flags names for each result the
    column that marks its samples. Per group: each result, its least distance, and the mean of z over the first set, of
    whose samples sum_z is the sum."""
    of = lambda f, value: F.when(F.col(f), value)
    weighed = F.col("distance") * F.col("n")
    aggregates = [a for n, f in flags.items() for a in (F.coalesce(F.sum(of(f, F.col("n"))), F.lit(0)).alias(f"n_{n}"), F.min(of(f, F.col("distance"))).alias(f"near_{n}"), (F.sum(of(f, weighed)) / F.sum(of(f, F.col("n")))).alias(f"mean_{n}"))]
    first = next(iter(flags.values()))
    buckets = samples.groupBy(*by, "level").agg(*aggregates, F.sum(of(first, F.col("sum_z"))).alias("sum_z"))
    order = lambda n: F.when(F.col(f"n_{n}") > 0, F.struct((-F.col(f"n_{n}")).alias("n"), f"near_{n}", f"mean_{n}", (-F.col("level")).alias("l")))
    chosen = [a for n in flags for a in (F.min_by("level", order(n)).alias(n), F.min(f"near_{n}").alias(f"{n}_distance"))]
    return buckets.groupBy(*by).agg(*chosen, (F.sum("sum_z") / F.sum(f"n_{next(iter(flags))}")).alias("mean_z"))


def base_elevation(points: DataFrame, by: list[str], step: float) -> DataFrame:
    return points.groupBy(*by).agg(bucket_elevation(F.min("z"), F.lit(step)).alias("base"))


def infer_interval(df: DataFrame, by: list[str], value: Column, target: int = 0) -> DataFrame:
    """The interval that fits: by the wanted number of levels, or by the least mean residual, then the most distinct
    levels, then the least interval."""
    span = df.groupBy(*by).agg((F.max(value) - F.min(value)).alias("span"), F.count(value).alias("n"))
    tries = F.explode(F.array(*map(F.lit, INTERVALS)))
    if target > 1:
        one = span.filter("n >= 2 and span > 1e-9").withColumn("c", tries)
        score = F.struct(F.abs(F.rint(F.col("span") / F.col("c")).cast("long") + 1 - target).alias("a"), F.abs(F.col("span") / (target - 1) - F.col("c")).alias("b"), F.col("c").alias("c"))
        return one.groupBy(*by).agg(F.min(score)["c"].alias("interval"))
    rows = df.select(*by, value.alias("v")).filter("v is not null").withColumn("c", tries)
    snapped = snap_elevation(F.col("v"), F.col("c"))
    fits = rows.groupBy(*by, "c").agg(F.round(F.avg(F.abs(F.col("v") - snapped)), 12).alias("r"), (-F.count_distinct(snapped)).alias("d"))
    best = fits.groupBy(*by).agg(F.min(F.struct("r", "d", "c"))["c"].alias("interval"))
    return best.join(span.filter("n >= 2 and span > 1e-9").select(*by), by) if by else best.join(span.filter("n >= 2 and span > 1e-9").select(), how="cross")
