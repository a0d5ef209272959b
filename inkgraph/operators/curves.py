"""Curves over checkpoints: normalized gain, emergence times, area between two series."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def long_curve(rows: DataFrame, pcts: str, *series: str, key: str = "run") -> DataFrame:
    """(key, series, step, pct, value) from arrays, cut to the shorter of each pair."""
    out = None
    for s in series:
        n = F.least(F.size(pcts), F.size(s))
        zipped = F.arrays_zip(F.slice(pcts, F.lit(1), n).alias("pct"), F.slice(s, F.lit(1), n).alias("value"))
        one = rows.filter(F.col(s).isNotNull()).select(key, F.lit(s).alias("series"), F.posexplode(zipped).alias("step", "z")).select(key, "series", "step", "z.pct", "z.value")
        out = one if out is None else out.unionByName(one)
    return out


def normalized_gain(curve: DataFrame, *keys: str) -> DataFrame:
    """curve (keys, step, value) with `gain`: (value - first) / (last - first), 0 where those are equal to 1e-8."""
    whole = Window.partitionBy(*keys).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last = F.first("value").over(whole), F.last("value").over(whole)
    return curve.withColumn("gain", F.when(F.abs(last - first) < 1e-8, 0.0).otherwise((F.col("value") - first) / (last - first)))


def emergence(gains: DataFrame, *keys: str, levels: tuple[int, ...] = (50, 90)) -> DataFrame:
    """Per series the pct of the first step whose gain reaches each level, null if none does."""
    reach = lambda t: F.min(F.when(F.col("gain") >= t / 100, F.struct("step", "pct")))["pct"].alias(f"t{t}")
    return gains.groupBy(*keys).agg(*(reach(t) for t in levels))


def area(gains: DataFrame, upper: str, lower: str, *keys: str) -> DataFrame:
    """Trapezoid area of gain(upper) - gain(lower) over pct; 0 with fewer than two points. Series join by step."""
    side = lambda s, name: gains.filter(F.col("series") == s).select(*keys, "step", "pct", F.col("gain").alias(name))
    both = side(upper, "a").join(side(lower, "b").drop("pct"), [*keys, "step"]).withColumn("y", F.col("a") - F.col("b"))
    after = Window.partitionBy(*keys).orderBy("step")
    piece = 0.5 * (F.col("y") + F.lead("y").over(after)) * (F.lead("pct").over(after) - F.col("pct"))
    return both.withColumn("piece", piece).groupBy(*keys).agg(F.coalesce(F.sum("piece"), F.lit(0.0)).alias("area"))
