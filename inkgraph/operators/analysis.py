"""The frames behind reports and charts: shares, histograms, orders, samples, and the gates between stages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

BUCKETS = ("workflow_like", "geometry_like", "labeled", "other")


def shares(rows: DataFrame, col: str = "bucket", known: tuple[str, ...] = BUCKETS) -> DataFrame:
    """Percent of each known bucket among the rows of known buckets (0 of nothing)."""
    counts = rows.filter(F.col(col).isin(*known)).groupBy(col).agg(F.count("*").alias("n"))
    return counts.withColumn("share", 100.0 * F.col("n") / F.greatest(F.sum("n").over(Window.partitionBy(F.lit(0))), F.lit(1)))  # one row a bucket


def pool_and_selected(rows: DataFrame, selected: Column, col: str = "bucket", known: tuple[str, ...] = BUCKETS) -> DataFrame:
    name = F.when(F.col(col).isin(*known), F.col(col)).otherwise("other").alias(col)
    return rows.groupBy(name).agg(F.count("*").alias("n_pool"), F.count_if(selected).alias("n_selected"))


def density(rows: DataFrame, value: str, bins: int = 40) -> DataFrame:
    """(bin, n, density) over equal widths between the least and the greatest value; the last bin holds the greatest."""
    ends = rows.agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(value).alias("total"))
    width = (F.col("hi") - F.col("lo")) / bins
    at = F.when(width == 0, 0).otherwise(F.least(F.floor((F.col(value) - F.col("lo")) / width), F.lit(bins - 1))).cast("int")
    counted = rows.filter(F.col(value).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(at.alias("bin"), "total", width.alias("w")).agg(F.count("*").alias("n"))  # ends is one row
    return counted.select("bin", "n", F.when(F.col("w") == 0, 1.0).otherwise(F.col("n") / (F.col("total") * F.col("w"))).alias("density"))


#: Bins of an interval that holds a wanted rank; only their counts, least and greatest values reach the driver.
BINS = 1024


def order_statistics(rows: DataFrame, value: str, ranks: list[int], least: float, greatest: float) -> dict[int, float]:
    """The finite values of the given ranks from 0, least and greatest being those of the first and the last.

    Each pass counts an interval's values in BINS equal bins by a pre-aggregated count, and only the bins that hold a wanted
    rank are looked into again, until such a bin holds one distinct value. No task holds or sorts the values."""
    v, found = F.col(value), {}
    open_ = [(least, greatest, 0, sorted(set(ranks)))]  # an interval, the values before it, and the ranks in it
    while open_:
        place = F.lit(None).cast("int")
        for k, (lo, hi, _, _) in enumerate(open_):
            at = F.lit(0) if lo == hi else F.least(F.floor((v * 0.5 - lo * 0.5) / (hi * 0.5 - lo * 0.5) * BINS), F.lit(BINS - 1))
            place = F.when((v >= lo) & (v <= hi), (at + k * BINS).cast("int")).otherwise(place)
        binned = rows.select(place.alias("bin"), v.alias("v")).filter("bin is not null").groupBy("bin").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        bins = sorted(tuple(r) for r in binned.collect())
        again = []
        for k, (_, _, before, wanted) in enumerate(open_):
            for at, n, lo, hi in bins:
                if at // BINS == k:
                    inside = [r for r in wanted if before <= r < before + n]
                    if inside and lo == hi:
                        found |= dict.fromkeys(inside, lo)
                    elif inside:
                        again.append((lo, hi, before, inside))
                    before += n
        open_ = again
    return found


def quantiles(rows: DataFrame, value: str, at: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Exact quantiles with linear interpolation, in one row; nulls do not count, NaN is the greatest, nothing gives nulls.

    Selection by counts, in a few passes over the values (see order_statistics), which are done when this is called."""
    v, inf = F.col(value), float("inf")
    finite = ~F.isnan(v) & (v > -inf) & (v < inf)
    rows = written(rows.select(v.cast("double").alias(value)), "quantiles")  # computed once, read by each pass
    low, mid, high, total, least, greatest = rows.agg(F.count_if(v == -inf), F.count_if(finite), F.count_if((v == inf) & ~F.isnan(v)), F.count(v), F.min(F.when(finite, v)), F.max(F.when(finite, v))).first()
    places = [q * (total - 1) for q in at]
    ranks = {int(p) for p in places} | {min(int(p) + 1, total - 1) for p in places}
    known = order_statistics(rows.filter(finite), value, [r - low for r in ranks if low <= r < low + mid], least, greatest) if total else {}
    value_of = lambda r: -inf if r < low else known[r - low] if r < low + mid else inf if r < low + mid + high else float("nan")

    def between(p: float) -> float:
        a, b = value_of(int(p)), value_of(min(int(p) + 1, total - 1))
        return a if a == b or p == int(p) else a + (b - a) * (p - int(p))

    found = [between(p) if total else None for p in places]
    return rows.sparkSession.range(1).select(*(F.lit(x).cast("double").alias(f"p{round(100 * q)}") for x, q in zip(found, at, strict=True)))


def by_fixed_order(counts: DataFrame, col: str, order: tuple[str, ...], n: str = "n") -> DataFrame:
    """Counts with `place`: the named ones first in their order, then the rest by count, then by name."""
    named = F.array_position(F.array(*map(F.lit, order)), F.col(col))
    rank = F.row_number().over(Window.orderBy(F.when(named > 0, named).otherwise(len(order) + 1), F.desc(n), col))  # one row a reason
    return counts.withColumn("place", rank)


def gate(stage: str, *checks: tuple[Column, str]) -> list[Column]:
    """Aggregates that say whether a stage may go on: (ok, detail) from aggregate conditions and their names."""
    ok = checks[0][0]
    for c, _ in checks[1:]:
        ok = ok & c
    failed = F.array_compact(F.array(*(F.when(~F.coalesce(c, F.lit(False)), name) for c, name in checks)))
    return [F.lit(stage).alias("stage"), F.coalesce(ok, F.lit(False)).alias("ok"), F.array_join(failed, ", ").alias("detail")]


def assert_gate(result: DataFrame) -> None:
    bad = [r for r in result.collect() if not r["ok"]]
    if bad:
        raise AssertionError("; ".join(f"{r['stage']}: {r['detail']}" for r in bad))


def embedding_gate(rows: DataFrame, pool_rows: int, vector: str = "embedding", least_dim: int = 256) -> DataFrame:
    from .coreset import norm

    return rows.agg(*gate("embed", (F.count("*") == pool_rows, "rows"), (F.min(F.size(vector)) == F.max(F.size(vector)), "one dimension"), (F.min(F.size(vector)) >= least_dim, "dimension"), (F.count_if(norm(F.col(vector)) == 0) == 0, "zero norms")))
