"""Nearest neighbours in the plane as relational joins: labels to boxes, line ends to boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import written


def _cell(c: str, size: float) -> Column:
    return F.floor(F.col(c) / size)


def nearest(queries: DataFrame, points: DataFrame, cell: float, radius: float | None = None, earlier: bool = False, by: str = "doc") -> DataFrame:
    """(by, q, p, d2): for each query (by, q, at, x, y) the nearest point (by, p, at, x, y) of the same document and the square
    of its distance, if any is nearer than radius; of equally near ones the first by `at`; only points before the query if
    earlier. Queries without such a point, and null or NaN coordinates, give no row; q is unique within its document.

    The plane is cut into squares and a query meets the points of nine of them. The squares start at `cell` and double for
    the queries that found nothing nearer than their side, so a dense place is met by small squares alone, and few queries
    are left for large ones. No two sets of rows are paired in full."""
    real = lambda rows: rows.filter("x is not null and y is not null and not isnan(x) and not isnan(y)")
    left, points = written(real(queries).select(by, "q", "at", "x", "y"), "nearest-left"), written(real(points).select(by, "p", "at", "x", "y"), "nearest-points")
    extent = lambda rows: rows.select("x", "y").agg(*(f(c) for c in "xy" for f in (F.min, F.max))).first()
    ends = [e for e in (extent(left), extent(points)) if e[0] is not None]
    if len(ends) < 2:
        return left.select(by, "q", F.lit(None).cast(points.schema["p"].dataType).alias("p"), F.lit(None).cast("double").alias("d2")).limit(0)
    widest = 2 * max(max(e[1] for e in ends) - min(e[0] for e in ends), max(e[3] for e in ends) - min(e[2] for e in ends)) + 1.0
    most, found, side = min(radius, widest) if radius else widest, None, min(cell, radius or cell)
    while True:
        last = side >= most
        side = most if last else side
        around = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)))).alias("d")
        spread = left.select("*", around).select(F.col(by).alias("_by"), "q", F.col("at").alias("_at"), F.col("x").alias("_x"), F.col("y").alias("_y"), (_cell("x", side) + F.col("d.i")).alias("cx"), (_cell("y", side) + F.col("d.j")).alias("cy"))
        held = points.select("*", _cell("x", side).alias("cx"), _cell("y", side).alias("cy"))
        d2 = (F.col("x") - F.col("_x")) * (F.col("x") - F.col("_x")) + (F.col("y") - F.col("_y")) * (F.col("y") - F.col("_y"))
        same = F.col(by).eqNullSafe(F.col("_by"))
        met = spread.join(held, ["cx", "cy"]).filter(same).withColumn("d2", d2).filter(F.col("d2") < side * side)
        met = met.filter(F.col("at") < F.col("_at")) if earlier else met
        best = met.groupBy(F.col("_by").alias(by), "q").agg(F.min(F.struct("d2", "at", "p")).alias("best")).select(by, "q", "best.p", "best.d2")
        best = written(best, "nearest-found")
        found = best if found is None else found.unionByName(best)
        if last:
            return found
        done = best.select(F.col(by).alias("_by"), F.col("q").alias("_q"))
        left = written(left.join(done, F.col(by).eqNullSafe(F.col("_by")) & (F.col("q") == F.col("_q")), "left_anti"), "nearest-left")
        if left.isEmpty():
            return found
        side *= 2


def labelled(boxes: DataFrame, texts: DataFrame, radius: float = 80.0, cell: float = 20.0, by: str = "doc") -> DataFrame:
    """boxes (by, box, at, x, y, width, height) with `label`: of the nearest text (by, at, x, y, label) before the box, measured
    from its middle, within the radius; else empty."""
    middle = boxes.select(by, F.col("box").alias("q"), "at", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"))
    found = nearest(middle, texts.withColumn("p", F.col("label")), cell, radius, earlier=True, by=by).select(F.col(by).alias("_by"), F.col("q").alias("_q"), "p")
    joined = boxes.join(found, F.col(by).eqNullSafe(F.col("_by")) & (F.col("box") == F.col("_q")), "left")
    return joined.select(*boxes.columns, F.coalesce("p", F.lit("")).alias("label"))


def connected(lines: DataFrame, boxes: DataFrame, cell: float = 20.0, by: str = "doc") -> DataFrame:
    """(by, line, src, dst): lines (by, line, x1, y1, x2, y2) as edges between the boxes whose middles are nearest to their
    ends, the first of equally near ones; lines with both ends at one box are none."""
    middle = boxes.select(by, F.col("box").alias("p"), "at", (F.col("x") + F.col("width") / 2).alias("x"), (F.col("y") + F.col("height") / 2).alias("y"))
    end = lambda k: F.struct(F.lit(k).alias("end"), F.col(f"x{k}").alias("x"), F.col(f"y{k}").alias("y"))
    ends = lines.select(by, "line", F.explode(F.array(end(1), end(2))).alias("e")).select(by, F.struct("line", "e.end").alias("q"), F.lit(0).alias("at"), "e.x", "e.y")
    found = nearest(ends, middle, cell, by=by)
    both = found.groupBy(by, F.col("q.line").alias("line")).agg(F.max(F.when(F.col("q.end") == 1, F.col("p"))).alias("src"), F.max(F.when(F.col("q.end") == 2, F.col("p"))).alias("dst"))
    return both.filter("src is not null and dst is not null and src <> dst")
