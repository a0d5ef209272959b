"""Operator 4, mixing sources to target weights: hash-threshold histograms.

Tokens are summed by source and hash bucket; the budget's threshold falls into one bucket, only that bucket is split
further, and the rows below the threshold are taken by a filter. Nothing is sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import NON_SPACE, Scratch, check_columns, numbered, read

BITS, LEVEL_BITS, CAP = 60, 12, 3


def size_of(text: Column) -> Column:
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(NON_SPACE)), F.lit(0)).cast("long")


def place_of(doc_id: Column, text_md5: Column, copy: Column) -> Column:
    """A row's fixed place in [0, 2**60), from its doc_id, its text and its number among rows equal in these and source."""
    word = lambda c: F.coalesce(c.cast("string"), F.lit("null"))
    return F.conv(F.substring(F.md5(F.concat_ws(":", word(doc_id), word(text_md5), copy.cast("string"))), 1, 15), 16, 10).cast("long")


def _ranked(totals: DataFrame, scratch: Scratch) -> DataFrame:
    """totals with rank: the sources in code point order from 0, null last, numbered by ranges."""
    order = F.col("source").asc_nulls_last()
    parts = scratch.cut(totals.repartitionByRange(order).withColumn("part", F.spark_partition_id()), "ranges")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    starts = parts.groupBy("part").agg(F.count("*").alias("held")).select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("start"))
    return parts.join(starts, "part").withColumn("rank", F.col("start") + F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1).drop("part", "start")


def targets(totals: DataFrame, weights: list[float], scratch: Scratch, cap: int = CAP) -> DataFrame:
    """(source, n, target) from (source, n): shares of the whole by weight (by rank, repeating), none above cap * n.

    Each round fills the sources that are not full up to one level; three numbers a round reach the driver."""
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    state = scratch.cut(_ranked(totals, scratch).select("source", "n", weight.alias("weight")), "weights")
    level, n_full = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap * F.col("n")
        found = state.agg(F.sum("n"), F.sum(F.when(full, F.col("n"))), F.sum(F.when(~full, F.col("weight"))), F.count_if(full)).first()
        if found[2] is None or found[3] == n_full:
            break
        level, n_full = ((found[0] or 0) - cap * (found[1] or 0)) / found[2], found[3]
    return state.select("source", "n", F.when(full, (cap * F.col("n")).cast("double")).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def _attach(df: DataFrame, table: DataFrame) -> DataFrame:
    """df with the written table's columns by source, null to null. Spark broadcasts the table below its own limit only."""
    other = table.withColumnRenamed("source", "_source")
    return df.join(other, df["source"].eqNullSafe(other["_source"])).drop("_source")


def plan(sizes: DataFrame, weights: list[float], scratch: Scratch) -> DataFrame:
    """From (source, size, place): (source, source_size, target, copies, edge); rows with a place below the edge are taken
    once more than the whole copies.

    One histogram of 4,096 buckets per source, then one of the boundary bucket alone, until that holds a single place.
    The rows on that place go in if this brings the sum nearer to the budget. Any number of sources: plans are tables."""
    aim = targets(sizes.groupBy("source").agg(F.sum("size").alias("n")), weights, scratch)
    copies = F.when(F.col("n") > 0, F.least(F.lit(CAP), F.floor(F.col("target") / F.col("n")))).otherwise(0).cast("int")
    state = aim.withColumn("copies", copies).withColumn("want", F.greatest(F.lit(0.0), F.col("target") - F.col("copies") * F.col("n")))
    none = F.lit(0).cast("long")
    state = scratch.cut(state.select("source", F.col("n").alias("source_size"), "target", "copies", "want", none.alias("edge"), none.alias("have"), ((F.col("n") == 0) | (F.col("want") <= 0)).alias("done")), "plan-0")
    for level in range(1, BITS // LEVEL_BITS + 1):
        if state.filter(~F.col("done")).isEmpty():
            break
        width = BITS - LEVEL_BITS * level
        at = _attach(sizes, state.filter(~F.col("done")).select("source", "edge", "have", "want"))
        inside = at.filter(F.shiftright("place", width + LEVEL_BITS) == F.shiftright("edge", width + LEVEL_BITS))
        buckets = inside.groupBy("source", "have", "want", F.shiftright("place", width).alias("bucket")).agg(F.sum("size").alias("here"), F.min("place").alias("first"), F.max("place").alias("last"))
        sums = buckets.withColumn("upto", F.col("have") + F.sum("here").over(Window.partitionBy("source").orderBy("bucket")))  # at most 4,096 rows a source
        over = sums.filter("upto > want").groupBy("source").agg(F.min_by(F.struct("first", "last", "here", "upto"), "bucket").alias("b"))
        joined = state.withColumnRenamed("source", "_s").join(over, F.col("_s").eqNullSafe(F.col("source")), "left").drop("source").withColumnRenamed("_s", "source")
        b, single = F.col("b"), F.col("b.first") == F.col("b.last")
        before = F.col("b.upto") - F.col("b.here")
        nearer = (F.abs(F.col("b.upto") - F.col("want")) < F.abs(before - F.col("want"))).cast("long")
        edge = F.when(F.col("done"), F.col("edge")).when(b.isNull(), F.lit(1 << BITS)).when(single, F.col("b.first") + nearer).otherwise(F.col("b.first"))
        state = scratch.cut(joined.select("source", "source_size", "target", "copies", "want", edge.alias("edge"), F.when(F.col("done") | b.isNull(), F.col("have")).otherwise(before).alias("have"), (F.col("done") | b.isNull() | single).alias("done")), f"plan-{level}")
    return state.select("source", "source_size", "target", "copies", "edge")


def _places(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(row, place) for every row of docs (doc_id, source, text_md5)."""
    rows = numbered(docs, F.struct("doc_id", "source", "text_md5"), scratch)
    return rows.select("row", place_of(F.col("row.doc_id"), F.col("row.text_md5"), F.col("copy")).alias("place"))


def sized(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, source, size, place), counted once over the whole texts and written."""
    check_columns(docs, "doc_id", "source", "text")
    narrow = scratch.cut(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), F.md5("text").alias("text_md5")), "narrow")
    return scratch.cut(_places(narrow, scratch).select("row.doc_id", "row.source", "row.size", "place"), "sizes")


def times() -> Column:
    return F.col("copies") + (F.col("place") < F.col("edge")).cast("int")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """One row per row of docs (doc_id, source, text): size, source_size, target, taken words and times it is taken.

    A document is taken whole, 0 to CAP times. Rows equal in doc_id, source and text have places of their own, so one
    document that makes up a source is taken in part of its rows. Null text has size 0 and is never taken more than CAP
    times either; a null source is a source of its own; an empty table gives no rows; other columns are ignored."""
    scratch = Scratch(docs.sparkSession, "mix")
    rows = sized(docs, scratch)
    return _attach(rows, plan(rows, list(weights), scratch)).select("doc_id", "size", "source_size", "target", (F.col("size") * times()).alias("taken"), times().alias("times"))


def apply_mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3)) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with their own columns, whatever their names. Texts are moved
    only where rows are equal in doc_id, source and text."""
    scratch = Scratch(docs.sparkSession, "mix")
    found = plan(sized(docs, scratch), list(weights), scratch)
    rows = numbered(docs, F.struct("doc_id", "source", F.md5("text").alias("text_md5")), Scratch(docs.sparkSession, "mix-rows"))
    rows = rows.select("row", F.col("row.source").alias("source"), place_of(F.col("key.doc_id"), F.col("key.text_md5"), F.col("copy")).alias("place"))
    kept = _attach(rows, found).withColumn("times", times()).filter("times > 0")
    return kept.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times")))).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null') || ':' || (row_number() OVER (PARTITION BY doc_id, source, text) - 1)), 1, 15))::BIGINT AS place
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
ranked AS (  -- the source whose cap binds first comes first
  SELECT *, row_number() OVER (ORDER BY 3.0 * n / w, source NULLS LAST) AS k,
         (SELECT sum(n) FROM s) - coalesce(sum(3.0 * n) OVER (ORDER BY 3.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY 3.0 * n / w DESC, source DESC NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS weight
  FROM s),
level AS (SELECT min(CASE WHEN 3.0 * n / w >= rest / weight THEN rest::DOUBLE / weight::DOUBLE END) AS unit FROM (SELECT * FROM ranked WHERE 3.0 * n / w >= rest / weight ORDER BY k LIMIT 1)),
t AS (
  SELECT source, n, least(w::DOUBLE * unit, 3.0::DOUBLE * n) AS target FROM s, level),
b AS (
  SELECT *, CASE WHEN n > 0 THEN least(3, floor(target / n))::INTEGER ELSE 0 END AS copies, CASE WHEN n > 0 THEN greatest(0, target - least(3, floor(target / n)) * n) ELSE 0 END AS want FROM t),
p AS (
  SELECT source, place, sum(size)::BIGINT AS here FROM d GROUP BY source, place),
c AS (
  SELECT p.source, p.place, p.here, sum(p.here) OVER (PARTITION BY p.source ORDER BY p.place) AS upto FROM p),
e AS (  -- the first place that goes beyond the budget, and whether it is nearer with it
  SELECT b.source, min(c.place) AS edge, arg_min(abs(c.upto - b.want) < abs(c.upto - c.here - b.want), c.place) AS with_it
  FROM c JOIN b ON c.source IS NOT DISTINCT FROM b.source WHERE c.upto > b.want AND b.want > 0 GROUP BY b.source)
SELECT d.doc_id, d.size, b.n AS source_size, b.target AS target,
       (d.size * (b.copies + CASE WHEN e.edge IS NOT NULL AND (d.place < e.edge OR (d.place = e.edge AND e.with_it)) THEN 1 ELSE 0 END))::BIGINT AS taken,
       (b.copies + CASE WHEN e.edge IS NOT NULL AND (d.place < e.edge OR (d.place = e.edge AND e.with_it)) THEN 1 ELSE 0 END)::INTEGER AS times
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source LEFT JOIN e ON d.source IS NOT DISTINCT FROM e.source
"""
