"""Evaluation: joining predictions to gold, safe means, gaps, controls, bootstrap intervals."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import by_value, spread, written

by_value(__name__)


def last_wins(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Per key the row last in order (order has no ties), by an aggregate that reads the rows once; null keys have none."""
    last = rows.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*rows.columns), order).alias("_row"))
    return last.filter("_row is not null").select("_row.*")  # null where no order is known


def gold_with_predictions(gold: DataFrame, predictions: DataFrame, key: str = "id", order: str = "pos", strict: bool = False) -> DataFrame:
    """Inner join after last-wins on both sides; strict keeps gold rows without a prediction. Its joins are merge joins at every
    size, since markup in files may be a hundredth of what a broadcast of it holds; both sides are dealt by key once."""
    p = last_wins(spread(predictions, key), key, order).drop(order)
    return last_wins(spread(gold, key), key, order).join(p.hint("merge"), key, "left" if strict else "inner")


def in_split(col: str, split: str) -> Column:
    """Rows of the split; null-split rows pass every split, `all` passes every row."""
    return F.lit(split == "all") | F.col(col).isNull() | (F.col(col) == split)


def clean(col: Column) -> Column:
    """Null for NaN."""
    return F.when(~F.isnan(col), col)


def safe_mean(col: Column) -> Column:
    """The mean without nulls and NaNs; NaN of nothing."""
    return F.coalesce(F.avg(clean(col)), F.lit(float("nan")))


def gap(value: Column, split: Column, left: str = "id", right: str = "ood") -> Column:
    return safe_mean(F.when(split == left, value)) - safe_mean(F.when(split == right, value))


def control_warning(correct: Column, shuffled: Column, least: float = 0.05) -> Column:
    return F.abs(correct - shuffled) < least


def bootstrap(values: list[float], n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> dict[str, float]:
    """Mean and percentile interval of ordered values; NaN for none. Resamples follow Python's seeded generator."""
    good = [v for v in values if v is not None and not math.isnan(v)]
    if not good:
        return dict.fromkeys(("mean", "lo", "hi"), math.nan)
    import numpy as np

    n, values = len(good), np.array(good)
    means = sorted(sum(values[at].tolist()) / n for at in _picks(n, n_boot, seed))
    return {"mean": sum(good) / n, "lo": means[int(alpha / 2 * n_boot)], "hi": means[int((1 - alpha / 2) * n_boot) - 1]}


def _picks(n: int, times: int, seed: int) -> Iterator:
    """What times lists of n calls of random.Random(seed).randrange(n) give, from whole arrays of the same generator's numbers."""
    import numpy as np

    state = random.Random(seed).getstate()[1]
    source = np.random.MT19937()
    source.state = {"bit_generator": "MT19937", "state": {"key": np.array(state[:-1], dtype=np.uint32), "pos": state[-1]}}
    bits, left = n.bit_length(), np.zeros(0, dtype=np.int64)
    for _ in range(times):
        while len(left) < n:  # numbers of so many bits; those that are too large are drawn again
            more = (source.random_raw(n - len(left) + 64) >> np.uint64(32 - bits)).astype(np.int64)
            left = np.concatenate([left, more[more < n]])
        yield left[:n]
        left = left[n:]


def bootstrap_by(rows: DataFrame, group: str, value: str, order: str, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """Exact intervals per group (group, mean, lo, hi); a group is one sample, read in order by one task."""

    def run(df: pd.DataFrame) -> pd.DataFrame:
        ordered = df.sort_values(order)[value].tolist()
        return pd.DataFrame([{group: df[group].iloc[0]} | bootstrap(ordered, n_boot, seed=seed)])

    return rows.select(group, value, order).groupBy(group).applyInPandas(run, f"{group} {rows.schema[group].dataType.simpleString()}, mean double, lo double, hi double")


def numbered(rows: DataFrame, group: str, order: str) -> DataFrame:
    """rows with `i`: their number from 0 within the group by order (which has no ties). The rows are sorted over all tasks,
    numbered within each, and moved on by the rows of the group in earlier ones: no task holds a group."""
    parts = written(rows.orderBy(group, order).withColumn("_part", F.spark_partition_id()), "numbered")
    sizes = parts.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    starts = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    here = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order))
    same = parts.withColumn("_here", here).alias("r").join(starts.alias("s"), F.col(f"r.{group}").eqNullSafe(F.col(f"s.{group}")) & (F.col("r._part") == F.col("s._part")))
    return same.select("r.*", (F.col("s._start") + F.col("r._here") - 1).alias("i")).drop("_part", "_here")


def interval(means: DataFrame, group: str, n_boot: int, alpha: float) -> DataFrame:
    """(group, lo, hi) of the means `m` of n_boot resamples a group at most."""
    ordered = means.groupBy(group).agg(F.sort_array(F.collect_list("m")).alias("ms"))  # n_boot numbers a group
    return ordered.select(group, F.element_at("ms", int(alpha / 2 * n_boot) + 1).alias("lo"), F.element_at("ms", int((1 - alpha / 2) * n_boot)).alias("hi"))


#: Positions of a block of values, 65,536 at most; draws that are made at once.
BLOCK, DRAWS = 32_768, 1_000_000


def _drawn(sizes: DataFrame, n_boot: int) -> DataFrame:
    """(g, block, counts, picks) of sizes (g, n): the draws of DRAWS / n_boot positions and all resamples that fall into a block
    of values, as two bytes each: their places in the block by resample, and how many each resample has."""
    step = min(max(1, DRAWS // n_boot), 65_535)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for rows in batches:
            for k, (n, at) in enumerate(zip(rows.column(1).to_pylist(), rows.column(2).to_pylist(), strict=True)):
                places = [b"%d" % i for i in range(at * step, min(n, (at + 1) * step))]
                raw = b"".join([hashlib.md5(head + i).digest() for head in (b"%d:" % b for b in range(n_boot)) for i in places])
                pick = np.frombuffer(raw, ">u4")[::4].astype(np.int64) % n
                block = pick // BLOCK
                by = np.argsort(block, kind="stable")
                found, first = np.unique(block[by], return_index=True)
                parts = np.split(by, first[1:])
                counts = [np.bincount(x // len(places), minlength=n_boot).astype(np.uint16).tobytes() for x in parts]
                picks = [(pick[x] % BLOCK).astype(np.uint16).tobytes() for x in parts]
                yield pa.RecordBatch.from_arrays([rows.column(0).take(pa.array([k] * len(parts))), pa.array(found), pa.array(counts, pa.binary()), pa.array(picks, pa.binary())], names=["g", "block", "counts", "picks"])

    spark = sizes.sparkSession
    chunks = sizes.select("g", "n", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / step))).alias("at"))
    dealt = chunks.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    return dealt.mapInArrow(run, f"g {sizes.schema['g'].dataType.simpleString()}, block long, counts binary, picks binary")


def _totals(drawn: DataFrame, kept: DataFrame, n_boot: int) -> DataFrame:
    """(g, b, total): what the draws of each resample add up to, a row for each block of values as well. A block is met by about
    n_boot draws for each of its values, however large its group is."""

    def run(draws: pa.Table, values: pa.Table) -> pa.Table:
        import numpy as np

        v = values.sort_by("i")["v"].to_numpy()
        total, every = np.zeros(n_boot), np.arange(n_boot)
        for counts, picks in zip(draws["counts"].to_pylist(), draws["picks"].to_pylist(), strict=True):
            of = np.repeat(every, np.frombuffer(counts, np.uint16))
            total += np.bincount(of, weights=v[np.frombuffer(picks, np.uint16)], minlength=n_boot)
        return pa.table({"g": values["g"].take(pa.array([0] * n_boot)), "b": pa.array(every), "total": pa.array(total)})

    blocks = kept.withColumn("block", F.floor(F.col("i") / BLOCK))
    return drawn.groupBy("g", "block").cogroup(blocks.groupBy("g", "block")).applyInArrow(run, f"g {kept.schema['g'].dataType.simpleString()}, b long, total double")


def bootstrap_md5(rows: DataFrame, group: str, value: str, order: str, n_boot: int = 1000, alpha: float = 0.05) -> DataFrame:
    """Intervals from resamples that md5 draws, so any engine repeats them: (group, mean, lo, hi).

    Draw i of resample b is value number md5(b:i) mod n of its group. Draws are made where Spark deals their positions, and
    meet the values in blocks, so neither a group nor a row per draw is moved as a row."""
    some = rows.filter(F.col(group).isNotNull() & F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    kept = written(numbered(some, group, order).select(F.col(group).alias("g"), "i", F.col(value).cast("double").alias("v")), "resampled")
    of = kept.groupBy("g").agg(F.count("*").alias("n"), F.round(F.avg("v"), 9).alias("mean"))
    totals = _totals(_drawn(of.select("g", "n"), n_boot), kept, n_boot).groupBy("g", "b").agg(F.sum("total").alias("total"))
    means = totals.join(of, "g").select("g", F.round(F.col("total") / F.col("n"), 9).alias("m"))
    return of.join(interval(means, "g", n_boot, alpha), "g").select(F.col("g").alias(group), "mean", "lo", "hi")


#: A draw of 32 bits reaches the first k of these with the probability that a Poisson number of mean 1 is k or more.
POISSON = [int(2**32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(12)]


def bootstrap_counts(rows: DataFrame, group: str, value: str, key: str, n_boot: int = 1000, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """Intervals for groups of any size: (group, mean, lo, hi), nulls and NaNs left out, null groups a group of their own.

    How often a row is in a resample is a Poisson number of mean 1 that a hash of its key and the resample gives (four
    resamples a digest), so rows need no numbers, no row meets another one, and the resamples' sums are pre-aggregated where
    the rows are: what is shuffled is a row per task, group and resample. Resamples without a row have no mean."""
    v = F.col(value).cast("double")
    kept = rows.filter(v.isNotNull() & ~F.isnan(v)).select(F.col(group).alias("g"), v.alias("v"), F.col(key).alias("k"))
    digest = kept.select("g", "v", "k", F.explode(F.sequence(F.lit(0), F.lit((n_boot - 1) // 4))).alias("j")).withColumn("d", F.md5(F.concat_ws(":", F.lit(seed), "j", "k")))
    draws = F.array(*(F.conv(F.substring("d", 8 * at + 1, 8), 16, 10).cast("long") for at in range(4)))
    x = digest.select("g", "v", "j", F.posexplode(draws).alias("at", "x")).filter(F.col("x") >= POISSON[0])  # the others draw none
    many = sum((F.col("x") >= t).cast("int") for t in POISSON)  # of a column, so that each draw is read from its digits once
    each = x.select("g", "v", (F.col("j") * 4 + F.col("at")).alias("b"), many.alias("n")).filter(F.col("b") < n_boot)
    means = each.groupBy("g", "b").agg(F.round(F.sum(F.col("v") * F.col("n")) / F.sum("n"), 9).alias("m"))
    ms = means.groupBy("g").agg(F.sort_array(F.collect_list("m")).alias("ms"))  # n_boot numbers a group
    at = lambda share: F.floor(F.size("ms") * share).cast("int")
    ends = ms.select(F.col("g").alias("of"), F.element_at("ms", at(alpha / 2) + 1).alias("lo"), F.element_at("ms", F.greatest(at(1 - alpha / 2), F.lit(1))).alias("hi"))
    mean = kept.groupBy("g").agg(F.round(F.avg("v"), 9).alias("mean"))
    return mean.join(ends, F.col("g").eqNullSafe(F.col("of"))).select(F.col("g").alias(group), "mean", "lo", "hi")
