"""Operator 8, embedding near-dedup by collision counting on sorted projections.

A table of one random projection has N * N / 4 pairs within any useful window, so each of the G tables here joins k - 1
coarse projections (cells of fixed width) with one fine projection that is sorted inside a cell and read through a window
centred on each vector. Collisions are counted per pair over all tables; pairs that reach a count set from the wanted
recall are verified by their cosine in double precision. k grows with the logarithm of the rows, so a vector keeps few
strangers in its cell; G follows from k and the recall."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, check_columns, read
from .graph import components

by_value(__name__)
COSINE, WIDTH, HALF, RECALL, COUNT, SEED, BLOCK = 0.95, 1.0, 0.5, 0.96, 2, 20_231, 2_000


def plan(n: int, cosine: float = COSINE, recall: float = RECALL, count: int = COUNT) -> tuple[int, int, int]:
    """Projections per table, tables, and the count to reach, for n distinct vectors.

    Gaussian projections of two unit vectors differ by a normal variable whose deviation is their distance; at the
    threshold that gives the chance of meeting in one table, and the count of meetings is binomial."""
    near, far = math.sqrt(2 - 2 * cosine), math.sqrt(2)
    phi = lambda x: 0.5 * math.erfc(-x / math.sqrt(2))

    def cell(s: float) -> float:
        r = WIDTH / s
        return 1 - 2 * phi(-r) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))

    k = max(3, math.ceil(math.log(10 * max(n, 10)) / -math.log(cell(far))))
    p = cell(near) ** (k - 1) * (2 * phi(HALF / near) - 1)
    tables = count
    while sum(math.comb(tables, j) * p**j * (1 - p) ** (tables - j) for j in range(count)) > 1 - recall:
        tables += 1
    return k, tables, count


def _projector(dim: int, k: int, tables: int):
    import numpy as np

    rng = np.random.default_rng(SEED)
    lines = rng.standard_normal((dim, tables * k))
    shift = rng.random(tables * (k - 1)) * WIDTH
    mix = rng.integers(1, 2**62, size=k - 1, dtype=np.int64) | 1

    def project(x):
        """Cells (rows x tables, hashed) and fine projections (rows x tables) of unit vectors."""
        y = (x @ lines).reshape(len(x), tables, k)
        coarse = np.floor((y[:, :, : k - 1].reshape(len(x), -1) + shift) / WIDTH).astype(np.int64).reshape(len(x), tables, k - 1)
        with np.errstate(over="ignore"):
            cells = (coarse * mix).sum(axis=2)
            cells ^= cells >> 29
        return cells, y[:, :, k - 1]

    return project


def _unit(vectors):
    import numpy as np

    x = np.asarray(vectors, dtype=np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def valid(col: str = "embedding"):
    """Neither null nor zero, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.col(col).isNotNull() & F.forall(col, finite) & F.exists(col, lambda x: x != 0), F.lit(False))


def _cells(reps: DataFrame, dim: int, k: int, tables: int) -> DataFrame:
    """(rep, t, cell) for every distinct vector and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        project = _projector(dim, k, tables)
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                cells, _ = project(_unit(part.column(1).to_pylist()))
                rep = np.repeat(np.asarray(part.column(0)), tables)
                yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(np.tile(np.arange(tables, dtype=np.int32), part.num_rows)), pa.array(cells.ravel())], names=["rep", "t", "cell"])

    return reps.select("rep", "v").mapInArrow(run, "rep long, t int, cell long")


def _compare(members: DataFrame, dim: int, k: int, tables: int, count: int, cosine: float) -> DataFrame:
    """From members sorted by group: (rep, to, links): the rows of other vectors verified to link, and a local root.

    A pair is counted by the first table in which it meets and nowhere else; pairs never leave the task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        project = _projector(dim, k, tables)

        def settle(df: pd.DataFrame) -> pd.DataFrame:
            x = _unit(df["v"].tolist())
            cells, fine = project(x)
            rep, m, t = df["rep"].to_numpy(), df["m"].to_numpy(), df["t"].to_numpy()
            own, a, b = df["part"].to_numpy(), df["a"].to_numpy(), df["b"].to_numpy()
            v = fine[np.arange(len(df)), t]
            code = (df["t"] * 1_000_003 + df["cell"]).to_numpy()
            group = np.concatenate([[0], np.cumsum((code[1:] != code[:-1]) | (t[1:] != t[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1]))])
            order = np.lexsort((v, group))
            links, root = np.zeros(len(df), np.int64), np.arange(len(df))

            def find(i: int) -> int:
                while root[i] != i:
                    root[i] = root[root[i]]
                    i = root[i]
                return i

            live, step = np.arange(len(df) - 1), 1
            while len(live):
                live = live[live + step < len(df)]
                i, j = order[live], order[live + step]
                meet = (group[i] == group[j]) & (v[j] - v[i] <= HALF)
                live, i, j = live[meet], i[meet], j[meet]
                mine = (own[i] != own[j]) | (a[i] == b[i])  # a split cell's pairs of two parts, or those of one part
                i, j = i[mine], j[mine]
                for at in range(0, len(i), 8192):
                    p, q = i[at : at + 8192], j[at : at + 8192]
                    same = (cells[p] == cells[q]) & (np.abs(fine[p] - fine[q]) <= HALF)
                    ok = (same.argmax(axis=1) == t[p]) & (same.sum(axis=1) >= count)
                    p, q = p[ok], q[ok]
                    ok = np.einsum("ij,ij->i", x[p], x[q]) >= cosine
                    p, q = p[ok], q[ok]
                    np.add.at(links, p, m[q])
                    np.add.at(links, q, m[p])
                    for r, s in zip(p.tolist(), q.tolist(), strict=True):
                        r, s = find(r), find(s)
                        root[max(r, s)] = min(r, s)
                step += 1
            tops = np.array([find(i) for i in np.nonzero(links)[0].tolist()], dtype=np.int64)
            hit = np.nonzero(links)[0]
            return pd.DataFrame({"rep": rep[hit], "to": rep[tops] if len(tops) else rep[:0], "links": links[hit]})

        tail = None
        keys = ["t", "cell", "a", "b"]
        for df in frames:
            df = df if tail is None else pd.concat([tail, df], ignore_index=True)
            last = (df[keys] == df[keys].iloc[-1]).all(axis=1).to_numpy()
            tail, done = df[last], df[~last]
            if len(done):
                yield settle(done.reset_index(drop=True))
        if tail is not None and len(tail):
            yield settle(tail.reset_index(drop=True))

    return members.mapInPandas(run, "rep long, to long, links long")


def _links(reps: DataFrame, dim: int, n: int, cosine: float, recall: float, scratch: Scratch) -> DataFrame:
    """(rep, to, links) among n distinct vectors of one length."""
    k, tables, count = plan(n, cosine, recall)
    cells = scratch.cut(_cells(reps, dim, k, tables), f"cells-{dim}")
    full = cells.groupBy("t", "cell").agg(F.count("*").alias("n")).filter("n > 1").withColumn("parts", F.ceil(F.col("n") / BLOCK).cast("int"))
    members = cells.join(full, ["t", "cell"]).withColumn("part", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    # a cell beyond BLOCK rows is compared as pairs of parts, each a task's share of its own
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    members = members.select("rep", "t", "cell", "part", other.alias("o")).select("rep", "t", "cell", "part", F.least("part", "o").alias("a"), F.greatest("part", "o").alias("b"))
    fat = members.join(reps.select("rep", "v", "m"), "rep").repartition("t", "cell", "a", "b").sortWithinPartitions("t", "cell", "a", "b")
    return scratch.cut(_compare(fat, dim, k, tables, count, cosine), f"links-{dim}")


def classes(vectors: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """One row per row of vectors (vec_id, embedding): n_links, component_id, kept.

    Equal vectors link with each other and are compared once; their number counts as links. Null, zero and non-finite
    vectors link with nothing and are components of their own. Null vec_ids take part but name no component. Vectors
    are compared with those of their own length; of two lengths there is no cosine and no link. An empty table gives no rows; other columns are ignored."""
    check_columns(vectors, "vec_id", "embedding")
    scratch = Scratch(vectors.sparkSession, "embeddings")
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    alone = rows.filter(~valid()).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    good = rows.filter(valid())
    reps = good.groupBy(F.col("embedding").alias("v")).agg(F.count("*").alias("m"), F.min("vec_id").alias("least")).withColumn("rep", F.monotonically_increasing_id())
    reps = scratch.cut(reps, "distinct")
    lengths = reps.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect()  # as a rule one
    if not lengths:
        return alone
    found = reduce(DataFrame.union, (_links(reps.filter(F.size("v") == r["dim"]), r["dim"], r["n"], cosine, recall, scratch) for r in lengths))
    roots = components(found.select(F.col("rep").alias("u"), F.col("to").alias("v")), scratch)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    named = reps.join(links, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    named = scratch.cut(named.select("v", "least", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("root")), "named")
    least = scratch.cut(named.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    named = named.join(least, "root").select("v", "n_links", "component_id")
    linked = good.join(named, F.col("embedding") == F.col("v"))
    return linked.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")).unionByName(alone)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "embeddings"))
