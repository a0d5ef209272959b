"""Coreset selection under quotas, from rows with an index, a cluster, a distance to its centre and a difficulty."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import by_value, written
from .analysis import gate

by_value(__name__)

REASONS = ("medoid", "complex", "rare", "reserve")


def zscore(rows: DataFrame, *cols: str) -> DataFrame:
    """cols standardized by population mean and deviation, zero deviation as 1. The statistics are one row."""
    stats = rows.agg(*(x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))))
    joined = rows.crossJoin(F.broadcast(stats))  # one row by construction
    scaled = {c: (F.col(c) - F.col(f"_m_{c}")) / F.when(F.coalesce(F.col(f"_s_{c}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_s_{c}")) for c in cols}
    return joined.withColumns(scaled).select(*rows.columns)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def l2_normalize(vector: Column, eps: float = 1e-8) -> Column:
    length = norm(vector) + eps
    return F.transform(vector, lambda x: x.cast("double") / length)


def combined(visual: Column, structural: Column, alpha: float = 2.0) -> Column:
    return F.concat(visual, F.transform(structural, lambda x: x * alpha))


def with_vectors(pool: DataFrame, vectors: DataFrame, dim: int, key: str = "pool_idx", vector: str = "v") -> DataFrame:
    """Every pool row with its vector, and `missing`: rows without one, or with a null one, have zeros. Vectors without a row
    are left out; a key has one vector."""
    joined = pool.join(vectors.select(key, F.col(vector).alias("_v")), key, "left")
    return joined.select(*pool.columns, F.coalesce("_v", F.array_repeat(F.lit(0.0), dim)).alias(vector), F.col("_v").isNull().alias("missing"))


def vectors_gate(rows: DataFrame, dim: int, most_missing: int = 0, vector: str = "v", stage: str = "vectors") -> DataFrame:
    """A gate on with_vectors(): rows, one size of vectors, and no more missing ones than allowed."""
    sizes = (F.count_if(F.size(vector) != dim) == 0, f"not {dim} numbers")
    return rows.agg(*gate(stage, (F.count("*") > 0, "empty"), sizes, (F.count_if("missing") <= most_missing, f"more than {most_missing} missing")))


def half(vector: str):
    """A column of vectors as little-endian numbers of 16 bits, and back as doubles: half of a float's room, three digits."""
    @F.udf("binary", useArrow=True)
    def pack(v):
        import numpy as np

        return None if v is None else np.array(v, dtype="<f2").tobytes()

    return pack(F.col(vector))


def from_half(packed: str):
    @F.udf("array<double>", useArrow=True)
    def unpack(b):
        import numpy as np

        return None if b is None else np.frombuffer(b, dtype="<f2").astype(float).tolist()

    return unpack(F.col(packed))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def centroids(rows: DataFrame, cluster: str = "cluster", vector: str = "v") -> DataFrame:
    each = rows.select(cluster, F.posexplode(vector).alias("i", "x")).groupBy(cluster, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return each.groupBy(cluster).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centre"))


def with_distance(rows: DataFrame, cluster: str = "cluster", vector: str = "v", digits: int = 9) -> DataFrame:
    """rows with d2, the squared distance to their cluster's mean, rounded so that ties are ties in every engine."""
    return rows.join(centroids(rows, cluster, vector), cluster).withColumn("d2", F.round(squared_distance(F.transform(vector, lambda x: x.cast("double")), F.col("centre")), digits)).drop("centre")


def sizes(rows: DataFrame, cluster: str = "cluster", k: int | None = None) -> DataFrame:
    """Rows per cluster; with k, empty clusters 0 to k - 1 as well."""
    n = rows.groupBy(cluster).agg(F.count("*").alias("size"))
    return n if k is None else rows.sparkSession.range(k).select(F.col("id").alias(cluster)).join(n, cluster, "left").withColumn("size", F.coalesce("size", F.lit(0)))


def medoids(rows: DataFrame, cluster: str = "cluster", idx: str = "idx") -> DataFrame:
    """Per cluster the row nearest to the centre, the first by idx on ties."""
    return rows.groupBy(cluster).agg(F.min(F.struct("d2", idx))[idx].alias(idx))


def select(rows: DataFrame, target: int, quotas: tuple[int, int, int, int], seed: int = 42, key: str = "key") -> DataFrame:
    """(idx, reason, rank): medoids of the largest clusters, the most difficult, one of each of the smallest clusters, a
    seeded reserve, then a seeded fill to target, cut to target. Quotas do not scale with target.

    rows: idx, cluster, d2, difficulty, key. Each choice is a total order; picks are limited before they are joined."""
    rows = written(rows.select("idx", "cluster", "d2", "difficulty", "key"), "selection")  # narrow, read at every stage
    by = sizes(rows)
    order = F.greatest(F.lit(1.0), F.sqrt(F.col("size").cast("double")))
    chosen = medoids(rows).join(by, "cluster").orderBy(order.desc(), "cluster").limit(quotas[0]).select("idx").withColumn("stage", F.lit(0))
    left = lambda df, c: df.join(c.select("idx"), "idx", "left_anti")
    hard = left(rows, chosen).orderBy(F.desc("difficulty"), "idx").limit(quotas[1]).select("idx").withColumn("stage", F.lit(1))
    chosen = chosen.unionByName(hard)
    lone = rows.groupBy("cluster").agg(F.min("idx").alias("idx"), F.count("*").alias("size"))
    rare = left(lone, chosen).orderBy("size", "cluster").limit(quotas[2]).select("idx").withColumn("stage", F.lit(2))
    chosen = chosen.unionByName(rare)
    shuffled = F.md5(F.concat_ws(":", F.lit(seed), F.col(key)))
    rest = left(rows, chosen).select("idx", shuffled.alias("h")).orderBy("h", "idx").limit(max(target, quotas[3]))
    place = F.row_number().over(Window.orderBy("h", "idx"))  # over at most target rows
    rest = rest.withColumn("n", place)
    late = rest.select("idx", F.when(F.col("n") <= quotas[3], 3).otherwise(4).alias("stage"), "n")
    early = chosen.withColumn("n", F.lit(0))
    ranked = early.unionByName(late).join(rows.select("idx", "difficulty"), "idx")
    rank = F.row_number().over(Window.orderBy("stage", "n", "idx"))  # over the quotas and at most target more rows
    return ranked.withColumn("rank", rank).filter(F.col("rank") <= target).select("idx", F.element_at(F.array(*(F.lit(r) for r in (*REASONS, "fill"))), F.col("stage") + 1).alias("reason"), "rank")


def pilot_quotas(target: int) -> tuple[int, int, int, int]:
    a, b, c = int(0.70 * target), int(0.15 * target), int(0.10 * target)
    return a, b, c, target - a - b - c


def kmeans(rows: DataFrame, k: int, seed: int = 42, vector: str = "v", max_iter: int = 10) -> DataFrame:
    """rows with `cluster` by Spark's own k-means; its labels are those of no other implementation."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    ready = rows.withColumn("_f", array_to_vector(F.col(vector)))
    model = KMeans(k=k, seed=seed, maxIter=max_iter, featuresCol="_f", predictionCol="cluster").fit(ready)
    return model.transform(ready).drop("_f")


def nearest(rows: DataFrame, centres, vector: str = "v") -> DataFrame:
    """rows with `cluster`, the number of the nearest centre (the first of equally near ones), and `distance` to it. centres:
    an array of as many vectors as there are clusters, shipped with each task; null vectors have neither."""
    import pandas as pd

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        c = np.asarray(centres, dtype=np.float64)
        for df in frames:
            ok = df[vector].notna().to_numpy()
            out, far = pd.array([None] * len(df), dtype="Int32"), pd.array([None] * len(df), dtype="Float64")
            if ok.any():
                x = np.stack([np.asarray(v, dtype=np.float64) for v in df[vector][ok]])
                near, d = closest(x, c)
                out[ok], far[ok] = near, d
            yield df.assign(cluster=out, distance=far)

    extra = ", cluster int, distance double"
    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + extra)


def closest(x, centres):
    """(numbers, distances) of the nearest centres, in blocks of rows so that memory stays bounded."""
    import numpy as np

    near, far, step = [], [], max(1, 4_000_000 // max(1, centres.size))
    for k in range(0, len(x), step):
        squares = ((x[k : k + step, None, :] - centres[None]) ** 2).sum(2)
        near.append(squares.argmin(1))
        far.append(np.sqrt(squares.min(1)))
    return np.concatenate(near), np.concatenate(far)


def first_centres(sample, k: int, seed: int):
    """k rows of a sample (an array), each drawn in proportion to its squared distance from those before it."""
    import numpy as np

    rng = np.random.default_rng(seed)
    picked = [int(rng.integers(len(sample)))]
    left = ((sample - sample[picked[0]]) ** 2).sum(1)
    while len(picked) < k:
        at = int(rng.choice(len(sample), p=left / left.sum())) if left.sum() > 0 else len(picked) % len(sample)
        picked.append(at)
        left = np.minimum(left, ((sample - sample[at]) ** 2).sum(1))
    return sample[picked].copy()


def minibatch_kmeans(rows: DataFrame, k: int, seed: int = 42, vector: str = "v", key: str = "idx", batch: int = 4096, passes: int = 3):
    """The centres (an array of k vectors) of mini-batch k-means over rows with a key and a vector.

    Every row belongs to a batch by a seeded hash of its key, about `batch` rows each; the batches are written once, apart
    from each other, and read one after another, `passes` times. A batch is assigned to the centres as they stand; tasks send
    back a sum and a count for each centre that they met, and a centre moves to the mean of all rows that it was ever given.
    It starts from rows of the first batch, or the first k rows if that has fewer. Null vectors are left out; fewer rows than k give repeated centres."""
    import numpy as np

    ready = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("v"))
    n = ready.count()
    if not n:
        raise ValueError("no vectors to cluster")
    n_batches = -(-n // batch)
    of = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), "key")), 1, 8), 16, 10).cast("long"), F.lit(n_batches)).cast("int")
    stored = written(ready.withColumn("batch", of), "batches", by="batch")
    sample = [r["v"] for r in stored.orderBy("batch", "key").limit(max(k, batch)).collect()]
    centres = first_centres(np.array(sample), k, seed)
    given = np.zeros(k)
    for step in range(passes * n_batches):
        now = centres.copy()

        def run(frames: Iterator, now=now) -> Iterator:
            import numpy as np
            import pandas as pd

            for df in frames:
                x = np.stack([np.asarray(v) for v in df["v"]])
                near, _ = closest(x, now)
                met, at, counts = np.unique(near, return_inverse=True, return_counts=True)
                sums = np.zeros((len(met), x.shape[1]))
                np.add.at(sums, at, x)
                yield pd.DataFrame({"centre": met, "n": counts, "total": list(sums)})

        parts = stored.filter(F.col("batch") == step % n_batches).select("v").mapInPandas(run, "centre int, n long, total array<double>").collect()
        for c in sorted({r["centre"] for r in parts}):  # rows of one batch at most
            total, m = sum(np.array(r["total"]) for r in parts if r["centre"] == c), sum(r["n"] for r in parts if r["centre"] == c)
            given[c] += m
            centres[c] += (total - m * now[c]) / given[c]
    return centres


def pca2(rows: DataFrame, vector: str = "v") -> DataFrame:
    """rows with x, y: the first two principal components of centred vectors (signs are arbitrary)."""
    from pyspark.ml.feature import PCA, StandardScaler
    from pyspark.ml.functions import array_to_vector, vector_to_array

    ready = rows.withColumn("_f", array_to_vector(F.col(vector)))
    centred = StandardScaler(withMean=True, withStd=False, inputCol="_f", outputCol="_c").fit(ready).transform(ready)
    out = PCA(k=2, inputCol="_c", outputCol="_p").fit(centred).transform(centred).withColumn("_p", vector_to_array("_p"))
    return out.withColumns({"x": F.col("_p")[0], "y": F.col("_p")[1]}).drop("_f", "_c", "_p")
