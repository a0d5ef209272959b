"""Operator 9, quality classifier: ordinal cumulative-link regression on graded ratings.

A rating has the grades 0 toxic, 1 poor, 2 good. One weight vector over hashed text features is shared by all grades and
ordered thresholds part them: P(grade <= k) = sigmoid(threshold_k - score). The expected grade and the tail probability
P(grade >= 2) rank and select documents."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import by_value, check_columns, read

by_value(__name__)
BITS, MAX_TRAIN, STEPS, RIDGE, MIN_DOCS, SHAPE, SIGNAL = 18, 12_000, 150, 2e-4, 4, 8, 4.0
KEEP_AT = 0.5
MARKS = "*$%&#!|<>{}[]=~^_/\\@+"
WORDS = re.compile(r"[^\W\d_]+")


def features(text: str | None, bits: int = BITS) -> list[int]:
    """The hashed features of a whole text: which words it has, and its shape in coarse steps, each worth SHAPE words."""
    mask, text = (1 << bits) - 1, text or ""
    low = WORDS.findall(text.lower())
    distinct = set(low)
    out = sorted({zlib.crc32(w.encode("utf-8", "replace")) & mask for w in distinct})
    n, tokens = max(1, len(low)), text.split()
    m = max(1, len(tokens))
    step = lambda x: min(10, int(x * 20))
    shape = {
        "repeats": step(sum(a == b for a, b in zip(low, low[1:], strict=False)) / n),
        "capitals": step(sum(t.isupper() and len(t) > 1 for t in tokens) / m),
        "symbols": step(sum(map(text.count, MARKS)) / m),
        "alone": step(sum(not any(map(str.isalnum, t)) for t in tokens) / m),
        "distinct": step(len(distinct) / n / 2),
        "length": min(14, n.bit_length()),
    }
    return out + SHAPE * [zlib.crc32(f"{k}={v}".encode(), 7) & mask for k, v in shape.items()]


def grade_of(quality: str = "quality", toxic: str = "toxic"):
    """Toxic 0, poor 1, good 2; null if neither column says anything."""
    return F.when(F.col(toxic) == 1, 0).when(F.col(quality) == 0, 1).when(F.col(quality) == 1, 2)


class Ordinal:
    """Weights by hashed feature and ordered thresholds."""

    def __init__(self, weights, thresholds: list[float]):
        self.weights, self.thresholds = weights, thresholds

    def score(self, feats) -> float:
        import numpy as np

        return float(self.weights[np.fromiter(feats, np.int64, len(feats))].sum())

    def tails(self, score: float) -> list[float]:
        """P(grade >= 1), P(grade >= 2), ..."""
        import math

        return [1 / (1 + math.exp(min(700.0, max(-700.0, t - score)))) for t in self.thresholds]


def fit(rows: list[tuple[list[int], int]], bits: int = BITS, grades: int = 3, steps: int = STEPS, ridge: float = RIDGE, min_docs: int = MIN_DOCS) -> Ordinal:
    """Full-batch Adam on the cumulative-link likelihood with class-balanced rows; features in fewer than min_docs
    rows, or whose rows lie within SIGNAL standard errors of the whole at every cut between grades, get no weight, so
    that long texts do not add up noise. Without rows every document gets the prior of even grades."""
    import numpy as np

    size = 1 << bits
    w, cuts = np.zeros(size), np.linspace(-1.0, 1.0, grades - 1)
    if not rows:
        return Ordinal(w, cuts.tolist())
    y = np.asarray([g for _, g in rows])
    n, below = np.zeros(size), np.zeros((grades - 1, size))
    for f, g in rows:  # counted row by row: the driver holds no array of all features but that of the telling ones
        own = np.unique(np.asarray(f, np.int64))
        n[own] += 1
        below[g:, own] += 1
    telling = np.zeros(size, bool)
    for k in range(grades - 1):
        under = (y <= k).astype(float)
        telling |= np.abs(below[k] - n * under.mean()) >= SIGNAL * max(float(under.std()), 1e-9) * np.sqrt(n)
    common = (n >= min_docs) & telling
    del n, below, telling
    kept = [f[common[f]] for f in (np.asarray(f, np.int64) for f, _ in rows)]
    idx, own = np.concatenate(kept), np.repeat(np.arange(len(rows)), [len(f) for f in kept])
    del kept
    per = np.bincount(y, minlength=grades)
    weight = np.sqrt(len(rows) / (grades * np.maximum(per, 1)))[y]
    weight /= weight.sum()
    gap = np.log(np.diff(cuts, prepend=cuts[0] - 1.0)[1:])
    par = np.concatenate([w, cuts[:1], gap])
    m, v = np.zeros_like(par), np.zeros_like(par)
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -500, 500)))
    for t in range(1, steps + 1):
        w, first, gap = par[:size], par[size], par[size + 1 :]
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gap))])
        score = np.bincount(own, weights=w[idx], minlength=len(rows))
        edges = np.concatenate([[-np.inf], cuts, [np.inf]])
        up, low = sig(edges[y + 1] - score), sig(edges[y] - score)
        p = np.maximum(up - low, 1e-12)
        d_up, d_low = weight * up * (1 - up) / p, weight * low * (1 - low) / p  # slopes of log p at both edges
        g_score = d_up - d_low
        g_cut = np.zeros(grades - 1)
        for k in range(grades - 1):
            g_cut[k] = -d_up[y == k].sum() + d_low[y == k + 1].sum()
        back = np.cumsum(g_cut[::-1])[::-1]
        grad = np.concatenate([np.bincount(idx, weights=g_score[own], minlength=size) + ridge * w, [back[0]], back[1:] * np.exp(gap)])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        par = par - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    cuts = par[size] + np.concatenate([[0.0], np.cumsum(np.exp(par[size + 1 :]))])
    return Ordinal(np.where(common, par[:size], 0.0), cuts.tolist())


def training_rows(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS) -> list[tuple[list[int], int]]:
    """At most max_train labelled documents, the first by hash of doc_id, as hashed features; only features reach the driver.

    A doc_id labelled twice takes its lowest grade, one that stands for several texts the least of them. The bound is on
    rows for the model alone; scoring covers every row."""
    graded = labels.select("doc_id", grade_of().alias("grade")).filter("grade is not null and doc_id is not null").groupBy("doc_id").agg(F.min("grade").alias("grade"))
    picked = graded.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([features(t.as_py(), bits) for t in b.column(0)], pa.list_(pa.int32())), b.column(1)], names=["f", "grade"])

    # picked has at most max_train rows, so it may be broadcast
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "grade").agg(F.min("text").alias("text")).select("text", "grade")
    table = chosen.mapInArrow(run, "f array<int>, grade int").toArrow()
    return [(f.values.to_numpy(), g) for f, g in zip(table.column(0), table.column(1).to_pylist(), strict=True)]


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, bits: int = BITS) -> Ordinal:
    return fit(training_rows(docs, labels, max_train, bits), bits)


def graded(docs: DataFrame, model: Ordinal, keep_at: float = KEEP_AT, bits: int = BITS) -> DataFrame:
    """(row, expected_grade, tail, kept) for every row of docs, the row packed, so that no column name can clash.

    expected_grade is 0 to 2, tail the probability of the highest grade, kept is tail >= keep_at. Null text counts as
    empty; texts are read whole, in Arrow batches; equal rows have equal results; empty tables give no rows."""
    check_columns(docs, "text")
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds))
    new = [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail", T.DoubleType()), T.StructField("kept", T.BooleanType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Ordinal(*shared.value)
        for b in batches:
            tails = [m.tails(m.score(features(t.as_py(), bits))) for t in b.column(1)]
            extra = [pa.array([sum(t) for t in tails], pa.float64()), pa.array([t[-1] for t in tails], pa.float64()), pa.array([t[-1] >= keep_at for t in tails], pa.bool_())]
            yield pa.RecordBatch.from_arrays([b.column(0), *extra], names=["row", "expected_grade", "tail", "kept"])

    packed = docs.select(F.struct("*").alias("row"), F.col("text"))
    return packed.mapInArrow(run, T.StructType([packed.schema["row"], *new]))


def grade(docs: DataFrame, model: Ordinal, keep_at: float = KEEP_AT, bits: int = BITS) -> DataFrame:
    """graded() with the rows' own columns, of which those named like a new one are replaced."""
    own = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in ("expected_grade", "tail", "kept")]
    return graded(docs, model, keep_at, bits).select(*own, "expected_grade", "tail", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return grade(docs.select("doc_id", "text"), train(docs, read(spark, sf_dir, "labels"))).drop("text")
