"""Selections, resamples and clusters that no task gathers, against plain versions of them."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgraph.operators import analysis, coreset, evaluate


@pytest.mark.parametrize("bins", [1024, 2])
def test_quantiles_are_exact(spark, monkeypatch, bins):
    monkeypatch.setattr(analysis, "BINS", bins)
    rng = random.Random(2)
    for values in ([rng.gauss(0, 1) for _ in range(301)], [10.0 ** rng.randint(-9, 9) for _ in range(60)], [1.5] * 7, [4.0], [1.0, 1.0, 2.0, 2.0], [-1e308, 1e308, 0.0]):
        rows = [(v,) for v in values] + [(None,)]
        got = analysis.quantiles(spark.createDataFrame(rows, "v double"), "v", (0.0, 0.25, 0.5, 0.9, 1.0)).first()
        with np.errstate(over="ignore"):
            want = [np.quantile(np.array(values), q) for q in (0.0, 0.25, 0.5, 0.9, 1.0)]
        assert all(math.isclose(a, b, rel_tol=1e-12, abs_tol=1e-12) or abs(b) > 1e307 or not math.isfinite(b) for a, b in zip(got, want, strict=True)), (values, got, want)


def test_quantiles_of_odd_values(spark):
    inf = float("inf")
    rows = spark.createDataFrame([(v,) for v in (-inf, -inf, 1.0, 3.0, inf, float("nan"), None)], "v double")
    got = analysis.quantiles(rows, "v", (0.0, 0.2, 0.4, 0.5, 0.6, 0.8, 1.0)).first()
    assert tuple(got)[:6] == (-inf, -inf, 1.0, 2.0, 3.0, inf) and math.isnan(got[6])
    assert tuple(analysis.quantiles(rows.filter("v is null"), "v").first()) == (None,) * 4


def test_numbers_within_groups(spark):
    rows = [(g, k) for k in range(200) for g in (("a", "b", None) if k % 2 else ("a",))]
    random.Random(1).shuffle(rows)
    got = evaluate.numbered(spark.createDataFrame(rows, "g string, k long").repartition(5), "g", "k").collect()
    assert len(got) == len(rows)
    for g in ("a", "b", None):
        of = sorted((r["k"], r["i"]) for r in got if r["g"] == g)
        assert [i for _, i in of] == list(range(len(of)))


def test_resamples_by_counts(spark):
    """Intervals as wide as theory has them, whatever the partitions; odd values and groups are told apart."""
    rng = random.Random(4)
    rows = [("a", k, rng.gauss(5, 2)) for k in range(400)] + [("b", k, 1.0) for k in range(5)] + [("c", 1, None), ("c", 2, float("nan")), (None, 9, 2.0)]
    frame = spark.createDataFrame(rows, "g string, k long, v double")
    got, again = ({r["g"]: tuple(r)[1:] for r in evaluate.bootstrap_counts(frame.repartition(n), "g", "v", "k").collect()} for n in (1, 7))
    assert got == again and set(got) == {"a", "b", None} and got["b"] == (1.0, 1.0, 1.0) == tuple(x / 2 for x in got[None])
    mean, lo, hi = got["a"]
    assert lo < mean < hi and 0.8 < (hi - lo) / (2 * 1.96 * 2 / math.sqrt(400)) < 1.2


def test_poisson_counts():
    assert POISSON_SHARES[0] == pytest.approx(math.exp(-1), abs=1e-9) and evaluate.POISSON == sorted(evaluate.POISSON)


POISSON_SHARES = [t / 2**32 for t in evaluate.POISSON]


def plain_minibatch(rows, k, seed, batch, passes):
    """The same batches and start, a row at a time."""
    import hashlib

    n_batches = -(-len(rows) // batch)
    of = {i: int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:8], 16) % n_batches for i, _ in rows}
    order = sorted(rows, key=lambda r: (of[r[0]], r[0]))
    centres = coreset.first_centres(np.array([v for _, v in order[: max(k, batch)]]), k, seed)
    given = [0] * k
    for step in range(passes * n_batches):
        now = centres.copy()
        moved = {}
        for i, v in rows:
            if of[i] == step % n_batches:
                c = int(np.argmin([sum((a - b) ** 2 for a, b in zip(v, m, strict=True)) for m in now]))
                moved.setdefault(c, []).append(v)
        for c, vs in moved.items():
            given[c] += len(vs)
            centres[c] += (np.sum(vs, axis=0) - len(vs) * now[c]) / given[c]
    return centres


def test_minibatch_kmeans_equals_the_plain_one(spark):
    rng = np.random.default_rng(3)
    middles = np.array([[0, 0, 0], [9, 0, 0], [0, 9, 0], [0, 0, 9]], dtype=float)
    rows = [(k, (middles[k % 4] + rng.normal(0, 0.5, 3)).tolist()) for k in range(120)]
    frame = spark.createDataFrame([*rows, (500, None)], "idx long, v array<double>").repartition(3)
    got = coreset.minibatch_kmeans(frame, 4, seed=5, batch=40, passes=2)
    assert np.allclose(got, plain_minibatch(rows, 4, 5, 40, 2))
    near = coreset.nearest(frame, got).collect()
    assert len(near) == 121 and {r["idx"]: r["cluster"] for r in near}[500] is None
    cost = lambda centres: sum(min(((np.array(v) - c) ** 2).sum() for c in centres) for _, v in rows)
    assert sum(r["distance"] ** 2 for r in near if r["distance"] is not None) == pytest.approx(cost(got))
    assert cost(got) < 0.5 * cost([np.mean([v for _, v in rows], axis=0)])
    assert len(coreset.minibatch_kmeans(frame.filter("idx < 2"), 4)) == 4
    with pytest.raises(ValueError):
        coreset.minibatch_kmeans(frame.filter("false"), 4)


def test_principal_components_hold_the_most_variance(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 5)) @ np.diag([5.0, 3.0, 1.0, 0.5, 0.1]) + 7
    rows = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "k long, v array<double>")
    got = np.array([(r["x"], r["y"]) for r in coreset.pca2(rows).orderBy("k").collect()])
    centred = x - x.mean(0)
    best = centred @ np.linalg.svd(centred, full_matrices=False)[2][:2].T
    assert np.allclose(np.abs(got), np.abs(best))


def test_a_renderer_that_fails_marks_its_row(spark):
    from inkgraph.functions import markup

    def draw(text):
        if "bad" in text:
            raise ValueError(text)
        return text.encode() if "none" not in text else None

    rows = spark.createDataFrame([(1, '<a fill="red"/>'), (2, "bad"), (3, "none")], "k long, normalized string")
    got = {r["k"]: (r["png"], r["render_ok"]) for r in markup.with_render(rows, draw).collect()}
    assert got[2] == got[3] == (None, False) and got[1][1] and b"#ff0000" in got[1][0]


def test_scores_are_joined_without_broadcasts(spark, tmp_path):
    """Markup in files is a small part of what it is in memory, so no join of it may rest on the size of files."""
    from inkgraph.plans import diagrams

    rows = diagrams.scored(spark, "/root/testdata/sf0.001")
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    gold, predictions, _ = diagrams.gold_and_predictions(spark, "/root/testdata/sf0.001")
    met = evaluate.gold_with_predictions(gold, predictions)
    assert "BroadcastHashJoin" not in met._jdf.queryExecution().executedPlan().toString()


def test_markup_of_a_small_file_is_parsed_by_many_tasks(spark):
    from inkgraph.plans import diagrams

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for make in (diagrams.drawings, diagrams.kinds, diagrams.scenes, diagrams.parts):
        sizes = [len(p) for p in make(spark, "/root/testdata/sf0.01").select("*").rdd.glom().collect()]
        assert len(sizes) >= n and max(sizes) < 2 * sum(sizes) / len(sizes)


@pytest.mark.parametrize(("block", "draws"), [(32_768, 1_000_000), (7, 60)])
def test_md5_resamples_equal_a_plain_loop(spark, monkeypatch, block, draws):
    import hashlib

    monkeypatch.setattr(evaluate, "BLOCK", block)
    monkeypatch.setattr(evaluate, "DRAWS", draws)
    rng = random.Random(8)
    rows = [("a", k, rng.gauss(0, 1)) for k in range(50)] + [("b", k, float(k)) for k in range(3)] + [("c", 1, 2.5), ("d", 1, None), (None, 1, 1.0)]
    frame = spark.createDataFrame(rows, "g string, k long, v double").repartition(3)
    got = {r["g"]: tuple(r)[1:] for r in evaluate.bootstrap_md5(frame, "g", "v", "k", n_boot=40).collect()}
    want = {}
    for g in "abc":
        v = [x for h, _, x in rows if h == g]
        pick = lambda b, i, n=len(v): int(hashlib.md5(f"{b}:{i}".encode()).hexdigest()[:8], 16) % n
        ms = sorted(sum(v[pick(b, i)] for i in range(len(v))) / len(v) for b in range(40))
        want[g] = (sum(v) / len(v), ms[1], ms[38])
    assert set(got) == set(want) and all(got[g] == pytest.approx(want[g], abs=2e-9) for g in want)


def test_md5_resamples_move_no_row_a_draw(spark):
    frame = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.lit(1.0).alias("v"))
    plan = evaluate.bootstrap_md5(frame, "g", "v", "k", n_boot=100)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroups" in plan and "pick" not in plan.replace("picks", "")


@pytest.mark.parametrize("n", [1, 2, 7, 64, 65, 1000])
def test_picks_are_those_of_the_plain_generator(n):
    rng = random.Random(5)
    assert [p.tolist() for p in evaluate._picks(n, 30, 5)] == [[rng.randrange(n) for _ in range(n)] for _ in range(30)]


def test_exact_resamples_of_a_large_group_are_drawn_in_arrays():
    """20,000,000 draws, which took about 22 s with one call of the generator each."""
    import time

    began = time.process_time()
    got = evaluate.bootstrap([float(k % 2) for k in range(20_000)], 1000)
    assert got["mean"] == 0.5 and 0.49 < got["lo"] < 0.5 < got["hi"] < 0.51
    assert time.process_time() - began < 6


def test_each_draw_of_counted_resamples_is_read_once(spark):
    frame = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").alias("k"), F.lit(1.0).alias("v"))
    plan = evaluate.bootstrap_counts(frame, "g", "v", "k", n_boot=8)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("conv(") <= 8
