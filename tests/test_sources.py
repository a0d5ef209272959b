"""Files on disk: pinned reads, resumed runs, error sink, counters, one file a row, and evaluation from manifests."""

import json
import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkgraph.operators import generate, scoring
from inkgraph.sources import files, runs, tables

SVG = '<svg xmlns="http://www.w3.org/2000/svg"><rect x="1" y="1" width="9" height="9"/><rect/></svg>'


def test_pinned_reads_see_the_pinned_files_alone(spark, tmp_path):
    data, at = f"{tmp_path}/data", f"{tmp_path}/pin"
    assert runs.pin(spark, data, at) is None and not tables.exists(spark, at)
    spark.range(10).withColumn("p", F.col("id") % 2).write.partitionBy("p").parquet(data)
    first = runs.pin(spark, data, at)
    spark.range(10, 15).withColumn("p", F.lit(0)).write.mode("append").partitionBy("p").parquet(data)
    assert sorted(r["id"] for r in runs.pinned(spark, at).collect()) == list(range(10)) and "p" in runs.pinned(spark, at).columns
    assert spark.read.parquet(data).count() == 15
    second = runs.pin(spark, data, f"{tmp_path}/pin2")
    assert first != second and runs.pinned(spark, f"{tmp_path}/pin2").count() == 15 and runs.pin(spark, data, f"{tmp_path}/pin3") == second
    spark.range(3).withColumn("p", F.lit(0)).write.mode("overwrite").partitionBy("p").parquet(data)
    with pytest.raises(RuntimeError, match="changed since they were pinned"):
        runs.pinned(spark, at)


def test_resumed_runs_compute_what_is_missing(spark, tmp_path):
    calls, folder = [], f"{tmp_path}/run"

    def step(rows):
        calls.append(sorted(r["k"] for r in rows.collect()))
        return rows.select("k", F.col("v").alias("out"), F.lit("x").alias("part"))

    def run(rows, settings=None):
        calls.clear()
        got = runs.resumed(rows, F.col("k") % 4, step, folder, settings)
        return sorted((r["k"], r["out"]) for r in got.collect()), [c for c in calls if c]

    rows = spark.createDataFrame([(k, f"v{k}") for k in range(12)] + [(None, "n")], "k long, v string")
    half = rows.filter("k % 4 < 2 or k is null")
    key = lambda r: (r[0] is not None, r[0] or 0)
    got = runs.resumed(half.filter("k is not null"), F.col("k") % 4, step, folder)
    assert got.count() == 6
    rows = rows.filter("k is not null")
    assert run(rows) == ([(k, f"v{k}") for k in range(12)], [[2, 3, 6, 7, 10, 11]])
    assert run(rows.repartition(3)) == ([(k, f"v{k}") for k in range(12)], [])
    changed = rows.withColumn("v", F.when(F.col("k") == 5, "new").otherwise(F.col("v")))
    assert run(changed)[1] == [[1, 5, 9]] and (5, "new") in run(changed)[0]
    assert run(rows)[1] == []  # the earlier result is still there
    assert run(rows.union(rows.filter("k = 3")))[1] == [[3, 3, 7, 11]]
    assert run(rows, {"alpha": 2})[1] == [list(range(12))]
    assert run(rows.filter("k % 4 = 0")) == ([(k, f"v{k}") for k in (0, 4, 8)], [])
    assert run(rows.filter("false")) == ([], [])
    assert sorted(map(key, [(r["k"],) for r in runs.resumed(half, F.col("k") % 4, step, folder).collect()]))[0] == (False, 0)


def test_a_run_that_broke_off_leaves_nothing_that_is_read(spark, tmp_path):
    rows, folder = spark.range(8), f"{tmp_path}/run"
    broken = F.udf(lambda x: 1 // (x - 5), "long")
    with pytest.raises(Exception):
        runs.resumed(rows, F.col("id") % 2, lambda r: r.withColumn("y", broken("id")), folder).count()
    assert runs.log_of(spark, folder).count() == 0
    assert runs.resumed(rows, F.col("id") % 2, lambda r: r.withColumn("y", F.lit(1).cast("long")), folder).count() == 8


def test_errors_are_appended_once(spark, tmp_path):
    path = f"{tmp_path}/errors"
    assert runs.errors_of(spark, path).count() == 0
    one = spark.createDataFrame([("a", "render", "m" * 600), ("b", "render", "x")], "row_id string, error_type string, message string")
    runs.append_errors(one, path, "render", "b1")
    runs.append_errors(one.limit(1), path, "select", "b1")
    runs.append_errors(one, path, "render", "b1")
    got = runs.errors_of(spark, path).collect()
    assert len(got) == 3 and max(len(r["message"]) for r in got) == 500 and {r["stage"] for r in got} == {"render", "select"}


def test_counters_equal_the_histogram(spark, tmp_path):
    rows = spark.range(100).select("id", F.when(F.col("id") % 3 == 0, "dup").when(F.col("id") % 7 == 0, "leak").when(F.col("id") == 1, "odd").alias("why"))
    watched, seen = runs.counted(rows, "why", ("dup", "leak"))
    watched.write.parquet(f"{tmp_path}/out")
    assert seen.get == {"scanned": 100, "kept": 100 - 34 - 10 - 1, "dup": 34, "leak": 10, "other": 1}


def test_one_file_a_row(spark, tmp_path):
    rows = spark.createDataFrame([("a/1.svg", "x"), ("a/2.svg", None), ("b.svg", "zwei é"), ("b.svg", "zwei é")], "p string, c string").repartition(3)
    for _ in range(2):  # a job that is run again puts the same files in the same places
        files.write_files(rows, f"{tmp_path}/out", F.col("p"), F.col("c"))
    found = {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*.svg")}
    assert found == {"a/1.svg": "x", "a/2.svg": "", "b.svg": "zwei é"}
    assert not list((tmp_path / "out").rglob(".*.svg*")) and json.loads((tmp_path / "out/_WRITTEN").read_text())["files"] == 3
    for bad in ("/abs", "a/../../b", "", None, "d/"):
        with pytest.raises(ValueError):
            files.write_files(spark.createDataFrame([(bad, "x")], "p string, c string"), f"{tmp_path}/bad", F.col("p"), F.col("c"))
    assert not (tmp_path / "bad").exists()


def test_paths_have_one_form(spark):
    given = ["file:///a/b%20c.json", "file:/a/b+c.json", "/a//b/./c.json", "./x/y.json", "x/y%20z.json", "s3://k/a//b.json", None]
    got = spark.createDataFrame([(x,) for x in given], "p string").select(tables.plain_path(F.col("p"))).collect()
    assert [r[0] for r in got] == ["/a/b c.json", "/a/b+c.json", "/a/b/c.json", "x/y.json", "x/y%20z.json", "s3://k/a/b.json", None]


def diagrams(tmp_path, n=6):
    """A manifest on disk: graphs in the line, in sidecars by relative and rooted paths, and in markup in the line and in files."""
    made = [generate.workflow(k, "train", 42) for k in range(n)]
    (tmp_path / "graphs dir").mkdir()
    (tmp_path / "svgs").mkdir()
    lines = []
    for k, m in enumerate(made):
        graph = m["scene_graph"] if isinstance(m["scene_graph"], dict) else json.loads(m["scene_graph"])
        row = {"id": f"d{k}", "split": "id"}
        if k % 3 == 0:
            row |= {"scene_graph": graph, "svg": m["svg"]}
        elif k % 3 == 1:
            (tmp_path / f"graphs dir/{k}.json").write_text(json.dumps(graph))
            row |= {"scene_graph_path": f"graphs dir/{k}.json" if k == 1 else f"{tmp_path}/graphs dir/{k}.json", "svg": m["svg"]}
        else:
            (tmp_path / f"svgs/{k}.svg").write_text(m["svg"])
            row |= {"svg_path": f"./svgs/{k}.svg"}
        lines.append(row)
    (tmp_path / "manifest.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n")
    return made


def test_evaluation_of_files(spark, tmp_path):
    made = diagrams(tmp_path)
    preds = [{"id": "d0", "pred_text": "junk"}] + [{"id": f"d{k}", "pred_text": m["svg"]} for k, m in enumerate(made[:4])] + [{"id": "d4", "svg": made[4]["svg"]}, {"id": "d5", "pred_text": "<svg", "svg": ""}, {"pred_text": "no id"}]
    (tmp_path / "preds.jsonl").write_text("\n".join(map(json.dumps, preds[:3])) + '\n\n{"id": "d9", "pred_te\n' + "\n".join(map(json.dumps, preds[3:])))
    scores, bad = scoring.evaluate_files(spark, f"{tmp_path}/manifest.jsonl", f"{tmp_path}/preds.jsonl", str(tmp_path), "id")
    got = {r["id"]: r for r in scores.collect()}
    assert sorted(got) == [f"d{k}" for k in range(6)]
    for k in range(5):
        assert (got[f"d{k}"]["entity_f1"], got[f"d{k}"]["relation_f1"], got[f"d{k}"]["validity"], got[f"d{k}"]["gold_ok"]) == (1.0, 1.0, 1.0, True), k
    assert got["d5"]["parse_ok"] is False and got["d5"]["entity_f1"] == 0.0
    assert sorted(r["line"] for r in bad.collect()) == ["no id", '{"id": "d9", "pred_te']
    row = scoring.report(scores, 200).first()
    assert row["n"] == 6 and row["validity"] == pytest.approx(5 / 6) and row["validity_lo"] <= row["validity"] <= row["validity_hi"]


def test_modules_run_from_any_folder(tmp_path):
    """Functions are shipped by value: a worker that cannot import the package still runs them."""
    root = Path(__file__).resolve().parent.parent
    code = f"""
import sys; sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession, functions as F
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from inkgraph.functions import markup
from inkgraph.operators import coreset, evaluate, scoring
rows = spark.createDataFrame([({SVG!r}, None, None)], "svg string, scene_graph string, scene_graph_path string")
assert markup.with_report(rows).first()["report"]["parse_ok"] and scoring.resolve_gold(rows).count() == 1
assert markup.with_judgement(rows, "svg", "svg", "svg").first()["own"]["n_drawable"] == 2
assert evaluate.bootstrap_by(spark.createDataFrame([("a", 1.0, 1)], "g string, v double, o int"), "g", "v", "o", 10).count() == 1
assert coreset.nearest(spark.createDataFrame([([1.0],)], "v array<double>"), [[0.0], [2.0]]).first()["cluster"] == 0
print("fine")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "fine" in out.stdout, out.stderr[-2000:]


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + (13).to_bytes(4, "big") + b"IHDR" + w.to_bytes(4, "big") + h.to_bytes(4, "big") + bytes(5)


def test_gates_look_at_every_image(spark, tmp_path):
    from inkgraph.operators import materialize

    (tmp_path / "pngs dir").mkdir()
    for name, content in (("a", png(448, 448)), ("b", png(448, 448)), ("c", png(448, 300)), ("d", b"no image")):
        (tmp_path / f"pngs dir/{name}.png").write_bytes(content)

    def gated(*ids, kept=None, target=1, edge=448):
        rows = spark.createDataFrame([(i, f"pngs dir/{i}.png") for i in ids], "id string, image_path string")
        seen = materialize.with_images(rows, str(tmp_path), str(tmp_path))
        pool, man = materialize.pool_gate(seen, len(ids) if kept is None else kept, 1).first(), materialize.manifest_gate(seen, target, edge).first()
        return (pool["ok"], pool["detail"]), (man["ok"], man["detail"])

    assert gated("a", "b") == ((True, ""), (True, ""))
    assert gated("a", "c") == ((False, "images not square"), (False, "images not 448 pixels"))
    assert gated("a", "x", kept=3)[0] == (False, "rows are not the 3 kept, images missing")
    assert gated("d")[1] == (False, "images not 448 pixels") and gated("a", "a", target=3)[1] == (False, "fewer than 3, ids repeat")
    assert gated("a", edge=224)[1] == (False, "images not 224 pixels")


def test_vectors_for_every_row(spark):
    import numpy as np

    from inkgraph.operators import coreset

    pool = spark.createDataFrame([(0,), (1,), (2,)], "pool_idx long")
    vectors = spark.createDataFrame([(0, [0.1, -2.5]), (2, None), (9, [1.0, 1.0])], "pool_idx long, v array<double>")
    rows = coreset.with_vectors(pool, vectors, 2)
    assert sorted((r["pool_idx"], r["v"], r["missing"]) for r in rows.collect()) == [(0, [0.1, -2.5], False), (1, [0.0, 0.0], True), (2, [0.0, 0.0], True)]
    assert coreset.vectors_gate(rows, 2, 2).first()["ok"] and coreset.vectors_gate(rows, 3, 1).first()["detail"] == "not 3 numbers, more than 1 missing"
    back = rows.withColumn("h", coreset.half("v")).withColumn("w", coreset.from_half("h")).filter("pool_idx = 0").first()
    assert len(back["h"]) == 4 and back["w"] == np.array([0.1, -2.5], "f2").astype(float).tolist()


def test_nearest_equals_all_pairs(spark):
    import random

    from inkgraph.operators import nearby

    rng = random.Random(8)
    place = lambda s: round(rng.choice([rng.uniform(0, s), rng.gauss(s / 2, 1)]), 1)  # noqa: E731  spread, and one dense place
    points = [(d, f"p{k}", k, place(500), place(500)) for d in ("a", "b", None) for k in range(0, 80, 2)] + [("a", "nan", 5, float("nan"), 1.0), ("a", "null", 5, None, 1.0)]
    queries = [(d, k, k, place(700), place(500)) for d in ("a", "b", None, "no points") for k in range(1, 60, 2)] + [("a", 999, 999, None, 0.0)]
    frames = spark.createDataFrame(queries, "doc string, q long, at long, x double, y double"), spark.createDataFrame(points, "doc string, p string, at long, x double, y double")
    for radius, earlier, cell in ((80.0, True, 20.0), (None, False, 1.0), (None, True, 300.0), (10.0, False, 50.0)):
        want = set()
        for d, q, at, x, y in queries:
            near = [((x - u) ** 2 + (y - v) ** 2, k, p) for e, p, k, u, v in points if x is not None and u is not None and u == u and e == d and (k < at or not earlier)]
            near = [n for n in near if radius is None or n[0] < radius**2]
            if near:
                want.add((d, q, min(near)[2]))
        got = nearby.nearest(*frames, cell, radius, earlier).collect()
        assert {(r["doc"], r["q"], r["p"]) for r in got} == want and len(got) == len(want)
    assert nearby.nearest(frames[0], frames[1].filter("false"), 20.0).count() == 0


def test_first_passing_makes_only_the_rows_it_needs(spark):
    rows = spark.range(2000).select((F.col("id") % 1990).alias("k"), "id").unionByName(spark.createDataFrame([(None, 5000)], "k long, id long"))
    for passes, most in (("k % 3 = 1", 11), ("k > 100", 1000), ("k >= 1985", 2001), ("k is null or k = 1989", 2001), ("false", 2001)):
        seen = []
        made = lambda r, p=passes, s=seen: (s.append(r.count()), r.filter(p))[1]
        found = [r["k"] for r in tables.first_passing(rows, "k", 3, made, stretch=10).collect()]
        assert found == [r["k"] for r in tables.first_rows(rows.filter(passes), "k", 3).collect()]
        assert 0 < sum(seen) <= most + 20 and sum(seen) <= 2001
