"""Evaluation end to end: gold graphs resolved, predictions read, one score record a row, means, controls and gates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import native
from ..functions.markup import SCENE, embedded_scene, with_judgement
from ..sources.tables import PREDICTIONS, asset_path, by_value, json_lines, markup_files, plain_path, sidecars, spread, written
from .analysis import gate
from .evaluate import bootstrap_counts, gold_with_predictions, in_split, safe_mean
from .graphs import entity_keys, from_json, relation_keys, set_scores, spatial_of

by_value(__name__)

GOLD = "id string, split string, svg string, svg_path string, scene_graph string, scene_graph_path string"
METRICS = ("validity", "entity_f1", "relation_f1", "spatial")
PROMPT = 'Reconstruct the diagram as a single canonical SVG. Use viewBox="0 0 512 512". Output only SVG markup.'


def messages(image: Column, svg: Column, prompt: str = PROMPT) -> Column:
    """The two turns of a training example; the user's content is an image reference and the prompt."""
    part = lambda kind, text=None, ref=None: F.struct(F.lit(kind).alias("type"), (F.lit(None).cast("string") if text is None else text).alias("text"), (F.lit(None).cast("string") if ref is None else ref).alias("image"))
    return F.array(F.struct(F.lit("user").alias("role"), F.array(part("image", ref=image), part("text", F.lit(prompt))).alias("content")), F.struct(F.lit("assistant").alias("role"), F.array(part("text", svg)).alias("content")))


def resolve_gold(rows: DataFrame, sidecars: DataFrame | None = None, root: str = "") -> DataFrame:
    """rows (scene_graph JSON, scene_graph_path, svg) with `gold`: the inline graph, else the sidecar's, else what the markup
    carries. sidecars: (path, scene); both sides' paths are brought to one form, those of rows under root if relative."""
    @F.udf(SCENE, useArrow=True)
    def carried(x):
        found = embedded_scene(x)
        return None if found is None else found | {"error": None}

    plain = lambda c: F.when(c.isNotNull(), F.struct(*(c[k].alias(k) for k in ("grammar", "entities", "relations", "meta"))))
    rows = rows.withColumn("_inline", from_json(F.col("scene_graph")))
    if sidecars is None:
        rows = rows.withColumn("_side", F.lit(None).cast(rows.schema["_inline"].dataType))
    else:
        none = F.concat(F.lit("\0"), F.monotonically_increasing_id())  # a path of its own, so that rows without one are not one group
        rows = rows.withColumn("_at", F.coalesce(under(F.col("scene_graph_path"), root), none))
        sides = sidecars.select(plain_path(F.col("path")).alias("_at"), F.col("scene").alias("_side"))
        rows = spread(rows, "_at").join(spread(sides, "_at").hint("merge"), "_at", "left").drop("_at")
    known = F.coalesce("_inline", "_side")
    markup = F.when(known.isNull(), F.col("svg"))  # parsed only where nothing else is known
    rows = rows.withColumn("_carried", carried.asNondeterministic()(markup))
    return rows.withColumn("gold", F.coalesce(known, plain(F.col("_carried")))).drop("_inline", "_side", "_carried")


def under(path: Column, root: str) -> Column:
    """A manifest's path in the form that readers of files give, under root if it is relative."""
    return plain_path(asset_path(path, root) if root else path)


def score(gold: DataFrame, predictions: DataFrame, split: str = "all", sidecars: DataFrame | None = None, root: str = "") -> DataFrame:
    """One record per gold row with a prediction: parse_ok, validity, n_drawable, errors, entity_f1, relation_f1, spatial.

    gold: id, pos, split, svg, scene_graph, scene_graph_path; predictions: id, pos, pred_text. Of repeated ids the last
    counts. Graph scores are null where no gold graph is found. gold_ok: the gold markup parses; null without markup."""
    both = gold_with_predictions(gold.filter(in_split("split", split)), predictions)
    both = resolve_gold(both, sidecars, root).withColumn("pred_text", F.coalesce("pred_text", F.lit("")))
    both = with_judgement(both.withColumn("blob", native.blob_or_raw(F.col("pred_text"))), "pred_text", "blob", "svg").withColumn("graph", F.col("id"))
    there, o = F.col("gold").isNotNull(), F.col("own")
    own = (o["parse_ok"].alias("parse_ok"), o["ok"].cast("double").alias("validity"), o["n_drawable"].alias("n_drawable"), o["errors"].alias("errors"), "gold_ok")
    keys = (F.when(there, of(F.col(c))).alias(f"{c}_{name}") for name, of in (("entities", entity_keys), ("relations", relation_keys)) for c in ("predicted", "gold"))
    keyed = both.select("id", "graph", *own, F.col("gold.grammar").alias("grammar"), *keys)
    f1 = lambda name: F.when(F.col(f"gold_{name}").isNotNull(), set_scores(F.col(f"predicted_{name}"), F.col(f"gold_{name}"))["f1"])
    # parsed and scored once; what is written, joined and sorted below has keys only, no markup and no scenes
    both = written(keyed.withColumns({"entity_f1": f1("entities"), "relation_f1": f1("relations")}).drop("predicted_entities", "gold_entities"), "scored")
    found = spatial_of(both, "predicted_relations", "gold_relations", "grammar")
    found = found.select("id", "parse_ok", "validity", "n_drawable", "errors", "gold_ok", "entity_f1", "relation_f1", "spatial")
    return written(found, "scores")  # reports and controls read it several times


def placed(lines: DataFrame) -> DataFrame:
    """Rows read from files with `pos`, which grows along each file: so that of repeated ids the last line counts."""
    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    return lines.select("*", at.alias("pos"))


def evaluate_files(spark: SparkSession, manifest: str, predictions: str, root: str, split: str = "all") -> tuple[DataFrame, DataFrame]:
    """The records of score() for files on disk, and the prediction lines that could not be read.

    manifest: JSON lines, trusted, whose graphs stand in the line or in sidecars and whose markup stands in the line or in
    files, by absolute paths or paths under root. predictions: JSON lines (id, pred_text or svg); bad lines, and lines
    without an id, are kept apart; blank lines are skipped. Only files of the sidecars' and the markup's kind are opened."""
    gold = placed(json_lines(spark, manifest, GOLD))
    if not gold.filter("svg is null and svg_path is not null").isEmpty():
        files = markup_files(spark, root).withColumnsRenamed({"path": "_at", "svg": "_svg"})
        gold = gold.withColumn("_at", F.when(F.col("svg").isNull(), under(F.col("svg_path"), root))).join(files, "_at", "left")
        gold = gold.withColumn("svg", F.coalesce("svg", "_svg")).drop("_at", "_svg")
    lines = written(placed(json_lines(spark, predictions, f"{PREDICTIONS}, svg string", trusted=False)), "predictions")
    read = lines.filter("_corrupt_record is null and id is not null").select("id", "pos", F.coalesce(F.nullif("pred_text", F.lit("")), "svg").alias("pred_text"))
    bad = lines.filter("_corrupt_record is not null or id is null").select(F.coalesce("_corrupt_record", F.lit("no id")).alias("line"))
    inline = gold.filter("scene_graph is null and scene_graph_path is not null").isEmpty()
    return score(gold, read, split, None if inline else sidecars(spark, root), root), bad


def report(scores: DataFrame, n_boot: int = 1000, seed: int = 0) -> DataFrame:
    """One row: the number of records, each metric's mean, and the ends of its bootstrap interval (metric_lo, metric_hi)."""
    row = aggregate(scores)
    long = scores.select("id", F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS))).alias("m")).select("id", "m.*")
    ends = {r["metric"]: r for r in bootstrap_counts(long, "metric", "value", "id", n_boot, seed=seed).collect()}  # a row a metric
    bound = lambda m, k: F.lit(ends[m][k] if m in ends else None).cast("double").alias(f"{m}_{k}")
    return row.select("*", *(bound(m, k) for m in METRICS for k in ("lo", "hi")))


def aggregate(scores: DataFrame) -> DataFrame:
    """One row: the number of records and the mean of each metric without nulls and NaNs."""
    return scores.agg(F.count("*").alias("n"), *(safe_mean(F.col(m)).alias(m) for m in METRICS))


def recovery_gate(scores: DataFrame, least: float = 0.999) -> DataFrame:
    """(stage, ok, detail): every record recovers its gold graph by all three measures."""
    bad = lambda m: F.count_if(F.coalesce(F.col(m) < least, F.lit(True)))
    return scores.agg(*gate("gold_recovery", (F.count("*") > 0, "empty"), *((bad(m) == 0, m) for m in METRICS[1:])))


def controls(reports: dict[str, DataFrame], metric: str = "relation_f1", least: float = 0.05) -> DataFrame:
    """One row from the reports (one row of aggregates each) of named controls: each metric as name_metric, and warning,
    whether correct and shuffled lie closer than least. Reports are one row by construction."""
    wide = [r.select(*(F.col(m).alias(f"{name}_{m}") for m in METRICS)) for name, r in reports.items()]
    row = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), wide)
    return row.withColumn("warning", F.abs(F.col(f"correct_{metric}") - F.col(f"shuffled_{metric}")) < least)


def checkpoint_gaps(rows: DataFrame, inside: str = "id_structure", outside: str = "ood_structure", key: str = "run") -> DataFrame:
    """(key, step, gap) per checkpoint, to the shorter of both series."""
    n = F.least(F.size(inside), F.size(outside))
    pairs = F.arrays_zip(F.slice(inside, F.lit(1), n).alias("a"), F.slice(outside, F.lit(1), n).alias("b"))
    return rows.select(key, F.posexplode(pairs).alias("step", "p")).select(key, "step", (F.col("p.a").cast("double") - F.col("p.b").cast("double")).alias("gap"))
