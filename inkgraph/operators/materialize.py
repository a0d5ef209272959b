"""From a selection to a training set: pool and vectors joined, near repeats replaced, valid rows taken until a target."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import native
from ..functions.markup import with_report
from ..sources.tables import asset_path, assets, plain_path
from .analysis import BUCKETS, gate
from .funnel import near_dedup


def aligned(pool: DataFrame, vectors: DataFrame, key: str = "pool_idx") -> DataFrame:
    """Pool rows with their vectors; aligned_gate says whether every row has exactly one."""
    return pool.join(vectors, key)


def aligned_gate(pool: DataFrame, vectors: DataFrame, key: str = "pool_idx") -> DataFrame:
    """One row (stage, ok, detail): as many vectors as rows, none without its row and no row without its vector."""
    sides = pool.select(key).groupBy(key).agg(F.count("*").alias("a")).join(vectors.select(key).groupBy(key).agg(F.count("*").alias("b")), key, "full")
    n = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return sides.agg(*gate("align", (n("a") > 0, "empty pool"), (n("a") == n("b"), "rows"), (F.count_if(F.coalesce("a", F.lit(0)) != F.coalesce("b", F.lit(0))) == 0, "keys")))


def selected(pool: DataFrame, picks: DataFrame, key: str = "pool_idx", other: str = "sha256") -> DataFrame:
    """Pool rows of a selection, by index if any pick has one, else by the other key."""
    indexed = picks.filter(F.col(key).isNotNull()).select(key)
    by_other = picks.select(other).join(indexed.limit(1).select(F.lit(True).alias("_any")), F.lit(True), "left_anti")
    return pool.join(indexed, key, "left_semi").unionByName(pool.join(by_other, other, "left_semi").select(*pool.columns))


def shuffled(key: Column, seed: int) -> Column:
    """A seeded order that any engine repeats."""
    return F.md5(F.concat_ws(":", F.lit(seed), key))


def backfilled(pool: DataFrame, picks: DataFrame, target: int, seed: int = 42, threshold: int = 3, prefix: int = 4) -> DataFrame:
    """(pool_idx, reason, place): the picks (pool_idx, reason, rank) in order, then the rest of the pool (pool_idx, phash) in
    seeded order as backfill, less near repeats of earlier rows, cut to target."""
    rest = shuffled(F.col("pool_idx").cast("string"), seed)
    rows = pool.select("pool_idx", "phash").join(picks.select("pool_idx", "reason", "rank"), "pool_idx", "left")
    order = F.struct(F.col("rank").isNull().alias("late"), F.coalesce("rank", F.lit(0)).alias("rank"), F.when(F.col("rank").isNull(), rest).alias("h"), "pool_idx")
    kept = near_dedup(rows.withColumn("order", F.to_json(F.struct(order["late"].cast("int").alias("a"), F.lpad(order["rank"].cast("string"), 12, "0").alias("b"), F.coalesce(order["h"], F.lit("")).alias("c"), F.lpad("pool_idx", 19, "0").alias("d")))), "phash", "order", threshold, prefix)
    first = kept.filter("kept").orderBy("order").limit(target)
    return first.select("pool_idx", F.coalesce("reason", F.lit("backfill")).alias("reason"), F.row_number().over(Window.orderBy("order")).alias("place"))  # target rows at most


def materialized(pool: DataFrame, picks: DataFrame, target: int, seed: int = 42, text: str = "svg") -> tuple[DataFrame, DataFrame]:
    """The manifest and the failures: picks in order, then the rest in seeded order (reason unknown), each valid row taken
    until target. Rows: pool_idx, id, text; picks: pool_idx, reason, place."""
    order = F.concat(F.lpad(F.coalesce("place", F.lit(10**9)).cast("string"), 12, "0"), F.when(F.col("place").isNull(), shuffled(F.col("pool_idx").cast("string"), seed)).otherwise(""), F.lpad(F.col("pool_idx").cast("string"), 19, "0"))
    rows = with_report(pool.join(picks.select("pool_idx", "reason", "place").hint("merge"), "pool_idx", "left").withColumn("_order", order), text)
    row_id = F.substring(F.concat(F.lit("broad_"), "id"), 1, 64)
    good = rows.filter("report.ok").orderBy("_order").limit(target)
    manifest = good.select(row_id.alias("id"), "report.sha256", native.bucket(F.col("report.normalized")).alias("bucket"), "report.n_drawable", "report.n_elements", F.coalesce("reason", F.lit("unknown")).alias("selection_reason"), F.col("pool_idx").alias("cluster_pool_idx"),
                           F.concat(F.lit("svgs/"), row_id, F.lit(".svg")).alias("svg_path"), F.concat(F.lit("pngs/"), row_id, F.lit(".png")).alias("image_path"))
    bad = rows.filter("not report.ok").select(F.lit("select").alias("stage"), row_id.alias("row_id"), "report.sha256", F.lit("validate").alias("error_type"), native.cut(F.concat_ws("; ", "report.errors"), 500).alias("message"))
    return manifest, bad


def subsample(pool: DataFrame, picks: DataFrame, n: int = 10_000, seed: int = 42, key: str = "pool_idx") -> DataFrame:
    """At most n pool rows in seeded order, and every selected one: (key, selected)."""
    some = pool.select(key).orderBy(shuffled(F.col(key).cast("string"), seed), key).limit(n)
    both = some.union(pool.join(picks.select(key), key, "left_semi").select(key)).distinct()
    return both.join(picks.select(key).distinct().withColumn("selected", F.lit(True)), key, "left").select(key, F.coalesce("selected", F.lit(False)).alias("selected"))


def thumbnails(picked: DataFrame, n: int = 12, key: str = "pool_idx", col: str = "bucket") -> DataFrame:
    """(key, place): the first row of each known bucket in their order, then the others by key, n in all."""
    known = F.array_position(F.array(*map(F.lit, BUCKETS)), F.col(col))
    first = picked.filter(known > 0).groupBy(col).agg(F.min(key).alias(key)).select(key, known.cast("long").alias("at"))
    rows = picked.select(key).join(first, key, "left").select(key, F.coalesce("at", F.lit(len(BUCKETS) + 1)).alias("at")).orderBy("at", key).limit(n)
    return rows.select(key, F.row_number().over(Window.orderBy("at", key)).alias("place"))  # n rows at most


def preview(rows: DataFrame, n: int, scan_cap: int, order: str = "row_pos", text: str = "svg", max_chars: int = 40_000) -> DataFrame:
    """The first n usable rows among the first scan_cap: parsed, two drawables at least, not too long."""
    seen = with_report(rows.orderBy(order).limit(scan_cap).withColumn(text, F.coalesce(native.blob_or_raw(F.col(text)), F.lit(""))), text)
    usable = seen.filter("report.parse_ok and report.normalized is not null and report.n_drawable >= 2").filter(F.length("report.normalized") <= max_chars)
    return usable.withColumn("bucket", native.bucket(F.col("report.normalized"))).orderBy(order).limit(n)


def test_hashes(rows: DataFrame, row_id: str = "filename", text: str = "svg") -> DataFrame:
    """(id, sha256) of held-out rows that parse, for the leak filter."""
    seen = with_report(rows.select(F.col(row_id).alias("id"), F.coalesce(native.blob_or_raw(F.col(text)), F.lit("")).alias("blob")), "blob")
    return seen.filter("report.sha256 is not null").select("id", "report.sha256")


def run_gates(spark: SparkSession, checks: dict[str, DataFrame], stage: str = "all") -> DataFrame:
    """(stage, ok, detail) of one gate, or of all of them with a last row `all` that holds if each does."""
    if stage != "all" and stage not in checks:
        return spark.range(1).select(F.lit(stage).alias("stage"), F.lit(False).alias("ok"), F.lit("unknown stage").alias("detail"))
    if stage != "all":
        return checks[stage]
    out = None
    for one in checks.values():
        out = one if out is None else out.unionByName(one)
    bad = F.array_join(F.array_sort(F.collect_list(F.when(~F.col("ok"), F.col("stage")))), ", ")
    return out.unionByName(out.agg(F.lit("all").alias("stage"), F.min("ok").alias("ok"), bad.alias("detail")).select("stage", "ok", "detail"))


def least_rows(stage: str, rows: DataFrame, least: int) -> DataFrame:
    """A gate on a stage's number of rows; an empty stage fails by name."""
    return rows.agg(*gate(stage, (F.count("*") > 0, "empty"), (F.count("*") >= least, f"fewer than {least}")))


def with_images(rows: DataFrame, folder: str, root: str, path: str = "image_path") -> DataFrame:
    """rows with `image_there` and `image` (width, height; null if it is no PNG) of the file at path, under root if relative.
    The files' first bytes are read where they lie; a path that several rows name is looked up for each."""
    files = assets(rows.sparkSession, folder, ("png",)).select(plain_path(F.col("path")).alias("_at"), native.png_size(F.col("content")).alias("image"), F.lit(True).alias("_there"))
    joined = rows.withColumn("_at", plain_path(asset_path(F.col(path), root))).join(files, "_at", "left")
    return joined.select(*rows.columns, F.coalesce("_there", F.lit(False)).alias("image_there"), "image")


def pool_gate(pool: DataFrame, kept: int, least: int, stage: str = "scan") -> DataFrame:
    """A gate on a pool with its images: enough rows, as many as the scan kept, every image there and square."""
    return pool.agg(*gate(stage, (F.count("*") > 0, "empty"), (F.count("*") >= least, f"fewer than {least}"), (F.count("*") == kept, f"rows are not the {kept} kept"), *_images(F.col("image.width") == F.col("image.height"), "not square")))


def manifest_gate(manifest: DataFrame, target: int, edge: int, stage: str = "select") -> DataFrame:
    """A gate on a manifest with its images: the rows wanted, no id twice, every image there and of the edge's size."""
    once = F.count("*") == F.count_distinct("id")
    return manifest.agg(*gate(stage, (F.count("*") >= target, f"fewer than {target}"), (once, "ids repeat"), *_images((F.col("image.width") == edge) & (F.col("image.height") == edge), f"not {edge} pixels")))


def _images(right: Column, wrong: str) -> list[tuple[Column, str]]:
    return [(F.count_if(~F.col("image_there")) == 0, "images missing"), (F.count_if(F.col("image_there") & ~F.coalesce(right, F.lit(False))) == 0, f"images {wrong}")]
