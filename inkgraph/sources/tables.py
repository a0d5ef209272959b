"""Readers and writers with fixed schemas: tables, JSON lines, sidecars, assets; writers replace what was there."""

from __future__ import annotations

import atexit
import json
import shutil
import sys
import tempfile
import time
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

X = TypeVar("X")

HASHES = "id string, sha256 string"
PREDICTIONS = "id string, pred_text string, protocol string, _corrupt_record string"
MANIFEST = "id string, sha256 string, bucket string, n_drawable int, n_elements int, difficulty double, selection_reason string, cluster_pool_idx long, svg_path string, image_path string, source string, svg string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str, trusted: bool = True) -> DataFrame:
    """JSON lines of a fixed schema, blank lines skipped. Trusted inputs fail on a bad line, others keep it apart."""
    return spark.read.schema(schema).option("mode", "FAILFAST" if trusted else "PERMISSIVE").json(path)


def by_value(module: str) -> None:
    """Ship this module's functions inside the task, so executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only in local mode, where all run on one machine, is a
    temporary folder made if the session names none."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="inkgraph-")
        spark.conf.set("spark.checkpoint.dir", found)
        atexit.register(shutil.rmtree, found, True)
    return found.rstrip("/")


def written(rows: DataFrame, label: str, by: str | None = None) -> DataFrame:
    """rows written in the folder that all executors share and read again, so that what is dear is done once and survives a
    lost executor; in a folder for each value of `by` if that is given, so a filter on it reads these alone."""
    path = f"{shared_root(rows.sparkSession)}/{label}-{uuid.uuid4().hex}"
    (rows.write.partitionBy(by) if by else rows.write).parquet(path)
    schema = rows.select(*(c for c in rows.columns if c != by), *([by] if by else [])).schema
    return rows.sparkSession.read.schema(schema).parquet(path)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """rows dealt by keys over as many tasks as shuffles have, or the session has cores if they are more. Small files of many
    rows are read by one task or a few, which is not enough where each row is parsed. The number is given, so Spark does not
    merge the tasks again, and joins and groups by the keys need no further shuffle. The other side of a join is not merged
    either: rows that are much alike are many times larger in a task than in the shuffle's bytes, by which Spark merges."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def hash_set(spark: SparkSession, path: str) -> DataFrame:
    """Held-out hashes; a missing file is an empty set."""
    return json_lines(spark, path, HASHES) if exists(spark, path) else spark.createDataFrame([], HASHES)


def first_rows(rows: DataFrame, order: str, n: int | None) -> DataFrame:
    """A row cap by order; 0 and None are no cap."""
    return rows.orderBy(order).limit(n) if n else rows


def first_passing(rows: DataFrame, order: str, n: int, made: Callable[[DataFrame], DataFrame], stretch: int = 1024) -> DataFrame:
    """The first n rows by order of made(rows), where made is dear and extends or drops each row for itself.

    Rows come by order in stretches, each longer than all before it, until n have passed or none are left: made sees a row
    once at most, and all of them if fewer than n pass. Rows equal in order are in one stretch, nulls in the first."""
    low, found = None, None
    while True:
        left = rows if low is None else rows.filter(F.col(order) > low)
        high = left.select(order).orderBy(order).limit(stretch).agg(F.max(order)).first()[0]
        here = left if high is None else left.filter(F.col(order).isNull() | (F.col(order) <= high))
        passed = written(first_rows(made(here), order, n), "passing")
        found = passed if found is None else found.union(passed)
        if high is None or found.count() >= n:
            return first_rows(found, order, n)
        low, stretch = high, stretch * 8


def plain_path(path: Column) -> Column:
    """One form of a path, however it was given: no file scheme, no doubled or leading ./ steps, no percent escapes.

    Spark names files by URI and manifests by plain paths; both sides of a join by path need this form."""
    bare = F.regexp_replace(F.regexp_replace(path, r"^file:/+", "/"), r"(?<=[^:/])/(\./)*/*", "/")
    local = F.url_decode(F.replace(F.regexp_replace(bare, r"^\./+", ""), F.lit("+"), F.lit("%2B")))
    return F.when(path.rlike("^file:/"), local).otherwise(F.regexp_replace(bare, r"^\./+", ""))


def sidecars(spark: SparkSession, path: str) -> DataFrame:
    """(path, scene): one scene graph per JSON file under path, by its plain path."""
    from ..operators.graphs import from_json

    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    return whole.select(plain_path(F.col("_metadata.file_path")).alias("path"), from_json(F.col("value")).alias("scene"))


def markup_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, svg): the whole text of each SVG file under path, by its plain path."""
    whole = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.svg")
    return whole.select(plain_path(F.col("_metadata.file_path")).alias("path"), F.col("value").alias("svg"))


def assets(spark: SparkSession, folder: str, kinds: tuple[str, ...]) -> DataFrame:
    """(stem, ext, path, content) of files with the given extensions."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    parts = files.select("path", "content", F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("stem"), F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"))
    return parts.filter(F.col("ext").isin(*kinds))


def with_sidecar(main: DataFrame, sides: DataFrame, priority: tuple[str, ...], name: str) -> DataFrame:
    """main joined by stem to the side file whose extension comes first in priority; none gives null."""
    rank = F.array_position(F.array(*map(F.lit, priority)), F.col("ext"))
    best = sides.filter(rank > 0).groupBy("stem").agg(F.min_by(F.struct("path", "content"), F.struct(rank, "path")).alias(name))
    return main.join(best, "stem", "left")


def write_lines(rows: DataFrame, path: str, by: str | None = None) -> None:
    w = rows.write.mode("overwrite")
    (w.partitionBy(by) if by else w).json(path)


def write_pool(rows: DataFrame, path: str, transient: tuple[str, ...] = ("normalized", "report", "blob")) -> None:
    rows.drop(*transient).write.mode("overwrite").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6).write.mode("append").json(path)


def resume(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no result yet."""
    return rows.join(done.select(key), key, "left_anti")


def retry(f: Callable[[], X], attempts: int = 3, base_delay: float = 2.0) -> X:
    """f's result; a call that fails is made again after base_delay, then twice that, and so on. For catalog calls of the
    driver only: Spark itself repeats tasks."""
    for k in range(attempts):
        try:
            return f()
        except Exception as e:  # noqa: BLE001  any failure of a remote call may pass
            if k == attempts - 1:
                raise RuntimeError(f"failed after {attempts} attempts: {e}") from e
            time.sleep(base_delay * 2**k)
    raise ValueError("attempts must be positive")


def pin(spark: SparkSession, path: str, out: str) -> str | None:
    """Records the files under path and returns their revision; see runs.pin, and runs.pinned for reads bound to it."""
    from .runs import pin as pin_files

    return pin_files(spark, path, out)


def ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.select(key)


def write_report(row: DataFrame, path: str) -> None:
    """A report of one row as JSON."""
    row.coalesce(1).write.mode("overwrite").json(path)


def write_splits(rows: DataFrame, path: str, pilot: bool = False) -> None:
    """A manifest per split; markup stays in the rows of a pilot only."""
    write_lines(rows if pilot else rows.drop("svg"), path, by="split")


def export_files(rows: DataFrame, folder: str, name: Column, content: Column, ext: str = "svg") -> None:
    """One row per file name as (name, content) under its partition of the name's first two digits. Names come from hashes,
    since ids may repeat; the payload stays in a table that readers of single files can query by name."""
    keyed = rows.select(F.concat(name, F.lit(f".{ext}")).alias("name"), content.alias("content"), F.substring(name, 1, 2).alias("part"))
    keyed.dropDuplicates(["name"]).write.mode("overwrite").partitionBy("part").parquet(folder)


def asset_path(path: Column, root: str) -> Column:
    """A path as it is if absolute or with a scheme, else under root."""
    return F.when(path.rlike(r"^(/|[a-z][a-z0-9+.-]*:)"), path).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), path))


def selection(spark: SparkSession, folder: str) -> DataFrame:
    """The picks of a run: the full manifest, else the pilot's, else none."""
    for name in ("train_manifest.jsonl", "candidates_pilot.jsonl"):
        if exists(spark, f"{folder}/{name}"):
            return json_lines(spark, f"{folder}/{name}", MANIFEST).withColumnRenamed("cluster_pool_idx", "pool_idx")
    return spark.createDataFrame([], MANIFEST).withColumnRenamed("cluster_pool_idx", "pool_idx")


def triplet_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per image of a directory tree: id, image_path, scene_graph from the sibling triplet file whose extension
    comes first (txt, triples, triplet), source, and code_path of the first of mmd, dot, puml."""
    from ..functions.native import triplets
    from ..operators.graphs import from_triplets

    names = assets(spark, folder, ("png", "txt", "triples", "triplet", "mmd", "dot", "puml")).withColumn("stem", F.regexp_replace("path", r"\.[^./]+$", ""))
    both = with_sidecar(names.filter("ext = 'png'").select("stem", "path"), names, ("txt", "triples", "triplet"), "t")
    both = with_sidecar(both, names, ("mmd", "dot", "puml"), "c")
    text = F.coalesce(F.col("t.content").cast("string"), F.lit(""))
    return both.select(F.regexp_extract("stem", r"([^/]+)$", 1).alias("id"), F.col("path").alias("image_path"), from_triplets(triplets(text)).alias("scene_graph"), F.lit("flowgen").alias("source"), F.col("c.path").alias("code_path"))


def curve(spark: SparkSession, path: str) -> DataFrame:
    """Checkpoint curves of a JSON file: run (its path) and arrays pcts, syntax, structure, id_structure, ood_structure."""
    names = ("pcts", "syntax", "structure", "id_structure", "ood_structure")
    read = spark.read.schema(", ".join(f"{n} array<double>" for n in names)).option("multiLine", "true").json(path)
    return read.select(F.col("_metadata.file_path").alias("run"), *names)


def config(text: str, needed: tuple[str, ...] = ("model_id",)) -> dict:
    """A driver-side run configuration from YAML if its parser is installed, else JSON. If only base checkpoints are
    wanted (use_base_not_it), an instruction-tuned one is refused."""
    try:
        from yaml import safe_load as load
    except ImportError:
        load = json.loads
    found = load(text)
    if missing := [k for k in needed if k not in found]:
        raise ValueError(f"missing settings {missing}")
    if found.get("use_base_not_it") and str(found["model_id"]).endswith("-it"):
        raise ValueError("this checkpoint is instruction-tuned; only base ones are wanted")
    return found
