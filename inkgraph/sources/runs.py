"""Runs that can be taken up again: pinned inputs, a log of finished parts, an error sink and counters that repeat nothing."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .tables import exists

PIN = "folder string, revision string, file string, length long, modified timestamp"
LOG = "part long, fingerprint string, path string, ts double"
ERRORS = "stage string, batch string, row_id string, error_type string, message string"


def listed(spark: SparkSession, folder: str) -> DataFrame:
    """(file, length, modified) of the data files under folder; their contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.col("path").alias("file"), "length", F.col("modificationTime").alias("modified"))


def pin(spark: SparkSession, folder: str, out: str) -> str | None:
    """Records the files under folder as they stand, and returns their revision: a digest of names, lengths and times. None,
    and nothing recorded, if there are none. Reads through `pinned` see these files alone, whatever is added later."""
    if not exists(spark, folder):
        return None
    files = listed(spark, folder)
    each = F.xxhash64("file", "length", F.unix_micros("modified"))
    n, total = files.agg(F.count("*"), F.sum(each.cast("decimal(38,0)"))).first()
    if not n:
        return None
    revision = f"{n}-{int(total) % (1 << 64):016x}"
    files.select(F.lit(folder).alias("folder"), F.lit(revision).alias("revision"), "*").write.mode("overwrite").parquet(out)
    return revision


def pinned(spark: SparkSession, at: str, schema: str | None = None, kind: str = "parquet") -> DataFrame:
    """The rows of a pin's files. A file that is gone, or whose length or time is another one now, stops the read: rows of
    two revisions are never mixed. The list of files is on the driver, as for any scan."""
    wanted = spark.read.schema(PIN).parquet(at)
    folder = wanted.first()["folder"]
    now = listed(spark, folder).select("file", F.struct("length", "modified").alias("now"))
    both = wanted.select("file", F.struct("length", "modified").alias("then")).join(now, "file", "left")
    changed = both.filter(~F.col("then").eqNullSafe(F.col("now"))).orderBy("file").limit(3).collect()
    if changed:
        raise RuntimeError(f"changed since they were pinned: {[r['file'] for r in changed]}")
    reader = spark.read.format(kind).option("basePath", folder)
    return (reader.schema(schema) if schema else reader).load([r["file"] for r in wanted.select("file").collect()])


def fingerprints(rows: DataFrame, part: Column, settings: dict) -> DataFrame:
    """(part, fingerprint): a digest of a part's rows, in any order and with their repeats, and of the settings."""
    whole = F.to_json(F.struct(*(F.col(f"`{c}`").alias(c) for c in rows.columns)), {"ignoreNullFields": "false"})
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), whole).cast("decimal(38,0)")).cast("string")
    found = rows.groupBy(part.cast("long").alias("part")).agg(F.count("*").alias("n"), total(1).alias("a"), total(2).alias("b"))
    return found.select("part", F.sha2(F.concat_ws(":", F.lit(json.dumps(settings, sort_keys=True)), "n", "a", "b"), 256).alias("fingerprint"))


def log_of(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(LOG).json(f"{folder}/log") if exists(spark, f"{folder}/log") else spark.createDataFrame([], LOG)


def resumed(rows: DataFrame, part: Column, step: Callable[[DataFrame], DataFrame], folder: str, settings: dict | None = None) -> DataFrame:
    """step's result for all rows, computing only what folder does not hold yet.

    Rows belong to parts by a column of whole numbers (thousands at most) that step keeps computable: it must not change the
    columns that `part` reads. A part is done if the log names a result for its fingerprint, which covers its rows and the
    settings; changed, added and new rows, and other settings, are computed anew, and parts that are gone are not read. The
    missing parts are computed by one job into a folder of their own and logged after it succeeded, so a run that broke off
    leaves nothing that is read, and finished parts are never computed again. Null parts are one part, -1. One run at a time
    may write a folder."""
    spark, of = rows.sparkSession, F.coalesce(part.cast("long"), F.lit(-1))
    wanted = {r["part"]: r["fingerprint"] for r in fingerprints(rows, of, settings or {}).collect()}  # a row a part
    done = {(r["part"], r["fingerprint"]): r["path"] for r in log_of(spark, folder).orderBy("ts").collect()}
    todo = sorted(p for p, f in wanted.items() if (p, f) not in done)
    schema = step(rows.limit(0)).schema
    if todo:
        path = f"{folder}/data-{uuid.uuid4().hex}"
        result = step(rows.filter(of.isin(todo)))
        result.withColumn("_part", of).write.partitionBy("_part").parquet(path)
        entries = spark.createDataFrame([(p, wanted[p], path) for p in todo], "part long, fingerprint string, path string")
        entries.withColumn("ts", F.unix_micros(F.current_timestamp()) / 1e6).coalesce(1).write.mode("append").json(f"{folder}/log")
        done |= {(p, wanted[p]): path for p in todo}
    paths: dict[str, list[int]] = {}
    for p, f in wanted.items():
        paths.setdefault(done[p, f], []).append(p)
    found = spark.createDataFrame([], schema)
    for path, parts in sorted(paths.items()):
        read = spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in schema)}, _part long").parquet(path)
        found = found.unionByName(read.filter(F.col("_part").isin(parts)).drop("_part"))
    return found


def append_errors(errors: DataFrame, path: str, stage: str, batch: str) -> None:
    """Appends (row_id, error_type, message) of a stage's batch. A batch that is run again replaces its own rows, so retries
    and resumed runs repeat none; others stay."""
    rows = errors.select(F.col("row_id").cast("string").alias("row_id"), "error_type", F.substring("message", 1, 500).alias("message"))
    rows.write.mode("overwrite").json(f"{path}/stage={stage}/batch={batch}")


def errors_of(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the error sink."""
    names = [c.split()[0] for c in ERRORS.split(", ")]
    if not exists(spark, path):
        return spark.createDataFrame([], ERRORS)
    return spark.read.schema("row_id string, error_type string, message string, stage string, batch string").json(path).select(*names)


def counted(rows: DataFrame, reason: str, known: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """rows unchanged, and counters of what passes: scanned, kept and one for each known reason, filled by the first action
    on the rows in the same pass over the data; any other reason is counted as `other`."""
    seen = Observation(f"counted-{uuid.uuid4().hex}")
    r = F.col(reason)
    named = [F.count_if(r == k).alias(k) for k in known]
    return rows.observe(seen, F.count("*").alias("scanned"), F.count_if(r.isNull()).alias("kept"), *named, F.count_if(r.isNotNull() & ~r.isin(*known)).alias("other")), seen
