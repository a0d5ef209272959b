"""Shared pieces of the training-data operators: table reading, lineage cuts, word rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import by_value, shared_root  # noqa: F401  by_value serves the operators

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A word character is a digit, a Latin letter or anything beyond ASCII.
NON_WORD = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
NON_SPACE = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only; every other code point stays."""
    return F.translate(col, UPPER, LOWER)


def key_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """What tells documents apart, null and repeated ids included: rows equal in it have equal results."""
    return F.struct(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_key"))


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share; only a local session may do without one."""
    return shared_root(spark)


class Scratch:
    """Written tables that cut lineage: they survive a lost executor and are read again, never recomputed."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def cut(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Bits of a filter of ids, in maps of 32,768: 8 MB at most, however many ids there are.
FILTER_BITS = 1 << 26


def maybe_in(df: DataFrame, of: Column, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """df with a boolean column `maybe`: false only where the value of `of` (a long) is nowhere in the one column of ids.

    One hashed bit per id, broadcast as at most 2,048 maps of 4 KB. What it lets through has still to be joined; what it does
    not need not be moved. A filter that very many ids fill lets more through, and the result after the join is the same."""
    place = lambda c: F.pmod(F.xxhash64(F.lit(11), c), F.lit(FILTER_BITS)) + 1
    bit = place(F.col(ids.columns[0]))
    maps = scratch.cut(ids.select(bit.alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits")), name)
    at = F.col("at")
    byte = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.pmod(at, F.lit(8)).cast("int"))) != 0, F.lit(False))
    packed = df.select(F.struct("*").alias("row"), F.bitmap_bucket_number(place(of)).alias("map"), F.bitmap_bit_position(place(of)).alias("at"))
    return packed.join(F.broadcast(maps), "map", "left").select("row", is_set.alias("maybe"))


def without(docs: DataFrame, key: Column, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of docs, packed in `row`, whose key (a struct) is not in the written column `key` of gone.

    Only rows that the filter of ids lets through take part in the join."""
    digest = lambda c: F.xxhash64(F.lit(5), c)
    flagged = maybe_in(docs.select(F.struct("*").alias("row"), key.alias("key")), digest(F.col("key")), gone.select(digest(F.col("key")).alias("id")), scratch, "gone-maps")
    doubt = flagged.filter("maybe").select("row.row", "row.key").join(gone, "key", "left_anti").select("row")
    return flagged.filter("not maybe").select("row.row").union(doubt)


def numbered(docs: DataFrame, key: Column, scratch: Scratch) -> DataFrame:
    """(row, key, copy): the packed rows of docs, those of one key numbered from 0 in copy.

    Rows whose key is their own are not moved unless Spark has to sort for the join. The others are numbered within the
    part of the input they come from and by the rows of its earlier parts, so a key with very many rows is split."""
    keyed = docs.select(F.struct("*").alias("row"), key.alias("key"))
    again = scratch.cut(docs.select(key.alias("key")).groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "again")
    first = F.lit(0).cast("long").alias("copy")
    if again.isEmpty():
        return keyed.select("row", "key", first)
    twice = scratch.cut(keyed.withColumn("part", F.spark_partition_id()).join(again, "key"), "twice")
    here = Window.partitionBy("key", "part").orderBy(F.to_json(F.struct("row")))
    before = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = twice.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    late = twice.withColumn("at", F.row_number().over(here)).join(starts, ["key", "part"]).select("row", "key", (F.col("start") + F.col("at") - 1).alias("copy"))
    return keyed.join(again, "key", "left_anti").select("row", "key", first).unionByName(late)


def check_columns(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; there are {df.columns}")
