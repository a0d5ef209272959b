"""A corpus pipeline of five stages: quality, near-duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and returns a DataFrame; run() writes each
stage as Parquet in the folder that all executors share and reads it again for the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from inkgraph.llm import decontamination, mixing, quality, sharding, simhash
from inkgraph.llm.common import Scratch, read


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ordinal classifier grades good; it learns from the ratings of these documents.

    Null and empty texts are graded as empty ones; repeated rows are graded alike; an empty table or one without ratings
    is graded by the prior, which keeps nothing; columns of any name pass through."""
    model = quality.train(docs, read(spark, sf_dir, "labels"))
    return quality.graded(docs, model).filter("kept").select("row.*")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: SimHash within two bits, or five-word shingles alike by 4/5.

    Null, empty and white texts are one component; of equal rows one stays; a null doc_id stays only where its component
    has no other; empty tables stay empty; columns of any name pass through."""
    return simhash.keep_one(docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside any window of a benchmark item.

    Null and empty texts have no words and stay, as do all documents if the benchmark is empty; repeated rows are judged
    alike; columns of any name pass through."""
    return decontamination.clean(docs, read(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them: not at all, once, or up to three times.

    Null texts have no words and are taken as the place of their row says; a null source is a source of its own; equal rows
    are taken each by its own place; empty tables stay empty; columns of any name pass through."""
    return mixing.apply_mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row's shard and place in it: null doc_ids and null texts, repeated rows and empty tables included."""
    return sharding.assign(docs)


STAGES = [("quality", good_quality), ("near_dedup", one_of_each), ("decontamination", without_benchmarks), ("mixing", mixed), ("sharding", sharded)]
#: The classifier is trained and SimHash needs XXH64: SQL expresses neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch, docs = Scratch(spark, "pipeline"), read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.cut(stage(spark, docs, sf_dir), name)
    return docs
