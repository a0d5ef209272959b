"""Operator 7, SimHash near-duplicates by anchor points of a covering code.

The anchors are the codewords of the perfect (63, 57) Hamming code on the low 63 bits, with the top bit kept: every
fingerprint lies within covering radius 1 of exactly one anchor. Two fingerprints within 2 bits have a midpoint within 1
bit of both, so each is replicated to the anchors within covering radius + half the threshold (32 on average, not the 652
within radius + threshold), and they are compared at their midpoints inside the anchor they share: 65 fingerprints at
most lie within one bit of a midpoint, however many near copies there are, so no anchor compares all its pairs."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, by_value, check_columns, key_of, numbered, read, without
from .graph import components
from .near import near_links

by_value(__name__)
SHINGLE, SEED, MAX_DISTANCE = 3, 42, 2


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The unsigned 64-bit SimHash of a whole text; 0 if it has no words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8").translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    first = [0, *(ends[: n - 1] + 1).tolist()]
    last = ends[len(words) - n :].tolist()
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], seed) for a, b in zip(first, last, strict=True)], dtype=np.uint64)
    # eight counters share a word, one byte each; a byte holds 255 hashes
    lanes, count = np.uint64(0x0101010101010101), np.zeros((8, 8), dtype=np.int64)
    for at in range(0, n, 255):
        block = h[at : at + 255]
        for bit in range(8):
            count[:, bit] += ((block >> np.uint64(bit)) & lanes).sum(dtype=np.uint64).reshape(1).view(np.uint8)
    return sum(1 << (8 * byte + bit) for byte in range(8) for bit in range(8) if 2 * count[byte, bit] > n)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) for every row, fp as a signed long. Texts pass through Arrow in batches and are never
    gathered; text_key is a hash of the text and tells rows with one doc_id apart."""
    check_columns(docs, "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = [_signed(fingerprint(t.as_py())) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps, pa.int64())], names=["doc_id", "text_key", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text").mapInArrow(run, f"doc_id {kind}, text_key long, fp long")


def _syndrome(x: Column) -> Column:
    """Of the low 63 bits: the xor of the numbers 1 to 63 of the set bits, which is the place of the bit to flip, or 0."""
    parity = lambda mask: F.bit_count(x.bitwiseAND(F.lit(mask))).cast("int") % 2
    masks = [sum(1 << (place - 1) for place in range(1, 64) if place >> k & 1) for k in range(6)]
    out = F.lit(0)
    for k, mask in enumerate(masks):
        out = out + parity(mask) * (1 << k)
    return out


def anchor(x: Column) -> Column:
    """The codeword nearest to x."""
    s = _syndrome(x)
    return F.when(s == 0, x).otherwise(x.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), s - 1)))


def links(fps: DataFrame, threshold: int = MAX_DISTANCE) -> DataFrame:
    """Links (u, v) between distinct fingerprints (column fp): enough of them that their components are those of all pairs
    within the threshold, none between fingerprints farther apart than the threshold by a chain of such pairs."""
    if threshold not in (0, 1, 2):
        raise ValueError("the threshold must be 0, 1 or 2 bits")
    own = fps.select("fp").distinct()
    if threshold == 0:
        return own.select(F.col("fp").alias("u"), F.col("fp").alias("v")).filter("false")
    # The anchors that a fingerprint's one-bit neighbourhood falls to: distinct ones only, so midpoints of one anchor travel once.
    one = F.lit(1).cast("long")
    flips = F.concat(F.array("fp"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda k: F.col("fp").bitwiseXOR(F.call_function("shiftleft", one, k))))
    sent = own.select("fp", F.explode(F.array_distinct(F.transform(flips, anchor))).alias("anchor"))
    # In the anchor's own task: which points of its ball lie within a bit of the fingerprint.
    ball = F.concat(F.array("anchor"), F.transform(F.sequence(F.lit(0), F.lit(62)), lambda k: F.col("anchor").bitwiseXOR(F.call_function("shiftleft", one, k))))
    near = F.filter(ball, lambda z: F.bit_count(z.bitwiseXOR(F.col("fp"))) <= 1)
    met = sent.repartition("anchor").select("anchor", "fp", F.explode(near).alias("mid"))
    at = Window.partitionBy("anchor", "mid")
    if threshold == 1:  # only midpoints that are fingerprints themselves link their neighbours
        met = met.withColumn("there", F.max((F.col("fp") == F.col("mid")).cast("int")).over(at)).filter("there = 1").select("fp", F.col("mid").alias("to"))
    else:
        met = met.withColumn("to", F.min("fp").over(at))
    return met.filter("fp <> to").select(F.col("fp").alias("u"), F.col("to").alias("v"))


def _classed(docs: DataFrame, threshold: int, scratch: Scratch, near: bool) -> DataFrame:
    """(doc_id, text_key, fp, root, component_id) for every row; root is a fingerprint that the component shares.

    near: near copies (near.py) are linked too, however far their fingerprints are apart."""
    rows = scratch.cut(fingerprints(docs), "fingerprints")
    least = scratch.cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    found = links(least, threshold)
    if near:
        of = scratch.cut(rows.select("text_key", "fp").distinct(), "fp-of")
        ends = near_links(docs, scratch).join(of.select(F.col("text_key").alias("u"), F.col("fp").alias("a")), "u").join(of.select(F.col("text_key").alias("v"), F.col("fp").alias("b")), "v")
        found = found.union(ends.select(F.col("a").alias("u"), F.col("b").alias("v")))
    roots = components(found, scratch)
    rooted = least.join(roots, least["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.cut(rooted, "roots")
    names = scratch.cut(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "names")
    return rows.join(rooted.join(names, "root").select("fp", "root", "component_id"), "fp")


def classes(docs: DataFrame, threshold: int = MAX_DISTANCE, near: bool = True) -> DataFrame:
    """One row per row of docs (doc_id, text): fingerprint in hex and component_id, the least doc_id reachable by links.

    Links join fingerprints within the threshold and, if near, texts that are near copies by five-word shingles.

    Null, empty and white texts have fingerprint zero and link like any other. Null doc_ids take part in links but never
    name a component unless all its ids are null. Equal texts and repeated rows share fingerprint and component. Empty
    tables give no rows; other columns are ignored."""
    found = _classed(docs, threshold, Scratch(docs.sparkSession, "simhash"), near)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, threshold: int = MAX_DISTANCE, near: bool = True) -> DataFrame:
    """The rows of docs less all but one of each component of classes(), with their own columns.

    The row with the least doc_id stays (nulls last: one without an id stays only if its whole component has none); of
    several texts with that doc_id, the one with the least hash; of rows equal in doc_id and text, the
    first in the order of the input's parts and of the rows' JSON. A doc_id that
    names rows of several components is judged in each of them by itself."""
    scratch = Scratch(docs.sparkSession, "keep")
    found = scratch.cut(_classed(docs, threshold, scratch, near).select("doc_id", "text_key", "root", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("least")), "classes")
    # written: the join may split a component with very many rows
    first = scratch.cut(found.filter("least").groupBy("root").agg(F.min("text_key").alias("first")), "first")
    gone = found.join(first, "root").filter(~F.col("least") | (F.col("text_key") != F.col("first"))).select(F.struct("doc_id", "text_key").alias("key")).distinct()
    kept = without(docs, key_of(), scratch.cut(gone, "gone"), scratch).select("row.*")
    repeated = found.filter("least").groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).filter("n > 1").limit(1).count()
    return numbered(kept, key_of(), scratch).filter("copy = 0").select("row.*") if repeated else kept


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(read(spark, sf_dir, "documents"), near=False)  # the contract: fingerprints within two bits only
