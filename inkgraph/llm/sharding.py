"""Operator 10, sharding: records hash into a fixed number of virtual slots, bytes are summed per slot, and a
versioned slot-to-shard map says where each slot lives. Growing or rebalancing edits the map, never the slots."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, check_columns, read

SLOTS, SHARDS, OVERHEAD, PARTS, PIECE = 4096, 40, 16, 64, 4096


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The virtual slot of a key: its first 32 md5 bits, modulo the slots. A null key hashes as the word null."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % F.lit(slots)).cast("int")


def grow(owners: list[int]) -> list[int]:
    """The next version of a map with one shard more, which takes slots from the fullest shards and only into itself."""
    shards = max(owners, default=-1) + 2
    held: list[list[int]] = [[] for _ in range(shards)]
    for slot, shard in enumerate(owners):
        held[shard].append(slot)
    for _ in range(len(owners) // shards):
        giver = max(range(shards - 1), key=lambda s: (len(held[s]), -s))
        held[-1].append(held[giver].pop())
    out = list(owners)
    for slot in held[-1]:
        out[slot] = shards - 1
    return out


def shard_map(shards: int, slots: int = SLOTS) -> list[int]:
    """The map for so many shards, by growth from one: it depends on nothing but the two counts."""
    if not 1 <= shards <= slots:
        raise ValueError("shards must lie between 1 and the number of slots")
    owners = [0] * slots
    for _ in range(shards - 1):
        owners = grow(owners)
    return owners


def rebalance(owners: list[int], loads: list[int], tolerance: float = 0.05) -> list[int]:
    """An edit of the map by measured bytes per slot: the fullest shard hands its best-fitting slot to the emptiest
    until all lie within the tolerance of the mean or no move helps. Works on the slots, a fixed number."""
    out, shards = list(owners), max(owners) + 1
    total = [0] * shards
    for slot, shard in enumerate(out):
        total[shard] += loads[slot]
    mean = sum(total) / shards
    for _ in range(len(out)):
        high, low = max(range(shards), key=lambda s: (total[s], -s)), min(range(shards), key=lambda s: (total[s], s))
        gap = total[high] - total[low]
        movable = [s for s, o in enumerate(out) if o == high and 0 < loads[s] < gap]
        if total[high] <= mean * (1 + tolerance) or not movable:
            break
        best = min(movable, key=lambda s: (abs(loads[s] - gap / 2), s))
        out[best] = low
        total[high] -= loads[best]
        total[low] += loads[best]
    return out


def map_table(spark: SparkSession, versions: list[tuple[int, list[int]]]) -> DataFrame:
    """The stored form of map versions: (version, slot, shard), one row per version and slot."""
    rows = [F.struct(F.lit(v).alias("version"), F.array(*map(F.lit, owners)).alias("owners")) for v, owners in versions]
    wide = spark.range(1).select(F.inline(F.array(*rows)))
    return wide.select("version", F.posexplode("owners").alias("slot", "shard"))


def slot_bytes(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(slot, rows, bytes) over all rows, summed on the map side first."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD
    return docs.groupBy(slot_of(F.col("doc_id"), slots).alias("slot")).agg(F.count("*").alias("rows"), F.sum(size.cast("long")).alias("bytes"))


def stored_maps(docs: DataFrame, scratch: Scratch, shards: int, slots: int, law: str) -> DataFrame:
    """(vslot, shard, grown_shard) from the stored map. Version 1 is grown to the shard count. Under the law `key` version
    2 grows it by one shard; under `bytes` version 2 is version 1 edited by the bytes per slot, and rows live by it."""
    first = shard_map(shards, slots)
    if law == "key":
        second = grow(first) if shards < slots else first
    else:
        held = dict.fromkeys(range(slots), 0) | {r["slot"]: r["bytes"] for r in slot_bytes(docs, slots).collect()}  # one number a slot
        second = rebalance(first, [held[k] for k in range(slots)])
    stored = scratch.cut(map_table(docs.sparkSession, [(1, first), (2, second)]), "map")
    at = lambda v: F.max(F.when(F.col("version") == v, F.col("shard")))
    by = stored.groupBy(F.col("slot").alias("vslot")).agg(at(1).alias("one"), at(2).alias("two"))
    return by.select("vslot", F.col("one" if law == "key" else "two").alias("shard"), (F.col("two") if law == "key" else F.lit(None).cast("int")).alias("grown_shard"))


def assign(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, law: str = "key") -> DataFrame:
    """One row per row of docs (doc_id, text): size, crc, shard, its place in the shard and the shard after growth.

    Under the law `key` doc_id and the shard count decide, and grown_shard says where one more shard would put the row;
    under `bytes` the map is rebalanced by the bytes that its slots hold, and grown_shard is null. Places within a shard run
    gapless from 0 by virtual slot, part of the slot, doc_id, crc and size; equal rows share those values, so any order
    among them is the same result. Null doc_id is a key of its own; null text has 0 bytes and a null crc; an empty table
    gives no rows; other columns are ignored. Texts are read once (twice under `bytes`); narrow rows are shuffled, equal
    ones as one row with a count. A doc_id that very many rows share lies in one virtual slot, which is numbered in PARTS
    parts: different texts are parted by crc, equal ones in pieces of at most PIECE rows."""
    check_columns(docs, "doc_id", "text")
    if law not in ("key", "bytes"):
        raise ValueError("the law is key or bytes")
    scratch = Scratch(docs.sparkSession, "shards")
    owned = stored_maps(docs, scratch, shards, slots, law)
    rows = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + OVERHEAD).cast("long").alias("size"),
        F.crc32("text").alias("text_crc32"),
        slot_of(F.col("doc_id"), slots).alias("vslot"),
    )
    equal = rows.groupBy("doc_id", "size", "text_crc32", "vslot").agg(F.count("*").alias("n"))
    pieces = equal.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / PIECE))))
    by_crc = F.shiftright(F.coalesce("text_crc32", F.lit(0).cast("long")), 26)
    pieces = pieces.withColumn("n", F.least(F.lit(PIECE), F.col("n") - F.col("piece") * PIECE).cast("int")).withColumn("part", F.pmod(by_crc + F.col("piece"), F.lit(PARTS)).cast("int"))
    pieces = scratch.cut(pieces, "pieces")
    counts = pieces.groupBy("vslot", "part").agg(F.sum("n").alias("held"))
    before = Window.partitionBy("shard").orderBy("vslot", "part").rowsBetween(Window.unboundedPreceding, -1)
    # owned and starts have one row for each of the fixed slots, with PARTS numbers at most, so their sizes are known before they are broadcast
    starts = counts.join(F.broadcast(owned), "vslot").withColumn("start", F.coalesce(F.sum("held").over(before), F.lit(0)))
    starts = starts.groupBy("vslot", "shard", "grown_shard").agg(F.map_from_entries(F.collect_list(F.struct("part", "start"))).alias("starts"))
    place = Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = pieces.withColumn("at", F.coalesce(F.sum("n").over(place), F.lit(0))).join(F.broadcast(starts), "vslot")
    placed = placed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    return placed.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.element_at("starts", F.col("part")) + F.col("at") + F.col("copy")).cast("long").alias("slot"), "grown_shard", "vslot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(read(spark, sf_dir, "documents"))


def _sql() -> str:
    """The same rows. The CRC goes byte by byte through its table of 256 remainders, a string of eight digits each."""
    now = shard_map(SHARDS)
    crc = "".join(f"{zlib.crc32(bytes([k ^ 255])) ^ 0xFF000000:08X}" for k in range(256))
    return f"""
WITH d AS (SELECT doc_id, text, coalesce(octet_length(encode(text)), 0) + {OVERHEAD} AS size, ('0x' || left(md5(coalesce(doc_id::VARCHAR, 'null')), 8))::BIGINT % {SLOTS} AS vslot FROM documents),
t AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::BIGINT)),
        lambda c, b: xor(('0x' || substr('{crc}', (xor(c, b) & 255) * 8 + 1, 8))::BIGINT, c >> 8)), 4294967295::BIGINT) AS crc FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
c AS (SELECT d.doc_id, d.size, d.vslot, t.crc, (row_number() OVER (PARTITION BY d.doc_id, d.size, t.crc) - 1) // {PIECE} AS piece FROM d LEFT JOIN t USING (text)),
p AS (SELECT *, ((coalesce(crc, 0) >> 26) + piece) % {PARTS} AS part, {now}[vslot + 1] AS shard, {grow(now)}[vslot + 1] AS grown_shard FROM c)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'key' AS law, shard::INTEGER AS shard,
       row_number() OVER (PARTITION BY shard ORDER BY vslot, part, doc_id NULLS FIRST, crc NULLS FIRST, size, piece) - 1 AS slot, grown_shard::INTEGER AS grown_shard, vslot::INTEGER AS vslot
FROM p
"""


SQL = _sql()
