"""Operator 6, benchmark decontamination: a positional index of the corpus, intersected from the rarest test terms.

Each test window is looked up by its rarest words. Their postings, less the word's place in the test item, give
alignments of item and document; an alignment that enough of the rarest words agree on is compared word by word, which
gives exact phrase matches and near (proximity) matches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WORD, Scratch, ascii_lower, check_columns, key_of, read, without

WIDTH, NEAR, RAREST = 10, 0.8, 2


def words_of(text: str):
    """Words of a text column, A-Z lower-cased; null has none."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(F.col(text)), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def items_of(items: DataFrame, width: int) -> DataFrame:
    """(item_id, w, at, words): every window of every item; an item with fewer words than width is one window."""
    w = items.select("item_id", words_of("text").alias("w")).filter(F.size("w") > 0)
    each = w.select("item_id", "w", F.explode(F.sequence(F.lit(0), F.greatest(F.size("w") - width, F.lit(0)))).alias("at"))
    return each.withColumn("words", F.slice("w", F.col("at") + 1, F.lit(width)))


def tokens(docs: DataFrame) -> DataFrame:
    return docs.select(key_of().alias("key"), F.posexplode(words_of("text")).alias("at", "term"))


def anchors_of(homes: DataFrame, docs: DataFrame, scratch: Scratch, rarest: int) -> DataFrame:
    """(item_id, place, term): for each window the words with the fewest places in the whole corpus, leftmost first.

    A window of which one of these is nowhere in the corpus is dropped: it has no match."""
    each = homes.select("win", "item_id", "at", F.posexplode("words").alias("offset", "term"))
    vocabulary = scratch.cut(each.select("term").distinct(), "vocabulary")
    counts = docs.select(F.explode(words_of("text")).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    ranked = each.join(counts, "term", "left").groupBy("win", "item_id", "at").agg(
        F.slice(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))), 1, rarest).alias("r")
    )
    there = ranked.filter(F.forall("r", lambda x: x["n"] > 0)).select("item_id", "at", F.explode("r").alias("r"))
    return scratch.cut(there.select("item_id", (F.col("at") + F.col("r.offset")).alias("place"), "r.term").distinct(), "anchors")


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, near: float = NEAR, rarest: int = RAREST) -> DataFrame:
    """One row for every aligned pair of document and item: key (doc_id, text_key), the item_ids whose windows stand
    there, spans (start, end) of exact windows and near_starts of windows with at least the share near of their words in
    place. docs: (doc_id, text); items: (item_id, text).

    Equal windows are searched once, by the first test that holds them, and count for all items that do; a test is an
    item_id with one text, so an item_id that stands for several texts has all their windows. Spark
    broadcasts a join's test side only if it is below the session's limit; else it sorts, splitting frequent terms."""
    check_columns(docs, "doc_id", "text")
    check_columns(items, "item_id", "text")
    scratch = Scratch(docs.sparkSession, "decontaminate")
    docs, items = docs.select("doc_id", "text"), items.select("item_id", "text").filter("item_id is not null")
    # inside, item_id is a test's (item_id, text_key)
    kind = items.schema["item_id"].dataType
    each = items_of(items.select(F.struct("item_id", F.xxhash64("text").alias("text_key")).alias("item_id"), "text"), width).withColumn("win", F.sha2(F.concat_ws(" ", "words"), 256))
    each = scratch.cut(each.groupBy("item_id", "at", "w", "words", "win").agg(F.count("*").alias("n")).drop("n"), "windows")
    grouped = each.groupBy("win").agg(F.min(F.struct("item_id", "at")).alias("home"), F.collect_set("item_id.item_id").alias("holders"))
    homes = each.join(grouped.select("win", F.col("home.item_id").alias("item_id"), F.col("home.at").alias("at")), ["win", "item_id", "at"], "left_semi")
    anchors = anchors_of(homes, docs, scratch, rarest)
    index = scratch.cut(tokens(docs).join(anchors.select("term").distinct(), "term", "left_semi"), "postings")
    lines = index.join(anchors, "term").groupBy("key", "item_id", (F.col("at") - F.col("place")).alias("shift")).agg(F.count("*").alias("n"))
    shared = grouped.filter(F.size("holders") > 1).groupBy("home.item_id").agg(F.collect_list(F.struct(F.col("home.at").alias("at"), "holders")).alias("shared"))
    tests = each.groupBy("item_id").agg(F.first("w").alias("test")).join(shared, "item_id", "left")
    tests = tests.withColumn("shared", F.coalesce("shared", F.array().cast(shared.schema["shared"].dataType)))
    tests = scratch.cut(tests, "tests")
    lines = scratch.cut(lines.join(tests.select("item_id", F.size("test").alias("len")), "item_id").filter(F.col("n") >= F.least(F.lit(rarest), "len")).select("key", "item_id", "shift"), "alignments")
    texts = docs.select(key_of().alias("key"), "text").join(lines.select("key").distinct(), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    pair = texts.select("key", words_of("text").alias("w")).join(lines, "key").join(tests, "item_id")
    here = F.slice("w", F.greatest(F.col("shift"), F.lit(0)) + 1, F.size("test") + F.least(F.col("shift"), F.lit(0)))
    lead = F.array_repeat(F.lit(None).cast("string"), F.greatest(-F.col("shift"), F.lit(0)))
    pair = pair.select("key", "item_id", "shift", "test", "shared", F.zip_with(F.concat(lead, here), "test", lambda a, b: F.coalesce(a == b, F.lit(False))).alias("same"))
    length = F.least(F.lit(width), F.size("test"))
    ats = F.sequence(F.lit(0), F.size("test") - length)
    scored = pair.select(
        "key", "item_id", "shift", "shared", length.alias("length"),
        F.transform(ats, lambda p: F.struct(p.alias("at"), F.size(F.filter(F.slice("same", p + 1, length), lambda x: x)).alias("n"))).alias("windows"),
    )
    exact = F.transform(F.filter("windows", lambda x: x["n"] == F.col("length")), lambda x: x["at"])
    close = F.filter("windows", lambda x: (x["n"] < F.col("length")) & (x["n"] >= F.ceil(F.col("length") * near)))
    scored = scored.withColumn("exact", exact).withColumn("near_starts", F.transform(close, lambda x: x["at"] + F.col("shift")))
    others = F.flatten(F.transform(F.filter("shared", lambda s: F.array_contains("exact", s["at"])), lambda s: s["holders"]))
    found = scored.select(
        "key",
        F.when(F.size("exact") > 0, F.array_union(F.array("item_id.item_id"), others)).otherwise(F.array().cast(T.ArrayType(kind))).alias("item_ids"),
        F.transform("exact", lambda p: F.struct((p + F.col("shift")).alias("start"), (p + F.col("shift") + F.col("length")).alias("end"))).alias("spans"),
        "near_starts",
    )
    return scratch.cut(found.filter((F.size("spans") > 0) | (F.size("near_starts") > 0)), "matches")


def covered(spans: Column) -> Column:
    """How many places sorted (start, end) spans cover."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("to"))
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).cast("long").alias("n"), F.greatest(acc["to"], s["end"]).alias("to"))
    return F.aggregate(spans, zero, step, lambda acc: acc["n"])


def contamination(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """One row per row of docs: words, hit words, items with occurring windows, and near windows that are no exact ones.

    Null and empty texts have no words and no hits; null item_ids and items without words are no tests; rows with equal
    doc_id and text have equal results; empty tables give rows without hits or no rows; other columns are ignored."""
    found = matches(docs, items, width).groupBy("key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
        F.array_sort(F.array_distinct(F.transform(F.flatten(F.collect_list("item_ids")), lambda x: x.cast("string")))).alias("ids"),
        F.size(F.array_distinct(F.flatten(F.collect_list("near_starts")))).cast("long").alias("n_near"),
    )
    per = found.select("key", covered(F.col("spans")).alias("n_hit"), F.size("ids").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "ids"), 256).alias("sha"), "n_near")
    base = docs.select("doc_id", key_of().alias("key"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("n_words"))
    zero = F.lit(0).cast("long")
    return base.join(per, "key", "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"),
        F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (F.coalesce("n_hit", zero) > 0).alias("contaminated"), F.coalesce("n_near", zero).alias("n_near"),
    )


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs without a hit word, with their own columns."""
    hit = matches(docs, items, width).filter(F.size("spans") > 0).select("key").distinct()
    scratch = Scratch(docs.sparkSession, "clean")
    return without(docs, key_of(), scratch.cut(hit, "hit"), scratch).select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("n_near")


SQL = r"""
WITH words AS (
  SELECT DISTINCT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL),
tests AS (
  SELECT DISTINCT item_id, w[pos:pos + 9] AS win FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS pos FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(win) AS n FROM tests),
hits AS (
  SELECT p.doc_id, p.w, p.pos, p.n, t.item_id
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS pos FROM words, sizes WHERE len(w) >= n) p JOIN tests t ON t.win = p.w[p.pos:p.pos + p.n - 1]),
per AS (
  SELECT doc_id, w, len(list_distinct(flatten(list(range(pos, pos + n))))) AS n_hit,
         list_sort(list_distinct(list(item_id::VARCHAR))) AS ids FROM hits GROUP BY doc_id, w)
SELECT d.doc_id, coalesce(len(d.w), 0)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(len(p.ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(p.ids, ','), '')) AS items_sha256, coalesce(p.n_hit, 0) > 0 AS contaminated
FROM (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents) d
LEFT JOIN per p ON p.doc_id = d.doc_id AND p.w = d.w
"""
