"""First-match rejection, exact and greedy near dedup, and their histograms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import by_value, spread, written

by_value(__name__)

#: Keys of a bucket that are compared with each other; larger ones are split first.
PAIRED = 1000


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """The name of the first rule that holds, null if none does; a null condition does not hold."""
    name, cond = rules[0]
    out = F.when(F.coalesce(cond, F.lit(False)), name)
    for name, cond in rules[1:]:
        out = out.when(F.coalesce(cond, F.lit(False)), name)
    return out


def with_leak_flag(rows: DataFrame, tests: DataFrame, key: str) -> DataFrame:
    """rows with `leaked`: whether the key is one of the tests'. Spark broadcasts the tests only below its own limit."""
    marks = tests.select(key).distinct().withColumn("_mark", F.lit(True))
    return rows.join(marks, key, "left").withColumn("leaked", F.coalesce("_mark", F.lit(False))).drop("_mark")


def reject(rows: DataFrame, rules: list[tuple[str, Column]], key: str, order: str, late: list[tuple[str, Column]] = ()) -> DataFrame:
    """rows with reject_reason. Rules come first, then exact_dup, then late rules.

    Only rows that pass every rule, the late ones included, count as seen: a repeat of a row that a late rule rejects is
    rejected by that rule as well, never as a duplicate. The first by order survives."""
    early = rows.withColumn("_early", first_reason(list(rules)) if rules else F.lit(None).cast("string")).withColumn("_late", first_reason(list(late)) if late else F.lit(None).cast("string"))
    passing = F.col("_early").isNull() & F.col("_late").isNull()
    # the least order of each passing key, pre-aggregated, instead of sorting each key's rows in one task
    firsts = early.filter(passing).groupBy(key).agg(F.min(order).alias("_first"))
    marked = early.join(firsts, key, "left")
    again = passing & (F.col(order) > F.col("_first"))
    return marked.withColumn("reject_reason", F.coalesce("_early", F.when(again, "exact_dup"), "_late")).drop("_early", "_late", "_first")


def histogram(rows: DataFrame, col: str) -> DataFrame:
    return rows.groupBy(col).agg(F.count("*").alias("n"))


def exact_dedup(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by order (order has no ties)."""
    first = rows.groupBy(key).agg(F.min(order).alias(order))
    return rows.join(first, [key, order], "left_semi")


def _digits(s: Column, n: int) -> Column:
    """The digits of s in n stretches whose sizes differ by one at most."""
    size = F.length(s)
    edge = lambda k: F.floor(size * k / n).cast("int")
    return F.array(*(F.substring(s, edge(k) + 1, edge(k + 1) - edge(k)) for k in range(n)))


def _split(rows: DataFrame, threshold: int) -> DataFrame:
    """Rows (key, at, fixed, rest) once for each stretch of rest, which moves to what is fixed.

    Two keys within threshold bits differ in at most so many of threshold + 1 stretches, so one of them is the same."""
    parts = F.posexplode(_digits(F.col("rest"), threshold + 1)).alias("part", "same")
    cut = rows.select("key", "at", "fixed", "rest", parts).withColumn("before", F.floor(F.length("rest") * F.col("part") / (threshold + 1)).cast("int"))
    left = F.concat(F.substring(F.col("rest"), F.lit(1), F.col("before")), F.substring(F.col("rest"), F.col("before") + F.length("same") + 1, F.length("rest")))
    return cut.select("key", "at", F.concat_ws("/", "fixed", "part", "same").alias("fixed"), left.alias("rest"))


def _bits(a: Column, b: Column) -> Column:
    """Differing bits of two hex keys of one length, eight digits at a time."""
    at = F.sequence(F.lit(0), F.floor((F.length(a) - 1) / 8).cast("int"))
    word = lambda s, k: F.conv(F.substring(s, k * 8 + 1, F.lit(8)), 16, 10).cast("long")
    return F.aggregate(at, F.lit(0), lambda n, k: n + F.bit_count(word(a, k).bitwiseXOR(word(b, k))))


def _buckets(rows: DataFrame, threshold: int, prefix: int) -> DataFrame:
    """Distinct (key, at) with fixed and rest, split once where the rest has a digit for each stretch."""
    block = F.concat_ws(":", F.length("key"), F.substring("key", 1, prefix))
    whole = rows.select("key", "at", block.alias("fixed"), F.substring(F.col("key"), F.lit(prefix + 1), F.length("key")).alias("rest"))
    long = F.length("rest") > threshold
    return _split(whole.filter(long), threshold).union(whole.filter(~long)) if threshold else whole.select("key", "at", F.col("key").alias("fixed"), F.lit("").alias("rest"))


def _led(rows: DataFrame, cut: DataFrame, threshold: int) -> DataFrame:
    """(key, at, leads, gone) of keys not settled yet, cut being their buckets: whether no earlier one shares any bucket, so it
    is kept whatever the others do, and whether it is near a key that leads, so it goes. One row a bucket and key: groups of
    near copies of any size are settled by their first without pairing the others."""
    heads = cut.groupBy("fixed").agg(F.min(F.struct("at", "key")).alias("head"))
    met = cut.join(heads, "fixed").select("key", F.col("head.key").alias("by"))
    leads = written(met.groupBy("key").agg(F.bool_and(F.col("by") == F.col("key")).alias("leads")), "near-heads")
    pairs = met.filter(F.col("by") != F.col("key")).filter(_bits(F.col("key"), F.col("by")) <= threshold)
    gone = pairs.join(leads.filter("leads").select(F.col("key").alias("by")), "by").select("key").distinct().withColumn("gone", F.lit(True))
    return rows.join(leads, "key").join(gone, "key", "left").select("key", "at", "leads", F.coalesce("gone", F.lit(False)).alias("gone"))


def _large(cut: DataFrame, threshold: int) -> DataFrame:
    """Buckets of more than PAIRED keys that can be split once more."""
    sizes = cut.groupBy("fixed").agg(F.count("*").alias("n"), F.max(F.length("rest")).alias("digits"))
    return sizes.filter((F.col("n") > PAIRED) & (F.col("digits") > threshold)).select("fixed")


def near_pairs(rows: DataFrame, threshold: int = 3, prefix: int = 4) -> DataFrame:
    """(u, v): distinct keys of rows (key, at) with one prefix, v later than u, within threshold bits.

    Keys meet where a stretch of digits is the same. What more than PAIRED keys share is split by another stretch, and again
    while there are digits, so no bucket of more than that is paired unless its keys differ in threshold digits at most."""
    return _paired(written(_buckets(rows, threshold, prefix), "near-level"), threshold)


def _words(key: Column) -> Column:
    """A hex key as numbers of eight digits each."""
    at = F.sequence(F.lit(0), F.floor((F.length(key) - 1) / 8).cast("int"))
    return F.transform(at, lambda k: F.conv(F.substring(key, k * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def _paired(left: DataFrame, threshold: int) -> DataFrame:
    """Near pairs (u, v) of buckets. Keys are read as numbers once each, not for each pair; buckets are dealt over all tasks,
    since few bytes may make many pairs."""
    digits, cold = left.agg(F.max(F.length("key"))).first()[0] or 0, None
    while True:
        large = written(_large(left, threshold), "near-large")
        more = bool(threshold) and not large.isEmpty()
        few = (left.join(large, "fixed", "left_anti") if more else left).select("key", "at", "fixed")
        cold = few if cold is None else cold.union(few)  # buckets of different levels have different names
        if not more:
            break
        left = written(_split(left.join(large, "fixed", "left_semi"), threshold), "near-level")
    none = F.lit(0).cast("long")
    word = lambda c, k: F.coalesce(F.get(c, F.lit(k)), none)
    bits = sum((F.bit_count(word("words_u", k).bitwiseXOR(word("words_v", k))) for k in range(-(-digits // 8))), F.lit(0))
    a, b = (spread(cold.select("fixed", F.col("key").alias(k), F.col("at").alias(f"at_{k}"), _words(F.col("key")).alias(f"words_{k}")), "fixed") for k in "uv")
    return a.join(b.hint("merge"), "fixed").filter((F.col("at_u") < F.col("at_v")) & (bits <= threshold)).select("u", "v").distinct()


def _later(edges: DataFrame) -> list[DataFrame]:
    """Keys that go, when each key of edges (u, v) is kept unless an earlier one that is kept is near.

    Settled in rounds: what no earlier key is near is kept, what is near a kept key goes, and both leave."""
    gone = []
    while not edges.isEmpty():
        free = edges.select("u").distinct().join(edges.select(F.col("v").alias("u")), "u", "left_anti")
        lost = written(edges.join(free, "u", "left_semi").select("v").distinct(), "near-gone")
        gone.append(lost.select(F.col("v").alias("key")))
        edges = written(edges.join(lost, "v", "left_anti").join(lost.select(F.col("v").alias("u")), "u", "left_anti"), "near-edges")
    return gone


def _by_heads(own: DataFrame, threshold: int, prefix: int) -> list[DataFrame]:
    """Keys (key) of rows (key, at) that go, where blocks can't be split because the threshold has more stretches than digits.

    The first PAIRED keys of each block are settled among themselves, since no later one has a say; what is near those that
    are kept goes, and the same again with what is left. So a key meets kept ones only, of which such a threshold leaves few."""
    def greedy(df: pd.DataFrame) -> pd.DataFrame:
        kept = []
        for k in df.sort_values("nr")["key"]:
            x = int(k, 16)
            if all((x ^ y).bit_count() > threshold for _, y in kept):
                kept.append((k, x))
        return pd.DataFrame({"block": df["block"].iloc[0], "keeps": [[k for k, _ in kept]]})

    left, gone = own.withColumn("block", F.concat_ws(":", F.length("key"), F.substring("key", 1, prefix))), []
    nr = F.row_number().over(Window.partitionBy("block").orderBy("at"))
    while not left.isEmpty():
        heads = written(left.withColumn("nr", nr).filter(F.col("nr") <= PAIRED), "near-heads")
        kept = written(heads.groupBy("block").applyInPandas(greedy, "block string, keeps array<string>"), "near-kept")
        met = left.join(kept, "block").withColumn("near", F.exists("keeps", lambda k: (k != F.col("key")) & (_bits(F.col("key"), k) <= threshold)))
        met = written(met.select("key", "at", "block", "near", F.array_contains("keeps", F.col("key")).alias("keeps")), "near-met")
        gone.append(met.filter("near and not keeps").select("key"))
        left = met.filter("not near and not keeps").select("key", "at", "block")
    return gone


def near_dedup(rows: DataFrame, key: str, order: str, threshold: int = 3, prefix: int = 4) -> DataFrame:
    """rows with `kept`, greedy in order: a row goes if a kept row whose key (hex digits) has the same prefix and length lies
    within threshold bits.

    Null and empty keys are always kept; of rows equal in key the first by order is judged and the others go, so order has no
    ties; a pair whose prefixes differ is never compared, by definition. No group is read by one task: while a bucket is too
    large to be paired, the keys that lead all of theirs settle what is near them, as long as that settles a tenth of what is
    left; then the near pairs among the rest are settled in rounds. Keys with
    fewer digits than the threshold has stretches are settled by the first ones of each block. An empty table stays empty."""
    rows = written(rows, "near-rows")  # keys may be dear: they are read three times below
    firsts = rows.filter(F.coalesce(F.length(key), F.lit(0)) > 0).groupBy(F.col(key).alias("key")).agg(F.min(order).alias("at"))
    own, gone = written(firsts, "near-keys"), []
    if threshold:
        short = F.length("key") - prefix <= threshold
        gone += _by_heads(own.filter(short), threshold, prefix)
        left = own.filter(~short)
        cut = written(_buckets(left, threshold, prefix), "near-level")
        while not _large(cut, threshold).isEmpty():
            led = written(_led(left, cut, threshold), "near-led")
            gone.append(led.filter("gone").select("key"))
            before, left = left.count(), led.filter("not gone and not leads").select("key", "at")
            cut = written(_buckets(left, threshold, prefix), "near-level")
            if left.count() > 0.9 * before:
                break
        gone += _later(written(_paired(cut, threshold), "near-edges"))
    lost = own.select("key").limit(0)
    for g in gone:
        lost = lost.union(g)
    first = own.join(lost.withColumn("_gone", F.lit(True)), "key", "left").filter("_gone is null").select(F.col("key").alias(key), F.col("at").alias("_first"), F.lit(True).alias("_keep"))
    joined = rows.join(first, key, "left")
    usable = F.coalesce(F.length(key), F.lit(0)) > 0
    return joined.withColumn("kept", ~usable | F.coalesce(F.col("_keep") & (F.col(order) == F.col("_first")), F.lit(False))).select(*rows.columns, "kept")


def top(rows: DataFrame, n: int, *order) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def first_per(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_n = 1").drop("_n")
