"""Near copies: all pairs of texts whose sets of five-word shingles have a Jaccard similarity of at least 4/5.

A prefix join, which loses no pair: shingles have one global order, and two such texts share one of the first
floor(n / 5) + 1 of their n. The order is by hash, with shingles that a sample of texts finds common put last; the sample
has no bearing on the pairs found. Texts that share a prefix shingle are first compared with one of them, the hub, and
then only those with each other that the hubs have not joined: a large group of near copies is never paired in full. Where
many unrelated texts share a prefix shingle that the sample has not seen, their shingles are counted exactly and they get
prefixes of their rarest ones."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_value, maybe_in
from .graph import components

by_value(__name__)
WIDTH, SEED, OF, PARTS = 5, 42, 4, 5
#: Longs of 64 bits in a text's sketch, and in the short one that each row carries into the join of prefixes.
LONGS, SHORT = 32, 8
#: Earlier shingles that are compared where two texts meet.
BEFORE = 3
#: Texts that are compared with each other for a prefix shingle that they share; more get new prefixes first.
HOT = 200
#: Texts sampled for common shingles, and how many shingles at most are put last.
SAMPLE, MOST_COMMON = 4000, 20_000


def shingles(text: str | None):
    """The distinct shingles of a text as sorted unsigned hashes; one shingle if it has fewer words, none without words."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8").translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    if len(words) < WIDTH:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype=np.uint64)
    h = np.array([xxhash.xxh64_intdigest(w, SEED) for w in words], dtype=np.uint64)
    n, out = len(h) - WIDTH + 1, np.zeros(len(h) - WIDTH + 1, dtype=np.uint64)
    for k in range(WIDTH):  # a polynomial of word hashes, mixed so that its order is even
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + n]
    out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return np.unique(out ^ (out >> np.uint64(32)))


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("text is not null").select(F.xxhash64("text").alias("id"), "text")


def _common(texts: DataFrame) -> list[int]:
    """Shingles in three texts or more of a sample by hash, the most frequent ones, rarest first."""
    import numpy as np

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.column(1):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py()).view(np.int64))], names=["h"])

    count = texts.count()
    part = max(1, count // SAMPLE)
    some = texts.filter(F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(part)) == 0).dropDuplicates(["id"])
    counted = some.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).filter("n > 2")
    return [r["h"] for r in reversed(counted.orderBy(F.desc("n"), "h").limit(MOST_COMMON).collect())]


def _prefixes(texts: DataFrame, common: list[int]) -> DataFrame:
    """(h, id, n, p): the first shingles of every text, numbered from 0 in the common order, n being the number of all."""
    import numpy as np

    last = np.array(common, dtype=np.int64).view(np.uint64)
    by = np.argsort(last)
    keys, rank = last[by], by

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hs, ids, ns, ps = [], [], [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                s = shingles(t.as_py())
                take = len(s) // PARTS + 1
                if len(s) and len(keys):
                    at = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                    is_common = keys[at] == s
                    late = s[is_common][np.argsort(rank[at[is_common]])]
                    first = np.concatenate([s[~is_common], late])[:take]
                else:
                    first = s[:take]
                hs.append(first.view(np.int64))
                ids.append(np.full(len(first), i, dtype=np.int64))
                ns.append(np.full(len(first), len(s), dtype=np.int32))
                ps.append(np.arange(len(first), dtype=np.int32))
            if hs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (hs, ids, ns, ps)], names=["h", "id", "n", "p"])

    return texts.mapInArrow(run, "h long, id long, n int, p int")


def _alike(a: str, b: str) -> Column:
    """Sizes of which one is not too small for the other."""
    return (F.col(a) * PARTS >= F.col(b) * OF) & (F.col(b) * PARTS >= F.col(a) * OF)


def _enough(a: str, b: str, shared: str) -> Column:
    """Whether texts of sizes a and b that share so many shingles of their prefixes can be near copies.

    Of the text whose prefix ends first in the common order, every shared shingle of the prefix is in the other prefix too,
    so all that they share is at most this number and the rest of that text. Near copies share 4/9 of both sizes added."""
    rest = lambda n: F.col(n) - F.floor(F.col(n) / PARTS) - 1
    return (F.col(shared) + F.greatest(rest(a), rest(b))) * (OF + PARTS) >= (F.col(a) + F.col(b)) * OF


def _bits(s, longs: int = LONGS):
    """A set of hashes as one bit each in so many longs."""
    import numpy as np

    on = np.zeros(longs * 64, dtype=np.uint8)
    on[(s % np.uint64(longs * 64)).astype(np.int64)] = 1
    return np.packbits(on).view(np.int64)


def _may_be(u: str, v: str) -> Column:
    """Whether texts with these sketches and sizes can be near copies.

    Each bit that only one has is at least one shingle that the other lacks, so the others of that text are all they share."""
    lacks = lambda a, b: F.aggregate(
        F.zip_with(f"bits_{a}", f"bits_{b}", lambda x, y: F.bit_count(x.bitwiseAND(F.bitwise_not(y)))), F.lit(0), lambda n, x: n + x
    )
    n, m = F.col(f"n_{u}"), F.col(f"n_{v}")
    return F.least(n - lacks(u, v), m - lacks(v, u)) * (OF + PARTS) >= (n + m) * OF


def _some(texts: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, text) of the texts with the given ids (written)."""
    # only texts that may be among them move, equal ones once from each part of the input
    some = maybe_in(texts, F.col("id"), ids, scratch, f"{name}-maps").filter("maybe").select("row.*").groupBy("id").agg(F.first("text").alias("text"))
    return some.join(ids, "id", "left_semi")


def _sets(texts: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, s, bits, n) of the texts with the given ids (written): their shingles, sketches and numbers of shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            sets = [shingles(t.as_py()) for t in b.column(1)]
            bits = [_bits(s) for s in sets]
            sets = [s.view(np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64()))], names=["id", "s", "bits"])

    return scratch.cut(_some(texts, ids, scratch, name).mapInArrow(run, "id long, s array<long>, bits array<long>").withColumn("n", F.size("s")), f"{name}-sets")


def _short(texts: DataFrame, ids: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(id, ones, b0, b1, ...) of the texts with the given ids (written): their short sketches and how many bits are set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            if b.num_rows:
                bits = np.array([_bits(shingles(t.as_py()), SHORT) for t in b.column(1)])
                ones = np.bitwise_count(bits.view(np.uint64)).sum(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ones), *(pa.array(bits[:, k]) for k in range(SHORT))], names=["id", "ones", *(f"b{k}" for k in range(SHORT))])

    return scratch.cut(_some(texts, ids, scratch, name).mapInArrow(run, "id long, ones int" + "".join(f", b{k} long" for k in range(SHORT))), f"{name}-short")


def _verified(pairs: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Those of the distinct pairs (u, v) of text ids that are near copies."""
    pairs = scratch.cut(pairs, f"{name}-pairs")
    ids = scratch.cut(pairs.select(F.col("u").alias("id")).union(pairs.select("v")).distinct(), f"{name}-ids")
    sets = _sets(texts, ids, scratch, name)
    u, v = (sets.select(F.col("id").alias(c), F.col("bits").alias(f"bits_{c}"), F.col("n").alias(f"n_{c}")) for c in "uv")
    pairs = scratch.cut(pairs.join(u, "u").join(v, "v").filter(_may_be("u", "v")).select("u", "v"), f"{name}-likely")
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("s").alias("a")), "u").join(sets.select(F.col("id").alias("v"), F.col("s").alias("b")), "v")
    same = F.size(F.array_intersect("a", "b"))
    return scratch.cut(both.filter(same * PARTS >= (F.size("a") + F.size("b") - same) * OF).select("u", "v"), f"{name}-links")


def _stars(rows: DataFrame, texts: DataFrame, before: DataFrame | None, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """Links between hubs and those that share a prefix shingle with them, and the rows (h, id, n, p, root) of shingles whose
    texts these links and those before have not all joined."""
    at = Window.partitionBy("h")
    rows = rows.withColumns({"least": F.min(F.struct("id", "n")).over(at), "hi": F.max("id").over(at)})
    met = rows.filter("least.id < hi").select("h", "id", "n", "p", F.col("least.id").alias("hub"), F.col("least.n").alias("hub_n")).distinct()
    met = scratch.cut(met, f"{name}-met")
    # Of a text's prefix shingles, its hub may have those whose hub is the hub itself or a lesser one, and no others.
    up_to = Window.partitionBy("id").orderBy("hub").rowsBetween(Window.unboundedPreceding, 0)
    counted = met.groupBy("id", "n", "hub", "hub_n").agg(F.count("*").alias("of_hub")).withColumn("shared", F.sum("of_hub").over(up_to))
    stars = counted.filter("id <> hub").filter(_alike("n", "hub_n") & _enough("n", "hub_n", "shared"))
    star = _verified(stars.select(F.col("hub").alias("u"), F.col("id").alias("v")), texts, scratch, name)
    star = star if before is None else before.union(star)
    roots = scratch.cut(components(star, scratch), f"{name}-roots")
    left = met.filter(F.col("id") != F.col("hub")).join(roots, met["id"] == roots["node"], "left").select("h", "id", "n", "p", F.coalesce("root", "id").alias("root"))
    left = scratch.cut(left, f"{name}-left")
    mixed = left.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo < hi").select("h")
    return star, scratch.cut(left.join(scratch.cut(mixed, f"{name}-mixed"), "h", "left_semi"), f"{name}-apart")


def _rare_first(texts: DataFrame, ids: DataFrame, scratch: Scratch) -> DataFrame:
    """(h, id, n, p): the first shingles of the texts with these ids, those first that the fewest of these texts have, so that
    what unrelated texts share comes last; shingles of one text are left out, since they meet no other."""
    sets = _sets(texts, ids, scratch, "hot")
    each = sets.select("id", "n", F.explode("s").alias("h"))
    ranked = each.join(each.groupBy("h").agg(F.count("*").alias("df")), "h").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("df", "h"))).alias("s"))
    first = F.slice("s", F.lit(1), (F.floor(F.col("n") / PARTS) + 1).cast("int"))
    return ranked.select("id", "n", F.posexplode(first).alias("p", "s")).filter("s.df > 1").select("s.h", "id", "n", "p")


def _met(left: DataFrame, texts: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Pairs (u, v), some of them repeated, of different components that can be near copies, from their first common shingle in the common order.

    There, what is left of either text holds all that they share; and no shingle of these rows that comes before is common to
    both, of which the last few are compared. Both are certain of near copies at that shingle, and short sketches are
    compared within the join too, so few pairs that can't be near copies leave a row."""
    ids = scratch.cut(left.select("id").distinct(), f"{name}-ids")
    before = {f"before{k}": F.lag("h", k).over(Window.partitionBy("id").orderBy("p")) for k in range(1, BEFORE + 1)}
    rows = left.withColumns(before).join(_short(texts, ids, scratch, name), "id")
    rows = scratch.cut(rows, f"{name}-rows")
    a, b = (rows.select("h", *(F.col(c).alias(f"{c}_{s}") for c in rows.columns if c != "h")) for s in "ab")
    least = (F.col("n_a") + F.col("n_b")) * OF
    long = lambda s: (F.col(f"n_{s}") - F.col(f"p_{s}")) * (OF + PARTS) >= least
    met = reduce(Column.__or__, (F.coalesce(F.col(f"{x}_a") == F.col(f"{y}_b"), F.lit(False)) for x in before for y in before))
    both = reduce(Column.__add__, (F.bit_count(F.col(f"b{k}_a").bitwiseAND(F.col(f"b{k}_b"))) for k in range(SHORT)))
    likely = (F.least(F.col("n_a") - F.col("ones_a"), F.col("n_b") - F.col("ones_b")) + both) * (OF + PARTS) >= least  # as _may_be
    apart = (F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b"))
    return a.join(b, "h").filter(apart & _alike("n_a", "n_b") & long("a") & long("b") & ~met & likely).select(F.col("id_a").alias("u"), F.col("id_b").alias("v"))


def near_links(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """Links (u, v) between hashes of texts: near copies only, and enough of them that their components are those of all
    pairs of near copies. Null texts and those without words have no links.

    Texts of a shingle that more than HOT of them still share get new prefixes by how many of them have each shingle. A
    pair that shares such a shingle is judged by the new prefixes, any other by the old ones, and either count is whole."""
    texts = _texts(docs)
    star, left = _stars(_prefixes(texts, _common(texts)), texts, None, scratch, "star")
    hot = scratch.cut(left.groupBy("h").agg(F.count("*").alias("n")).filter(F.col("n") > HOT).select("h"), "hot")
    if hot.isEmpty():
        return star.union(_verified(_met(left, texts, scratch, "met").distinct(), texts, scratch, "rest"))
    ids = scratch.cut(left.join(hot, "h", "left_semi").select("id").distinct(), "hot-ids")
    star, again = _stars(_rare_first(texts, ids, scratch), texts, star, scratch, "rare")
    pairs = _met(left.join(hot, "h", "left_anti"), texts, scratch, "met").union(_met(again, texts, scratch, "met-again")).distinct()
    return star.union(_verified(pairs, texts, scratch, "rest"))
