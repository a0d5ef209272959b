"""Greedy near dedup against the rule applied one row after another."""

import random

import pytest

from inkgraph.operators import funnel

SCHEMA = "i long, k string"


def greedy(rows, threshold, prefix):
    kept, out = [], set()
    for i, k in sorted(rows):
        if not k:
            out.add(i)
        elif not any(x[:prefix] == k[:prefix] and len(x) == len(k) and (int(x, 16) ^ int(k, 16)).bit_count() <= threshold for x in kept):
            kept.append(k)
            out.add(i)
    return out


def made(n, centres, flips, digits=16, seed=1):
    """Keys around a few centres, so that most of them are near others but not all of a group are near each other."""
    rng = random.Random(seed)
    bits = 4 * digits
    around = [rng.getrandbits(bits) for _ in range(centres)]
    keys = []
    for _ in range(n):
        k = rng.choice(around)
        for _ in range(rng.randint(0, flips)):
            k ^= 1 << rng.randrange(bits - 12)
        keys.append(f"{k:0{digits}x}")
    rows = [*enumerate(keys), (n, None), (n + 1, ""), (n + 2, keys[0]), (n + 3, keys[1][: digits // 2])]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(
    ("threshold", "prefix", "digits", "paired"),
    [(3, 4, 16, 1000), (3, 4, 16, 2), (1, 2, 16, 3), (0, 4, 16, 1000), (5, 3, 8, 2), (3, 0, 16, 5), (24, 2, 16, 1000), (3, 4, 20, 2)],
)
def test_equals_the_greedy_rule(spark, monkeypatch, threshold, prefix, digits, paired):
    monkeypatch.setattr(funnel, "PAIRED", paired)
    rows = made(150, 6, 5, digits)
    got = funnel.near_dedup(spark.createDataFrame(rows, SCHEMA), "k", "i", threshold, prefix)
    assert got.columns == ["i", "k", "kept"] and got.count() == len(rows)
    assert {r["i"] for r in got.filter("kept").collect()} == greedy(rows, threshold, prefix)


def test_a_large_group_of_near_copies_is_not_paired(spark, monkeypatch):
    """400 keys within three bits of one: its first settles them all, so no pairs are left to make."""
    monkeypatch.setattr(funnel, "PAIRED", 50)
    rng = random.Random(3)
    keys = {0} | {sum(1 << b for b in rng.sample(range(48), rng.randint(1, 3))) for _ in range(400)}
    rows = [(0, "0" * 16), *((k + 1, f"{x:016x}") for k, x in enumerate(sorted(keys - {0})))]
    made = []
    monkeypatch.setattr(funnel, "_paired", lambda cut, t, f=funnel._paired: made.append(f(cut, t)) or made[-1])
    assert {r["i"] for r in funnel.near_dedup(spark.createDataFrame(rows, SCHEMA), "k", "i").filter("kept").collect()} == {0}
    assert made[0].count() == 0


def test_keys_are_computed_once(spark):
    """A key may be dear, such as the profile of a text; the calls are counted as the result is made and read."""
    from pyspark.sql import functions as F

    calls = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def key(i):
        calls.add(1)
        return f"{i * 7919 % 2**60:016x}"

    rows = spark.range(0, 300, 1, 2).select(F.col("id").alias("i"), key("id").alias("k"))
    got = {r["i"] for r in funnel.near_dedup(rows, "k", "i").filter("kept").collect()}
    assert calls.value == 300 and got == greedy([(i, f"{i * 7919 % 2**60:016x}") for i in range(300)], 3, 4)


def test_chains_and_empty_tables(spark):
    """Of a chain in which each is near the next alone, every second key stays."""
    chain = [(k, f"{(1 << 3 * k) - 1:016x}") for k in range(12)]
    got = funnel.near_dedup(spark.createDataFrame(chain, SCHEMA), "k", "i")
    assert {r["i"] for r in got.filter("kept").collect()} == set(range(0, 12, 2)) == greedy(chain, 3, 4)
    assert funnel.near_dedup(spark.createDataFrame([], SCHEMA), "k", "i").count() == 0


def test_pairs_equal_all_pairs(spark, monkeypatch):
    keys = sorted({(k, i) for i, k in made(120, 4, 4) if k and len(k) == 16})
    first = {}
    for k, i in keys:
        first.setdefault(k, i)
    want = {(u, v) for u in first for v in first if first[u] < first[v] and u[:4] == v[:4] and (int(u, 16) ^ int(v, 16)).bit_count() <= 3}
    for paired in (1000, 2):
        monkeypatch.setattr(funnel, "PAIRED", paired)
        got = funnel.near_pairs(spark.createDataFrame([(k, i) for k, i in first.items()], "key string, at long")).collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want) > 0


@pytest.mark.parametrize(("paired", "prefix"), [(1000, 2), (7, 0), (1, 1)])
def test_blocks_that_cannot_be_split_are_not_paired(spark, monkeypatch, paired, prefix):
    """Random keys at a threshold of more stretches than digits: each meets the kept ones of its block alone."""
    monkeypatch.setattr(funnel, "PAIRED", paired)
    rng = random.Random(9)
    rows = [(k, f"{rng.getrandbits(64):016x}") for k in range(300)]
    made = []
    monkeypatch.setattr(funnel, "_paired", lambda cut, t, f=funnel._paired: made.append(f(cut, t)) or made[-1])
    got = funnel.near_dedup(spark.createDataFrame(rows, SCHEMA), "k", "i", 24, prefix)
    assert {r["i"] for r in got.filter("kept").collect()} == greedy(rows, 24, prefix)
    assert all(pairs.count() == 0 for pairs in made)
