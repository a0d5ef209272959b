"""The training-data operators against brute force on small fixtures, with nulls, ties, repeats and odd columns."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkgraph.llm import chat, decontamination, embeddings, langid, licenses, lines, mixing, quality, sharding, simhash
from inkgraph.llm.common import Scratch, key_of, maybe_in, without
from inkgraph.llm.graph import components
from inkgraph.llm.registry import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [(1, "Under the MIT License.", "x"), (2, None, None), (3, "", "x"), (3, "", "x"), (None, "one two three", None), (5, " é \U0001f600 A", "b"), (6, "a b c d e f g h i j k l", "b"), (6, "a b c d e f g h i j k l", "b")]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({c: F.lit("clash") for c in ("size", "n", "key", "label", "place", "line", "fp", "w", "row", "root", "times", "gone", "_key")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def test_filter_of_ids_loses_no_row(spark, odd, empty, monkeypatch):
    """It lets every id through, and little else unless it is full; without() equals a plain anti join either way."""
    rows = spark.range(-2000, 2000).select(F.col("id").alias("x"), F.lit("mine").alias("row"), F.lit(1).alias("map"))
    ids = rows.filter("x % 7 = 0").select(F.col("x").alias("id")).union(spark.createDataFrame([(None,)], "id long"))
    for bits in (1 << 26, 1 << 4):
        monkeypatch.setattr("inkgraph.llm.common.FILTER_BITS", bits)
        got = maybe_in(rows, F.col("x"), ids, Scratch(spark, "t"), "maps")
        assert got.count() == 4000 and got.filter("row.x % 7 = 0 and not maybe").count() == 0
        assert (got.filter("row.x % 7 <> 0 and maybe").count() < 10) == (bits > 16)
        for docs in (odd, empty):
            for gone in (docs.filter("doc_id is null or doc_id in (2, 6)"), docs.filter("false"), docs):
                keys = gone.select(key_of().alias("key")).distinct()
                want = docs.select(F.struct("*").alias("packed"), key_of().alias("of")).join(keys.select(F.col("key").alias("of")), "of", "left_anti").select("packed.*")
                left = without(docs, key_of(), keys, Scratch(spark, "t")).select("row.*")
                assert left.columns == docs.columns and Counter(map(tuple, left.collect())) == Counter(map(tuple, want.collect()))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_matches_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    cur = db.execute(ORACLE_SQL[name])
    want, names = cur.fetchall(), [c[0] for c in cur.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(repr, (tuple(r[n] for n in names) for r in got.collect()))) == sorted(map(repr, want))


def test_every_operator_is_registered():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES) == list(range(1, 11))


def test_components_of_a_long_path_and_a_star(spark):
    rows = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3), (41, 40)]
    got = components(spark.createDataFrame(rows, "u long, v long"), Scratch(spark, "t")).collect()
    assert Counter(r["root"] for r in got) == {0: 42, 100: 60}


# 1

def test_license_rules_suppress_and_count(spark, odd, empty):
    assert 190 < len(licenses.rules()) == len(set(licenses.rules()))
    assert all(keyword in {w for part in phrase.split() for w in part.split("|")} for _, keyword, _, _, phrase in licenses.signatures())
    texts = ["Under the MIT License; under the mit license", "GNU General Public License, version 3.", "licensed under cc-by-nc-sa 4.0", "Apache License, Version 2.0", "nothing here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.licenses(df).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["n_words"]) == (2, 0, 4, 8)
    assert got[1]["labels"] == "gpl-3" and got[1]["n_base"] == 0
    assert got[2]["base_labels"] == "cc-by-nc" and "cc-by-nc-sa-4" in got[2]["labels"]
    assert "apache-2" in got[3]["labels"] and got[4]["labels"] == "" and got[4]["score"] == 0
    assert licenses.licenses(odd).count() == len(ODD) and licenses.licenses(empty).count() == 0
    clash = odd.withColumns({"_hits": F.lit("mine"), "form": F.lit("mine"), "x.y": F.lit("mine")})
    assert {tuple(r) for r in licenses.scan(clash).select("_hits", "form", "`x.y`").collect()} == {("mine",) * 3}


def test_bare_license_names_match_as_in_sql(spark, tmp_path):
    import duckdb

    texts = ["GPL v3", "Apache 2.0", "LGPL 2.1", "AGPL v3", "Artistic 2", "Open Database 1", "GNU Free Documentation 1.3", "no name at all", None, "word " * 30_000 + "mit license"] + [licenses.example(phrase) for *_, phrase in licenses.signatures()]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in licenses.licenses(df).collect()}
    assert [got[k]["labels"] for k in range(9)] == ["gpl-3", "apache-2", "lgpl-2", "agpl-3", "artistic-2", "odbl-1", "gfdl-1", "", ""] and got[0]["score"] == 0.8
    assert got[9]["labels"] == "mit" and all(label in {x["label"] for x in found} for (label, *_), found in zip(licenses.signatures(), [r["found"] for r in licenses.scan(df.filter("doc_id > 9")).orderBy("doc_id").collect()], strict=True))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    cur = duckdb.connect().execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'").execute(licenses.SQL)
    names = [c[0] for c in cur.description]
    assert sorted(map(repr, cur.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in got.values())


# 2

def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def within_edits(a, b, k):
    """Whether k edits at most part two texts, by trying each edit where they first differ."""
    n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    a, b = a[n:], b[n:]
    if not a or not b or not k:
        return max(len(a), len(b)) <= k
    return within_edits(a[1:], b[1:], k - 1) or within_edits(a[1:], b, k - 1) or within_edits(a, b[1:], k - 1)


def classes_of(names, linked):
    """The least name of each name's class, by brute force over all pairs."""
    parent = {x: x for x in names}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in names:
        for b in names:
            if a < b and find(a) != find(b) and linked(a, b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {x: find(x) for x in names}


def test_line_dedup_against_brute_force(spark, odd, empty):
    a, b = "the quick brown fox jumps over", "a rather long other line of text"
    docs = [(1, f"{a}\n{b}\nshort"), (2, f"{a}!\nnew line number one here\n\n"), (3, f"{b[:10]}{b[11:]}\nshort"), (4, f"{a[:5]}X{a[6:]}\n{a[:5]}X{a[6:]}"), (5, None), (6, "short\nshor"), (7, "lone\n\nother"), (7, "lone\n\nother"), (None, "lone"), (8, ""), (8, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("x.y", F.lit(1))
    got = sorted(((r["doc_id"] or 99, str(r["text"])) for r in lines.dedup_lines(df).collect()))
    assert got == [(1, f"{a}\n{b}\nshort"), (2, "new line number one here\n\n"), (3, ""), (4, ""), (5, "None"), (6, "shor"), (7, ""), (7, "lone\n\nother"), (8, ""), (8, ""), (99, "")]
    seen = sorted(tuple(-1 if x is None else x for x in r) for r in lines.summary(df).collect())
    assert seen == [(-1, 1, 1, 0, 0), (1, 3, 0, 0, -1), (2, 4, 1, 1, 0), (3, 2, 2, 1, 0), (4, 2, 2, 2, 0), (5, 0, 0, 0, -1), (6, 2, 1, 0, 0), (7, 3, 0, 0, -1), (7, 3, 2, 0, 0), (8, 1, 0, 0, -1), (8, 1, 0, 0, -1)]
    assert lines.dedup_lines(empty).count() == 0
    assert sorted((str(r["doc_id"]), r["n_dropped"]) for r in lines.summary(odd).collect()) == [("1", 0), ("2", 0), ("3", 0), ("3", 0), ("5", 0), ("6", 0), ("6", 1), ("None", 0)]


def test_blank_lines_are_told_without_rewriting_lines(spark, capsys):
    blank = [" ", "\t", "\r", "\f", "\u000b", "", " \t\r\f\u000b "]
    df = spark.createDataFrame([(1, "\n".join([*blank, "\u00a0", " x ", "\ty"])), (2, None)], "doc_id long, text string")
    filled = lines._filled(df)
    assert [(r["pos"], r["line"]) for r in filled.collect()] == [(7, "\u00a0"), (8, " x "), (9, "\ty")]
    filled.explain()
    assert "translate(" not in capsys.readouterr().out  # it takes every character of every line to a new string


@pytest.mark.parametrize("edits", [1, 2])
def test_edit_classes_equal_brute_force(spark, edits):
    """Random lines with edits, short and long ones, and four hundred lines that are all near each other."""
    import random

    rng = random.Random(5)
    words = set()
    for _ in range(40):
        base = "".join(rng.choice("abcd") for _ in range(rng.choice([3, 19, 20, 21, 24, 39, 41, 60])))
        for _ in range(6):
            s = list(base)
            for _ in range(rng.randint(0, 3)):
                k = rng.randrange(len(s))
                rng.choice([lambda s=s, k=k: s.pop(k) if len(s) > 2 else None, lambda s=s, k=k: s.insert(k, "z"), lambda s=s, k=k: s.__setitem__(k, "\u00e9")])()
            words.add("".join(s))
    one = "x" * 30 + "".join(rng.choice("mnopq") for _ in range(70))
    places = range(0, 100, 1 if edits == 1 else 12)
    words |= {one[:k] + c + one[k + 1 :] for k in places for c in "12"} | {one[:k] + c + one[k:] for k in places for c in "34"} | {one[:k] + one[k + 1 :] for k in places}
    words |= {one[:50] + "".join(rng.choice("rstuv") for _ in range(50)) for _ in places}  # half a line in common, no more
    words = sorted(words)
    near = lambda i, j: abs(len(words[i]) - len(words[j])) <= edits and within_edits(words[i], words[j], min(edits, min(len(words[i]), len(words[j])) // 20))
    df = spark.createDataFrame(list(enumerate(words)), "id long, line string")
    scratch = Scratch(spark, "t")
    found = lines.edit_links(df, scratch, edits)
    pairs = [tuple(r) for r in found.collect()]
    assert all(near(*p) for p in pairs)
    roots = {r["node"]: r["root"] for r in components(found, scratch).collect()}
    assert {i: roots.get(i, i) for i in range(len(words))} == classes_of(range(len(words)), near)
    if edits == 1:
        assert len(pairs) < 30 * len(words)


def test_banded_distance(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab\U0001f600") for _ in range(rng.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(600)]
    df = spark.createDataFrame(pairs, "a string, b string")
    for edits in (1, 2, 4):
        for r in df.select("a", "b", lines.within(F.col("a"), F.col("b"), edits).alias("d")).collect():
            want = edits_between(r["a"], r["b"])
            assert r["d"] == (want if want <= edits else None), (r, want)


def test_a_very_long_line(spark):
    text = "".join(chr(97 + k * k % 23) for k in range(60_000))
    df = spark.createDataFrame([(k, text[:k] + "!" + text[k:]) for k in range(12)] + [(50, text)], "doc_id long, text string")
    assert sorted(r["n_dropped"] for r in lines.summary(df).collect()) == [0] + [1] * 12


# 3

def test_language_id(spark, odd, empty):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lists = langid.profiles(docs.filter(~langid.held_out()))
    got = {r["doc_id"]: r for r in langid.identify(docs, lists).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i]["lang_pred"] == truth[i] for i in held) / len(held) > 0.97
    assert {r["lang_pred"] for r in langid.identify(odd.filter("text is null or text = ''"), lists).collect()} == {"und"}
    assert langid.identify(empty, lists).count() == 0 and langid.profiles(empty.withColumn("lang", F.lit("x"))) == {}
    codes, counts = langid.grams("ab, Ab")
    assert dict(zip(codes.tolist(), counts.tolist()))[ord("a")] == 2 and counts.sum() == 4 + 6 + 4


@pytest.mark.parametrize("languages", [2, 1500])
def test_every_language_is_learned(spark, languages):
    """Letters of its own for each language; distances equal a plain count of places, term by term."""
    letters = lambda k: chr(0x4E00 + 3 * k) + chr(0x4E01 + 3 * k) + chr(0x4E02 + 3 * k)
    docs = spark.createDataFrame([(k, f"{letters(k)} {letters(k)[::-1]}", f"l{k:05d}") for k in range(languages)], "doc_id long, text string, lang string")
    lists = langid.profiles(docs)
    assert len(lists) == languages
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, lists).collect()}
    assert got == {k: f"l{k:05d}" for k in range(languages)}


def test_distances_equal_a_plain_count(spark):
    """Out-of-place distances with dictionaries, for every document and language of the smallest tables."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    lists = langid.profiles(docs.filter(~langid.held_out()))

    def plain(text):
        low = "".join(c if c.isalpha() else " " for c in (text or "").lower())
        counts = Counter()
        for w in low.split():
            counts.update(w)
            edged = f" {w} "
            counts.update(edged[k : k + 2] for k in range(len(edged) - 1))
            counts.update(edged[k : k + 3] for k in range(len(edged) - 2))
        return counts

    def code(gram):
        p = [ord(c) for c in gram]
        return p[0] if len(p) == 1 else (p[0] << 21 | p[1]) | 1 << 62 if len(p) == 2 else p[0] << 42 | p[1] << 21 | p[2]

    want, ranks = {}, {k: {c: at for at, c in enumerate(v)} for k, v in lists.items()}
    for r in docs.collect():
        own = [code(g) for g, _ in sorted(plain(r["text"]).items(), key=lambda x: (-x[1], code(x[0])))[: langid.TOP]]
        away = {k: sum(min(langid.TOP, abs(v.get(g, 10**6) - at)) for at, g in enumerate(own)) for k, v in ranks.items()}
        best = min(away, key=lambda k: (away[k], k)) if own else "und"
        want[r["doc_id"]] = (best, 1 - away[best] / (langid.TOP * len(own)) if own else 0.0)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, lists).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


# 4

def test_mix_targets_and_nearness(spark, odd, empty):
    totals = spark.createDataFrame([("a", 100), ("b", 10), (None, 50), ("\U0001f600", 0)], "source string, n long")
    t = {r["source"]: r["target"] for r in mixing.targets(totals, [1, 2, 3], Scratch(spark, "t")).collect()}
    assert abs(sum(t.values()) - 160) < 1e-9 and t["b"] == 30 and t["\U0001f600"] == 0
    one = spark.range(100).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") < 50, "s").otherwise("t").alias("source"), F.when(F.col("id") == 99, "").otherwise("w " * 10).alias("text"))
    rows = mixing.mix(one).collect()
    for s in {r["target"] for r in rows}:
        assert abs(sum(r["taken"] for r in rows if r["target"] == s) - s) <= 10
    assert len(rows) == 100 and max(r["times"] for r in rows) <= 3 and mixing.apply_mix(one).count() == sum(r["times"] for r in rows)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, None).otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"))
    rows = mixing.mix(docs).collect()
    for s in {r["source_size"] for r in rows}:
        own = [r for r in rows if r["source_size"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 17 and all(r["taken"] <= 3 * r["size"] for r in own)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, mixing.mix(docs.repartition(7)).collect()))
    assert mixing.mix(odd).count() == len(ODD) and mixing.mix(empty).count() == 0
    kept = mixing.apply_mix(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r["times"] for r in rows)
    assert mixing.apply_mix(empty).count() == 0


# 5

def test_chat_round_trip(spark):
    texts = ["\\", "<turn>", "</turn>\n<turn>user\n", "\\l < \\\\n \n", "", "é😀 x", "  lead", "a\\\\lb"]
    rows = [(1, k, "assistant" if k % 2 else "us<er\n", t) for k, t in enumerate(texts)] + [(2, None, None, None), (2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (None, 1, "assistant", chat.PROBE)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("ids", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digest(chat.formatted(df)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("".join(f"{'assistant' if k % 2 else 'us<er' + chr(10)}\n{t}\n" for k, t in enumerate(texts)))
    assert got[1]["loss_sha256"] == sha("".join(texts[1::2])) and got[1]["n_turns"] == len(texts)
    assert got[2]["n_turns"] == 3 and got[2]["loss_sha256"] == sha("xx") and got[None]["loss_sha256"] == sha(chat.PROBE)
    assert chat.digest(chat.formatted(df.filter("false"))).count() == 0


# 6

def brute_hits(docs, items, width=10):
    rx = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = lambda t: rx.findall((t or "").translate(LOWER))
    wins = [(i, tuple(w[k : k + width])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - width + 1))]
    out = []
    for d, t in docs:
        w, hit, ids = words(t), set(), set()
        for i, win in wins:
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    ids.add(str(i))
        out.append((d, len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()))
    return sorted(map(repr, out))


def test_decontamination_against_brute_force(spark, odd, empty):
    long = "a b c d e f g h i j k l m n"
    items = [(1, long), (2, "x " + long), (10, "the the"), (3, ""), (4, None), (5, "b C d E f g h i j k"), (6, "the"), (7, "q " * 12)]
    docs = [(1, long), (2, "zz " + long.upper() + " yy"), (3, "the the the"), (4, None), (5, "b c d e f g h i j k"), (6, "q " * 30), (7, "a b c d e f g h i X k l m n"), (8, "b c d e f g h i j"), (8, "other"), (None, long)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r)[:5] for r in decontamination.contamination(d, b).collect()]
    assert sorted(map(repr, got)) == brute_hits(docs, items)
    near = {r["doc_id"]: r["n_near"] for r in decontamination.contamination(d, b).collect()}
    assert near[7] > 0
    assert decontamination.contamination(odd, b).count() == len(ODD) and decontamination.contamination(empty, b).count() == 0
    assert decontamination.contamination(odd, b.filter("false")).filter("contaminated").count() == 0
    kept = decontamination.clean(d, b)
    assert kept.columns == d.columns and sorted(r["doc_id"] for r in kept.collect()) == [4, 7, 8, 8]


def test_decontamination_with_an_item_id_of_several_texts(spark):
    a, b, c = ("a b c d e f g h i j k l", "m n o p q r s t u v w x", "zz m n o p q r s t u v w")
    items = [(1, a), (1, b), (1, "the"), (2, c), (3, b), (1, a)]
    docs = [(1, a), (2, b), (3, "one the two"), (4, c), (5, "a b c d e f g h i j"), (6, f"{a} {b}"), (7, "q")]
    for turned in (items, items[::-1]):
        d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(turned, "item_id long, text string")
        got = [tuple(r)[:5] for r in decontamination.contamination(d, t).collect()]
        assert sorted(map(repr, got)) == brute_hits(docs, items)
        assert [r["doc_id"] for r in decontamination.clean(d, t).collect()] == [7]


# 7

def test_simhash_against_brute_force(spark, odd, empty):
    import random

    rng = random.Random(3)
    base = [rng.getrandbits(64) for _ in range(20)]
    fps = base + [b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base] + [b ^ (7 << 60) for b in base[:5]] + [base[0] ^ (1 << k) for k in range(64)] + [0, 1, 3, 7, 15, 31]
    fps = list(dict.fromkeys(fps))
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for threshold in (1, 2):
        parent = {f: f for f in fps}

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a in fps:
            for b in fps:
                if (a ^ b).bit_count() <= threshold:
                    parent[find(a)] = find(b)
        want = Counter(Counter(find(f) for f in fps).values())
        roots = {r["node"]: r["root"] for r in components(simhash.links(df, threshold), Scratch(spark, "t")).collect()}
        assert Counter(Counter(roots.get(simhash._signed(f), simhash._signed(f)) for f in fps).values()) == want
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.classes(odd).collect()}
    assert {(2, "0" * 16, 2), (3, "0" * 16, 2)} <= got and simhash.classes(odd).count() == len(ODD) and simhash.classes(empty).count() == 0
    kept = simhash.keep_one(odd)
    assert kept.columns == odd.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "2", "5", "6", "None"]


def test_keep_one_judges_a_repeated_id_in_each_component(spark):
    docs = [(2, "alpha beta gamma delta"), (5, "ALPHA beta gamma delta"), (5, "some wholly other words here"), (5, "some wholly other words here"), (7, "some wholly other Words here"), (None, "alpha beta gamma delta"), (None, "lone text without id"), (None, "lone text without id")]
    got = simhash.keep_one(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [docs[0], docs[2], docs[6]]))


def test_unrelated_texts_with_one_passage_are_not_paired(spark, monkeypatch):
    """400 texts share a passage that no sample has seen, and ten of them have a near copy: few pairs are looked at."""
    import random

    from inkgraph.llm import near

    monkeypatch.setattr(near, "MOST_COMMON", 0)
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    passage, texts = [word() for _ in range(12)], []
    for k in range(400):
        own = [word() for _ in range(90)]
        texts.append(own + passage)
        if k < 10:
            texts.append([*own[:-1], word(), *passage][1:])
    looked = []
    monkeypatch.setattr(near, "_verified", lambda pairs, *a, f=near._verified: looked.append(pairs.count()) or f(pairs, *a))
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    sets = [{tuple(t[k : k + 5]) for k in range(len(t) - 4)} for t in texts]
    want = sum(5 * len(a & b) >= 4 * len(a | b) for k, a in enumerate(sets) for b in sets[:k])
    assert near.near_links(df, Scratch(spark, "t")).distinct().count() == want > 0
    assert sum(looked) < 2000


def test_pairs_meet_once_and_only_if_they_may_be_near(spark):
    """Of 30 texts with 40 of 120 words changed in one and two near copies, which share many prefix shingles, few pairs are made."""
    import random

    from inkgraph.llm import near

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(120)]
    texts = [base[:60] + [word() for _ in range(40)] + base[100:] for _ in range(30)]
    texts += [[*texts[0][:-1], word()], [word(), *texts[1][1:]]]
    scratch = Scratch(spark, "t")
    df = near._texts(spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string"))
    left = near._prefixes(df, []).withColumn("root", F.col("id"))
    pairs = [tuple(sorted(r)) for r in near._met(left, df, scratch, "met").collect()]
    ids = [r["id"] for r in df.collect()]
    assert {tuple(sorted((ids[0], ids[30]))), tuple(sorted((ids[1], ids[31])))} <= set(pairs) and len(pairs) < 20


@pytest.mark.parametrize("hot", [200, 1])
def test_near_copies_against_brute_force(spark, monkeypatch, hot):
    """Texts with changed words, a large group, a common passage and copies: all components by five-word Jaccard >= 4/5."""
    import random

    from inkgraph.llm import near

    monkeypatch.setattr(near, "HOT", hot)
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    common = [word() for _ in range(30)]
    texts = []
    for size in [3, 5, 6, 30, 60, 100, 200, 200] * 4:
        base = [word() for _ in range(size)] + (common if size > 90 else [])
        texts.append(base)
        for changes in (1, 2, 3, 4, 6):
            texts.append([word() if k in set(rng.sample(range(len(base)), min(changes, len(base)))) else w for k, w in enumerate(base)])
    base = [word() for _ in range(120)]
    for _ in range(40):
        base = list(base)
        base[rng.randrange(120)] = word()
        texts.append(base)
    docs = [(k, " ".join(w)) for k, w in enumerate(texts)] + [(900, None), (901, ""), (902, " ".join(texts[30]).upper()), (903, " ".join(texts[30]))]
    sets = {d: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for d, t in docs if (w := (t or "").lower().split())}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    far = 0
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
                far += (simhash.fingerprint(dict(docs)[a]) ^ simhash.fingerprint(dict(docs)[b])).bit_count() > 2
    assert far > 50
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: r["component_id"] for r in simhash.classes(df, 0).collect()}
    assert {d: got[d] for d in sets} == {d: find(d) for d in sets} and got[900] == got[901] == 900
    assert sorted(r["doc_id"] for r in simhash.keep_one(df, 0).collect()) == sorted({find(d) for d in sets} | {900})
    assert len(near.shingles("a b c")) == 1 and len(near.shingles("")) == 0


def test_fingerprint_equals_the_plain_rule(spark):
    """Bit by bit over every shingle, repeats included, for whole texts."""
    import xxhash

    def plain(text):
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(LOWER)) if w]
        if not words:
            return 0
        parts = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or [" ".join(words)]
        h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    texts = [r["text"] for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()] + [t for _, t, _ in ODD] + ["A b", "a\u00a0b c d", "x " * 700, "ÀB c d e"]
    assert [simhash.fingerprint(t) for t in texts] == [plain(t) for t in texts]


# 8

def test_embeddings_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.standard_normal((120, 32))
    x = np.concatenate([base, base[:60] + 0.12 * rng.standard_normal((60, 32)), base[:10] * 3, base[:1].repeat(40, 0) + 0.08 * rng.standard_normal((40, 32)), base[:5]])
    rows = [(i, v.astype("float32").tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 32), (902, [float("nan")] * 32), (903, [None] + [1.0] * 31)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit("clash"))
    got = {r["vec_id"]: r for r in embeddings.classes(df).collect()}
    u = x.astype("float32").astype("float64")
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    want = s.sum(axis=1) - 1
    found = sum(got[i]["n_links"] for i in range(len(x)))
    assert 0.9 * want.sum() <= found <= want.sum() and all(got[i]["n_links"] <= want[i] for i in range(len(x)))
    assert all(got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"] for i in (900, 901, 902, 903))
    assert len(got) == len(rows) and embeddings.classes(df.filter("false")).count() == 0
    mixed = spark.createDataFrame([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [1.0, 2.0, 0.0]), (None, [2.0, 4.0, 0.0]), (5, [])], "vec_id long, embedding array<double>")
    assert sorted((str(r["vec_id"]), r["n_links"], r["component_id"]) for r in embeddings.classes(mixed).collect()) == [("1", 1, 1), ("2", 1, 1), ("3", 1, 3), ("5", 0, 5), ("None", 1, 3)]


# 9

def test_quality_fit_holds_little_beside_its_rows():
    """Features that tell nothing are counted and left: no array of all of them is made on the driver."""
    import tracemalloc

    import numpy as np

    rng = np.random.default_rng(1)
    rows = [(np.append(rng.integers(16, 1 << 10, 400), 7 - 2 * (k % 2)).astype(np.int32), 2 * (k % 2)) for k in range(1500)]
    tracemalloc.start()
    model = quality.fit(rows, bits=10, steps=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8 * sum(len(f) for f, _ in rows), "less than one long for each feature of the rows"
    assert model.weights[7] < 0 < model.weights[5] and not model.weights[:5].any()


def test_quality_separates_held_out_grades(spark, odd, empty):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("aeioubcdlmnrst") for _ in range(rng.randint(2, 7)))
    good = lambda: " ".join(word() for _ in range(80)) + "."
    poor = lambda: " ".join(word() + "***" for _ in range(80))
    toxic = lambda: good() + " idiot moron " + good()
    made = [(quality.features(f()), g) for g, f in ((0, toxic), (1, poor), (2, good)) for _ in range(80)]
    model = quality.fit(made)
    assert model.thresholds == sorted(model.thresholds)
    tail = lambda t: model.tails(model.score(quality.features(t)))[-1]
    assert sum(tail(good()) > 0.5 for _ in range(40)) > 36 and sum(tail(f()) < 0.5 for f in (poor, toxic) for _ in range(20)) > 36
    out = quality.grade(odd, model)
    assert out.count() == len(ODD) and set(odd.columns) <= set(out.columns) and quality.grade(empty, model).count() == 0
    labels = spark.createDataFrame([(1, 1, 0), (1, 1, 1), (None, 1, 1), (6, None, None), (77, 1, 0)], "doc_id long, quality int, toxic int")
    assert [g for _, g in quality.training_rows(odd, labels)] == [0]
    hot = spark.range(300).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("t "), "id").alias("text")).union(spark.range(50).select("id", F.lit("x")))
    many = spark.range(40).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    assert len(quality.training_rows(hot, many, max_train=10)) == 10
    clash = odd.withColumns({"tail": F.lit("mine"), "kept": F.lit("mine"), "x.y": F.lit(1)})
    assert {tuple(r) for r in quality.graded(clash, model).select("row.tail", "row.kept", "row.`x.y`").collect()} == {("mine", "mine", 1)}
    assert quality.train(odd, labels.filter("false")).tails(0.0)[-1] < 0.5 and quality.train(empty, labels).thresholds


# 10

def test_sharding_laws(spark, odd, empty):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
    rows = sharding.assign(docs).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
        assert r["size"] == len(f"text {r['doc_id'] % 50}") + 16 and r["text_crc32"] == zlib.crc32(f"text {r['doc_id'] % 50}".encode())
        assert r["grown_shard"] in (r["shard"], 40)
    assert set(by) <= set(range(40)) and all(sorted(v) == list(range(len(v))) for v in by.values())
    part = {r["doc_id"]: r["shard"] for r in sharding.assign(docs.filter("doc_id % 3 = 0")).collect()}
    assert all(part[r["doc_id"]] == r["shard"] for r in rows if r["doc_id"] in part)
    again = {r["doc_id"]: r["shard"] for r in sharding.assign(docs, 41).collect()}
    assert all(again[r["doc_id"]] == r["grown_shard"] for r in rows)
    counts = Counter(sharding.shard_map(40))
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sharding.assign(odd).count() == len(ODD) and sharding.assign(empty).count() == 0


def test_sharding_by_bytes(spark):
    """One very large document a few slots share: the map is edited by bytes per slot."""
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), F.when(F.col("id") < 20, 4000).otherwise(60)).alias("text"))
    by = {law: Counter() for law in ("key", "bytes")}
    for law, held in by.items():
        for r in sharding.assign(docs, 8, 512, law).collect():
            held[r["shard"]] += r["size"]
            assert (r["grown_shard"] is None) == (law == "bytes")
    assert max(by["bytes"].values()) <= 1.1 * sum(by["bytes"].values()) / 8 and max(by["bytes"].values()) <= max(by["key"].values())


def test_sharding_numbers_a_hot_key_in_parts(spark):
    """Null ids with one text, null ids with many texts, and others: slots are gapless and every row stays."""
    hot = spark.range(9000).select(F.lit(None).cast("long").alias("doc_id"), F.when(F.col("id") % 9 > 0, "copy").otherwise(F.concat(F.lit("t"), "id")).alias("text"))
    rows = sharding.assign(hot.union(spark.range(500).select("id", F.lit(None).cast("string")))).collect()
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert len(rows) == 9500 and all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sum(r["doc_id"] is None and r["text_crc32"] == zlib.crc32(b"copy") for r in rows) == 8000
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1


def test_rebalance_and_map_table(spark):
    owners = sharding.shard_map(4, 64)
    loads = [1000 if k < 4 else 10 for k in range(64)]
    after = sharding.rebalance(owners, loads)
    total = lambda m: [sum(x for x, o in zip(loads, m, strict=True) if o == s) for s in range(4)]
    assert max(total(after)) <= max(total(owners)) and max(total(after)) <= 1.2 * sum(loads) / 4
    assert sharding.map_table(spark, [(1, owners), (2, after)]).groupBy("version").count().count() == 2
    docs = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    assert sharding.slot_bytes(docs).agg(F.sum("bytes")).first()[0] == 1600


# pipeline

def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    scratch, seen = Scratch(spark, "t"), docs
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.cut(stage(spark, seen, FOLDER), name)
        if name != "sharding":
            assert out.columns == docs.columns
        if name == "near_dedup":
            want = {r["component_id"] for r in simhash.classes(seen).collect()}
            assert sorted(want) == sorted(r["doc_id"] for r in out.collect())
        if name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").select("item_id", "text").collect()]
            hits = [eval(x) for x in brute_hits([(r["doc_id"], r["text"]) for r in seen.collect()], items)]  # noqa: S307
            assert sorted(h[0] for h in hits if not h[2]) == sorted(r["doc_id"] for r in out.collect())
        if name == "mixing":
            assert out.count() == mixing.mix(seen).agg(F.sum("times")).first()[0]
        if name == "sharding":
            assert out.count() == seen.count()
        seen = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, FOLDER).collect())) == sorted(map(tuple, seen.collect()))


def test_pipeline_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows and clashing names, stage after stage; and an empty table."""
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = ("tail", "kept", "row", "key", "copy", "place", "times", "shard", "gone", "x.y")
    odd = docs.unionByName(docs.limit(3)).unionByName(spark.createDataFrame([(None, None, None, None, None), (None, None, None, None, None), (-1, "", "en", None, 0), (-2, "plain words of a long text " * 20_000, "en", "web", 1)], docs.schema))
    odd = odd.withColumns({n: F.lit("mine") for n in names})
    scratch = Scratch(spark, "t")
    for name, stage in corpus_pipeline.STAGES:
        out = scratch.cut(stage(spark, odd, FOLDER), name)
        assert stage(spark, odd.filter("false"), FOLDER).count() == 0
        if name != "sharding":
            assert out.columns == odd.columns and out.filter("tail <> 'mine' or kept <> 'mine' or `x.y` <> 'mine'").count() == 0
            assert name == "mixing" or out.count() > 50
