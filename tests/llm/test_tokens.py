"""Operators 11 to 13 against brute force and exact round trips, with nulls, repeats, odd texts and empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkgraph.llm import align, periodic, tokenfiles
from inkgraph.llm.common import Scratch, scratch_root
from inkgraph.llm.registry import QUERIES
from inkgraph.llm.vocabulary import BYTE_VOCABULARY, PIECE_VOCABULARY, ByteLevel, SentencePiece, content, pack

FOLDER = "/root/testdata/sf0.001"
TEXTS = [
    "", " ", "a", " a", "a ", "a  b", "a\n b", "a \nb", "a\n\nb c", "x.\ny z", "it's, don't. we'll!", "a\tb c\t d", "<|endoftext|> x <|endoftext|>.", "\n", "a\n", "\na b",
    "1,2. 3;4 a1.", "中文 文。 中", "a​ b", "﻿ a", "<s> </s> <unk> <0x41>", "▁ a▁b ▁", "\x00 \x01 a", "a\r\nb", "ﬁ ﬀ ①", "b \x1cx", "a \x85 b", "x\n'sy t's", "x<|endoftext|> y<|endoftext|>.", "a... b.. c!? d's. é.; 中. ", "é ́a", "word " * 300,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(k * 7 % 31, t) for k, t in enumerate(TEXTS)] + [(None, "no id here"), (3, None), (3, "x y"), (3, "x y"), (99, "a b c d " * 4000)]
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("part", "start", "ids", "groups", "runs", "file", "n_a", "count", "spread")})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="module")
def library():
    return ByteLevel(content(BYTE_VOCABULARY)), ByteLevel(content(BYTE_VOCABULARY), plain=True), SentencePiece(content(PIECE_VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab .,!$'\n\t1é中 \x1c<|>s", max_size=25), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(library, texts):
    for tool in library[:2]:
        assert tool.encode(texts) == [pack(tool.whole(t)) for t in texts]


def test_pieces_of_odd_texts_and_a_full_memory(library, monkeypatch):
    for limit in (600_000, 3):
        monkeypatch.setattr("inkgraph.llm.vocabulary.REMEMBERED", limit)
        for tool in library[:2]:
            assert tool.encode(TEXTS) == [pack(tool.whole(t)) for t in TEXTS] == tool.encode(TEXTS)
    assert library[0].encode(["<|endoftext|>"]) == [pack([50256])] != library[1].encode(["<|endoftext|>"])
    assert b"".join(library[0].bytes[i] for i in np.frombuffer(library[0].encode(["naïve 中文\n"])[0], "<u4")).decode() == "naïve 中文\n"


def test_pieces_of_arrow_texts_and_all_characters_remembered():
    tool = ByteLevel(content(BYTE_VOCABULARY))
    texts = pa.array([f"word{k} again{k}, again{k}!\nline{k} 中{k}" for k in range(500)] + ["", "one", " two  three "])[3:]
    assert tool.encode(texts) == [pack(tool.whole(t)) for t in texts.to_pylist()]
    assert tool.characters == sum(map(len, tool.ids))  # those cut from marks count, so the memory has its bound


def test_marks_after_a_word_take_no_room_in_memory(monkeypatch):
    monkeypatch.setattr("inkgraph.llm.vocabulary.REMEMBERED", 50)
    tool = ByteLevel(content(BYTE_VOCABULARY))
    first, second = ([f" {a}{k} {a}{k}, {a}{k}! {a}{k}?" for k in range(20)] for a in ("left", "right"))
    found, _ = tool.encode(first), tool.encode(second)
    assert found == [pack(tool.whole(t)) for t in first]
    monkeypatch.setattr(tool, "whole", None)  # all 20 words are known, so the library is not called again
    assert tool.encode(first) == found


# --- files --------------------------------------------------------------------------------------------------------


def expected(rows, tool):
    out, start = [], 0
    for r in sorted(rows, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = [*tool.library.encode(r["text"] or "", add_special_tokens=False).ids, 2]
        out.append((r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    return out


@pytest.mark.parametrize("frame_ids", [1 << 16, 7])
def test_files_hold_every_document_in_order(spark, odd, library, frame_ids):
    folder = f"{scratch_root(spark)}/files-{frame_ids}"
    files = tokenfiles.write(odd.repartition(3), folder, frame_ids=frame_ids)
    got = tokenfiles.documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("crc"), "ids").collect()
    want = expected(odd.collect(), library[0])
    assert Counter((r["doc_id"], r["n_tokens"], r["crc"]) for r in got) == Counter(want)
    got.sort(key=lambda r: r["start"])
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0))
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    # any zstandard tool reads the plain stream of ids
    stream = b""
    for r in files.orderBy("first").collect():
        with open(r["file"].removeprefix("file://"), "rb") as f:
            stream += zstandard.ZstdDecompressor().stream_reader(f.read(), read_across_frames=True).read()
    assert np.frombuffer(stream, "<u2").astype("<u4").tobytes() == b"".join(r["ids"] for r in got)


def test_wanted_documents_unpack_their_frames_alone(spark, odd, monkeypatch):
    files = tokenfiles.write(odd, f"{scratch_root(spark)}/files-some", frame_ids=50)
    every = {(r["doc_id"], r["start"]): r["ids"] for r in tokenfiles.documents(files).collect()}
    got = tokenfiles.documents(files, spark.createDataFrame([(99,), (3,), (3,), (12345,)], "doc_id long")).collect()
    assert {r["doc_id"] for r in got} == {3, 99} and len(got) == len([k for k in every if k[0] in (3, 99)])
    assert all(every[r["doc_id"], r["start"]] == r["ids"] for r in got)
    row = files.orderBy(F.desc("first")).first()
    fs, path = tokenfiles.opened(row["file"])
    with fs.open_input_file(path) as f:
        reader, unpacked = tokenfiles.Reader(f, row["width"]), []
        real = reader.unpack
        reader.unpack = lambda raw: unpacked.append(len(raw)) or real(raw)
        assert len(reader.ids(40, 20)) == 20 and len(unpacked) <= 2 < len(reader.checks)


def test_damage_is_found(spark, odd, tmp_path):
    files = tokenfiles.write(odd.coalesce(1), f"{tmp_path}/files")
    row = files.first()
    fs, path = tokenfiles.opened(row["file"])
    raw = bytearray(open(path, "rb").read())
    for at, message in ((len(raw) - 1, "seek table"), (12, None)):
        bad = bytearray(raw)
        bad[at] ^= 0xFF
        (tmp_path / "bad.zst").write_bytes(bytes(bad))
        with fs.open_input_file(f"{tmp_path}/bad.zst") as f, pytest.raises(Exception, match=message):
            tokenfiles.Reader(f, row["width"]).ids(0, 5)


def test_an_attempt_that_failed_leaves_nothing_that_is_read(spark, odd, tmp_path):
    """Only files named in the manifest are read, so what a repeated task has left behind changes nothing."""
    files = tokenfiles.write(odd, f"{tmp_path}/files")
    row = files.first()
    path = row["file"]
    (tmp_path / "files/ids/00000000-left-behind.zst").write_bytes(open(path, "rb").read()[:100])
    again = tokenfiles.manifest(spark, f"{tmp_path}/files")
    assert tokenfiles.documents(again).count() == odd.count()


def test_files_of_an_empty_table(spark, empty, tmp_path):
    files = tokenfiles.write(empty, f"{tmp_path}/files")
    assert files.count() == 0 and tokenfiles.documents(files).count() == 0


# --- runs ---------------------------------------------------------------------------------------------------------


def brute_runs(w, least=12):
    out, seen = [], set()
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= 2 * q and (i, length) not in seen:
                seen.add((i, length))
                if length >= least:
                    out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out)


def brute_kept(words, runs):
    return [w for k, w in enumerate(words) if not any(s + q <= k < s + n for s, n, q in runs)]


def brute_planted(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    a = (h // 10) % n
    p = 1 + (n - a) // (3 + (h // 10) % 8)
    return [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]


@settings(max_examples=400, deadline=None)
@given(st.integers(1, 5).flatmap(lambda k: st.lists(st.integers(0, k), max_size=70)), st.sampled_from([2, 12]))
def test_runs_equal_brute_force(w, least):
    words = [str(v).encode() for v in w]
    assert periodic.found(words, least) == brute_runs(w, least)


def test_runs_of_nested_repeats_and_long_texts():
    rng, fib = random.Random(5), ([0], [0, 1])
    while len(fib[1]) < 1200:
        fib = (fib[1], fib[1] + fib[0])
    for w in ([0] * 900, fib[1], [0, 1] * 500, ([0] * 40 + [1]) * 20, [rng.randrange(3) for _ in range(700)], list(range(400)) * 2 + [7]):
        words = [str(v).encode() for v in w]
        assert periodic.found(words) == brute_runs(w)
        assert periodic.collapsed(words, brute_runs(w)) == brute_kept(words, brute_runs(w))
    assert periodic.found([b"a"] * 200_000) == [(0, 200_000, 1)]


def test_runs_of_documents(spark, odd, empty):
    got = periodic.periodic(odd).collect()
    want = [(r["doc_id"], (r["text"] or "").encode().split()) for r in odd.collect()]
    assert periodic.periodic(empty).count() == 0 and len(got) == len(want)
    assert Counter((r["doc_id"], r["n_words"], tuple(map(tuple, r["runs"])), r["collapsed"]) for r in got) == Counter(
        (d, len(w), tuple(brute_runs(w)), b" ".join(brute_kept(w, brute_runs(w))).decode()) for d, w in want
    )


def test_op12_query_equals_brute_force(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        words = brute_planted(r["doc_id"], [w.decode() for w in (r["text"] or "").encode().split()])
        runs = brute_runs(words)
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        milli = best[1] * 1000 // best[2] if runs else None
        want[r["doc_id"]] = (len(runs), *best, milli, sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(brute_kept(words, runs))))
    got = QUERIES["op12_periodic_runs"](spark, FOLDER)
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert {r["doc_id"]: tuple(r)[1:] for r in got.collect()} == want and any(v[0] for v in want.values())


# --- alignment ----------------------------------------------------------------------------------------------------


def brute_alignment(texts, library):
    """Per text (numbers, groups, links with their times), then n_best and count_sum over all."""
    _, a_tool, b_tool = library
    out = []
    for text in texts:
        a, b = a_tool.whole(" " + (text or "")), b_tool.library.encode(text or "")
        in_a, in_b = [a_tool.bytes[i] for i in a], [b_tool.bytes[i] for i in b]
        whole = (" " + (text or "")).encode()
        if not text or b"".join(in_a) != whole or b"".join(in_b) != whole:
            out.append(((0, 0, 0, 0), "", Counter()))
            continue
        owner = [[k for k, t in enumerate(x) for _ in t] for x in (in_a, in_b)]
        links = Counter((a[i], b[j]) for i, j in set(zip(*owner, strict=True)))
        both = [k for k in range(1, len(whole) + 1) if k == len(whole) or owner[0][k] != owner[0][k - 1] and owner[1][k] != owner[1][k - 1]]
        groups = []
        for lo, hi in zip([0, *both], both, strict=False):
            sides = [",".join(str(ids[k]) for k in dict.fromkeys(own[lo:hi])) for ids, own in ((a, owner[0]), (b, owner[1]))]
            groups.append("|".join(sides))
        out.append(((len(a), len(b), len(both), sum(links.values())), ";".join(groups), links))
    count = Counter(p for _, _, links in out for p in links)
    most = {}
    for (i, _), n in count.items():
        most[i] = max(most.get(i, 0), n)
    return [(*n, sum(t for p, t in links.items() if count[p] == most[p[0]]), sum(t * count[p] for p, t in links.items()), hashlib.sha256(g.encode()).hexdigest() if g else "") for n, g, links in out]


@pytest.mark.parametrize("part", [3_000_000, 40])
def test_op13_query_equals_brute_force(spark, library, monkeypatch, part):
    monkeypatch.setattr("inkgraph.llm.align.PART_PAIRS", part)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").orderBy("doc_id").collect()
    want = brute_alignment([r["text"] for r in docs], library)
    got = QUERIES["op13_alignment"](spark, FOLDER)
    assert set(got.columns) == {"doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"}
    rows = got.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(d["doc_id"], *w) for d, w in zip(docs, want, strict=True)]


@pytest.mark.parametrize("together", [512, 2])
def test_alignment_of_odd_texts(spark, odd, empty, library, monkeypatch, together):
    monkeypatch.setattr("inkgraph.llm.align.TOGETHER", together)
    rows = odd.orderBy("doc_id", "text").collect()
    want = Counter((r["doc_id"], *w[:-1]) for r, w in zip(rows, brute_alignment([r["text"] for r in rows], library), strict=True))
    scratch = Scratch(spark, "t")
    got = align.counted(scratch.cut(align.aligned(odd), "odd"), scratch).collect()
    assert Counter((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in got) == want
    plain = next(r for r in got if r["doc_id"] == 99)
    assert plain["groups"].count(";") + 1 == plain["n_groups"] and plain["groups"].count("|") == plain["n_groups"]
    assert align.counted(scratch.cut(align.aligned(empty), "none"), scratch).count() == 0
    white = spark.createDataFrame([(1, ""), (2, None)], "doc_id long, text string")
    assert [tuple(r)[1:5] for r in align.counted(scratch.cut(align.aligned(white), "white"), scratch).collect()] == [(0, 0, 0, 0)] * 2


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=9))
def test_packed_numbers_come_back(values):
    assert align.unpacked(align.packed(np.array(values, dtype=np.int64))).tolist() == values
