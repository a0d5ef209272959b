"""Operator 13, alignment of two tokenizers.

Both encode a text; a label of each byte says whether no token, one of A, one of B or one of both ends there, and a regular
expression takes the spans up to each byte where both end: the labels inside a span count the tokens of its group. Tokens
link where their bytes overlap, and a pair of ids counts the documents that hold it linked.

Counts cover the corpus, yet no row per document and pair is shuffled: a task numbers the distinct pairs of a part (documents
with a bounded number of links), only these go to the count, and come back to the part as one row each."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, by_value, check_columns, read
from .tokenfiles import slices
from .vocabulary import BYTE_VOCABULARY, PIECE_VOCABULARY, ByteLevel, SentencePiece, content, shared

by_value(__name__)
#: Labels of a byte: nothing, the end of an A token, of a B token, of both.
LABELS = b".abx"
SPAN = re.compile(rb"[^x]*x")
#: A part ends with the first batch that brings its distinct pairs, counted in each document, to this number.
PART_PAIRS = 3_000_000
#: Documents taken together at most, besides their bytes.
TOGETHER = 512
NUMBERS = ("n_a", "n_b", "n_groups", "n_links")


class Counts(dict):
    """(A tokens, B tokens) of a span of labels as one number; a span has the end of both at its end only."""

    def __missing__(self, span: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[span] = out = (span.count(b"a") + 1 << 32) + span.count(b"b") + 1
        return out


class Aligner:
    """Groups and links of batches of texts."""

    def __init__(self, a: bytes, b: bytes):
        import numpy as np

        self.a, self.b, self.counts = shared(ByteLevel, a, plain=True), shared(SentencePiece, b), Counts()
        self.size_a, self.size_b = len(self.a.bytes), len(self.b.bytes)
        self.length_a, self.length_b = (np.array([len(t) for t in x.bytes], dtype=np.int64) for x in (self.a, self.b))
        # an id with what follows it: in its group, then at its end
        self.shown = np.array([f"{i}{s}" for n, ends in ((self.size_a, ",|"), (self.size_b, ",;")) for s in ends for i in range(n)], dtype=object)
        self.labels = np.frombuffer(LABELS, dtype=np.uint8)

    def align(self, texts: list[str]):
        """Per text (n_a, n_b, n_groups, n_links) and its groups `a1,a2|b1;a3|b2,b3`; and arrays (text, a * size_b + b, times) of
        the distinct pairs that each text holds linked. A text whose tokens do not spell a space and the text has zeros."""
        import numpy as np

        n, numbers, groups = len(texts), np.zeros((len(texts), 4), dtype=np.int64), [""] * len(texts)
        ids_a, ids_b, good = [], [], []
        some = [k for k, t in enumerate(texts) if t]
        spaced = [" " + texts[k] for k in some]
        for k, t, x, y in zip(some, spaced, self.a.encode(spaced), self.b.encode([texts[k] for k in some]), strict=True):
            x, y, whole = np.frombuffer(x, dtype="<u4"), np.frombuffer(y, dtype="<u4"), t.encode("utf-8")
            if b"".join(map(self.a.bytes.__getitem__, x.tolist())) == whole == b"".join(map(self.b.bytes.__getitem__, y.tolist())):
                ids_a.append(x)
                ids_b.append(y)
                good.append(k)
        none = np.zeros(0, dtype=np.int64)
        if not good:
            return numbers, groups, (none, none, none)
        n_a, n_b = (np.array([len(x) for x in ids]) for ids in (ids_a, ids_b))
        x, y = np.concatenate(ids_a).astype(np.int64), np.concatenate(ids_b).astype(np.int64)
        # all good texts stand one after another: both tokenizers end with each, so no group goes over its edge
        end_a, end_b = np.cumsum(self.length_a[x]), np.cumsum(self.length_b[y])
        label = np.zeros(end_a[-1] + 1, dtype=np.uint8)
        label[end_a] += 1
        label[end_b] += 2
        label = label[1:]
        packed = np.fromiter(map(self.counts.__getitem__, SPAN.findall(self.labels[label].tobytes())), dtype=np.int64)
        in_a, in_b = packed >> 32, packed & 0xFFFFFFFF
        ends = np.flatnonzero(label)
        kind = label[ends].astype(np.int64)
        at_a, at_b = np.cumsum(kind & 1) - (kind & 1), np.cumsum(kind >> 1) - (kind >> 1)
        stop_a = np.cumsum(n_a)
        text_of_link = np.searchsorted(stop_a, at_a, side="right")
        text_of_group = np.searchsorted(stop_a, np.cumsum(in_a) - 1, side="right")
        numbers[good] = np.stack([n_a, n_b, *(np.bincount(t, minlength=len(good)) for t in (text_of_group, text_of_link))], axis=1)
        last_a, last_b = np.zeros(len(x), dtype=np.int64), np.zeros(len(y), dtype=np.int64)
        last_a[np.cumsum(in_a) - 1] = 1
        last_b[np.cumsum(in_b) - 1] = 1
        order = np.empty(len(x) + len(y), dtype=np.int64)
        order[np.arange(len(x)) + np.repeat(np.cumsum(in_b) - in_b, in_a)] = x + last_a * self.size_a
        order[np.arange(len(y)) + np.repeat(np.cumsum(in_a), in_b)] = y + last_b * self.size_b + 2 * self.size_a
        shown, stops = self.shown[order].tolist(), np.cumsum(n_a + n_b).tolist()
        for k, a, z in zip(good, [0, *stops], stops, strict=False):
            groups[k] = "".join(shown[a:z])[:-1]
        pairs = self.size_a * self.size_b
        key, times = np.unique(text_of_link * pairs + x[at_a] * self.size_b + y[at_b], return_counts=True)
        return numbers, groups, (np.array(good)[key // pairs], key % pairs, times)


def packed(values) -> bytes:
    """Whole numbers in the least width that holds them, compressed."""
    import numpy as np
    import zstandard

    wide = max(k for k in (2, 4, 8) if k == 2 or (len(values) and int(values.max()) >> (4 * k)))
    return bytes([wide]) + zstandard.ZstdCompressor(level=1).compress(values.astype(f"<u{wide}").tobytes())


def unpacked(data: bytes):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), dtype=f"<u{data[0]}").astype(np.int64)


def aligned(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, groups, and pairs and times (packed: places among its part's
    pairs, as differences, and how often it holds each). And a row per part, whose doc_id is null and whose id_a, id_b and
    docs (arrays) are its distinct pairs and how many of its documents hold each.

    a and b are paths of a byte-level and a sentencepiece vocabulary. Null and empty texts, and those that either tokenizer
    does not spell, have zeros and empty groups; strings of special tokens are plain text; repeated rows and null doc_ids
    are documents of their own; an empty table gives no row; other columns are not read. A text is aligned by one task."""
    check_columns(docs, "doc_id", "text")
    of_a, of_b = content(BYTE_VOCABULARY, a), content(PIECE_VOCABULARY, b)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"part long, doc_id {kind}, {', '.join(f'{n} long' for n in NUMBERS)}, groups string, pairs binary, times binary, id_a array<int>, id_b array<int>, docs array<long>"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tool, first, parts = Aligner(of_a, of_b), TaskContext.get().partitionId() << 24, 0
        waiting: list = []

        def part() -> pa.RecordBatch:
            """The waiting documents, then the row of their pairs."""
            nonlocal waiting, parts
            distinct, place, in_docs = np.unique(np.concatenate([w[3][1] for w in waiting]), return_inverse=True, return_counts=True)
            ids = pa.concat_arrays([w[0] for w in waiting] + [pa.nulls(1, waiting[0][0].type)])
            numbers = np.concatenate([w[1] for w in waiting])
            pairs, times, at = [], [], 0
            for _, of, _, (text, _, n) in waiting:
                edge = np.searchsorted(text, np.arange(len(of) + 1))
                for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                    pairs.append(packed(np.diff(place[at + s : at + e], prepend=0)))
                    times.append(packed(n[s:e]))
                at += len(text)
            rows, nothing = len(pairs), pa.array([None])
            absent = lambda v: pa.array([None] * rows + [v])
            columns = [pa.array([first + parts] * (rows + 1)), ids, *(pa.concat_arrays([pa.array(numbers[:, k]), nothing.cast(pa.int64())]) for k in range(4))]
            columns += [pa.array([g for w in waiting for g in w[2]] + [None]), pa.array(pairs + [None], pa.binary()), pa.array(times + [None], pa.binary())]
            columns += [absent((distinct // tool.size_b).astype(np.int32)), absent((distinct % tool.size_b).astype(np.int32)), absent(in_docs)]
            waiting, parts = [], parts + 1
            return pa.RecordBatch.from_arrays([c if c.type != pa.null() else c.cast(pa.string()) for c in columns], names=names)

        held = 0
        for batch in batches:
            texts = batch.column(1)
            for s, e in slices(texts):
                for k in range(s, e, TOGETHER):
                    some = [t or "" for t in texts[k : min(e, k + TOGETHER)].to_pylist()]
                    numbers, groups, pairs = tool.align(some)
                    waiting.append((batch.column(0).slice(k, len(some)), numbers, groups, pairs))
                    held += len(pairs[0])
                    if held >= PART_PAIRS:
                        yield part()
                        held = 0
        if waiting:
            yield part()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def counted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """Documents of aligned(), written before, with n_best (links whose pair counts highest for its A id) and count_sum (what
    the pairs of its links count)."""
    pairs = rows.filter("docs is not null").select("part", F.posexplode(F.arrays_zip("id_a", "id_b", "docs")).alias("at", "p")).select("part", "at", "p.id_a", "p.id_b", "p.docs")
    total = scratch.cut(pairs.groupBy("id_a", "id_b").agg(F.sum("docs").alias("count")), "pair-counts")
    best = total.groupBy("id_a").agg(F.max("count").alias("best"))
    judged = total.join(best, "id_a").select("id_a", "id_b", F.when(F.col("count") == F.col("best"), F.col("count")).otherwise(-F.col("count")).alias("count"))
    back = pairs.join(judged, ["id_a", "id_b"]).select(F.col("part").alias("of_part"), "at", "count")
    docs = rows.filter("docs is null").drop("id_a", "id_b", "docs")
    kept = [c for c in docs.columns if c not in ("part", "pairs", "times")]
    schema = f"{', '.join(f'`{c}` {docs.schema[c].dataType.simpleString()}' for c in kept)}, n_best long, count_sum long"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Of one part: its documents, and the count of every pair, negative if another pair of its A id counts more."""
        import numpy as np

        count = np.zeros(right.num_rows, dtype=np.int64)
        count[right.column("at").to_numpy()] = right.column("count").to_numpy()
        best, total = [], []
        for p, t in zip(left.column("pairs").to_pylist(), left.column("times").to_pylist(), strict=True):
            found, n = count[np.cumsum(unpacked(p))], unpacked(t)
            best.append(int(n[found > 0].sum()))
            total.append(int((n * np.abs(found)).sum()))
        return pa.table({**{c: left.column(c) for c in kept}, "n_best": pa.array(best, pa.int64()), "count_sum": pa.array(total, pa.int64())})

    return docs.groupBy("part").cogroup(back.groupBy("of_part")).applyInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "align")
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    rows = scratch.cut(aligned(read(spark, sf_dir, "documents")).withColumn("groups_sha256", digest).drop("groups"), "documents")
    return counted(rows, scratch)
