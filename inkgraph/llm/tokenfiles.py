"""Operator 11, token ids in seekable files.

A file is a sequence of independent zstandard frames of ids, then two skippable frames: one with its documents' ids and
lengths, and a seek table as the public seekable format has it (sizes of every frame, the low half of the XXH64 of its
content, and a footer at the very end). So any zstandard tool unpacks the plain stream of ids, and a reader of some
documents takes the end of the file, then the frames that hold them, and checks each against its checksum.

Documents are sorted over all files. A task writes its stretch under a name of its own and returns one row about it; only
the rows of attempts that succeeded reach the written manifest, so what a lost or repeated task has left is never read."""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import by_value, check_columns, read, scratch_root
from .vocabulary import BYTE_VOCABULARY, ByteLevel, content, shared

by_value(__name__)
END = 2
#: Ids in a frame: a frame ends with the first document that reaches them; longer documents go over several frames.
FRAME_IDS = 1 << 16
#: Bytes of text encoded at a time, and of ids handed on.
AT_A_TIME, HANDED = 4_000_000, 1_000_000
SKIPPABLE, SEEK, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
MANIFEST = "part long, file string, width int, documents long, ids long"
ROWS = "doc_id long, start long, n_tokens long, file string, width int, at long"


class Writer:
    """One file: documents are added in order, then the file is closed with its tables."""

    def __init__(self, out, width: int, frame_ids: int = FRAME_IDS):
        import numpy as np
        import zstandard

        self.out, self.width, self.frame_ids = out, width, frame_ids
        self.kind = np.dtype(f"<u{width}")
        self.pack = zstandard.ZstdCompressor(level=3).compress
        self.waiting, self.n_waiting, self.frames, self.documents, self.n_ids = [], 0, [], [], 0

    def add(self, doc_id: int | None, ids) -> None:
        self.documents.append((doc_id, len(ids)))
        self.n_ids += len(ids)
        for k in range(0, len(ids), self.frame_ids):
            self.waiting.append(ids[k : k + self.frame_ids].astype(self.kind))
            self.n_waiting += len(self.waiting[-1])
            if self.n_waiting >= self.frame_ids:
                self.flush()

    def flush(self) -> None:
        import xxhash

        if self.waiting:
            raw = b"".join(a.tobytes() for a in self.waiting)
            packed = self.pack(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.waiting, self.n_waiting = [], 0

    def close(self) -> None:
        import numpy as np

        self.flush()
        known = np.array([d is not None for d, _ in self.documents], dtype=np.uint8)
        ids, lengths = np.array([d or 0 for d, _ in self.documents], dtype="<i8"), np.array([n for _, n in self.documents], dtype="<u8")
        table = self.pack(struct.pack("<Q", len(known)) + known.tobytes() + ids.tobytes() + lengths.tobytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        entries = b"".join(struct.pack("<III", *f) for f in self.frames)
        self.out.write(struct.pack("<II", SEEK, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0x80, FOOTER))


class Reader:
    """A file's documents, and the ids of any stretch of it from the frames that hold it alone."""

    def __init__(self, file, width: int):
        import numpy as np
        import zstandard

        self.file, self.kind = file, np.dtype(f"<u{width}")
        self.unpack = zstandard.ZstdDecompressor().decompress
        end = file.size()
        count, flags, footer = struct.unpack("<IBI", file.read_at(9, end - 9))
        if footer != FOOTER or flags != 0x80:
            raise ValueError("no seek table at the end of the file")
        table = np.frombuffer(file.read_at(12 * count, end - 9 - 12 * count), dtype="<u4").reshape(-1, 3)
        if struct.unpack("<II", file.read_at(8, end - 17 - 12 * count)) != (SEEK, 12 * count + 9):
            raise ValueError("the seek table is damaged")
        self.checks = table[:, 2]
        self.places, self.firsts = (np.concatenate([[0], np.cumsum(table[:, k].astype(np.int64))]) for k in (0, 1))
        self.last, self.unpacked = -1, b""

    def documents(self):
        """(known, doc_ids, lengths) as arrays."""
        import numpy as np

        at = int(self.places[-1])
        magic, size = struct.unpack("<II", self.file.read_at(8, at))
        if magic != SKIPPABLE:
            raise ValueError("no table of documents after the frames")
        raw = self.unpack(self.file.read_at(size, at + 8))
        n = struct.unpack("<Q", raw[:8])[0]
        return np.frombuffer(raw, np.uint8, n, 8), np.frombuffer(raw, "<i8", n, 8 + n), np.frombuffer(raw, "<u8", n, 8 + 9 * n).astype(np.int64)

    def frame(self, k: int) -> bytes:
        import xxhash

        if k != self.last:
            a, b = int(self.places[k]), int(self.places[k + 1])
            raw = self.unpack(self.file.read_at(b - a, a))
            if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(self.checks[k]) or len(raw) != self.firsts[k + 1] - self.firsts[k]:
                raise ValueError(f"frame {k} does not match its checksum")
            self.last, self.unpacked = k, raw
        return self.unpacked

    def ids(self, at: int, n: int):
        """n ids from id number `at` of the file."""
        import numpy as np

        a, b, out = at * self.kind.itemsize, (at + n) * self.kind.itemsize, []
        k = int(np.searchsorted(self.firsts, a, side="right")) - 1
        while a < b:
            stop = min(b, int(self.firsts[k + 1]))
            first = int(self.firsts[k])
            out.append(self.frame(k)[a - first : stop - first])
            a, k = stop, k + 1
        return np.frombuffer(b"".join(out), dtype=self.kind).astype("<u4")


def opened(folder: str):
    """The file system of a URI or a path, and the path in it. Executors have to reach it by pyarrow (local or shared
    folders, s3, gs, and hdfs where its library is installed)."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(folder)


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, frame_ids: int = FRAME_IDS) -> DataFrame:
    """The manifest, one row per file written under folder: all documents in ascending doc_id order, each with `end` after it.

    A null text is empty and so has the end id only, as have empty texts; a null doc_id comes first; rows of equal doc_id go
    by the hash of their text, and each has its ids, so a doc_id of very many rows may fill many files; texts of any length
    go over several frames; an empty table has a manifest without rows; other columns are not read."""
    check_columns(docs, "doc_id", "text")
    spark, model, target = docs.sparkSession, content(BYTE_VOCABULARY, vocabulary), f"{folder}/ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        tokens, (fs, path) = shared(ByteLevel, model), opened(target)
        width = 2 if max(len(tokens.bytes), end + 1) <= 1 << 16 else 4
        last, writer, stream = np.array([end], dtype="<u4").tobytes(), None, None
        part = TaskContext.get().partitionId()
        name = f"{part:08d}-{uuid.uuid4().hex}.zst"
        for b in batches:
            ids, texts = b.column(0).to_pylist(), b.column(1)
            if writer is None and len(ids):
                fs.create_dir(path, recursive=True)
                stream = fs.open_output_stream(f"{path}/{name}", compression=None)
                writer = Writer(stream, width, frame_ids)
            for a, z in slices(texts, AT_A_TIME):
                for doc_id, found in zip(ids[a:z], tokens.encode(texts[a:z]), strict=True):
                    writer.add(doc_id, np.frombuffer(found + last, dtype="<u4"))
        if writer:
            writer.close()
            stream.close()
            values = ([part], [name], [width], [len(writer.documents)], [writer.n_ids])
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "width", "documents", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("spread"))
    ordered = rows.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "spread").select("doc_id", "text")
    ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return manifest(spark, folder)


def slices(texts: pa.Array, size: int = HANDED) -> Iterator[tuple[int, int]]:
    """Stretches of texts with so many bytes or one text."""
    import pyarrow.compute as pc

    a, total = 0, 0
    for k, n in enumerate(pc.binary_length(texts).to_pylist()):
        if total and total + (n or 0) > size:
            yield a, k
            a, total = k, 0
        total += n or 0
    if a < len(texts):
        yield a, len(texts)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file, with its whole path and the number of ids in the files before it."""
    rows = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return rows.select(F.concat(F.lit(f"{folder}/ids/"), "file").alias("file"), "width", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("first"))


def index(files: DataFrame) -> DataFrame:
    """A row per document from the files' own tables: doc_id, start (ids of all documents before it), n_tokens, file, width,
    at (its first id in the file). Reads the end of each file only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for file, width, first in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                fs, path = opened(file)
                with fs.open_input_file(path) as f:
                    known, ids, lengths = Reader(f, width).documents()
                at = np.cumsum(lengths) - lengths
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=known == 0), pa.array(first + at), pa.array(lengths), pa.array([file] * len(ids)), pa.array(np.full(len(ids), width, np.int32)), pa.array(at)], names=["doc_id", "start", "n_tokens", "file", "width", "at"])

    return files.mapInArrow(run, ROWS)


def fetch(rows: DataFrame) -> DataFrame:
    """Documents of the index, whole or filtered, with `ids`: their ids as little-endian unsigned integers of 32 bits.

    Rows of one file that come together share an open file and its last frame; only frames with wanted ids are unpacked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, stream, reader = None, None, None
        for b in batches:
            found, size, a = [], 0, 0
            for k, (n, file, width, at) in enumerate(zip(*(b.column(c).to_pylist() for c in (2, 3, 4, 5)), strict=True)):
                if file != name:
                    if stream:
                        stream.close()
                    fs, path = opened(file)
                    name, stream = file, fs.open_input_file(path)
                    reader = Reader(stream, width)
                found.append(reader.ids(at, n).tobytes())
                size += len(found[-1])
                if size > HANDED or k == b.num_rows - 1:
                    yield pa.RecordBatch.from_arrays([*(b.column(c).slice(a, k + 1 - a) for c in range(3)), pa.array(found, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])
                    found, size, a = [], 0, k + 1
        if stream:
            stream.close()

    return rows.select("doc_id", "start", "n_tokens", "file", "width", "at").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def documents(files: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """Every document of the files with its ids, or those whose doc_id is in wanted; a task for each file."""
    spread = files.repartition(max(1, files.count()), "file")
    rows = index(spread)
    if wanted is not None:
        rows = rows.join(wanted.select("doc_id").distinct(), "doc_id", "left_semi").repartition("file").sortWithinPartitions("file", "at")
    return fetch(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write(read(spark, sf_dir, "documents"), f"{scratch_root(spark)}/tokens-{uuid.uuid4().hex}")
    return documents(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
