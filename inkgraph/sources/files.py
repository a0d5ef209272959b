"""A sink that leaves one file a row, readable by its path."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from .tables import by_value

by_value(__name__)


@dataclass
class Written(WriterCommitMessage):
    """What a task that succeeded has put in place."""

    files: int
    size: int


def opened(path: str):
    """The file system of a URI or path, and the path in it; executors have to reach it by pyarrow."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(path)


class Writer(DataSourceWriter):
    """Each row goes to a file of its own beside its place and is then moved there, so a reader never sees half of one, and a
    task that is repeated puts the same file in the same place again."""

    def __init__(self, folder: str):
        self.folder, self.run = folder.rstrip("/"), uuid.uuid4().hex

    def write(self, rows: Iterator[Row]) -> Written:
        fs, root = opened(self.folder)
        made, files, size = set(), 0, 0
        for row in rows:
            path, content = f"{root}/{row['path']}", row["content"]
            parent, _, name = path.rpartition("/")
            if parent not in made:
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            aside = f"{parent}/.{name}.{uuid.uuid4().hex}"
            try:
                with fs.open_output_stream(aside, compression=None) as out:
                    out.write(bytes(content or b""))
                fs.move(aside, path)
            except BaseException:
                fs.delete_file(aside)
                raise
            files, size = files + 1, size + len(content or b"")
        return Written(files, size)

    def commit(self, messages: list[Written | None]) -> None:
        """Notes how many files the run left, as the last thing it does."""
        fs, root = opened(self.folder)
        told = {"run": self.run, "files": sum(m.files for m in messages if m), "bytes": sum(m.size for m in messages if m)}
        with fs.open_output_stream(f"{root}/_WRITTEN", compression=None) as out:
            out.write(json.dumps(told).encode("utf-8"))

    def abort(self, messages: list[Written | None]) -> None:
        """Files in place stay: a later run puts the same ones there again."""


class FilePerRow(DataSource):
    """Rows of path (relative, unique) and content (binary)."""

    @classmethod
    def name(cls) -> str:
        return "file_per_row"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema: StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"])


def write_files(rows: DataFrame, folder: str, path: Column, content: Column) -> None:
    """A file for each distinct path under folder with the content of its row (of several rows, the least content; null is
    an empty file), and then `_WRITTEN` with their number. Null, empty and absolute paths, and those that leave the folder,
    fail before anything is written."""
    ready = rows.select(path.cast("string").alias("path"), F.coalesce(content.cast("binary"), F.lit(b"")).alias("content"))
    bad = F.col("path").isNull() | (F.col("path") == "") | F.col("path").rlike(r"^/|(^|/)\.\.(/|$)|^_WRITTEN$|/$")
    found = ready.filter(bad).limit(3).collect()
    if found:
        raise ValueError(f"paths that cannot be written: {[r['path'] for r in found]}")
    rows.sparkSession.dataSource.register(FilePerRow)
    one = ready.groupBy("path").agg(F.min("content").alias("content"))
    one.write.format("file_per_row").mode("append").option("path", folder).save()
