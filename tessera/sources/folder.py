"""A folder of texts as a Python data source, for batches and for streams.

``spark.read.format("text_folder").load(folder)`` lists the files once and deals them to
tasks; ``spark.readStream`` takes them in the order of (time of change, path), and its offset
is the last of them: a restart goes on behind it. A file that changes comes again; one that
is put in with a time before the cursor is found by a batch only. Folders are URIs that pyarrow can open on every machine. Rows hold the bytes; what they
are is told by Column expressions (:func:`documents`).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from tessera.sources import pages

SCHEMA = "path string, size long, changed_at long, content binary"
#: Endings that are listed.
ENDINGS = (".md", ".markdown", ".txt", ".pdf")
MAX_PARTITION_BYTES = 32 << 20


class Files(InputPartition):
    def __init__(self, files: list[tuple[str, int, int]]):
        self.files = files


def listed(folder: str, endings: tuple[str, ...] = ENDINGS) -> list[tuple[int, str, int]]:
    """Time of change (in nanoseconds), path below the folder, and size of every file, in this order."""
    store, root = fs.FileSystem.from_uri(folder)
    found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return sorted((x.mtime_ns or 0, x.path[len(root) :].lstrip("/"), x.size) for x in found if x.type == fs.FileType.File and x.path.lower().endswith(endings))


def _dealt(files: list[tuple[int, str, int]], most: int) -> list[Files]:
    """Neighbours together, up to ``most`` bytes."""
    out, held, size = [], [], 0
    for at, path, n in files:
        if held and size + n > most:
            out.append(Files(held))
            held, size = [], 0
        held.append((path, n, at))
        size += n
    return [*out, Files(held)] if held else out


def _read(folder: str, part: Files) -> Iterator[tuple]:
    store, root = fs.FileSystem.from_uri(folder)
    for path, _, changed_at in part.files:
        try:
            with store.open_input_stream(f"{root}/{path}") as file:
                content = file.read()
        except FileNotFoundError:  # gone since it was listed
            continue
        yield path, len(content), changed_at, content


class _Batch(DataSourceReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def partitions(self) -> list[Files]:
        return _dealt(listed(self.folder), self.most) or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.folder, partition)


class _Stream(DataSourceStreamReader):
    def __init__(self, folder: str, most: int):
        self.folder, self.most = folder, most

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": "0", "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        files = listed(self.folder)
        return {"at": str(files[-1][0]), "path": files[-1][1]} if files else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        key = lambda o: (int(o["at"]), o["path"])
        return _dealt([x for x in listed(self.folder) if key(start) < x[:2] <= key(end)], self.most)

    def read(self, partition: Files) -> Iterator[tuple]:
        return _read(self.folder, partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept here: Spark's checkpoint has the offsets."""


class TextFolder(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return SCHEMA

    def _of_options(self) -> tuple[str, int]:
        if not self.options.get("path"):
            raise ValueError("text_folder needs the path of a folder")
        return self.options["path"].rstrip("/"), int(self.options.get("maxPartitionBytes", MAX_PARTITION_BYTES))

    def reader(self, schema) -> DataSourceReader:
        return _Batch(*self._of_options())

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(*self._of_options())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(TextFolder)


def documents(files: DataFrame) -> DataFrame:
    """path, kind, sha256 and text (null for what isn't text) of files (path, content) that are of a known kind."""
    known = files.withColumn("kind", pages.kind(F.col("path"), F.lit(""), F.col("content"))).filter("kind is not null")
    plain = F.regexp_replace(F.regexp_replace(F.decode("content", "UTF-8"), "^﻿", ""), "\r\n", "\n")
    return known.select("path", "kind", F.sha2("content", 256).alias("sha256"), F.when(F.col("kind") != "pdf", F.regexp_replace(plain, r"^\s+|\s+$", "")).alias("text"))
