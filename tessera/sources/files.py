"""A sink that writes a file for each row, and listings of files without their content."""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

_STAGING, _DONE = "_staging", "_SUCCESS"


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class RowFiles(DataSource):
    """Format `row_files`: rows (path string, value string), the path below the option `path`."""

    @classmethod
    def name(cls) -> str:
        return "row_files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if schema.fieldNames() != ["path", "value"]:
            raise ValueError(f"row_files takes (path, value), not {schema.fieldNames()}")
        return RowFilesWriter(self.options["path"])


class RowFilesWriter(DataSourceWriter):
    """Tasks write below a staging folder of their own and move whole files into place when all of theirs are written.

    So no name ever holds half a file, and what a lost or repeated task has staged
    is never seen.  The marker file is there only after all tasks have ended; it is
    taken away when a new write begins.
    """

    def __init__(self, root: str) -> None:
        self.root = root
        fs, base = self._open()
        fs.create_dir(base)
        if fs.get_file_info(f"{base}/{_DONE}").is_file:
            fs.delete_file(f"{base}/{_DONE}")

    def _open(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, base = self._open()
        own, moves, size = f"{base}/{_STAGING}/{uuid.uuid4().hex}", [], 0
        fs.create_dir(own)
        for n, row in enumerate(iterator):
            name = posixpath.normpath(row["path"] or "")
            if name.startswith(("/", "..", _STAGING)) or name in (".", _DONE):
                raise ValueError(f"not a path below the folder: {row['path']!r}")
            data = (row["value"] or "").encode()
            with fs.open_output_stream(f"{own}/{n}") as out:
                out.write(data)
            moves.append((f"{own}/{n}", f"{base}/{name}"))
            size += len(data)
        for folder in {posixpath.dirname(to) for _, to in moves}:
            fs.create_dir(folder)
        for staged, to in moves:
            fs.move(staged, to)
        return Written(len(moves), size)

    def commit(self, messages: list[Written | None]) -> None:
        fs, base = self._open()
        done = [m for m in messages if m is not None]
        self._clear(fs, base)
        with fs.open_output_stream(f"{base}/{_DONE}") as out:
            out.write(json.dumps({"files": sum(m.files for m in done), "bytes": sum(m.bytes for m in done)}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        self._clear(*self._open())

    def _clear(self, fs, base: str) -> None:
        if fs.get_file_info(f"{base}/{_STAGING}").type.name == "Directory":
            fs.delete_dir(f"{base}/{_STAGING}")


def write_row_files(files: DataFrame, folder: str) -> None:
    """Writes (path, value) as one file for each row below the folder; of rows with one path, one stays. Null values are empty files."""
    files.sparkSession.dataSource.register(RowFiles)
    files.select("path", "value").write.format("row_files").mode("append").option("path", folder).save()


class Entries(InputPartition):
    def __init__(self, paths: list[tuple[str, bool]]) -> None:
        self.paths = paths  # and whether each is a folder


class FolderListing(DataSource):
    """Format `folder_listing`: all files below the option `path`; each task walks some of the folder's own entries."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, name string, length long"

    def reader(self, schema) -> DataSourceReader:
        return FolderListingReader(self.options["path"], int(self.options.get("tasks", "64")))


class FolderListingReader(DataSourceReader):
    def __init__(self, root: str, tasks: int) -> None:
        self.root, self.tasks = root, tasks

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        found = [(f.path, f.type == fs.FileType.Directory) for f in store.get_file_info(fs.FileSelector(base))]
        return [Entries(found[k :: self.tasks]) for k in range(min(self.tasks, len(found)))] or [Entries([])]

    def read(self, partition: Entries) -> Iterator[tuple[str, str, int]]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.root)
        for path, is_folder in partition.paths:
            for f in store.get_file_info(fs.FileSelector(path, recursive=True)) if is_folder else store.get_file_info([path]):
                if f.type == fs.FileType.File:
                    yield f.path, f.path.removeprefix(base).lstrip("/"), f.size


def file_listing(spark: SparkSession, folder: str, *suffixes: str) -> DataFrame:
    """(path, name, length) of all files below a folder, empty and hidden ones too, or of those that end in one of the suffixes.

    name is relative to the folder; no file is opened.
    """
    spark.dataSource.register(FolderListing)
    uri = folder if "://" in folder else f"file://{folder}"
    found = spark.read.format("folder_listing").option("path", uri).load()
    return found.filter(" OR ".join(f"endswith(name, '{s}')" for s in suffixes)) if suffixes else found
