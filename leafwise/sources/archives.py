"""Archives of page files: a data source that lists their members, and a sink that writes them.

``spark.read.format("archives").load(path)`` lists the members of every CBZ and ZIP file under a folder once
``register`` has named the format in the session. The names of the archives are listed where the query is planned and
dealt to tasks in lots; only the tasks open archives, and only the end of each is read. ``archive_members`` does the same
for paths that stand in a table, whose number then has no bound.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

# Extensions of archives.
ARCHIVE_EXTENSIONS = (".cbz", ".zip")
ARCHIVES_A_TASK = 32
ROWS_A_BATCH = 4096
SHORT = 1 << 12  # bytes
UNNAMED = "__HIVE_DEFAULT_PARTITION__"  # as Spark names the folder of a null

MEMBERS = "archive_path string, member_ordinal long, member_name string, is_dir boolean, size long, error string"
_ARROW = pa.schema(
    [
        ("archive_path", pa.string()),
        ("member_ordinal", pa.int64()),
        ("member_name", pa.string()),
        ("is_dir", pa.bool_()),
        ("size", pa.int64()),
        ("error", pa.string()),
    ]
)


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path inside it; ``file:/x`` is what Spark calls ``file:///x``."""
    if path.startswith("file:/") and not path.startswith("file://"):
        path = path.replace("file:/", "file:///", 1)
    return fs.FileSystem.from_uri(path)


def _child(folder: str, name: str) -> str:
    """A path inside a folder; inside a URI the name is written as URIs have it."""
    uri = re.match("[A-Za-z][A-Za-z0-9+.-]*:/", folder) is not None
    return f"{folder.rstrip('/')}/{quote(name) if uri else name}"


def _directory(path: str) -> list[tuple]:
    """Rows of one archive in directory order, or one row with ``error`` for whatever keeps it from being read."""
    try:
        system, name = open_path(path)
        with system.open_input_file(name) as handle:
            # Short files are read whole: the search for the directory may start ahead of their first byte.
            archive = zipfile.ZipFile(handle if handle.size() > SHORT else io.BytesIO(handle.read()))
            return [(path, i, m.filename, m.is_dir(), m.file_size, None) for i, m in enumerate(archive.infolist())]
    except (OSError, ValueError, zipfile.BadZipFile, NotImplementedError, pa.ArrowException):
        return [(path, None, None, None, None, f"Cannot read archive source: {path}")]


def _batches(paths: Iterable[str]) -> Iterator[pa.RecordBatch]:
    for path in paths:
        rows = _directory(path)
        for at in range(0, len(rows), ROWS_A_BATCH):
            columns = zip(*rows[at : at + ROWS_A_BATCH], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)


class Lot(InputPartition):
    """Archives that one task lists."""

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class ArchiveReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path
        self.wanted: set[str] | None = None

    def partitions(self) -> list[Lot]:
        paths = sorted(p for p in self._archives() if self.wanted is None or p in self.wanted)
        return [Lot(paths[at : at + ARCHIVES_A_TASK]) for at in range(0, len(paths), ARCHIVES_A_TASK)] or [Lot([])]

    def _archives(self) -> Iterator[str]:
        system, name = open_path(self.path)
        if system.get_file_info(name).type != fs.FileType.Directory:
            yield self.path  # a single archive, or nothing at all, which its row then says
            return
        for info in system.get_file_info(fs.FileSelector(name, recursive=True)):
            if info.type == fs.FileType.File and PurePosixPath(info.path).suffix.lower() in ARCHIVE_EXTENSIONS:
                yield _child(self.path, info.path[len(name.rstrip("/")) + 1 :])

    def read(self, partition: Lot) -> Iterator[pa.RecordBatch]:
        return _batches(partition.paths)


class PruningReader(ArchiveReader):
    """Spark refuses a reader that takes filters where ``spark.sql.python.filterPushdown.enabled`` is not set."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Equality on ``archive_path`` leaves the other archives unopened; Spark still applies every filter."""
        for item in filters:
            if isinstance(item, (EqualTo, In)) and item.attribute == ("archive_path",):
                values = {item.value} if isinstance(item, EqualTo) else set(item.value)
                self.wanted = values if self.wanted is None else self.wanted & values
            yield item


class ArchiveSource(DataSource):
    """Members of archives by entry; see the module's text. Option ``prune``: take filters on ``archive_path``."""

    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema) -> ArchiveReader:
        if "path" not in self.options:
            raise ValueError("archives need a path: load(path)")
        kind = PruningReader if self.options.get("prune", "false").lower() == "true" else ArchiveReader
        return kind(self.options["path"])


def register(spark: SparkSession) -> None:
    """Name the format ``archives`` in this session."""
    spark.dataSource.register(ArchiveSource)


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """Members of all CBZ and ZIP files under ``path``, by entry: repeated names stay separate.

    An archive that cannot be read, or a path that does not exist, gives one row with ``error``. An archive without
    members gives no row. With ``spark.sql.python.filterPushdown.enabled`` a filter on ``archive_path`` prunes archives.
    """
    register(spark)
    prune = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return spark.read.format("archives").option("prune", prune).load(path)


def archive_members(paths: DataFrame) -> DataFrame:
    """The same rows for the archives that ``paths(archive_path)`` names; a null path gives no row.

    Nothing is listed on the driver. A path that names no archive, vanished or not readable, gives one row with ``error``.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from _batches(p for p in batch.column(0).to_pylist() if p is not None)

    return paths.select(F.col("archive_path").cast("string")).mapInArrow(scan, MEMBERS)


def write_archives(members: DataFrame, folder: str) -> DataFrame:
    """Write ``members(archive, position, name, content)`` as ``<folder>/<archive>.cbz``: (archive, archive_path, members).

    Members stand in the order of ``position``, then ``name``. An archive is a file, so one task writes it, member by member;
    no archive is held in memory. It appears under its name only when it is whole, and a task that runs twice
    replaces it by the same. Null contents are empty members; null names and archives are called like
    the folder of a null. Nothing is written until the result is read.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(UNNAMED)).alias(c)
    rows = members.select(name("archive"), "position", name("name"), F.col("content").cast("binary"))
    rows = rows.repartition("archive").sortWithinPartitions("archive", "position", "name")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current: _Writer | None = None
        for batch in batches:
            for archive, member, content in zip(*(batch.column(c) for c in ("archive", "name", "content")), strict=True):
                if current is None or current.archive != archive.as_py():
                    if current is not None:
                        yield current.close()
                    current = _Writer(folder, archive.as_py())
                current.add(member.as_py(), content.as_py() or b"")
        if current is not None:
            yield current.close()

    return rows.mapInArrow(write, "archive string, archive_path string, members long")


class _Writer:
    """One archive on its way: written under another name, then moved to its own."""

    def __init__(self, folder: str, archive: str) -> None:
        self.archive, self.count = archive, 0
        self.path = _child(folder, f"{quote(archive, safe='')}.cbz")
        self.system, self.target = open_path(self.path)
        parent, _, file = self.target.rpartition("/")
        self.system.create_dir(parent, recursive=True)
        self.draft = f"{parent}/.{file}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.draft)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED)

    def add(self, name: str, content: bytes) -> None:
        self.zip.writestr(zipfile.ZipInfo(name), content)
        self.count += 1

    def close(self) -> pa.RecordBatch:
        self.zip.close()
        self.stream.close()
        self.system.move(self.draft, self.target)
        columns = [pa.array([self.archive]), pa.array([self.path]), pa.array([self.count], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["archive", "archive_path", "members"])
