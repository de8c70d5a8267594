"""Preset and series project files (JSON documents)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import islice
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.functions.names import stem
from leafwise.functions.paths import loaded_path, stored_path
from leafwise.operators.ordered import spread
from leafwise.operators.presets import PRESET_TYPE, parse_presets
from leafwise.operators.series import DEFAULT_LANGUAGE, DEFAULT_TITLE
from leafwise.session import durable
from leafwise.sources.archives import UNNAMED, _child, open_path

VOLUME_TYPE = (
    "struct<pdf_path:string,volume_number:bigint,status:string,output_path:string,warnings:array<string>,"
    f"error:string,layout:{PRESET_TYPE}>"
)
PROJECT_TYPE = (
    "struct<version:int,title:string,author:string,language:string,active_volume_number:bigint,"
    f"volumes:array<{VOLUME_TYPE}>>"
)
PROJECT_VERSION = 1
FILES_A_BATCH = 256


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, json): one row per file."""
    texts = spark.read.text(path, wholetext=True, recursiveFileLookup=True)
    return texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("json"))


def documents_at(files: DataFrame) -> DataFrame:
    """``json`` for each row of ``files(path, ...)``, read where the rows are: no folder is listed on the driver."""
    names = [c for c in files.columns if c != "path"]
    at = files.columns.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, FILES_A_BATCH):
                part = batch.slice(start, FILES_A_BATCH)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([_text_at(p) for p in part.column(at).to_pylist()], pa.string())],
                    [*part.schema.names, "json"],
                )

    schema = files.schema.add("json", "string")
    return spread(files, *(names or ["path"])).mapInArrow(read, schema)


def _text_at(path: str) -> str:
    system, name = open_path(path)
    with system.open_input_stream(name, compression=None) as handle:
        return handle.read().decode()


def read_presets(spark: SparkSession, path: str) -> DataFrame:
    """Presets by file stem; unsupported versions carry ``error``."""
    rows = read_documents(spark, path)
    return parse_presets(rows.select(stem(F.col("path")).alias("preset_id"), "json"))


def parse_projects(documents: DataFrame) -> DataFrame:
    """``documents(path, json)`` with ``project`` and ``error``."""
    rows = documents.withColumn("project", F.from_json("json", PROJECT_TYPE))
    good = F.coalesce(F.col("project.version") == PROJECT_VERSION, F.lit(False))
    return rows.withColumn("error", F.when(~good, "Unsupported series project version"))


def _or_default(value: Column, default: str) -> Column:
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def project_series(projects: DataFrame) -> DataFrame:
    """One row per valid project."""
    p = F.col("project")
    return projects.where(F.col("error").isNull()).select(
        F.col("path").alias("project_path"),
        _or_default(p["title"], DEFAULT_TITLE).alias("title"),
        _or_default(p["author"], "").alias("author"),
        _or_default(p["language"], DEFAULT_LANGUAGE).alias("language"),
        p["active_volume_number"].alias("active_volume_number"),
    )


def project_volumes(projects: DataFrame) -> DataFrame:
    """One row per volume; paths are resolved against the project file."""
    rows = projects.where(F.col("error").isNull()).select(
        F.col("path").alias("project_path"), F.posexplode("project.volumes").alias("_at", "v")
    )
    here = F.col("project_path")
    output = F.nullif(F.col("v.output_path"), F.lit(""))
    return rows.select(
        "project_path",
        (F.col("_at") + 1).cast("bigint").alias("position"),
        loaded_path(F.coalesce("v.pdf_path", F.lit("")), here).alias("path"),
        F.coalesce("v.volume_number", F.col("_at") + 1).alias("volume_number"),
        _or_default(F.col("v.status"), "Unreviewed").alias("status"),
        F.when(output.isNotNull(), loaded_path(output, here)).alias("output_path"),
        F.coalesce("v.warnings", F.array().cast("array<string>")).alias("warnings"),
        F.col("v.error").alias("error"),
        F.col("v.layout").alias("layout"),
    )


def read_projects(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(series, volumes) of the project files under ``path``."""
    projects = parse_projects(read_documents(spark, path))
    return project_series(projects), project_volumes(projects)


# --- writing ----------------------------------------------------------------------------------------

def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def document_lines(heads: DataFrame, items: DataFrame, key: str, list_name: str) -> DataFrame:
    """Documents as text lines: a head, one line per list item, a tail.

    ``heads(key, head)`` holds the opening object, ``items(key, position, item)`` the list. A
    document is never held in memory, whatever its number of items.
    """
    last = items.groupBy(key).agg(F.max("position").alias("_last"))
    head = F.concat(F.substring(F.col("head"), 1, F.length("head") - 1), F.lit(f', "{list_name}": ['))
    parts = F.array(
        F.struct(F.lit(0).alias("part"), head.alias("value")), F.struct(F.lit(2).alias("part"), F.lit("]}").alias("value"))
    )
    frame = heads.select(key, F.lit(0).cast("bigint").alias("position"), F.inline(parts))
    comma = F.when(F.col("position") < F.col("_last"), ",").otherwise("")
    body = items.join(last, key).select(
        key, "position", F.lit(1).alias("part"), F.concat("item", comma).alias("value")
    )
    return frame.unionByName(body)


def write_documents(lines: DataFrame, key: str, path: str) -> DataFrame:
    """One file per document, in a folder named by its key: (key, path) of each.

    Its lines are sorted and streamed by one task, which writes many files, each under another name until it is whole.
    Documents are dealt over a fixed number of tasks, because the cost lies in the files, not in their few bytes.
    """
    system, root = open_path(path)
    if system.get_file_info(root).type != fs.FileType.NotFound:
        raise FileExistsError(f"{path} already exists")
    system.create_dir(root, recursive=True)
    rows = spread(lines, key).sortWithinPartitions(key, "part", "position")
    rows = rows.select(F.col(key), F.col(key).cast("string").alias("_name"), "value")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        documents = _documents(batches, path, key)
        while done := list(islice(documents, FILES_A_BATCH)):
            keys, paths = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(paths, pa.string())], ["_name", "path"])

    written = durable(rows.mapInArrow(write, "_name string, path string"))
    return written.select(F.col("_name").cast(lines.schema[key].dataType).alias(key), "path")


def _documents(batches: Iterator[pa.RecordBatch], path: str, key: str) -> Iterator[tuple[str | None, str]]:
    """Write the documents whose sorted lines arrive, and name each one when its file is whole."""
    current: _Document | None = None
    for batch in batches:
        for name, value in zip(batch.column("_name").to_pylist(), batch.column("value").to_pylist(), strict=True):
            if current is None or current.name != name:
                if current is not None:
                    yield current.close()
                current = _Document(path, key, name)
            current.stream.write(f"{value or ''}\n".encode())
    if current is not None:
        yield current.close()


class _Document:
    """One document on its way: written under another name, then moved to its own."""

    def __init__(self, folder: str, key: str, name: str | None) -> None:
        self.name = name
        self.path = _child(folder, f"{key}={UNNAMED if name is None else quote(name, safe=' ')}/document.txt")
        self.system, self.target = open_path(self.path)
        parent, _, file = self.target.rpartition("/")
        self.system.create_dir(parent, recursive=True)
        self.draft = f"{parent}/.{file}.{uuid.uuid4().hex}"
        self.stream = self.system.open_output_stream(self.draft, compression=None)

    def close(self) -> tuple[str | None, str]:
        self.stream.close()
        self.system.move(self.draft, self.target)
        return self.name, self.path


def preset_document_lines(meta: DataFrame, entries: DataFrame) -> DataFrame:
    """Version 2 presets from ``meta(volume_id, source_page_count, title, author, language,
    exclude_cover, cover_kind, cover_source_index, cover_entry_id)`` and extracted entries."""
    head = F.struct(
        F.lit(2).alias("version"),
        "source_page_count",
        F.struct("title", "author", "language", F.col("exclude_cover").alias("exclude_cover_from_reading")).alias("metadata"),
        F.struct(
            F.col("cover_kind").alias("kind"),
            F.col("cover_source_index").alias("source_index"),
            F.col("cover_entry_id").alias("entry_id"),
        ).alias("cover"),
    )
    item = F.to_json(F.struct("kind", "source_index", "path", "entry_id"))
    return document_lines(
        meta.select("volume_id", _json(head).alias("head")),
        entries.select("volume_id", "position", item.alias("item")),
        "volume_id",
        "entries",
    )


def project_document_lines(series: DataFrame, volumes: DataFrame) -> DataFrame:
    """Project files from ``series(series_id, project_path, title, author, language,
    active_volume_number)`` and ``volumes(series_id, position, path, ...)``; an unedited volume has
    a null layout. Paths are stored relative to the project file."""
    head = F.struct(F.lit(PROJECT_VERSION).alias("version"), "title", "author", "language", "active_volume_number")
    rows = volumes.join(series.select("series_id", "project_path"), "series_id")
    here = F.col("project_path")
    item = F.struct(
        stored_path(F.col("path"), here).alias("pdf_path"),
        "volume_number",
        "status",
        F.when(F.col("output_path").isNotNull(), stored_path(F.col("output_path"), here)).alias("output_path"),
        "warnings",
        "error",
        "layout",
    )
    return document_lines(
        series.select("series_id", _json(head).alias("head")),
        rows.select("series_id", "position", _json(item).alias("item")),
        "series_id",
        "volumes",
    )
