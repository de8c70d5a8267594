"""Queries for project documents."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafwise.operators import spine as spine_ops
from leafwise.operators.ordered import spread
from leafwise.plans.inputs import ORDER_SPINE_SQL, order_spine, table
from leafwise.plans.registry import query
from leafwise.session import checkpoint_folder, durable
from leafwise.sources import documents


def project_texts(spark, sf):
    """One project file per customer, with two volumes; every fifth has another version."""
    key = F.col("c_custkey")
    n = key.cast("string")
    text = F.concat(
        F.lit('{"version": '), F.when(key % 5 == 4, "2").otherwise("1"),
        F.lit(', "title": "'), F.when(key % 3 == 0, "").otherwise(F.col("c_name")),
        F.lit('", "language": null, "volumes": [{"pdf_path": "../in/'), n,
        F.lit('.cbz", "status": "", "warnings": ["w1", "w2"]}, {"pdf_path": "/abs/'), n,
        F.lit('.zip", "volume_number": '), n, F.lit(', "status": "Ready", "output_path": "out/'), n, F.lit('.epub"}]}'),
    )
    path = F.concat(F.lit("/shelf/"), F.col("c_mktsegment"), F.lit("/"), n, F.lit(".json"))
    return table(spark, sf, "customer").select(path.alias("path"), text.alias("json"))


_P = "'/shelf/' || c_mktsegment || '/' || c_custkey || '.json'"


@query(
    "project_series",
    f"""SELECT {_P} AS project_path, CASE WHEN c_custkey % 3 = 0 THEN 'Untitled Series' ELSE c_name END AS title,
      '' AS author, 'zh-Hant' AS language FROM customer WHERE c_custkey % 5 <> 4""",
)
def project_series(spark, sf):
    projects = documents.parse_projects(project_texts(spark, sf))
    return documents.project_series(projects).select("project_path", "title", "author", "language")


_VOLUMES = f"""SELECT {_P} AS project_path, 1::BIGINT AS position, '/shelf/in/' || c_custkey || '.cbz' AS path, 1::BIGINT AS volume_number,
  'Unreviewed' AS status, NULL AS output_path, 'w1; w2' AS warnings FROM customer WHERE c_custkey % 5 <> 4
UNION ALL SELECT {_P}, 2, '/abs/' || c_custkey || '.zip', c_custkey, 'Ready',
  '/shelf/' || c_mktsegment || '/out/' || c_custkey || '.epub', '' FROM customer WHERE c_custkey % 5 <> 4"""


@query("project_volumes", _VOLUMES)
def project_volumes(spark, sf):
    return _volume_columns(documents.project_volumes(documents.parse_projects(project_texts(spark, sf))))


def _volume_columns(found):
    return found.select(
        "project_path", "position", "path", "volume_number", "status", "output_path",
        F.array_join("warnings", "; ").alias("warnings"),
    )


@query("project_files", _VOLUMES)
def project_files(spark, sf):
    """The volumes of all projects after writing them as project files and reading these back."""
    # Parsing is costly for its few bytes; the writer reads its result several times.
    parsed = documents.parse_projects(spread(project_texts(spark, sf), "path"))
    number = F.regexp_extract("project_path", "([0-9]+)[.]json$", 1).cast("bigint").alias("series_id")
    series = durable(documents.project_series(parsed).select(number, "*"))
    rows = durable(documents.project_volumes(parsed).select(number, "*").drop("project_path"))
    folder = f"{checkpoint_folder(spark)}/projects-{uuid.uuid4().hex}"
    files = documents.write_documents(documents.project_document_lines(series, rows), "series_id", folder)
    # Paths inside a file are relative to where the project lives, not to this folder.
    files = documents.documents_at(files).select("series_id", "json")
    back = files.join(series.select("series_id", F.col("project_path").alias("path")), "series_id")
    return _volume_columns(documents.project_volumes(documents.parse_projects(back.select("path", "json"))))


@query(
    "rejected_projects",
    f"""SELECT {_P} AS path, 'Unsupported series project version' AS error FROM customer WHERE c_custkey % 5 = 4""",
)
def rejected_projects(spark, sf):
    projects = documents.parse_projects(project_texts(spark, sf))
    return projects.where(F.col("error").isNotNull()).select("path", "error")


@query(
    "preset_document_lines",
    f"""WITH {ORDER_SPINE_SQL}, n AS (SELECT volume_id, max(entry_index) AS last FROM order_spine GROUP BY 1)
    SELECT volume_id, 1 AS part, entry_index AS position, '{{"kind":"' || kind || '"'
        || CASE kind WHEN 'source' THEN ',"source_index":' || source_index
           WHEN 'inserted' THEN ',"path":"' || inserted_path || '","entry_id":"' || item_id || '"' ELSE '' END || '}}'
        || CASE WHEN entry_index < last THEN ',' ELSE '' END AS value FROM order_spine JOIN n USING (volume_id)
    UNION ALL SELECT volume_id, 0, 0, '{{"version":2,"source_page_count":' || (last + 1) || ',"metadata":{{"title":"Vol '
        || volume_id || '","author":"","language":"en","exclude_cover_from_reading":false}},"cover":{{"kind":"first-image",'
        || '"source_index":null,"entry_id":null}}, "entries": [' FROM n
    UNION ALL SELECT volume_id, 2, 0, ']}}' FROM n""",
)
def preset_document_lines(spark, sf):
    spine = order_spine(spark, sf)
    meta = spine.groupBy("volume_id").agg((F.max("entry_index") + 1).alias("source_page_count")).select(
        "volume_id", "source_page_count",
        F.concat(F.lit("Vol "), F.col("volume_id").cast("string")).alias("title"),
        F.lit("").alias("author"), F.lit("en").alias("language"), F.lit(False).alias("exclude_cover"),
        F.lit("first-image").alias("cover_kind"), F.lit(None).cast("bigint").alias("cover_source_index"),
        F.lit(None).cast("string").alias("cover_entry_id"),
    )
    lines = documents.preset_document_lines(meta, spine_ops.extract_entries(spine))
    return lines.select("volume_id", "part", "position", "value")
