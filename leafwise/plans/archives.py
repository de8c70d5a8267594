"""Queries for archives: members of the document table go into archives in the shared folder and are listed again."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafwise.functions.names import is_image_member, stem
from leafwise.plans.inputs import table
from leafwise.plans.registry import query
from leafwise.session import checkpoint_folder
from leafwise.sources import archives

# 64 documents an archive; every third is a picture, every ninth hidden.
_MEMBERS_SQL = """members AS (SELECT 'set-' || (doc_id // 64) AS archive, doc_id,
    CASE WHEN doc_id % 9 = 0 THEN '__MACOSX/' ELSE '' END || 'art/' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.png' ELSE '.txt' END AS name,
    coalesce(strlen(text), 0) AS size FROM documents)"""


def _members(spark, sf):
    key = F.col("doc_id")
    name = F.concat(
        F.when(key % 9 == 0, "__MACOSX/").otherwise(""), F.lit("art/"), key.cast("string"), F.when(key % 3 == 0, ".png").otherwise(".txt")
    )
    return table(spark, sf, "documents").select(
        F.concat(F.lit("set-"), F.floor(key / 64).cast("string")).alias("archive"),
        key.alias("position"), name.alias("name"), F.col("text").cast("binary").alias("content"),
    )


def _written(spark, sf):
    """The folder of the archives and, by archive, where each was written."""
    folder = f"{checkpoint_folder(spark).rstrip('/')}/archives-{uuid.uuid4().hex}"
    written = archives.write_archives(_members(spark, sf), f"{folder}/files")
    written.write.parquet(f"{folder}/written")
    return f"{folder}/files", spark.read.parquet(f"{folder}/written")


@query(
    "scan_archives",
    f"""WITH {_MEMBERS_SQL} SELECT archive, row_number() OVER (PARTITION BY archive ORDER BY doc_id, name) - 1 AS member_ordinal,
      name AS member_name, size, doc_id % 3 = 0 AND doc_id % 9 <> 0 AS is_page FROM members""",
)
def scan_archives(spark, sf):
    rows = archives.scan_archives(spark, _written(spark, sf)[0])
    archive = stem(F.col("archive_path")).alias("archive")
    page = is_image_member(F.col("member_name"), F.col("is_dir")).alias("is_page")
    return rows.select(archive, "member_ordinal", "member_name", "size", page)


@query(
    "archive_members",
    f"""WITH {_MEMBERS_SQL}, a AS (SELECT archive, count(*) AS members, sum(size) AS bytes FROM members GROUP BY 1)
    SELECT archive, members, bytes, 0::BIGINT AS errors FROM a UNION ALL SELECT archive || '-gone', 0, NULL, 1 FROM a""",
)
def archive_members(spark, sf):
    """Paths from rows: each archive once, and once under a name that no archive has."""
    written = _written(spark, sf)[1]
    gone = written.select(F.concat(F.col("archive"), F.lit("-gone")), F.replace("archive_path", F.lit(".cbz"), F.lit("-gone.cbz")))
    paths = written.select("archive", "archive_path").union(gone)
    rows = archives.archive_members(paths).withColumn("archive", stem(F.col("archive_path")))
    return rows.groupBy("archive").agg(
        F.count("member_name").alias("members"), F.sum("size").alias("bytes"), F.count_if(F.col("error").isNotNull()).alias("errors")
    )
