"""Files as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.functions.names import base_name, extension, natural_key
from leafwise.operators.ordered import ranked

# Image files a folder scan takes.
FOLDER_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "tif", "tiff")


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, length) of every file under ``path``; no content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "length")


def list_image_files(spark: SparkSession, path: str) -> DataFrame:
    """Image files of each folder in natural order: (folder, path, position)."""
    files = list_files(spark, path).where(extension(F.col("path")).isin(*FOLDER_EXTENSIONS))
    rows = files.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder"), "path")
    name = base_name(F.col("path"))
    return ranked(rows, ["folder"], [natural_key(name), F.col("path")], "position")
