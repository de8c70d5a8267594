"""Page ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def page_range(pages: DataFrame, wanted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages inside, invalid ranges) for ``wanted(volume_id, page_from, page_to)``; 0 means the last page."""
    sizes = pages.groupBy("volume_id").agg(F.count(F.lit(1)).alias("_n"))
    low, high, n = F.col("page_from"), F.col("_to"), F.col("_n")
    ranges = wanted.join(sizes, "volume_id").withColumn(
        "_to", F.when(F.col("page_to") > 0, F.col("page_to")).otherwise(n)
    )
    invalid = (low < 1) | (high > n) | (low >= high)
    error = F.format_string("invalid page range %d-%d; volume has %d pages", low, high, n)
    errors = ranges.where(invalid).select("volume_id", error.alias("error"))
    good = ranges.where(~invalid).select("volume_id", "page_from", "_to")
    inside = pages.join(good, "volume_id").where(F.col("page").between(low, high))
    return inside.select(*pages.columns), errors
