"""CSV interchange of candidates and scores."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.functions.frames import settle
from leafwise.functions.names import pair_id, stem
from leafwise.functions.scores import FEATURES
from leafwise.operators.gaps import RATIOS
from leafwise.operators.select import _score_order

# Columns of the interchange files, each list in the order of its file.
SPREAD_COLUMNS = ("start_page", "end_page", "decision", "spread", "review_score")
INSERT_COLUMNS = (
    "gap", "after_page", "before_page", "safe_insert_score", "label", "visual_difference", "continuity_risk", "reasons",
)
MATCHING_FIELDS = (
    "right", "left", "total", "spread", "review_score", "raw_spread", "raw_review_score", "local_margin",
    "context_penalty", "context_boost", "stability_score", "relative_score", "reliability_penalty", "reliability_boost",
    "expected", "offset", *FEATURES,
)
SCORE_FIELDS = (
    "rank", "total", "spread", "review_score", "raw_spread", "raw_review_score", "local_margin", "context_penalty",
    "context_boost", "stability_score", "relative_score", "reliability_penalty", "reliability_boost", "right", "left",
    "expected", "offset", *FEATURES,
)
REVIEW_FIELDS = (
    "rank", "right", "left", "spread", "total", "review_score", "raw_spread", "raw_review_score", "decision",
    "margin_to_next", "local_margin", "context_penalty", "stability_score", "relative_score", "reliability_penalty",
    "reliability_boost", "expected", "patch", "composition", "seam_activity", "panel", "page_panel", "inner_gutter",
    "barrier", "seam_contact",
)
CLUSTER_FIELDS = (
    "cluster", "rank_in_cluster", "decision", "start_page", "end_page", "right", "left", "spread", "review_score",
    "raw_spread", "raw_review_score", "margin_to_next", "local_margin", "context_penalty", "stability_score",
    "relative_score", "reliability_penalty", "reliability_boost", "composition", "patch", "seam_activity",
    "seam_contact", "barrier", "page_panel", "inner_gutter",
)
FEATURE_FIELDS = ("page", "width", "height", *RATIOS)
GAP_FIELDS = INSERT_COLUMNS
# Types of the fields; all others are doubles.
_LONGS = {
    "rank", "offset", "cluster", "rank_in_cluster", "start_page", "end_page", "page", "width", "height", "after_page", "before_page",
}
_TEXTS = {"right", "left", "decision", "gap", "label", "reasons"}


def require_columns(df: DataFrame, wanted: Iterable[str], name: str = "table") -> DataFrame:
    """The table itself, or a ValueError that lists the missing columns in order."""
    missing = sorted(set(wanted) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
    return df


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``line, file, _first``: all lines that are not empty; ``_first`` orders those of a file's first split."""
    first = F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id())
    rows = spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"), first.alias("_first"))
    return rows.where(F.trim(F.regexp_replace("line", "^\ufeff|\r$", "")) != "")


def file_headers(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, header``: the header of every file under ``path``, its names in the order of that file."""
    rows = _lines(spark, path).where(F.col("_first").isNotNull()).groupBy("file").agg(F.min_by("line", "_first").alias("line"))
    clean = F.regexp_replace("line", "^\ufeff|\r$", "")
    names = F.transform(F.split(clean, ","), lambda n: F.regexp_replace(F.trim(n), '^"|"$', ""))
    return rows.select("file", "line", names.alias("header"))


def files_without_columns(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """``file, error``: every file under ``path`` whose header lacks wanted columns, with their names in order."""
    missing = F.array_sort(F.array_except(F.array(*map(F.lit, sorted(wanted))), "header"))
    rows = file_headers(spark, path).withColumn("_missing", missing).where(F.size("_missing") > 0)
    name = F.regexp_extract("file", "([^/]*)$", 1)
    error = F.concat(name, F.lit(" is missing required columns: "), F.array_join("_missing", ", "))
    return rows.select("file", error.alias("error"))


ERRORS_SHOWN = 20


def read_named(spark: SparkSession, path: str, wanted: Sequence[str]) -> DataFrame:
    """The wanted columns of all files as texts, found by name in the header of each file, with ``file`` and ``volume``.

    Files may order their columns as they like and have others besides. A ValueError names the files that lack a column,
    the first ``ERRORS_SHOWN`` of them; ``files_without_columns`` lists all. Lines equal to their file's header are no rows.
    """
    bad = [r.error for r in files_without_columns(spark, path, wanted).orderBy("file").limit(ERRORS_SHOWN + 1).collect()]
    if bad:
        raise ValueError("; ".join(bad[:ERRORS_SHOWN]) + ("; and more files" if len(bad) > ERRORS_SHOWN else ""))
    headers = file_headers(spark, path)
    widest = headers.agg(F.max(F.size("header"))).first()[0] or 1
    # Two keys leave the join an exchange of its own, which adaptive execution splits for a file with many lines.
    headers = headers.groupBy("file", "line").agg(F.first("header").alias("header"))
    headers = headers.select(F.col("file").alias("_file"), F.col("line").alias("_line"), "header")
    rows = _lines(spark, path).join(headers, F.col("file") == F.col("_file")).where(F.col("line") != F.col("_line"))
    cells = F.from_csv("line", ", ".join(f"c{i} string" for i in range(widest)))
    rows = settle(rows.select("file", "header", cells.alias("_c")), {"_cells": F.array(*[F.col(f"_c.c{i}") for i in range(widest)])})
    value = lambda n: F.get("_cells", (F.array_position("header", n) - 1).cast("int")).alias(n)
    name = _decoded(F.regexp_extract("file", "([^/]*)$", 1))
    return rows.select(*[value(n) for n in wanted], "file", stem(name).alias("volume"))


def _decoded(text: Column) -> Column:
    return F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))


def read_table(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """A folder written by one of the sinks below: ``volume_id`` (text, from the folder's name) and typed ``fields``."""
    volume = _decoded(_decoded(F.regexp_extract("file", "/volume_id=([^/]*)/[^/]*$", 1)))

    def typed(field: str) -> Column:
        if field in _TEXTS:
            return F.col(field)
        if field == "expected":
            return (F.col(field) == "yes").alias(field)
        return F.col(field).cast("long" if field in _LONGS else "double").alias(field)

    rows = read_named(spark, path, fields)
    volume = F.when(volume != "__HIVE_DEFAULT_PARTITION__", volume).alias("volume_id")
    return rows.select(volume, *[typed(f) for f in fields])


def read_spread_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Cluster files, one per volume; ``volume`` is the file stem."""
    return spread_candidates(read_named(spark, path, SPREAD_COLUMNS))


def spread_candidates(rows: DataFrame) -> DataFrame:
    """Rows of cluster files, all texts, as candidates."""
    start, end = F.col("start_page").cast("int"), F.col("end_page").cast("int")
    return rows.select(
        "volume",
        pair_id(start, end).alias("pair_id"),
        start.alias("start_page"),
        end.alias("end_page"),
        F.col("spread").cast("double").alias("score"),
        F.col("review_score").cast("double").alias("review_score"),
        "decision",
        F.lit("spread-continuity").alias("source"),
    )


def read_insert_candidates(spark: SparkSession, path: str) -> DataFrame:
    """Gap files, one per volume. The gap id is derived from the pages, not read."""
    after, before = F.col("after_page").cast("int"), F.col("before_page").cast("int")
    reasons = F.filter(F.transform(F.split(F.coalesce("reasons", F.lit("")), ";"), lambda r: F.trim(r)), lambda r: r != "")
    return read_named(spark, path, INSERT_COLUMNS).select(
        "volume",
        pair_id(after, before).alias("gap_id"),
        after.alias("after_page"),
        before.alias("before_page"),
        *[F.col(c).cast("double").alias(c) for c in ("safe_insert_score", "visual_difference", "continuity_risk")],
        "label",
        reasons.alias("reasons"),
    )


# --- writing --------------------------------------------------------------------------------------

def _texts(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Fixed columns: six decimals, yes / no."""
    named = {"right": "right_name", "left": "left_name", "start_page": "span_start", "end_page": "span_end"}
    kinds = dict(df.dtypes)

    def text(field: str) -> Column:
        source = named[field] if field not in kinds and field in named else field
        value = F.col(source)
        if kinds[source] == "double":
            value = F.when(value.isNotNull(), F.format_string("%.6f", value))
        elif kinds[source] == "boolean":
            value = F.when(value, "yes").otherwise("no")
        return value.alias(field)

    return df.select("volume_id", *[text(f) for f in fields])


def _write(df: DataFrame, fields: Sequence[str], order: Sequence[Column], path: str) -> None:
    """One folder per volume. The range sort splits a long volume over several files in order."""
    rows = _texts(df.repartitionByRange("volume_id", *order).sortWithinPartitions("volume_id", *order), fields)
    rows.write.mode("errorifexists").partitionBy("volume_id").option("header", "true").csv(path)


def write_scores(ranked_scores: DataFrame, path: str) -> None:
    _write(ranked_scores, SCORE_FIELDS, [F.col("rank")], path)


def write_review(decided: DataFrame, path: str) -> None:
    _write(decided, REVIEW_FIELDS, [F.col("rank")], path)


def write_clusters(table: DataFrame, path: str) -> None:
    _write(table, CLUSTER_FIELDS, [F.col("cluster"), F.col("rank_in_cluster")], path)


def write_selected(selected: DataFrame, path: str) -> None:
    _write(selected, MATCHING_FIELDS, [F.col("span_start")], path)


def write_matching(pairs: DataFrame, path: str) -> None:
    _write(pairs, MATCHING_FIELDS, _score_order(), path)


def write_features(features: DataFrame, path: str) -> None:
    _write(features, FEATURE_FIELDS, [F.col("page")], path)


def write_gaps(gaps: DataFrame, path: str) -> None:
    rows = gaps.withColumns(
        {
            "gap": pair_id(F.col("gap_after_page"), F.col("gap_before_page")),
            "after_page": F.col("gap_after_page"),
            "before_page": F.col("gap_before_page"),
            "reasons": F.array_join("reasons", "; "),
        }
    )
    _write(rows, GAP_FIELDS, [F.col("after_page")], path)
