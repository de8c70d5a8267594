"""Series catalogue: inference, scopes, validation, export accounting and status history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.functions.names import (
    generated_title,
    natural_key,
    safe_filename,
    series_title_author,
    stem,
    volume_number,
)
from leafwise.operators.ordered import ranked

SERIES = ["series_id"]
DEFAULT_LANGUAGE = "zh-Hant"
DEFAULT_TITLE = "Untitled Series"
REPORT_LIMIT = 20


# --- building -------------------------------------------------------------------------------------

def build_series(files: DataFrame) -> DataFrame:
    """``files(series_id, path)`` in natural order with position and inferred volume number."""
    keyed = files.withColumn("_stem", stem(F.col("path")))
    order = [natural_key(F.col("_stem")), F.col("path")]
    placed = ranked(keyed, SERIES, order, "position")
    return placed.select(
        "series_id", "path", "position", volume_number(F.col("_stem"), F.col("position")).alias("volume_number")
    )


def series_metadata(files: DataFrame) -> DataFrame:
    """Title and author of each series, read off its first file in natural order."""
    name = stem(F.col("path"))
    first = files.groupBy("series_id").agg(F.min_by(name, F.struct(natural_key(name), F.col("path"))).alias("_stem"))
    title, author = series_title_author(F.col("_stem"))
    return first.select("series_id", title.alias("title"), author.alias("author"))


# --- scopes ---------------------------------------------------------------------------------------

def scope_tokens(scopes: DataFrame) -> DataFrame:
    """``scopes(series_id, scope)`` to number ranges: (series_id, token, low, high, error).

    ``all`` as the whole scope gives an open range, inside a list it is an error; a blank scope gives
    no row. A number beyond 64 bits is an error.
    """
    text = F.lower(F.trim("scope"))
    tokens = scopes.select("series_id", (text == "all").alias("_all"), F.explode(F.split(text, ",")).alias("token"))
    tokens = tokens.withColumn("token", F.trim("token")).where(F.col("token") != "")
    dashed = F.contains(F.col("token"), F.lit("-"))
    low = F.trim(F.regexp_extract("token", r"^([^-]*)-?", 1))
    high = F.when(dashed, F.trim(F.regexp_extract("token", r"^[^-]*-(.*)$", 1))).otherwise(low)
    everything = F.col("_all")
    good = low.rlike("^[0-9]+$") & high.rlike("^[0-9]+$")
    number = lambda c: F.when(good, c.try_cast("bigint"))
    rows = tokens.withColumns({"low": number(low), "high": number(high)})
    bad = ~everything & (F.col("low").isNull() | F.col("high").isNull() | (F.col("low") > F.col("high")))
    return rows.withColumns(
        {
            "low": F.when(everything, F.lit(0).cast("bigint")).otherwise(F.col("low")),
            "high": F.when(everything, F.lit(9223372036854775807)).otherwise(F.col("high")),
            "error": F.when(bad, F.concat(F.lit("Invalid volume scope: "), "token")),
        }
    ).drop("_all")


def volumes_in_scope(volumes: DataFrame, scopes: DataFrame) -> DataFrame:
    """Volumes whose number lies in the scope of their series; a scope with a bad token selects none."""
    tokens = scope_tokens(scopes)
    broken = tokens.where(F.col("error").isNotNull()).select("series_id").distinct()
    ranges = tokens.where(F.col("error").isNull()).join(broken, "series_id", "left_anti").alias("r")
    rows = volumes.alias("v")
    hit = (F.col("v.series_id") == F.col("r.series_id")) & F.col("v.volume_number").between(
        F.col("r.low"), F.col("r.high")
    )
    return rows.join(ranges, hit, "left_semi")


# --- validation -----------------------------------------------------------------------------------

def output_name(title: Column, number: Column) -> Column:
    return F.concat(safe_filename(generated_title(title, number)), F.lit(".epub"))


def baseline_page_count(volumes: DataFrame, ready_only: bool = False) -> DataFrame:
    """Image count of the first usable volume of each series."""
    usable = F.col("source_exists") & F.col("image_count").isNotNull() & F.col("missing_image").isNull()
    if ready_only:
        usable = usable & (F.col("status") == "Ready")
    return volumes.groupBy("series_id").agg(
        F.min_by("image_count", F.when(usable, F.col("position"))).alias("baseline")
    )


def _repeated(rows: DataFrame, key: str, flag: str) -> DataFrame:
    """Mark rows whose ``key`` occurs more than once in the series.

    Only the repeated keys are joined back, so a key shared by many rows is counted map-side.
    """
    twice = rows.groupBy("series_id", key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    twice = twice.select("series_id", key, F.lit(True).alias(flag))
    return rows.join(twice, ["series_id", key], "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def validate_volumes(volumes: DataFrame, ready_only: bool = False) -> DataFrame:
    """Warnings, error and status of every volume after validation.

    ``volumes`` needs series_id, volume_id, title, position, volume_number, path, status,
    source_exists, image_count, saved_layout, exclude_cover and missing_image (path of a missing
    inserted image, or null). Failed never turns back into another status here.
    """
    rows = volumes.where(F.col("status") == "Ready") if ready_only else volumes
    rows = rows.withColumn("output_name", output_name(F.col("title"), F.col("volume_number")))
    rows = _repeated(_repeated(rows, "output_name", "_collides"), "volume_number", "_repeats")
    rows = rows.join(baseline_page_count(volumes, ready_only), "series_id", "left")
    exists, missing, count = F.col("source_exists"), F.col("missing_image"), F.col("image_count")
    countable = exists & missing.isNull()
    nothing = countable & (count == 0)
    differs = countable & ~nothing & F.col("saved_layout") & (count != F.col("baseline"))
    cover_only = countable & ~nothing & F.col("exclude_cover") & (count <= 1)
    collision = F.concat(F.lit("Output filename collision: "), "output_name")
    warnings = F.array_compact(
        F.array(
            F.when(F.col("_collides"), collision),
            F.when(F.col("_repeats"), F.concat(F.lit("Duplicate volume number: "), F.col("volume_number").cast("string"))),
            F.when(exists & missing.isNotNull(), F.concat(F.lit("Missing inserted image: "), missing)),
            F.when(
                differs,
                F.format_string("Applied layout image count differs from baseline: %d != %d", count, F.col("baseline")),
            ),
        )
    )
    # A later check overwrites the message of an earlier one.
    error = (
        F.when(~exists, F.concat(F.lit("Source file not found: "), "path"))
        .when(missing.isNotNull(), F.concat(F.lit("Inserted image not found: "), missing))
        .when(nothing, "Cannot export an EPUB without image pages")
        .when(cover_only, "Cover-only export would leave no reading pages")
        .when(F.col("_collides"), collision)
    )
    return rows.withColumns({"warnings": warnings, "error": error}).withColumn(
        "status", F.when(F.col("error").isNotNull(), "Failed").otherwise(F.col("status"))
    ).drop("_collides", "_repeats", "baseline")


def validation_summary(validated: DataFrame) -> DataFrame:
    failed = F.col("status") == "Failed"
    return validated.groupBy("series_id").agg(
        F.count_if(~failed).alias("ready"),
        F.count_if(failed).alias("failed"),
        F.count_if(F.size("warnings") > 0).alias("warnings"),
    )


# --- export ---------------------------------------------------------------------------------------

def export_plan(volumes: DataFrame, existing: DataFrame) -> DataFrame:
    """What an export does with each volume; ``existing(output_name)`` files are never overwritten."""
    there = existing.select("output_name").distinct().withColumn("_there", F.lit(True))
    rows = volumes.join(there, "output_name", "left")
    ready = F.col("status") == "Ready"
    blocked = ready & F.coalesce("_there", F.lit(False))
    event = F.when(blocked | (F.col("status") == "Failed"), "failed").when(ready, "started").otherwise("skipped")
    error = F.when(blocked, F.concat(F.lit("Refusing to overwrite existing file: "), "output_name"))
    return rows.select("series_id", "volume_id", "volume_number", "output_name", event.alias("event"), error.alias("error"))


def export_summary(events: DataFrame) -> DataFrame:
    """Totals of ``events(series_id, event, was_failed, warned)``.

    Volumes that had failed before the export report an event but do not count as failed again.
    """
    return events.groupBy("series_id").agg(
        F.count_if(F.col("event") == "exported").alias("exported"),
        F.count_if((F.col("event") == "failed") & ~F.col("was_failed")).alias("failed"),
        F.count_if(F.col("event") == "skipped").alias("skipped"),
        F.count_if(F.col("warned")).alias("warnings"),
    )


def preflight_report(validated: DataFrame, existing: DataFrame, limit: int = REPORT_LIMIT) -> DataFrame:
    """Warning lines and existing-output lines, the first ``limit`` of each per series."""
    tag = F.format_string("Vol.%02d: ", "volume_number")
    warned = validated.select("series_id", "position", tag.alias("_tag"), F.posexplode("warnings").alias("_nth", "_text"))
    warned = warned.select(
        "series_id",
        F.lit("warning").alias("kind"),
        "position",
        F.col("_nth").alias("nth"),
        F.concat("_tag", "_text").alias("line"),
    )
    kept = "output exists and will not be overwritten: "
    there = validated.where(F.col("status") == "Ready").join(existing.select("output_name").distinct(), "output_name")
    there = there.select(
        "series_id",
        F.lit("existing_output").alias("kind"),
        "position",
        F.lit(0).alias("nth"),
        F.concat(tag, F.lit(kept), "output_name").alias("line"),
    )
    order = Window.partitionBy("series_id", "kind").orderBy("position", "nth")
    lines = warned.unionByName(there).withColumn("line_number", F.row_number().over(order))
    return lines.where(F.col("line_number") <= limit).select("series_id", "kind", "line_number", "line")


# --- status history -------------------------------------------------------------------------------

def mark_ready(volumes: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(volumes, history) after marking ``marks(series_id, volume_id, batch_seq)`` as Ready."""
    chosen = marks.groupBy("series_id", "volume_id").agg(F.max("batch_seq").alias("batch_seq"))
    rows = volumes.join(chosen, ["series_id", "volume_id"], "left")
    history = rows.where(F.col("batch_seq").isNotNull()).select(
        "series_id", "volume_id", "batch_seq", F.col("status").alias("previous_status")
    )
    marked = rows.withColumns(
        {
            "status": F.when(F.col("batch_seq").isNotNull(), "Ready").otherwise(F.col("status")),
            "error": F.when(F.col("batch_seq").isNull(), F.col("error")),
        }
    )
    return marked.drop("batch_seq"), history


def unready(volumes: DataFrame, history: DataFrame, selected: DataFrame | None = None) -> DataFrame:
    """Restore the status before the newest mark of each selected volume, or of the last batch.

    ``history(series_id, volume_id, batch_seq, previous_status)``; the last batch is per series.
    """
    keys = ["series_id", "volume_id"]
    if selected is None:
        last = history.groupBy("series_id").agg(F.max("batch_seq").alias("batch_seq"))
        undone = history.join(last, ["series_id", "batch_seq"])
    else:
        undone = history.join(selected.select(*keys).distinct(), keys, "left_semi")
    back = undone.groupBy(*keys).agg(F.max_by("previous_status", "batch_seq").alias("_back"))
    return (
        volumes.join(back, keys, "left")
        .withColumns(
            {
                "status": F.coalesce("_back", "status"),
                "error": F.when(F.col("_back").isNull(), F.col("error")),
            }
        )
        .drop("_back")
    )


def status_summary(volumes: DataFrame) -> DataFrame:
    names = ("Ready", "Edited", "Failed")
    return volumes.groupBy("series_id").agg(
        F.count(F.lit(1)).alias("volumes"), *[F.count_if(F.col("status") == n).alias(n.lower()) for n in names]
    )


def template_batch_check(items: DataFrame, template_pages: Column) -> DataFrame:
    """Batch items against a template: page count and output collisions from the second item on.

    ``items(series_id, position, path, page_count)``; a null page_count means it cannot be read.
    """
    rows = items.withColumn("output_name", F.concat(stem(F.col("path")), F.lit(".epub")))
    first = rows.groupBy("series_id", "output_name").agg(F.min("position").alias("_first"))
    rows = rows.join(first, ["series_id", "output_name"])
    differs = F.col("page_count") != template_pages
    warnings = F.array_compact(
        F.array(
            F.when(F.col("position") > F.col("_first"), F.concat(F.lit("Output filename collision: "), "output_name")),
            F.when(
                differs, F.format_string("Page count differs: expected %d, got %d", template_pages, F.col("page_count"))
            ),
        )
    )
    rows = rows.withColumn("warnings", warnings)
    status = F.when(F.col("page_count").isNull(), "Failed").when(F.size("warnings") > 0, "Warning").otherwise("Ready")
    return rows.withColumn("status", status).drop("_first")
