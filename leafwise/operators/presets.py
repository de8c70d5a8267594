"""Layout templates: parse, apply to volumes, and write."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions.names import generated_title, padded4
from leafwise.operators.ordered import running
from leafwise.operators.series import DEFAULT_LANGUAGE, volumes_in_scope
from leafwise.operators.spine import INSERTED_PREFIX, SPINE_COLUMNS, VOLUME, image_ext, inserted_number, is_blank
from leafwise.session import durable

ENTRY_TYPE = "struct<kind:string,source_index:bigint,path:string,entry_id:string>"
PRESET_TYPE = (
    "struct<version:int,source_page_count:string,"
    "metadata:struct<title:string,author:string,language:string,exclude_cover_from_reading:boolean>,"
    "cover:struct<kind:string,source_index:bigint,entry_id:string>,"
    f"entries:array<{ENTRY_TYPE}>,deleted_source_pages:array<bigint>,blank_positions:array<bigint>>"
)


def parse_presets(texts: DataFrame, json: str = "json") -> DataFrame:
    """Add ``preset`` and ``error``; versions other than 1 and 2 are rejected."""
    rows = texts.withColumn("preset", F.from_json(json, PRESET_TYPE))
    known = F.coalesce(F.col("preset.version").isin(1, 2), F.lit(False))
    return rows.withColumn("error", F.when(~known, "Unsupported preset version"))


def template_page_count(preset: Column) -> Column:
    """Stated page count, else the highest source page of the entries."""
    stated = F.when(preset["source_page_count"].rlike("^[0-9]+$"), preset["source_page_count"].cast("bigint"))
    sources = F.transform(F.filter(preset["entries"], lambda e: e["kind"] == "source"), lambda e: e["source_index"])
    return F.coalesce(stated, F.array_max(sources), F.lit(0).cast("bigint"))


def preset_entries(presets: DataFrame) -> DataFrame:
    """One row per template entry: (preset_id, position, kind, source_index, path, entry_id)."""
    return presets.select("preset_id", F.posexplode("preset.entries").alias("position", "_e")).select(
        "preset_id", F.col("position").cast("bigint").alias("position"), "_e.*"
    )


def preset_meta(presets: DataFrame) -> DataFrame:
    """One row per template with its metadata, cover choice and page count."""
    preset = F.col("preset")
    return presets.select(
        "preset_id",
        template_page_count(preset).alias("template_pages"),
        F.coalesce(F.size("preset.entries"), F.lit(0)).cast("bigint").alias("entry_total"),
        F.nullif(preset["metadata"]["title"], F.lit("")).alias("title"),
        F.coalesce(preset["metadata"]["author"], F.lit("")).alias("author"),
        F.coalesce(F.nullif(preset["metadata"]["language"], F.lit("")), F.lit(DEFAULT_LANGUAGE)).alias("language"),
        F.coalesce(preset["metadata"]["exclude_cover_from_reading"], F.lit(False)).alias("exclude_cover"),
        preset["cover"]["kind"].alias("cover_kind"),
        preset["cover"]["source_index"].alias("cover_source_index"),
        preset["cover"]["entry_id"].alias("cover_entry_id"),
    )


def blank_slots(count: int, positions: Iterable[int | None]) -> list[int]:
    """Final places, ascending, of blanks put one after the other into ``count`` entries at limited positions.

    The last blank stands where it was put. Every earlier one was put at a place counted without the blanks that came
    after it: its final place is as many free places away from the start. Null positions are passed over.
    """
    indexes: list[int] = []
    for position in positions:
        if position is not None:
            indexes.append(min(max(position, 0), count + len(indexes)))
    taken: list[int] = []
    for index in reversed(indexes):
        passed = bisect_right(range(len(taken)), index, key=lambda i: taken[i] - i)
        taken.insert(passed, index + passed)
    return taken


def _slots(wanted: DataFrame) -> DataFrame:
    """``preset_id, _count, place, gap`` of the blanks of each template in volumes of each length.

    ``place`` is final, ``gap`` the number of entries ahead. ``wanted`` holds ``preset_id, _count, positions``.
    """

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = np.array(blank_slots(row["_count"], row["positions"] or ()), np.int64)
                keys = [pa.array(np.full(len(place), row[k], np.int64)) for k in ("preset_id", "_count")]
                columns = [*keys, pa.array(place), pa.array(place - np.arange(len(place)))]
                yield pa.RecordBatch.from_arrays(columns, ["preset_id", "_count", "place", "gap"])

    rows = wanted.select(F.col("preset_id").cast("long").alias("preset_id"), F.col("_count").cast("long").alias("_count"), "positions")
    return rows.mapInArrow(fill, "preset_id long, _count long, place long, gap long")


def apply_preset_v1(spine: DataFrame, targets: DataFrame, presets: DataFrame) -> DataFrame:
    """Drop the listed sources, then insert blanks one after the other at limited positions.

    ``targets(volume_id, preset_id)``. Where the blanks of a template end up depends on the number of entries alone, so it
    is found once for each template and length; one ordered pass then moves the entries behind them and sizes each blank by
    the nearest earlier page, or else the next one. Volumes without a page get no blank.
    """
    chosen = targets.join(presets.select("preset_id", "preset"), "preset_id")
    gone = chosen.select("volume_id", F.explode("preset.deleted_source_pages").alias("source_index")).distinct()
    named = spine.join(targets.select("volume_id").distinct(), "volume_id", "left_semi")
    kept = named.join(gone, ["volume_id", "source_index"], "left_anti").select(*SPINE_COLUMNS)
    dense = running(kept, VOLUME, "entry_index", sums={"_n": F.lit(1)})
    # Three branches read the kept entries.
    dense = durable(dense.withColumn("entry_index", (F.col("_n") - 1).cast("bigint")).select(*SPINE_COLUMNS))
    sizes = dense.groupBy("volume_id").agg(F.count(F.lit(1)).alias("_count"), F.bool_or(~is_blank()).alias("_paged"))
    sized = targets.join(sizes.where("_paged"), "volume_id").select("volume_id", "preset_id", "_count")
    positions = presets.select("preset_id", F.col("preset.blank_positions").alias("positions"))
    slots = _slots(sized.select("preset_id", "_count").distinct().join(positions, "preset_id"))
    blanks = sized.join(slots, ["preset_id", "_count"]).select(
        "volume_id", F.col("gap").alias("entry_index"), F.lit("blank").alias("kind"), "place", F.lit(0).alias("_tie")
    )
    both = dense.withColumn("_tie", F.lit(1)).unionByName(blanks, allowMissingColumns=True)
    size = F.when(~is_blank(), F.struct("width", "height"))
    new = F.col("_tie") == 0
    seen = running(
        both,
        VOLUME,
        "entry_index",
        sums={"_shift": F.when(new, 1).otherwise(0)},
        before={"_earlier": size},
        after={"_next": size},
        tie=["_tie"],
    )
    near = F.coalesce("_earlier", "_next")
    found = {
        "entry_index": F.when(new, F.col("place")).otherwise(F.col("entry_index") + F.col("_shift")).cast("bigint"),
        "width": F.when(new, near["width"]).otherwise(F.col("width")),
        "height": F.when(new, near["height"]).otherwise(F.col("height")),
    }
    return seen.select(*[found[c].alias(c) if c in found else F.col(c) for c in SPINE_COLUMNS])


def missing_images(targets: DataFrame, presets: DataFrame, files: DataFrame) -> DataFrame:
    """(volume_id, error) for inserted images that ``files(path, width, height)`` does not have."""
    wanted = preset_entries(presets).where(F.col("kind") == "inserted").select("preset_id", "path").distinct()
    lost = wanted.join(files.select("path"), "path", "left_anti")
    return targets.join(lost, "preset_id").select(
        "volume_id", F.concat(F.lit("Inserted image not found: "), "path").alias("error")
    )


def preset_errors(targets: DataFrame, presets: DataFrame, files: DataFrame) -> DataFrame:
    """(volume_id, error): why the template of a volume cannot be applied, by its first bad entry."""
    # Entries are checked once a template; only the verdicts meet the volumes.
    entries = preset_entries(presets).join(files.select("path", F.lit(True).alias("_found")).distinct(), "path", "left")
    kind, path = F.col("kind"), F.coalesce("path", F.lit(""))
    inserted = kind == "inserted"
    problem = (
        F.when(inserted & (path != "") & F.col("_found").isNull(), F.concat(F.lit("Inserted image not found: "), path))
        .when(inserted & ~F.coalesce(image_ext(path).isin("jpg", "png"), F.lit(False)), "Only JPEG and PNG images can be inserted")
        .when(
            ~F.coalesce(kind.isin("source", "blank", "inserted"), F.lit(False)),
            F.concat(F.lit("Unsupported preset entry kind: "), F.coalesce(kind, F.lit("None"))),
        )
    )
    bad = entries.withColumn("_problem", problem).where(F.col("_problem").isNotNull())
    bad = bad.groupBy("preset_id").agg(F.min_by("_problem", "position").alias("_problem"))
    unfit = ~F.coalesce(F.col("preset.version") == 2, F.lit(False))
    known = presets.select("preset_id", F.lit(True).alias("_known"), F.when(unfit, "Unsupported preset version").alias("_version"))
    found = targets.join(known, "preset_id", "left").join(bad, "preset_id", "left")
    error = F.when(F.col("_known").isNull(), "Preset not found").otherwise(F.coalesce("_version", "_problem"))
    return found.select("volume_id", error.alias("error")).where(F.col("error").isNotNull())


def apply_preset_v2(
    spine: DataFrame, targets: DataFrame, presets: DataFrame, files: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(spines, errors): all spines, rebuilt in template order for ``targets(volume_id, preset_id)``.

    Volumes without a target, and those with a row in ``errors(volume_id, error)``, keep their entries.
    """
    errors = preset_errors(targets, presets, files)
    usable = targets.join(errors.select("volume_id").distinct(), "volume_id", "left_anti")
    kept = spine.select(*SPINE_COLUMNS).join(usable.select("volume_id").distinct(), "volume_id", "left_anti")
    return _rebuilt(spine, usable, presets, files).unionByName(kept), errors


def _rebuilt(spine: DataFrame, usable: DataFrame, presets: DataFrame, files: DataFrame) -> DataFrame:
    """Spines of ``usable(volume_id, preset_id)`` in template order.

    Absent sources are skipped, pages beyond the template's page count follow at the end.
    """
    meta = preset_meta(presets)
    used = presets.join(usable.select("preset_id").distinct(), "preset_id", "left_semi")
    template = preset_entries(used)
    wanted = usable.join(template.where(F.col("kind") != "inserted"), "preset_id")
    sources = spine.where(F.col("source_index").isNotNull())
    rest = [c for c in SPINE_COLUMNS if c not in ("volume_id", "source_index")]
    last = sources.groupBy("volume_id", "source_index").agg(
        F.max_by(F.struct(*rest), "entry_index").alias("_row")
    )  # of repeated sources the last entry counts
    from_source = (
        wanted.where(F.col("kind") == "source")
        .select("volume_id", "position", "source_index")
        .join(last, ["volume_id", "source_index"])
        .select("volume_id", F.col("position").alias("_pos"), "source_index", "_row.*")
    )
    blanks = wanted.where(F.col("kind") == "blank").select("volume_id", F.col("position").alias("_pos"), "kind")
    # Images meet their files once a template: many templates share a path, and all their volumes would share a task.
    images = _template_images(template).join(files.select(F.col("path").alias("inserted_path"), "width", "height"), "inserted_path")
    images = usable.select("volume_id", "preset_id").join(images, "preset_id").drop("preset_id")
    applied = wanted.where(F.col("kind") == "source").select("volume_id", "source_index").distinct()
    beyond = (
        sources.join(usable.join(meta.select("preset_id", "template_pages", "entry_total"), "preset_id"), "volume_id")
        .where(F.col("source_index") > F.col("template_pages"))
        .join(applied, ["volume_id", "source_index"], "left_anti")
        .withColumn("_pos", F.col("entry_total") + F.col("entry_index"))
        .select(*SPINE_COLUMNS, "_pos")
    )
    rows = from_source
    for more in (blanks, images, beyond):
        rows = rows.unionByName(more, allowMissingColumns=True)
    first_page = spine.where(~is_blank()).groupBy("volume_id").agg(
        F.min_by(F.struct("width", "height"), "entry_index").alias("_first")
    )
    rows = durable(rows.drop("entry_index"))  # an ordered pass reads its input twice
    size = F.when(~is_blank(), F.struct("width", "height"))
    rows = running(rows, VOLUME, "_pos", sums={"_n": F.lit(1)}, before={"_earlier": size})
    # A leading blank takes the size of the first page the volume had.
    rows = rows.join(first_page, "volume_id", "left").withColumn("_size", F.coalesce("_earlier", "_first"))
    return rows.withColumns(
        {
            "entry_index": (F.col("_n") - 1).cast("bigint"),
            "width": F.when(is_blank(), F.col("_size.width")).otherwise(F.col("width")),
            "height": F.when(is_blank(), F.col("_size.height")).otherwise(F.col("height")),
        }
    ).select(*SPINE_COLUMNS)


def _template_images(entries: DataFrame) -> DataFrame:
    """Inserted template entries with their ids.

    An id ``inserted-N`` raises the counter to N; an entry without a number takes the next one. In
    closed form: unnumbered entries so far + the largest (N - unnumbered entries before it).
    """
    rows = entries.where(F.col("kind") == "inserted").withColumn("_given", inserted_number(F.col("entry_id")))
    rows = running(rows, ["preset_id"], "position", sums={"_free": F.col("_given").isNull().cast("bigint")})
    rows = running(rows, ["preset_id"], "position", maxes={"_lead": F.col("_given") - F.col("_free")})
    number = F.col("_free") + F.greatest(F.coalesce("_lead", F.lit(0)), F.lit(0))
    return rows.select(
        "preset_id",
        F.col("position").alias("_pos"),
        "kind",
        F.coalesce(F.nullif("entry_id", F.lit("")), F.concat(F.lit(INSERTED_PREFIX), padded4(number))).alias("item_id"),
        F.col("path").alias("inserted_path"),
        image_ext(F.col("path")).alias("ext"),
    )


def preset_covers(spine: DataFrame, targets: DataFrame, presets: DataFrame) -> DataFrame:
    """Cover of each volume after a template: its choice if present, else the first source page."""
    rows = targets.join(preset_meta(presets), "preset_id")
    pages = spine.where(~is_blank()).join(
        rows.select("volume_id", "cover_kind", "cover_source_index", "cover_entry_id"), "volume_id"
    )
    first = lambda hit: F.min(F.when(hit, F.col("entry_index")))
    inserted, source = F.col("cover_kind") == "inserted", F.col("source_index")
    named = F.col("cover_entry_id").isNotNull()
    found = pages.groupBy("volume_id").agg(
        first(inserted & named & (F.col("item_id") == F.col("cover_entry_id"))).alias("_id"),
        first(inserted & ~named & source.isNull()).alias("_any"),
        first((F.col("cover_kind") == "source") & (source == F.col("cover_source_index"))).alias("_source"),
        first(source.isNotNull()).alias("_first"),
    )
    return rows.select("volume_id").join(found, "volume_id", "left").select(
        "volume_id", F.coalesce("_id", "_any", "_source", "_first").alias("cover_entry_index")
    )


def apply_preset_to_scope(
    volumes: DataFrame, scopes: DataFrame, preset_of: DataFrame, spine: DataFrame, presets: DataFrame, files: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spines, volumes, errors): templates applied to the volumes in scope.

    ``preset_of(series_id, preset_id)``; templates have version 1 or 2. Series metadata wins over the template's, the
    status becomes Edited. Volumes with a row in ``errors(volume_id, error)`` keep their entries and status.
    """
    # Read by many branches below: stored, so the scopes are resolved once.
    hit = durable(volumes_in_scope(volumes, scopes).join(preset_of, "series_id").select("volume_id", "preset_id"))
    first = presets.where(F.coalesce(F.col("preset.version") == 1, F.lit(False)))
    hit_v1 = hit.join(first.select("preset_id"), "preset_id", "left_semi").select("volume_id", "preset_id")
    hit_v2 = hit.join(first.select("preset_id"), "preset_id", "left_anti").select("volume_id", "preset_id")
    spines, errors = apply_preset_v2(spine, hit_v2, presets, files)
    if not hit_v1.isEmpty():
        others = spines.join(hit_v1, "volume_id", "left_anti")
        spines = others.unionByName(apply_preset_v1(spine, hit_v1, first))
    done = hit.select("volume_id").distinct().join(errors, "volume_id", "left_anti")
    marked = volumes.join(done.withColumn("_hit", F.lit(True)), "volume_id", "left")
    after = {
        "status": F.when(F.coalesce("_hit", F.lit(False)), "Edited").otherwise(F.col("status")),
        "book_title": generated_title(F.col("title"), F.col("volume_number")),
    }
    return spines, marked.withColumns(after).drop("_hit"), errors
