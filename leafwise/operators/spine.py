"""Page order as a table: edits of any number of volumes at once.

A spine row is (volume_id, entry_index, kind, source_index, item_id, inserted_path, width, height,
ext); ``kind`` is source, inserted or blank and ``entry_index`` is dense from 0. Edits come as
tables too and refer to the indexes before the edit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions.names import padded, padded4
from leafwise.operators.ordered import chunk_bits, number_rows, ranked, running
from leafwise.session import durable

VOLUME = ["volume_id"]
SPINE_COLUMNS = (
    "volume_id",
    "entry_index",
    "kind",
    "source_index",
    "item_id",
    "inserted_path",
    "width",
    "height",
    "ext",
)
INSERTED_PREFIX = "inserted-"


def lengths(spine: DataFrame) -> DataFrame:
    return spine.groupBy("volume_id").agg(F.count(F.lit(1)).alias("entry_count"))


def is_blank() -> Column:
    return F.col("kind") == "blank"


def _renumbered(rows: DataFrame, pos: str, tie: list[str], **more) -> DataFrame:
    """Dense ``entry_index`` along (pos, tie), in the same pass as any other running values."""
    numbered = running(rows, VOLUME, pos, sums={"_place": F.lit(1)}, tie=tie, **more)
    return numbered.withColumn("entry_index", (F.col("_place") - 1).cast("bigint"))


# --- insert ---------------------------------------------------------------------------------------

def check_points(spine: DataFrame, points: DataFrame, what: str = "Blank") -> DataFrame:
    """Points with ``error``: an index outside 0..entry_count, or no page to size a blank by."""
    size = spine.groupBy("volume_id").agg(F.count(F.lit(1)).alias("_n"), F.count_if(~is_blank()).alias("_pages"))
    outside = ~F.col("index").between(0, F.coalesce("_n", F.lit(0)))
    error = F.when(outside, f"{what} insertion index out of range")
    if what == "Blank":
        bare = F.coalesce("_pages", F.lit(0)) == 0
        error = error.when(bare, "Cannot insert blank page into an empty layout")
    return points.join(size, "volume_id", "left").withColumn("error", error).drop("_n", "_pages")


def insert_blanks(spine: DataFrame, points: DataFrame) -> DataFrame:
    """Insert one blank per row of ``points(volume_id, index, seq)``, ahead of the entry there.

    A blank takes its size from the nearest earlier page, else from the next one.
    """
    valid = check_points(spine, points).where(F.col("error").isNull())
    blanks = valid.select(
        "volume_id",
        F.col("index").cast("bigint").alias("_pos"),
        F.lit(0).alias("_side"),
        F.col("seq").cast("bigint").alias("_seq"),
        F.lit("blank").alias("kind"),
    )
    entries = spine.withColumns({"_pos": F.col("entry_index"), "_side": F.lit(1), "_seq": F.lit(0).cast("bigint")})
    rows = entries.drop("entry_index").unionByName(blanks, allowMissingColumns=True)
    size = F.when(~is_blank(), F.struct("width", "height"))
    rows = _renumbered(rows, "_pos", ["_side", "_seq"], before={"_earlier": size}, after={"_next": size})
    reference = F.coalesce("_earlier", "_next")
    new = F.col("_side") == 0
    return rows.withColumns(
        {
            "width": F.when(new, reference["width"]).otherwise(F.col("width")),
            "height": F.when(new, reference["height"]).otherwise(F.col("height")),
        }
    ).select(*SPINE_COLUMNS)


def image_ext(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.when(ext == "jpeg", "jpg").otherwise(ext)


def inserted_number(item_id: Column) -> Column:
    return F.nullif(F.regexp_extract(item_id, f"^{INSERTED_PREFIX}([0-9]+)$", 1), F.lit("")).try_cast("bigint")


def check_images(spine: DataFrame, images: DataFrame) -> DataFrame:
    """Images with ``error`` for a bad index or a format other than JPEG and PNG."""
    checked = check_points(spine, images, "Image")
    bad = F.when(~image_ext(F.col("path")).isin("jpg", "png"), "Only JPEG and PNG images can be inserted")
    return checked.withColumn("error", F.coalesce("error", bad))


def insert_images(spine: DataFrame, images: DataFrame) -> DataFrame:
    """Insert ``images(volume_id, index, seq, path, width, height)``.

    Ids continue after the highest number already used in the volume, in ``seq`` order.
    """
    valid = check_images(spine, images).where(F.col("error").isNull()).drop("error")
    highest = spine.groupBy("volume_id").agg(F.max(inserted_number(F.col("item_id"))).alias("_used"))
    counted = number_rows(valid, VOLUME, "seq", "_nth", first=1).join(highest, "volume_id", "left")
    number = F.coalesce("_used", F.lit(0)) + F.col("_nth")
    new = counted.select(
        "volume_id",
        F.col("index").cast("bigint").alias("_pos"),
        F.lit(0).alias("_side"),
        F.col("seq").cast("bigint").alias("_seq"),
        F.lit("inserted").alias("kind"),
        F.concat(F.lit(INSERTED_PREFIX), padded4(number)).alias("item_id"),
        F.col("path").alias("inserted_path"),
        "width",
        "height",
        image_ext(F.col("path")).alias("ext"),
    )
    entries = spine.withColumns({"_pos": F.col("entry_index"), "_side": F.lit(1), "_seq": F.lit(0).cast("bigint")})
    rows = entries.drop("entry_index").unionByName(new, allowMissingColumns=True)
    return _renumbered(rows, "_pos", ["_side", "_seq"]).select(*SPINE_COLUMNS)


# --- delete, move, recover ------------------------------------------------------------------------

def first_ranges(counts: DataFrame) -> DataFrame:
    """Ranges for ``counts(volume_id, count)`` leading entries; counts must be positive."""
    return counts.select("volume_id", F.lit(0).cast("bigint").alias("start"), (F.col("count") - 1).alias("end"))


def last_ranges(spine: DataFrame, counts: DataFrame) -> DataFrame:
    """Ranges for ``counts(volume_id, count)`` trailing entries."""
    n = F.col("entry_count")
    return counts.join(lengths(spine), "volume_id").select(
        "volume_id", F.greatest(n - F.col("count"), F.lit(0)).alias("start"), (n - 1).alias("end")
    )


def check_ranges(spine: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges with the end clamped to the last entry and ``error`` for unusable ones."""
    start, end, n = F.col("start"), F.col("end"), F.coalesce("entry_count", F.lit(0))
    error = (
        F.when(n == 0, "Cannot delete from an empty layout")
        .when((start < 0) | (end < 0), "Delete range cannot be negative")
        .when(start > end, "Delete range start must be before end")
        .when(start >= n, "Delete range starts after the end of the layout")
    )
    return (
        ranges.join(lengths(spine), "volume_id", "left")
        .withColumns({"error": error, "end": F.least(end, n - 1)})
        .drop("entry_count")
    )


def merged_ranges(ranges: DataFrame) -> DataFrame:
    """Ranges of each volume with overlapping and adjacent ones made one."""
    ends = running(ranges, VOLUME, "start", before={}, maxes={"_upto": F.col("end")}, tie=["end"])
    opens = ends.withColumn("_before", F.col("_upto"))
    shifted = running(opens, VOLUME, "start", before={"_last": F.col("_upto")}, tie=["end"])
    new = F.col("_last").isNull() | (F.col("start") > F.col("_last") + 1)
    grouped = running(shifted.withColumn("_new", new.cast("bigint")), VOLUME, "start", sums={"_group": F.col("_new")}, tie=["end"])
    return grouped.groupBy("volume_id", "_group").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_group")


def _in_ranges(spine: DataFrame, merged: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on merged ranges. They are cut at chunk borders: the join key is
    (volume, chunk), a long volume spreads over many tasks, and an entry meets one range at most."""
    bits = chunk_bits(spine.sparkSession)
    cut = merged.select(
        "volume_id",
        "start",
        "end",
        F.explode(F.sequence(F.shiftright("start", bits), F.shiftright("end", bits))).alias("_chunk"),
    )
    rows = spine.withColumn("_chunk", F.shiftright("entry_index", bits)).alias("s")
    cut = cut.alias("r")
    match = (
        (F.col("s.volume_id") == F.col("r.volume_id"))
        & (F.col("s._chunk") == F.col("r._chunk"))
        & F.col("s.entry_index").between(F.col("r.start"), F.col("r.end"))
    )
    return rows.join(cut, match, how).drop("_chunk")


def delete_entries(spine: DataFrame, ranges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept and renumbered, deleted with their old indexes) for ``ranges(volume_id, start, end)``."""
    valid = check_ranges(spine, ranges).where(F.col("error").isNull())
    # Merging takes three ordered passes, each of which reads its input twice, and both joins read the merged ranges.
    merged = durable(merged_ranges(durable(valid.select("volume_id", "start", "end").distinct())))
    kept = _in_ranges(spine, merged, "left_anti").withColumn("_pos", F.col("entry_index"))
    deleted = _in_ranges(spine, merged, "left_semi")
    return _renumbered(kept, "_pos", []).select(*SPINE_COLUMNS), deleted.select(*SPINE_COLUMNS)


def check_moves(spine: DataFrame, moves: DataFrame) -> DataFrame:
    """Moves with ``error`` for an index outside the spine, or for several moves of one volume."""
    n = F.coalesce("entry_count", F.lit(0))
    several = moves.groupBy("volume_id").agg(F.count(F.lit(1)).alias("_moves"))
    error = (
        F.when(F.col("_moves") > 1, "Only one move for each volume")
        .when(~F.col("from_index").between(0, n - 1), "Move source index out of range")
        .when(~F.col("to_index").between(0, n - 1), "Move destination index out of range")
    )
    checked = moves.join(several, "volume_id").join(lengths(spine), "volume_id", "left")
    return checked.withColumn("error", error).drop("_moves", "entry_count")


def move_entries(spine: DataFrame, moves: DataFrame) -> DataFrame:
    """Move one entry per volume to its final index: ``moves(volume_id, from_index, to_index)``.

    Only indexes between the two places shift; rows are never reordered. Moves that ``check_moves``
    rejects change nothing.
    """
    usable = check_moves(spine, moves).where(F.col("error").isNull())
    rows = spine.join(usable.select("volume_id", "from_index", "to_index"), "volume_id", "left")
    at, start, end = F.col("entry_index"), F.col("from_index"), F.col("to_index")
    moved = (
        F.when(start.isNull(), at)
        .when(at == start, end)
        .when((at > start) & (at <= end), at - 1)
        .when((at < start) & (at >= end), at + 1)
        .otherwise(at)
    )
    return rows.withColumn("entry_index", moved.cast("bigint")).select(*SPINE_COLUMNS)


def recover_deleted(spine: DataFrame, deleted: DataFrame) -> DataFrame:
    """Put one deleted group back at its old indexes (past the end: appended in order).

    The k-th row by old index stands behind ``index - k`` kept entries.
    """
    size = lengths(spine)
    back = number_rows(deleted, VOLUME, "entry_index", "_seq").join(size, "volume_id", "left")
    kept_before = F.least(F.greatest(F.col("entry_index") - F.col("_seq"), F.lit(0)), F.coalesce("entry_count", F.lit(0)))
    back = back.withColumns({"_pos": kept_before.cast("bigint"), "_side": F.lit(0)}).drop("entry_count")
    entries = spine.withColumns({"_pos": F.col("entry_index"), "_side": F.lit(1), "_seq": F.lit(0).cast("bigint")})
    rows = entries.unionByName(back.select(*entries.columns)).drop("entry_index")
    return _renumbered(rows, "_pos", ["_side", "_seq"]).select(*SPINE_COLUMNS)


# --- derived tables -------------------------------------------------------------------------------

def normalize_spine(spine: DataFrame) -> DataFrame:
    """Sequential 1-based names; blanks are numbered on their own. Adds hrefs and ``original_id``."""
    rows = running(
        spine,
        VOLUME,
        "entry_index",
        sums={"_blanks": is_blank().cast("bigint")},
        totals={"_count": F.lit(1).cast("bigint")},
    )
    index = F.col("entry_index") + 1
    number = padded(index, F.col("_count"))
    blank_id = F.concat(F.lit("blank-"), padded4(F.col("_blanks")))
    new_id = F.when(is_blank(), blank_id).otherwise(F.concat(F.lit("page-"), padded4(index)))
    page = F.when(is_blank(), blank_id).otherwise(F.concat(F.lit("page-"), number))
    return rows.select(
        "volume_id",
        index.cast("bigint").alias("page_index"),
        "kind",
        "source_index",
        F.col("item_id").alias("original_id"),
        new_id.alias("item_id"),
        F.when(~is_blank(), F.concat(F.lit("images/page-"), number, F.lit("."), F.col("ext"))).alias("image_href"),
        F.concat(F.lit("xhtml/"), page, F.lit(".xhtml")).alias("page_href"),
        "width",
        "height",
        "ext",
    )


def page_counts(spine: DataFrame) -> DataFrame:
    """Pages per volume by extension, and blanks; jpg and png always appear."""
    ext = F.col("ext")
    return spine.groupBy("volume_id").agg(
        F.count_if(~is_blank() & (ext == "jpg")).alias("jpg"),
        F.count_if(~is_blank() & (ext == "png")).alias("png"),
        F.count_if(is_blank()).alias("blank"),
    )


def resolve_cover(spine: DataFrame, meta: DataFrame) -> DataFrame:
    """Cover entry per volume: the chosen id, else the chosen source, else the first source page.

    ``meta(volume_id, cover_entry_id, cover_source_index)``; null when there is no image page left.
    """
    rows = spine.where(~is_blank()).join(meta.select("volume_id", "cover_entry_id", "cover_source_index"), "volume_id")
    first = lambda hit: F.min(F.when(hit, F.col("entry_index")))
    found = rows.groupBy("volume_id").agg(
        first(F.col("item_id") == F.col("cover_entry_id")).alias("_by_id"),
        first(F.col("source_index") == F.col("cover_source_index")).alias("_by_source"),
        first(F.col("source_index").isNotNull()).alias("_first"),
    )
    return meta.select("volume_id").join(found, "volume_id", "left").select(
        "volume_id", F.coalesce("_by_id", "_by_source", "_first").alias("cover_entry_index")
    )


def reading_pages(spine: DataFrame, covers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages to read, volumes with ``error``) for ``covers(volume_id, cover_entry_index, exclude_cover)``."""
    rows = spine.join(covers, "volume_id", "left")
    dropped = F.coalesce(F.col("exclude_cover") & (F.col("entry_index") == F.col("cover_entry_index")), F.lit(False))
    left = rows.groupBy("volume_id").agg(F.count_if(~dropped).alias("_left"))
    errors = left.where(F.col("_left") == 0).select("volume_id", F.lit("No reading pages remain").alias("error"))
    return rows.where(~dropped).select(*spine.columns), errors


def spread_property(page_index: Column, blank: Column, centre: bool, pair_first_two: bool) -> Column:
    """Page-spread property of a reading page; the two modes exclude each other."""
    if centre and pair_first_two:
        raise ValueError("centred pages cannot pair the first two")
    if centre:
        return F.lit("rendition:page-spread-center")
    if not pair_first_two:
        return F.lit(None).cast("string")
    return F.when(~blank & (page_index == 1), "rendition:page-spread-right").when(
        ~blank & (page_index == 2), "rendition:page-spread-left"
    )


def extract_entries(spine: DataFrame) -> DataFrame:
    """Preset entries as rows: (volume_id, position, kind, source_index, path, entry_id)."""
    inserted = F.col("kind") == "inserted"
    return spine.select(
        "volume_id",
        F.col("entry_index").alias("position"),
        "kind",
        F.when(F.col("kind") == "source", F.col("source_index")).alias("source_index"),
        F.when(inserted, F.col("inserted_path")).alias("path"),
        F.when(inserted, F.col("item_id")).alias("entry_id"),
    )


def deleted_sources(spine: DataFrame, meta: DataFrame) -> DataFrame:
    """Source pages 1..source_page_count that the spine no longer holds."""
    bits = chunk_bits(spine.sparkSession)
    # Two steps, so one long volume is expanded by many tasks.
    blocks = meta.where(F.col("source_page_count") > 0).select(
        "volume_id",
        "source_page_count",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("source_page_count") - 1, bits))).alias("_block"),
    )
    begin = F.shiftleft("_block", bits) + 1
    end = F.least(F.shiftleft(F.col("_block") + 1, bits), F.col("source_page_count"))
    pages = blocks.repartition("volume_id", "_block").select(
        "volume_id", F.explode(F.sequence(begin, end)).alias("source_index")
    )
    held = spine.where(F.col("source_index").isNotNull()).select("volume_id", "source_index")
    return pages.join(held, ["volume_id", "source_index"], "left_anti")


def blank_positions(spine: DataFrame) -> DataFrame:
    return spine.where(is_blank()).select("volume_id", F.col("entry_index").alias("position"))


def selected_image_names(spine: DataFrame, selection: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """File names for ``selection(volume_id, index, seq)``: blanks and unknown indexes drop out.

    A repeated name gets -1, -2, ... past the names in ``existing(volume_id, name)``.
    """
    pages = spine.where(~is_blank()).select("volume_id", F.col("entry_index").alias("index"), "ext")
    rows = selection.join(pages, ["volume_id", "index"]).join(lengths(spine), "volume_id")
    rows = durable(rows.withColumn("_stem", padded(F.col("index") + 1, F.col("entry_count"))))  # numbering reads it three times
    nth = number_rows(rows, ["volume_id", "_stem", "ext"], "seq", "_nth")
    if existing is None:
        place = F.col("_nth")
        taken = nth
    else:
        taken = _free_suffixes(nth, existing)
        place = F.col("_suffix")
    suffix = F.when(place > 0, F.concat(F.lit("-"), place.cast("string"))).otherwise("")
    return taken.select(
        "volume_id", "index", "seq", F.concat("_stem", suffix, F.lit("."), F.col("ext")).alias("file_name")
    )


def _free_suffixes(rows: DataFrame, existing: DataFrame) -> DataFrame:
    """``_suffix``: the ``_nth`` free suffix number per (volume, stem, ext).

    The occupied numbers below a free number n are counted by the merge order of
    ``occupied - rank`` and ``nth``, so no candidate number is tried one by one.
    """
    keys = ["volume_id", "_stem", "ext"]
    parts = existing.select(
        "volume_id",
        F.regexp_extract("name", r"^([0-9]+)(?:-([0-9]+))?\.([^.]+)$", 1).alias("_stem"),
        F.regexp_extract("name", r"^([0-9]+)(?:-([0-9]+))?\.([^.]+)$", 3).alias("ext"),
        F.coalesce(
            F.nullif(F.regexp_extract("name", r"^([0-9]+)(?:-([0-9]+))?\.([^.]+)$", 2), F.lit("")).cast("bigint"),
            F.lit(0).cast("bigint"),
        ).alias("_used"),
    )
    parts = durable(parts.distinct())
    used = number_rows(parts, keys, "_used", "_rank").select(
        *keys, (F.col("_used") - F.col("_rank")).alias("_key"), F.lit(0).alias("_side")
    )
    both = durable(rows.withColumns({"_key": F.col("_nth"), "_side": F.lit(1)}).unionByName(used, allowMissingColumns=True))
    counted = running(both, keys, "_key", sums={"_before": (F.col("_side") == 0).cast("bigint")}, tie=["_side"])
    return counted.where(F.col("_side") == 1).withColumn("_suffix", F.col("_nth") + F.col("_before"))


def skipped_blanks(spine: DataFrame, selection: DataFrame) -> DataFrame:
    """Selected blanks per volume; they are not exported."""
    blanks = spine.where(is_blank()).select("volume_id", F.col("entry_index").alias("index"))
    return selection.join(blanks, ["volume_id", "index"]).groupBy("volume_id").agg(F.count(F.lit(1)).alias("skipped"))


def cover_blank_points(covers: DataFrame) -> DataFrame:
    """Insertion points for ``covers(volume_id, cover_entry_index, before, after)``.

    ``before`` blanks stand directly ahead of the cover and ``after`` blanks directly behind it.
    """
    cover = F.coalesce("cover_entry_index", F.lit(0)).cast("bigint")

    def several(count: str, index: Column) -> DataFrame:
        numbers = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(count).cast("bigint")))
        return covers.where(F.col(count) > 0).select("volume_id", index.alias("index"), numbers.alias("seq"))

    # The two groups never share an index, so their numbers may overlap.
    return several("before", cover).unionByName(several("after", cover + 1))


def has_saved_layout(spine: DataFrame, meta: DataFrame) -> DataFrame:
    """``saved``: the spine is not simply source pages 1..source_page_count in order."""
    off = (F.col("kind") != "source") | (F.col("source_index") != F.col("entry_index") + 1)
    state = spine.groupBy("volume_id").agg(
        F.count_if(F.coalesce(off, F.lit(True))).alias("_off"), F.count(F.lit(1)).alias("_n")
    )
    changed = (F.coalesce("_off", F.lit(0)) > 0) | (F.coalesce("_n", F.lit(0)) != F.col("source_page_count"))
    return meta.join(state, "volume_id", "left").select("volume_id", changed.alias("saved"))


def member_names(pages: DataFrame) -> DataFrame:
    """Package names of imported pages: zero-padded to the page count, at least four digits."""
    count = pages.groupBy("volume_id").agg(F.count(F.lit(1)).alias("_count"))
    number = padded(F.col("page"), F.col("_count"))
    return pages.join(count, "volume_id").select(
        *pages.columns,
        F.concat(F.lit("page-"), padded4(F.col("page"))).alias("item_id"),
        F.concat(F.lit("images/page-"), number, F.lit("."), F.col("ext")).alias("image_href"),
        F.concat(F.lit("xhtml/page-"), number, F.lit(".xhtml")).alias("page_href"),
    )
