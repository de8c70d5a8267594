"""Confirmed spreads against a layout: damage, insertion points and what-if results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions.names import is_reviewable, pair_id
from leafwise.operators.ordered import chunk_bits, ranked, running

REVIEW_STATUSES = ("pending", "true", "false")
# Texts of the damage reports.
WRONG_ORDER = "Confirmed pages are in different preview spreads or wrong order"
SPLIT_PAIR = "Confirmed pages are in different preview spreads"
INTACT = "Confirmed spread is paired in the current preview"


# --- review of candidates ---------------------------------------------------------------------------

def check_pairs(candidates: DataFrame, volumes: DataFrame) -> DataFrame:
    """Add ``error``: null for a pair of adjacent pages inside 1..source_page_count."""
    error = (
        F.when(
            (F.col("start_page") < 1) | (F.col("end_page") > F.col("source_page_count")),
            "Spread pair is outside the source page range",
        )
        .when(F.col("end_page") != F.col("start_page") + 1, "Spread pair must use adjacent source pages")
    )
    sizes = volumes.select("volume_id", "source_page_count")
    return candidates.join(sizes, "volume_id").withColumn("error", error).drop("source_page_count")


def load_candidates(candidates: DataFrame) -> DataFrame:
    """One row per pair. Rows load best first and later ones overwrite, so the lowest score stays."""
    rest = [c for c in candidates.columns if c not in ("volume_id", "pair_id")]
    lowest = F.min_by(F.struct(*rest), F.struct("score", "review_score", "decision"))
    return candidates.groupBy("volume_id", "pair_id").agg(lowest.alias("_c")).select("volume_id", "pair_id", "_c.*")


def apply_review_marks(candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """``status`` per candidate: the newest valid mark, else pending."""
    valid = marks.where(F.col("status").isin(*REVIEW_STATUSES))
    newest = valid.groupBy("volume_id", "pair_id").agg(F.max_by("status", "seq").alias("status"))
    return candidates.join(newest, ["volume_id", "pair_id"], "left").withColumn(
        "status", F.coalesce("status", F.lit("pending"))
    )


def rejected_marks(candidates: DataFrame, marks: DataFrame) -> DataFrame:
    """Marks with an unknown status or an unknown pair, with ``error``."""
    known = candidates.select("volume_id", "pair_id").distinct().withColumn("_known", F.lit(True))
    error = F.when(~F.col("status").isin(*REVIEW_STATUSES), "Unsupported spread candidate status").when(
        F.col("_known").isNull(), "Unknown spread pair"
    )
    rows = marks.join(known, ["volume_id", "pair_id"], "left").withColumn("error", error).drop("_known")
    return rows.where(F.col("error").isNotNull())


def add_manual_spreads(reviewed: DataFrame, manual: DataFrame) -> DataFrame:
    """Add hand-picked pairs as confirmed; they replace a scanned row of the same pair."""
    chosen = manual.select("volume_id", "start_page", "end_page").distinct()
    rows = chosen.select(
        "volume_id",
        pair_id(F.col("start_page"), F.col("end_page")).alias("pair_id"),
        "start_page",
        "end_page",
        F.lit(1.0).alias("score"),
        F.lit(1.0).alias("review_score"),
        F.lit("manual").alias("decision"),
        F.lit("true").alias("status"),
    )
    kept = reviewed.join(rows.select("volume_id", "pair_id"), ["volume_id", "pair_id"], "left_anti")
    return kept.select(*rows.columns).unionByName(rows)


def manual_pair_check(spine: DataFrame, selections: DataFrame) -> DataFrame:
    """Two selected spine rows make a pair when they are neighbours holding consecutive sources.

    ``selections(volume_id, first_index, second_index)``; adds start_page, end_page, accepted.
    """
    low = F.least("first_index", "second_index").alias("_low")
    high = F.greatest("first_index", "second_index").alias("_high")
    sources = spine.where(F.col("kind") != "blank").select("volume_id", "entry_index", "source_index")
    first = sources.withColumnsRenamed({"entry_index": "_low", "source_index": "start_page"})
    second = sources.withColumnsRenamed({"entry_index": "_high", "source_index": "end_page"})
    rows = selections.select("*", low, high).join(first, ["volume_id", "_low"], "left")
    rows = rows.join(second, ["volume_id", "_high"], "left")
    fits = (F.col("_high") == F.col("_low") + 1) & (F.col("end_page") == F.col("start_page") + 1)
    return rows.withColumn("accepted", F.coalesce(fits, F.lit(False))).drop("_low", "_high")


def confirmed_spreads(reviewed: DataFrame) -> DataFrame:
    return reviewed.where(F.col("status") == "true")


def review_summary(reviewed: DataFrame) -> DataFrame:
    """Candidates per volume by review status."""
    return reviewed.groupBy("volume_id").agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(f"{s}_count") for s in REVIEW_STATUSES],
    )


# --- placement of source pages in the preview -----------------------------------------------------

def _flag(value: bool | Column) -> Column:
    return F.lit(value) if isinstance(value, bool) else value


def preview_index(entry: Column, cover_gap: bool | Column) -> Column:
    """Place in the two-page preview; a cover gap moves everything behind the cover by one."""
    return entry + F.when(_flag(cover_gap) & (entry >= 1), 1).otherwise(0)


def placements(spine: DataFrame, cover_gap: bool | Column) -> DataFrame:
    """Where each source page stands; of repeated sources the last entry counts."""
    pages = spine.where((F.col("kind") != "blank") & F.col("source_index").isNotNull())
    last = pages.groupBy("volume_id", "source_index").agg(F.max("entry_index").alias("entry_index"))
    return last.withColumn("preview_index", preview_index(F.col("entry_index"), cover_gap)).withColumn(
        "preview_pair_index", F.expr("preview_index div 2")
    )


def preview_pairs(spine: DataFrame, cover_gap: bool) -> DataFrame:
    """Preview order with the virtual cover gap, the pair of each place and its side."""
    place = preview_index(F.col("entry_index"), cover_gap)
    shown = F.array(F.struct(place.alias("preview_index"), F.lit(False).alias("is_gap")))
    if cover_gap:
        gap = F.array(F.struct(F.lit(1).cast("bigint").alias("preview_index"), F.lit(True).alias("is_gap")))
        shown = F.when(F.col("entry_index") == 0, F.concat(shown, gap)).otherwise(shown)
    rows = spine.select("volume_id", "entry_index", F.inline(shown)).withColumn("pair_index", F.expr("preview_index div 2"))
    first_right = F.lit(not cover_gap) | (F.col("pair_index") != 0)
    is_first = F.col("preview_index") % 2 == 0
    return rows.select(
        "volume_id",
        F.when(~F.col("is_gap"), F.col("entry_index")).alias("entry_index"),
        "preview_index",
        "pair_index",
        "is_gap",
        F.when(is_first == first_right, "right").otherwise("left").alias("side"),
    )


def diagnose_damage(spine: DataFrame, confirmed: DataFrame, cover_gap: bool | Column) -> DataFrame:
    """Is each confirmed spread still shown as one spread?"""
    at = placements(spine, cover_gap)

    def side(page: str, tag: str) -> DataFrame:
        return at.select(
            "volume_id",
            F.col("source_index").alias(page),
            F.col("entry_index").alias(f"{tag}_entry_index"),
            F.col("preview_index").alias(f"_{tag}"),
            F.col("preview_pair_index").alias(f"_{tag}_pair"),
        )

    rows = confirmed.select("volume_id", "pair_id", "start_page", "end_page")
    rows = rows.join(side("start_page", "start"), ["volume_id", "start_page"], "left")
    rows = rows.join(side("end_page", "end"), ["volume_id", "end_page"], "left")
    gone = lambda tag, page: F.when(F.col(f"_{tag}").isNull(), F.format_string("Page %d", page))
    missing = F.concat_ws(" and ", gone("start", F.col("start_page")), gone("end", F.col("end_page")))
    apart = F.col("_start") + 1 != F.col("_end")
    split = F.col("_start_pair") != F.col("_end_pair")
    return rows.select(
        "volume_id",
        "pair_id",
        "start_page",
        "end_page",
        F.when(missing != "", "missing").when(apart | split, "damaged").otherwise("intact").alias("status"),
        F.when(missing != "", F.concat(missing, F.lit(" missing from current layout")))
        .when(apart, WRONG_ORDER)
        .when(split, SPLIT_PAIR)
        .otherwise(INTACT)
        .alias("reason"),
        "start_entry_index",
        "end_entry_index",
    )


# --- insertion points -----------------------------------------------------------------------------

def insertion_index(candidates: DataFrame, spine: DataFrame) -> DataFrame:
    """Where a candidate gap lies now; null (stale) unless both pages are still neighbours."""
    at = placements(spine, False).select("volume_id", "source_index", "entry_index")
    after = at.withColumnsRenamed({"source_index": "after_page", "entry_index": "_after"})
    before = at.withColumnsRenamed({"source_index": "before_page", "entry_index": "_before"})
    rows = candidates.join(after, ["volume_id", "after_page"], "left").join(
        before, ["volume_id", "before_page"], "left"
    )
    index = F.when(F.col("_before") == F.col("_after") + 1, F.col("_before"))
    return rows.withColumn("insertion_index", index).drop("_after", "_before")


def protected_gaps(candidates: DataFrame, confirmed: DataFrame) -> DataFrame:
    """``inside_pair``: the confirmed spread the gap would cut, or null."""
    inside = confirmed.select(
        "volume_id",
        F.col("start_page").alias("after_page"),
        F.col("end_page").alias("before_page"),
        F.col("pair_id").alias("inside_pair"),
    ).distinct()
    return candidates.join(inside, ["volume_id", "after_page", "before_page"], "left")


def repair_ranges(damage: DataFrame, cover_gap: bool | Column) -> DataFrame:
    """Damaged spreads that one blank can repair, with the insertion indexes that do it.

    A blank ahead of two adjacent pages flips their parity. It repairs a pair that straddles two
    preview spreads, and breaks every intact pair behind it. So a blank at ``i`` repairs a spread
    without breaking another exactly when ``repair_from <= i <= repair_to``; no layout has to be
    simulated. Rows whose range is empty are dropped.
    """
    last_intact = damage.groupBy("volume_id").agg(
        F.max(F.when(F.col("status") == "intact", F.col("start_entry_index"))).alias("_last")
    )
    rows = damage.where(_straddles(cover_gap)).join(last_intact, "volume_id")
    return rows.select(
        "volume_id",
        "pair_id",
        F.greatest(F.coalesce("_last", F.lit(0)) + 1, F.lit(1)).cast("bigint").alias("repair_from"),
        F.col("start_entry_index").alias("repair_to"),
    ).where(F.col("repair_from") <= F.col("repair_to"))


def _straddles(cover_gap: bool | Column) -> Column:
    """Damaged, adjacent, and only off by parity."""
    start = F.col("start_entry_index")
    odd = preview_index(start, cover_gap) % 2 == 1
    return (F.col("status") == "damaged") & (F.col("end_entry_index") == start + 1) & odd


def what_if_insert(
    spine: DataFrame, confirmed: DataFrame, candidates: DataFrame, cover_gap: bool | Column
) -> DataFrame:
    """Classify every reviewable gap: suggested, protected or stale; others are dropped.

    Breaking and repairing depend only on the spreads that start at or behind the insertion index
    (see ``repair_ranges``), so suffix aggregates over one ordered pass replace the
    candidate x spread product. ``fix_count`` and ``first_fix`` describe the repaired spreads;
    ``with_fixes`` and ``expand_fixes`` list them. Stale gaps have no place and stay out of that pass.
    """
    damage = diagnose_damage(spine, confirmed, cover_gap)
    gaps = candidates.where(is_reviewable(F.col("label")))
    gaps = protected_gaps(insertion_index(gaps, spine), confirmed)
    intact = F.when(F.col("status") == "intact", F.col("pair_id"))
    fixable = F.when(_straddles(cover_gap), F.col("pair_id"))
    spreads = damage.where(F.col("start_entry_index").isNotNull()).select(
        "volume_id", F.col("start_entry_index").alias("_at"), intact.alias("_intact"), fixable.alias("_fixable")
    )
    spreads = spreads.where(F.col("_intact").isNotNull() | F.col("_fixable").isNotNull())
    points = gaps.withColumns(
        {
            "_at": F.col("insertion_index"),
            "_intact": F.lit(None).cast("string"),
            "_fixable": F.lit(None).cast("string"),
            "_point": F.lit(0),
        }
    )
    stale = F.col("insertion_index").isNull()
    lost = points.where(stale).drop("_at", "_intact", "_fixable", "_point")
    both = points.where(~stale).unionByName(spreads.withColumn("_point", F.lit(1)), allowMissingColumns=True)
    seen = running(
        both,
        ["volume_id"],
        "_at",
        later_mins={"_broken": F.col("_intact"), "_fixed": F.col("_fixable")},
        later_sums={"fix_count": F.when(F.col("_fixable").isNotNull(), 1).otherwise(0)},
        tie=["_point"],
    ).where(F.col("_point") == 0)
    seen = seen.unionByName(lost, allowMissingColumns=True)
    inside, broken, fixed = F.col("inside_pair"), F.col("_broken"), F.col("_fixed")
    kind = (
        F.when(stale, "stale")
        .when(inside.isNotNull() | broken.isNotNull(), "protected")
        .when(fixed.isNotNull(), "suggested")
    )
    reason = (
        F.when(stale, F.lit(None))
        .when(inside.isNotNull(), F.concat(F.lit("Gap is inside confirmed spread "), inside))
        .when(broken.isNotNull(), F.concat(F.lit("Insertion would damage confirmed spread "), broken))
        .otherwise(F.concat(F.lit("Repairs confirmed spread "), fixed))
    )
    suggested = F.col("kind") == "suggested"
    return (
        seen.withColumns({"kind": kind, "reason": reason})
        .where(F.col("kind").isNotNull())
        .select(
            "volume_id",
            "kind",
            "gap_id",
            "after_page",
            "before_page",
            "insertion_index",
            F.when(~stale, F.greatest(F.lit(0), F.col("insertion_index") - 1)).alias("marker_entry_index"),
            F.col("safe_insert_score").alias("score"),
            "label",
            "reason",
            F.when(suggested, F.col("fix_count")).otherwise(F.lit(0)).alias("fix_count"),
            F.when(suggested, fixed).alias("first_fix"),
        )
    )


def expand_fixes(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """(volume_id, gap_id, pair_id): every spread repaired by the given suggested points.

    A range stands in every chunk of positions that it covers, a point in one: they meet by volume and chunk, so that
    the result, which lists all repaired spreads of each point, is the largest table that is made.
    """
    bits = chunk_bits(points.sparkSession)
    index = F.col("insertion_index")
    chosen = points.where(F.col("kind") == "suggested").select("volume_id", "gap_id", "insertion_index", F.shiftright(index, bits).alias("_chunk"))
    covered = F.explode(F.sequence(F.shiftright("repair_from", bits), F.shiftright("repair_to", bits)))
    spread_out = ranges.select("volume_id", "pair_id", "repair_from", "repair_to", covered.alias("_chunk"))
    met = chosen.join(spread_out, ["volume_id", "_chunk"])
    return met.where(index.between(F.col("repair_from"), F.col("repair_to"))).select("volume_id", "gap_id", "pair_id")


def with_fixes(points: DataFrame, ranges: DataFrame) -> DataFrame:
    """``points`` with ``fixes``, the sorted ids of the spreads that a suggested point repairs; empty for others.

    A list may hold all damaged spreads of its volume. For many points of long volumes use ``expand_fixes``.
    """
    lists = expand_fixes(points, ranges).groupBy("volume_id", "gap_id").agg(F.array_sort(F.collect_set("pair_id")).alias("fixes"))
    none = F.array().cast("array<string>")
    return points.join(lists, ["volume_id", "gap_id"], "left").withColumn("fixes", F.coalesce("fixes", none))


def best_suggestion(points: DataFrame) -> DataFrame:
    """The highest-scored suggested point of each volume."""
    rest = [c for c in points.columns if c != "volume_id"]
    best = F.min_by(F.struct(*rest), F.struct(-F.col("score"), F.col("insertion_index"), F.col("gap_id")))
    suggested = points.where(F.col("kind") == "suggested")
    return suggested.groupBy("volume_id").agg(best.alias("_p")).select("volume_id", "_p.*")


def order_insert_points(points: DataFrame) -> DataFrame:
    """``place``: suggestions by score then index, protected gaps by index then score."""
    shown = points.where(F.col("kind") != "stale")
    suggested = F.col("kind") == "suggested"
    down, index = -F.col("score"), F.col("insertion_index").cast("double")
    lead = F.when(suggested, down).otherwise(index)
    order = [lead, F.when(suggested, index).otherwise(down), F.col("gap_id")]
    return ranked(shown, ["volume_id", "kind"], order, "place")


def spine_markers(points: DataFrame) -> DataFrame:
    """One marker per spine entry: suggestions win; among equals the last in display order."""
    shown = points.where(F.col("kind") != "stale")
    latest = F.struct((F.col("kind") == "suggested").cast("int"), -F.col("score"), F.col("gap_id"))
    return (
        shown.groupBy("volume_id", "marker_entry_index")
        .agg(F.max_by(F.struct("kind", "gap_id", "score"), latest).alias("_m"))
        .select("volume_id", "marker_entry_index", "_m.*")
    )


def damage_summary(damage: DataFrame, points: DataFrame) -> DataFrame:
    """Counts per volume of damage states and insertion point kinds."""
    rows = damage.select("volume_id", F.col("status").alias("_s")).unionByName(
        points.select("volume_id", F.col("kind").alias("_s"))
    )
    names = ("damaged", "intact", "missing", "suggested", "protected", "stale")
    return rows.groupBy("volume_id").agg(*[F.count_if(F.col("_s") == n).alias(n) for n in names])


def stale_results(results: DataFrame, edits: DataFrame) -> DataFrame:
    """``stale``: the layout or the marks changed after the result was computed.

    ``results(volume_id, computed_seq)``, ``edits(volume_id, seq)``.
    """
    newest = edits.groupBy("volume_id").agg(F.max("seq").alias("_edited"))
    stale = F.coalesce(F.col("_edited") > F.col("computed_seq"), F.lit(False))
    return results.join(newest, "volume_id", "left").withColumn("stale", stale).drop("_edited")
