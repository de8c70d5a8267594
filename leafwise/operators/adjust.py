"""Score adjustment: local competition, probe stability and robust per-volume position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.functions.frames import settle
from leafwise.functions.names import page_number
from leafwise.functions.numeric import clamp01
from leafwise.operators.ordered import group_median, halo, own_rows

# Fixed value: pairs below this score get no stability probes.
STABILITY_THRESHOLD = 0.47
PAIR_KEYS = ["volume_id", "right_name", "left_name"]


def span_start() -> Column:
    """First page of a pair of consecutive pages, or null."""
    right, left = page_number(F.col("right_name")), page_number(F.col("left_name"))
    return F.when(F.abs(right - left) == 1, F.least(right, left))


def spans_overlap(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Closed intervals share a page."""
    return (a_start <= b_end) & (b_start <= a_end)


def attach_raw_scores(scores: DataFrame) -> DataFrame:
    """Keep the scores before any adjustment and start the adjustments at zero."""
    zero = F.lit(0.0)
    return scores.withColumns(
        {
            "raw_spread": F.col("spread"),
            "raw_review_score": F.col("review_score"),
            "local_margin": zero,
            "context_penalty": zero,
            "context_boost": zero,
        }
    )


# Four competitors settle every outcome: the near-tie penalty is full from the fourth on.
_COMPETITORS = 4


def contextual_adjustment(scores: DataFrame) -> DataFrame:
    """Lower pairs that compete with an overlapping pair, lift clear local peaks.

    Spans are two pages long, so competitors start at most one page away: one range frame per
    chunk. Only the best few pairs of each start enter the frame, which bounds its size.
    """
    spans = settle(scores, {"span_start": span_start()})
    # Pairs without a span take scattered negative places; they meet no real span.
    scattered = F.lit(-10) - F.pmod(F.xxhash64("right_name", "left_name"), F.lit(1 << 30))
    placed = spans.withColumn("_place", F.coalesce(F.col("span_start"), scattered))
    rows, parts = halo(placed, ["volume_id"], "_place", 1, 1)
    best = Window.partitionBy(*parts, "_place").orderBy(F.col("spread").desc(), "right_name", "left_name")
    nearby = Window.partitionBy(*parts).orderBy("_place").rangeBetween(-1, 1)
    entry = F.when(F.col("_rank") <= _COMPETITORS + 1, F.struct("spread", "right_name", "left_name"))
    rows = own_rows(
        rows.withColumn("_rank", F.row_number().over(best)).withColumn("_near", F.collect_list(entry).over(nearby))
    )
    itself = lambda e: (e["right_name"] == F.col("right_name")) & (e["left_name"] == F.col("left_name"))
    rivals = F.transform(F.filter("_near", lambda e: ~itself(e)), lambda e: e["spread"])
    rows = settle(rows, {"_rivals": F.when(F.col("span_start").isNotNull(), rivals)})
    ties = F.size(F.filter("_rivals", lambda s: s >= F.col("spread") - 0.05))
    has_rival = F.size("_rivals") > 0
    rows = settle(
        rows,
        {
            "local_margin": F.when(has_rival, F.col("spread") - F.array_max("_rivals")).otherwise(F.lit(0.0)),
            "_ties": F.when(has_rival, ties).otherwise(F.lit(0)),
            "_contested": F.coalesce(has_rival, F.lit(False)),
        },
    )
    margin = F.col("local_margin")
    loss = clamp01(
        clamp01((F.lit(0.04) - margin) / 0.12) * 0.10 + clamp01((F.col("_ties") - 1) / F.lit(3.0)) * 0.04
    )
    peak = clamp01((margin - 0.12) / 0.10) * 0.015
    rows = settle(
        rows,
        {
            "_loss": F.when(F.col("_contested"), loss).otherwise(F.lit(0.0)),
            "_peak": F.when(F.col("_contested"), peak).otherwise(F.lit(0.0)),
        },
    )
    rows = settle(
        rows,
        {
            "_spread": clamp01(F.col("spread") * (F.lit(1.0) - F.col("_loss")) + F.col("_peak")),
            "_review": clamp01(F.col("review_score") * (F.lit(1.0) - F.col("_loss") * 0.72) + F.col("_peak")),
        },
    )
    zero = F.lit(0.0)
    kept = [c for c in scores.columns if c not in ("spread", "review_score")]
    on_span = F.col("span_start").isNotNull()
    return rows.select(
        *kept,
        "span_start",
        F.when(F.col("_contested"), F.col("_spread")).otherwise(F.col("spread")).alias("spread"),
        F.when(F.col("_contested"), F.col("_review")).otherwise(F.col("review_score")).alias("review_score"),
        F.col("spread").alias("raw_spread"),
        F.col("review_score").alias("raw_review_score"),
        "local_margin",
        F.when(
            on_span & F.col("_contested") & (F.col("spread") > 0),
            F.greatest(zero, F.lit(1.0) - F.col("_spread") / F.col("spread")),
        )
        .otherwise(zero)
        .alias("context_penalty"),
        F.when(on_span & F.col("_contested"), F.greatest(zero, F.col("_spread") - F.col("spread")))
        .otherwise(zero)
        .alias("context_boost"),
    )


def stability_gate(scores: DataFrame, threshold: float = STABILITY_THRESHOLD) -> DataFrame:
    """Pairs worth the extra probe scorings."""
    return scores.where(F.greatest("spread", "review_score") >= threshold)


def stability_from_probes(probes: DataFrame) -> DataFrame:
    """Agreement of all scorings of a pair (the base score counts as a probe)."""
    seen = probes.groupBy(*PAIR_KEYS).agg(
        (F.max("spread") - F.min("spread")).alias("_range"),
        F.stddev_pop("spread").alias("_std"),
        F.count("spread").alias("_n"),
    )
    stability = clamp01(F.lit(1.0) - F.col("_range") / 0.35 - F.col("_std") / 0.22)
    return seen.select(
        *PAIR_KEYS, F.when(F.col("_n") <= 1, F.lit(1.0)).otherwise(stability).alias("stability")
    )


def robust_relative(scores: DataFrame) -> DataFrame:
    """``relative_score``: place of the spread in its volume by median and absolute deviation.

    Null for a pair without a spread; every pair is kept.
    """
    keys = ["volume_id"]
    values = scores.select(*keys, "spread")
    middle = group_median(values, keys, "spread", "_median")
    away = values.join(middle, keys).select(*keys, "_median", F.abs(F.col("spread") - F.col("_median")).alias("_away"))
    spread_of = group_median(away, keys, "_away", "_mad").join(middle, keys)
    scale = F.greatest(F.lit(0.035), F.lit(1.4826) * F.col("_mad"))
    relative = clamp01(((F.col("spread") - F.col("_median")) / scale + 0.6) / 3.2)
    return settle(scores.join(spread_of, keys), {"relative_score": relative}).drop("_median", "_mad")


def reliability_adjustment(scores: DataFrame, stability: DataFrame) -> DataFrame:
    """Apply probe stability and relative position; pairs without probes are not penalised."""
    rows = robust_relative(scores).join(stability, PAIR_KEYS, "left")
    s, zero = F.col("stability"), F.lit(0.0)
    distinct = clamp01((F.col("relative_score") - 0.74) / 0.16)
    steady = F.when(s.isNull(), zero).otherwise(clamp01((s - 0.88) / 0.12) * 0.012 * distinct)
    rows = settle(
        rows,
        {
            "reliability_penalty": F.when(s.isNull(), zero).otherwise(clamp01((F.lit(0.55) - s) / 0.55) * 0.055),
            "reliability_boost": clamp01((F.col("relative_score") - 0.74) / 0.26) * 0.020 + steady,
        },
    )
    lost, won = F.col("reliability_penalty"), F.col("reliability_boost")
    changed = {
        "_spread": clamp01(F.col("spread") * (F.lit(1.0) - lost) + won),
        "_review": clamp01(F.col("review_score") * (F.lit(1.0) - lost * 0.7) + won),
        # A raw score of zero counts as not set.
        "raw_spread": F.when(F.col("raw_spread") == 0, F.col("spread")).otherwise(F.col("raw_spread")),
        "raw_review_score": F.when(F.col("raw_review_score") == 0, F.col("review_score")).otherwise(
            F.col("raw_review_score")
        ),
        "stability_score": F.coalesce(s, zero),
    }
    rows = settle(rows, changed).drop("spread", "review_score", "stability")
    return rows.withColumnsRenamed({"_spread": "spread", "_review": "review_score"})
