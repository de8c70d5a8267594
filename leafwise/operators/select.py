"""Ranking, review decisions, clusters and non-overlapping selection of scored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.functions.scores import is_auto_safe
from leafwise.operators.adjust import span_start
from leafwise.operators.ordered import falling, halo, own_rows, ranked, ranked_with_next, running

# Thresholds of the decisions.
THRESHOLD = 0.53
RANK_MARGIN = 0.08
CLUSTER_MARGIN = 0.04
EDGE_WINDOW = 3


def _score_order() -> list[Column | str]:
    return [*falling("spread"), *falling("review_score"), "right_name", "left_name"]


def rank_scores(scores: DataFrame) -> DataFrame:
    """``rank`` per volume by spread, review score and names."""
    return ranked(scores, ["volume_id"], _score_order(), "rank")


def review_decisions(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """auto / review / borderline / reject by score and distance to the next-ranked pair."""
    rows = ranked_with_next(scores, ["volume_id"], _score_order(), "rank", {"_next": "spread"})
    rows = rows.withColumn("margin_to_next", F.col("spread") - F.coalesce("_next", F.lit(0.0))).drop("_next")
    spread, review = F.col("spread"), F.col("review_score")
    decision = (
        F.when((spread >= threshold) & (F.col("margin_to_next") >= RANK_MARGIN) & is_auto_safe(), "auto")
        .when((spread >= threshold) | (review >= threshold), "review")
        .when((spread >= threshold - 0.06) | (review >= threshold - 0.04), "borderline")
        .otherwise("reject")
    )
    return rows.withColumn("decision", decision)


def _spans(scores: DataFrame) -> DataFrame:
    rows = scores if "span_start" in scores.columns else scores.withColumn("span_start", span_start())
    return rows.where(F.col("span_start").isNotNull()).withColumn("span_end", F.col("span_start") + 1)


def candidate_items(scores: DataFrame, threshold: float, review_floor: float | None = None) -> DataFrame:
    """Adjacent pairs with a high spread or review score."""
    floor = threshold if review_floor is None else review_floor
    return _spans(scores).where((F.col("spread") >= threshold) | (F.col("review_score") >= floor))


def candidate_items_edge(
    scores: DataFrame, threshold: float, review_floor: float, page_counts: DataFrame | None = None
) -> DataFrame:
    """Like ``candidate_items``, but the review score counts only near either end of the book."""
    rows = _spans(scores)
    at_start = F.col("span_start") <= EDGE_WINDOW
    if page_counts is None:
        near_edge = at_start
    else:
        rows = rows.join(page_counts.select("volume_id", "page_count"), "volume_id", "left")
        at_end = F.col("span_end") >= F.col("page_count") - EDGE_WINDOW + 1
        near_edge = at_start | F.coalesce(at_end, F.lit(False))
    kept = rows.where((F.col("spread") >= threshold) | (near_edge & (F.col("review_score") >= review_floor)))
    return kept.drop("page_count")


def clusters(items: DataFrame) -> DataFrame:
    """``cluster``: 1, 2, ... per volume; spans that touch the previous one join its cluster.

    Every span is two pages long, so the running end is the previous start + 1 and one lag
    decides; the cluster number is a running count carried over chunks.
    """
    rows, parts = halo(items, ["volume_id"], "span_start", 1, 0)
    along = Window.partitionBy(*parts).orderBy("span_start", "right_name", "left_name")
    previous = F.lag("span_start").over(along)
    opens = F.coalesce((F.col("span_start") > previous + 1).cast("int"), F.lit(1))
    marked = own_rows(rows.withColumn("_opens", opens))
    return running(
        marked,
        ["volume_id"],
        "span_start",
        sums={"cluster": F.col("_opens").cast("bigint")},
        tie=["right_name", "left_name"],
    ).drop("_opens")


def _cluster_order() -> list[Column | str]:
    return [*falling("spread"), *falling("review_score"), "span_start", "right_name", "left_name"]


def cluster_table(
    scores: DataFrame, threshold: float = THRESHOLD, page_counts: DataFrame | None = None
) -> DataFrame:
    """Clusters with the rank and decision of each member; only a clear safe winner is auto."""
    items = clusters(candidate_items_edge(scores, threshold, threshold - 0.01, page_counts))
    rows = ranked_with_next(items, ["volume_id", "cluster"], _cluster_order(), "rank_in_cluster", {"_next": "spread"})
    rows = rows.withColumn("margin_to_next", F.col("spread") - F.coalesce("_next", F.lit(0.0))).drop("_next")
    auto = (
        (F.col("rank_in_cluster") == 1)
        & (F.col("spread") >= threshold)
        & (F.col("margin_to_next") >= CLUSTER_MARGIN)
        & is_auto_safe()
    )
    return rows.withColumn("decision", F.when(auto, "auto").otherwise("review"))


def select_non_overlapping(
    scores: DataFrame, threshold: float = THRESHOLD, min_margin: float = CLUSTER_MARGIN
) -> DataFrame:
    """The winner of each cluster, if clear and safe. Only two rows per cluster leave each task."""
    items = clusters(candidate_items(scores, threshold))
    inside = Window.partitionBy("volume_id", "cluster").orderBy(*_cluster_order())
    leaders = items.withColumn("_place", F.row_number().over(inside)).where(F.col("_place") <= 2)
    runner_up = F.coalesce(F.lead("spread").over(inside), F.lit(0.0))
    winners = leaders.withColumn("margin_to_next", F.col("spread") - runner_up).where(F.col("_place") == 1)
    return winners.where(
        (F.col("spread") >= threshold) & (F.col("margin_to_next") >= min_margin) & is_auto_safe()
    ).drop("_place")


def mutual_best_pairs(scores: DataFrame, min_spread: float = 0.0) -> DataFrame:
    """Pairs that are the best choice of both their right and their left page (one to one)."""
    usable = scores.where(F.col("spread") >= min_spread)

    def best(side: str, other: str) -> DataFrame:
        # The greatest struct wins; names break ties, so the smaller name needs the larger key last.
        choice = F.min_by(other, F.struct(-F.col("spread"), -F.col("review_score"), F.col(other)))
        return usable.groupBy("volume_id", side).agg(choice.alias(other))

    keys = ["volume_id", "right_name", "left_name"]
    both = best("right_name", "left_name").select(*keys).join(best("left_name", "right_name").select(*keys), keys)
    return usable.join(both, keys, "left_semi")
