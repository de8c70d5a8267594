"""Candidate page pairs and the choice of the best vertical offset."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwise.functions.names import token_prefix
from leafwise.functions.scores import FEATURES
from leafwise.operators.ordered import with_neighbours

# Search range, smallest usable overlap, number of offsets kept for the costly stage.
MAX_OFFSET = 18
MIN_OVERLAP = 24
KEPT_OFFSETS = 7


def adjacent_pairs(pages: DataFrame, reading: str = "rtl") -> DataFrame:
    """Consecutive pages as (right, left); right-to-left reading puts the first page right."""
    if reading not in ("rtl", "ltr"):
        raise ValueError(f"unknown reading direction: {reading}")
    payload = ["page", "name"]
    near = with_neighbours(pages.select("volume_id", *payload), ["volume_id"], "page", {"second": 1}, payload)
    first, second = F.struct("page", "name"), F.col("second")
    right, left = (first, second) if reading == "rtl" else (second, first)
    return near.where(second.isNotNull()).select(
        "volume_id",
        right["page"].alias("right_page"),
        left["page"].alias("left_page"),
        right["name"].alias("right_name"),
        left["name"].alias("left_name"),
    )


def has_side(name: Column, side: str) -> Column:
    return F.contains(F.upper(name), F.lit(f"-{side}"))


def side_named_pairs(pages: DataFrame, reading: str = "rtl") -> DataFrame:
    """Adjacent pairs; in volumes with ``-R`` / ``-L`` names only opposite sides pair up."""
    sided = pages.groupBy("volume_id").agg(
        F.bool_or(has_side(F.col("name"), "R") | has_side(F.col("name"), "L")).alias("sided")
    )
    pairs = adjacent_pairs(pages, "rtl").join(sided, "volume_id")
    first, second = F.col("right_name"), F.col("left_name")
    forward = has_side(first, "R") & has_side(second, "L")
    backward = has_side(first, "L") & has_side(second, "R")
    swap = F.when(F.col("sided"), ~forward & backward).otherwise(F.lit(reading != "rtl"))
    kept = pairs.where(~F.col("sided") | forward | backward)
    return kept.select(
        "volume_id",
        F.when(swap, F.col("left_page")).otherwise(F.col("right_page")).alias("right_page"),
        F.when(swap, F.col("right_page")).otherwise(F.col("left_page")).alias("left_page"),
        F.when(swap, second).otherwise(first).alias("right_name"),
        F.when(swap, first).otherwise(second).alias("left_name"),
    )


def mark_expected(pairs: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """``expected``: both names share a ``T<digits>`` token that, if given, is in ``truth(token)``."""
    token = token_prefix(F.col("right_name"))
    same = F.coalesce(token == token_prefix(F.col("left_name")), F.lit(False))
    if truth is None:
        return pairs.withColumn("expected", same)
    known = truth.select(F.col("token").alias("_token")).distinct().withColumn("_known", F.lit(True))
    return (
        pairs.withColumn("_token", F.when(same, token))
        .join(known, "_token", "left")
        .withColumn("expected", F.coalesce("_known", F.lit(False)))
        .drop("_token", "_known")
    )


def offset_candidates(pairs: DataFrame, max_offset: int = MAX_OFFSET) -> DataFrame:
    """Every vertical offset whose overlap is high enough; needs left_height and right_height."""
    offset = F.col("offset")
    overlap = F.least(
        F.col("left_height") - F.greatest(F.lit(0), offset), F.col("right_height") - F.greatest(F.lit(0), -offset)
    )
    return (
        pairs.withColumn("offset", F.explode(F.sequence(F.lit(-max_offset), F.lit(max_offset))))
        .withColumn("overlap", overlap)
        .where(F.col("overlap") > MIN_OVERLAP)
    )


PAIR_KEYS = ["volume_id", "right_name", "left_name"]
# Fixed value: order that decides between equal coarse scores.
COARSE_ORDER = ("coarse_score", "offset", "color", "gradient", "profile", "edge", "barrier")


def coarse_topk(candidates: DataFrame, k: int = KEPT_OFFSETS) -> DataFrame:
    """Best ``k`` offsets of each pair by the cheap score, with ``coarse_rank``.

    A pair has at most ``2 * MAX_OFFSET + 1`` candidates, so its group is bounded.
    """
    order = Window.partitionBy(*PAIR_KEYS).orderBy(*[F.col(c).desc() for c in COARSE_ORDER])
    return candidates.withColumn("coarse_rank", F.row_number().over(order)).where(F.col("coarse_rank") <= k)


def best_offset(scored: DataFrame) -> DataFrame:
    """Highest spread per pair; the better coarse rank wins ties."""
    names = [c for c in scored.columns if c not in PAIR_KEYS]
    row = F.max_by(F.struct(*names), F.struct(F.col("spread"), -F.col("coarse_rank")))
    return scored.groupBy(*PAIR_KEYS).agg(row.alias("_best")).select(*PAIR_KEYS, "_best.*")


def fill_empty_scores(pairs: DataFrame, best: DataFrame) -> DataFrame:
    """One row per pair; a pair without any usable offset gets zeros and a full barrier."""
    scores = ["total", "spread", "review_score", "offset", *FEATURES]
    joined = pairs.join(best.select(*PAIR_KEYS, *scores), PAIR_KEYS, "left")
    empty = {n: F.lit(0) if n == "offset" else F.lit(0.0) for n in scores} | {"barrier": F.lit(1.0)}
    return joined.withColumns({n: F.coalesce(F.col(n), empty[n]) for n in scores})
