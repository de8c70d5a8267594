"""Queries for page features and gap scoring."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafwise.operators import gaps
from leafwise.operators.gaps import RATIOS
from leafwise.plans.inputs import PAGE_FEATURES_SQL, page_features
from leafwise.plans.registry import query
from leafwise.plans.sqltext import c01, r6
from leafwise.session import checkpoint_folder
from leafwise.sources import tables

DIFFERENCE = c01(
    "(abs({a}.ink_ratio - {b}.ink_ratio) * 1.7 + abs({a}.edge_density - {b}.edge_density) * 1.4"
    " + abs({a}.blank_ratio - {b}.blank_ratio) * 1.2 + abs({a}.dark_ratio - {b}.dark_ratio) * 1.1"
    " + abs({a}.center_ink_ratio - {b}.center_ink_ratio) + abs({a}.bottom_activity - {b}.bottom_activity))"
    " / 6 * 2.0"
)


def diff(a: str, b: str) -> str:
    return DIFFERENCE.replace("{a}", a).replace("{b}", b)


SCORED_PAGES_SQL = f"""{PAGE_FEATURES_SQL},
pages_scored AS (
  SELECT *, {c01("ink_ratio * 0.55 + edge_density * 0.45")} AS content_density,
    {c01(
        c01("(blank_ratio - 0.62) / 0.35") + " * 0.34"
        + " + greatest(0.0::DOUBLE, 1.0 - abs(ink_ratio - 0.05) / 0.18) * 0.24"
        + " + " + c01("(center_ink_ratio - border_ink_ratio) * 5.0") + " * 0.26"
        + " + " + c01("1.0 - edge_density * 5.0") + " * 0.16"
    )} AS title_likeness
  FROM page_features)"""

GAPS_SQL = f"""{SCORED_PAGES_SQL},
pairs AS (
  SELECT l.volume_id, l AS l, r AS r, p AS p, n AS n
  FROM pages_scored l
  JOIN pages_scored r ON r.volume_id = l.volume_id AND r.page = l.page + 1
  LEFT JOIN pages_scored p ON p.volume_id = l.volume_id AND p.page = l.page - 1
  LEFT JOIN pages_scored n ON n.volume_id = l.volume_id AND n.page = l.page + 2),
signals AS (
  SELECT volume_id, l.page AS gap_after_page, r.page AS gap_before_page,
    p.page AS previous_page, n.page AS following_page,
    {diff('l', 'r')} AS visual_difference,
    CASE WHEN p.page IS NOT NULL THEN 1.0 - {diff('p', 'l')} END AS left_continuity,
    CASE WHEN n.page IS NOT NULL THEN 1.0 - {diff('r', 'n')} END AS right_continuity,
    greatest(l.blank_ratio, r.blank_ratio) AS low_content,
    (l.content_density + r.content_density) / 2 AS avg_density,
    greatest(l.content_density, r.content_density) AS climax_density,
    greatest(l.title_likeness, r.title_likeness) AS gap_title,
    (l.dark_ratio >= 0.82 AND l.edge_density <= 0.04) AS left_dark,
    (r.dark_ratio >= 0.82 AND r.edge_density <= 0.04) AS right_dark,
    (l.blank_ratio >= 0.66 AND l.ink_ratio >= 0.14 AND l.edge_density >= 0.08 AND l.title_likeness < 0.5
      AND l.center_ink_ratio >= 0.18) OR
    (r.blank_ratio >= 0.66 AND r.ink_ratio >= 0.14 AND r.edge_density >= 0.08 AND r.title_likeness < 0.5
      AND r.center_ink_ratio >= 0.18) AS sparse_dramatic
  FROM pairs),
risks AS (
  SELECT *, CASE WHEN left_dark OR right_dark THEN least(raw_risk, 0.42::DOUBLE) ELSE raw_risk END AS continuity_risk
  FROM (SELECT *, greatest(1.0 - {c01('visual_difference')},
          coalesce({c01('left_continuity')}, 0.0), coalesce({c01('right_continuity')}, 0.0)) AS raw_risk
        FROM signals)),
scored AS (
  SELECT *, {c01('''0.18::DOUBLE + visual_difference * 0.28 + low_content * 0.34
      + greatest(0.0::DOUBLE, 0.55 - avg_density) * 0.38 + gap_title * 0.22 - continuity_risk * 0.28
      - greatest(0.0::DOUBLE, climax_density - 0.62) * 0.30
      + CASE WHEN low_content >= 0.68 OR avg_density <= 0.16 THEN 0.12 ELSE 0 END
      + CASE WHEN gap_title >= 0.65 THEN 0.16 ELSE 0 END
      + CASE WHEN left_dark THEN 0.48 WHEN right_dark THEN 0.30 ELSE 0 END
      + CASE WHEN visual_difference >= 0.58 THEN 0.05 ELSE 0 END
      - CASE WHEN continuity_risk >= 0.68 THEN 0.18 ELSE 0 END
      - CASE WHEN climax_density >= 0.62 AND low_content <= 0.12 AND NOT left_dark AND NOT right_dark
          THEN 0.12 ELSE 0 END
      - CASE WHEN sparse_dramatic AND continuity_risk >= 0.58 AND gap_title < 0.5 AND NOT left_dark
          AND NOT right_dark THEN 0.22 ELSE 0 END
      + CASE WHEN previous_page IS NULL OR following_page IS NULL THEN 0.03 ELSE 0 END''')} AS safe_insert_score
  FROM risks),
gaps AS (
  SELECT *,
    CASE WHEN continuity_risk >= 0.82 AND safe_insert_score <= 0.35 THEN 'F do_not_insert'
      WHEN gap_title >= 0.65 AND safe_insert_score >= 0.72 THEN 'A chapter_boundary'
      WHEN low_content >= 0.68 AND safe_insert_score >= 0.58 THEN 'B low_content_pause'
      WHEN safe_insert_score >= 0.7 AND visual_difference >= 0.55 THEN 'C scene_change'
      WHEN safe_insert_score >= 0.5 AND visual_difference >= 0.45 THEN 'D visual_discontinuity'
      WHEN safe_insert_score <= 0.3 THEN 'F do_not_insert'
      ELSE 'E risky_continuity' END AS label,
    coalesce(nullif(concat_ws('; ',
      CASE WHEN low_content >= 0.68 OR avg_density <= 0.16 THEN 'low content' END,
      CASE WHEN gap_title >= 0.65 THEN 'title-like page' END,
      CASE WHEN left_dark THEN 'dark pause page' WHEN right_dark THEN 'dark pause follows' END,
      CASE WHEN visual_difference >= 0.58 THEN 'visual discontinuity' END,
      CASE WHEN continuity_risk >= 0.68 THEN 'high continuity risk' END,
      CASE WHEN climax_density >= 0.62 AND low_content <= 0.12 AND NOT left_dark AND NOT right_dark
        THEN 'dense adjacent pages' END,
      CASE WHEN sparse_dramatic AND continuity_risk >= 0.58 AND gap_title < 0.5 AND NOT left_dark
        AND NOT right_dark THEN 'sparse dramatic content' END,
      CASE WHEN previous_page IS NULL OR following_page IS NULL THEN 'edge context missing' END), ''),
      'balanced visual pause') AS reasons
  FROM scored)"""


def _pages(spark, sf):
    return gaps.derive_page_scores(page_features(spark, sf))


@query(
    "page_scores",
    f"WITH {SCORED_PAGES_SQL} SELECT volume_id, page, {r6('content_density', 'title_likeness')} FROM pages_scored",
)
def page_scores(spark, sf):
    return _pages(spark, sf).select(
        "volume_id", "page", *[F.round(c, 6).alias(c) for c in ("content_density", "title_likeness")]
    )


@query(
    "visual_difference",
    f"WITH {GAPS_SQL} SELECT volume_id, gap_after_page, {r6('visual_difference')} FROM signals",
)
def visual_difference(spark, sf):
    windows = gaps.gap_windows(_pages(spark, sf))
    return windows.select(
        "volume_id",
        F.col("left.page").alias("gap_after_page"),
        F.round(gaps.visual_difference("left", "right"), 6).alias("visual_difference"),
    )


@query(
    "gap_windows",
    f"""WITH {GAPS_SQL} SELECT volume_id, gap_after_page, gap_before_page, previous_page, following_page
    FROM signals""",
)
def gap_windows(spark, sf):
    return gaps.gap_windows(_pages(spark, sf)).select(
        "volume_id",
        F.col("left.page").alias("gap_after_page"),
        F.col("right.page").alias("gap_before_page"),
        F.col("previous.page").alias("previous_page"),
        F.col("following.page").alias("following_page"),
    )


@query(
    "gap_signals",
    f"""WITH {GAPS_SQL} SELECT volume_id, gap_after_page, left_dark, right_dark, sparse_dramatic,
    {r6('continuity_risk', 'raw_risk')} FROM risks""",
)
def gap_signals(spark, sf):
    signals = gaps.gap_signals(gaps.gap_windows(_pages(spark, sf)))
    return signals.select(
        "volume_id",
        "gap_after_page",
        "left_dark",
        "right_dark",
        "sparse_dramatic",
        *[F.round(c, 6).alias(c) for c in ("continuity_risk", "raw_risk")],
    )


@query(
    "score_gaps",
    f"""WITH {GAPS_SQL} SELECT volume_id, gap_after_page, gap_before_page, label, reasons,
    {r6('safe_insert_score', 'visual_difference', 'continuity_risk')} FROM gaps""",
)
def score_gaps(spark, sf):
    return gaps.gap_table(_pages(spark, sf)).select(
        "volume_id",
        "gap_after_page",
        "gap_before_page",
        "label",
        F.array_join("reasons", "; ").alias("reasons"),
        *[F.round(c, 6).alias(c) for c in ("safe_insert_score", "visual_difference", "continuity_risk")],
    )


@query(
    "gap_label_counts",
    f"WITH {GAPS_SQL} SELECT volume_id, label, count(*) AS gaps FROM gaps GROUP BY ALL",
)
def gap_label_counts(spark, sf):
    return gaps.gap_table(_pages(spark, sf)).groupBy("volume_id", "label").agg(F.count(F.lit(1)).alias("gaps"))


@query(
    "reviewable_insert_candidates",
    f"""WITH {GAPS_SQL} SELECT volume_id, printf('%03d-%03d', gap_after_page, gap_before_page) AS gap_id, label
    FROM gaps WHERE substr(label, 1, 2) IN ('A ', 'B ', 'C ', 'D ')""",
)
def reviewable(spark, sf):
    from leafwise.functions.names import is_reviewable, pair_id

    return (
        gaps.gap_table(_pages(spark, sf))
        .where(is_reviewable(F.col("label")))
        .select("volume_id", pair_id(F.col("gap_after_page"), F.col("gap_before_page")).alias("gap_id"), "label")
    )


@query(
    "gap_report",
    f"""WITH {GAPS_SQL} SELECT g.volume_id, gap_after_page, gap_before_page, label,
      row_number() OVER (PARTITION BY g.volume_id ORDER BY safe_insert_score DESC, gap_after_page) AS rank,
      gap_after_page - 1 < 1 AS left_outer_missing,
      gap_before_page + 1 > n.page_count AS right_outer_missing
    FROM gaps g JOIN (SELECT volume_id, count(*) AS page_count FROM page_features GROUP BY 1) n
      ON n.volume_id = g.volume_id""",
)
def gap_report(spark, sf):
    return gaps.gap_report(_pages(spark, sf)).select(
        "volume_id", "gap_after_page", "gap_before_page", "label", "rank", "left_outer_missing", "right_outer_missing"
    )


# --- files ----------------------------------------------------------------------------------------

@query(
    "gap_files",
    f"""WITH {GAPS_SQL} SELECT volume_id, gap_after_page, gap_before_page, label, reasons,
    {r6('safe_insert_score', 'visual_difference', 'continuity_risk')} FROM gaps""",
)
def gap_files(spark, sf):
    """The gap table after writing it as gap files and reading these back."""
    path = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    tables.write_gaps(gaps.gap_table(_pages(spark, sf)), path)
    back = tables.read_table(spark, path, tables.GAP_FIELDS)
    names = {"after_page": "gap_after_page", "before_page": "gap_before_page"}
    reasons = F.coalesce("reasons", F.lit("")).alias("reasons")
    scores = ("safe_insert_score", "visual_difference", "continuity_risk")
    return back.select("volume_id", *[F.col(old).alias(new) for old, new in names.items()], "label", reasons, *scores)


@query("feature_files", f"WITH {SCORED_PAGES_SQL} SELECT volume_id, page, {r6(*RATIOS)} FROM pages_scored")
def feature_files(spark, sf):
    """The page features after writing them as feature files and reading these back."""
    path = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    tables.write_features(_pages(spark, sf), path)
    return tables.read_table(spark, path, tables.FEATURE_FIELDS).select("volume_id", "page", *RATIOS)
