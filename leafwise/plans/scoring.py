"""Queries for pair scoring, adjustment and selection."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafwise.functions.frames import rounded
from leafwise.functions.scores import score_pairs
from leafwise.functions import scores as formulas
from leafwise.operators import adjust, pairs, select
from leafwise.plans.inputs import (
    EMBEDDING_PAGES_SQL,
    PAIR_FEATURES_SQL,
    embedding_pages,
    pair_features,
    probe_scores,
    table,
)
from leafwise.plans.registry import ORACLES, query
from leafwise.plans.sqltext import c01, r6
from leafwise.session import checkpoint_folder, durable
from leafwise.sources import tables

# --- pairs ----------------------------------------------------------------------------------------

PAIR_COLUMNS = ("volume_id", "right_page", "left_page", "right_name", "left_name")


@query(
    "adjacent_pairs_rtl",
    f"""WITH {EMBEDDING_PAGES_SQL} SELECT a.volume_id, a.page AS right_page, b.page AS left_page,
    a.name AS right_name, b.name AS left_name
    FROM embedding_pages a JOIN embedding_pages b ON a.volume_id = b.volume_id AND b.page = a.page + 1""",
)
def adjacent_rtl(spark, sf):
    return pairs.adjacent_pairs(embedding_pages(spark, sf))


@query(
    "adjacent_pairs_ltr",
    f"""WITH {EMBEDDING_PAGES_SQL} SELECT a.volume_id, b.page AS right_page, a.page AS left_page,
    b.name AS right_name, a.name AS left_name
    FROM embedding_pages a JOIN embedding_pages b ON a.volume_id = b.volume_id AND b.page = a.page + 1""",
)
def adjacent_ltr(spark, sf):
    return pairs.adjacent_pairs(embedding_pages(spark, sf), "ltr")


_SIDED = """CASE WHEN volume_id % 3 = 0 THEN name
  ELSE name || CASE vec_id % 5 WHEN 0 THEN '' WHEN 1 THEN '-R' WHEN 2 THEN '-l' WHEN 3 THEN '-L' ELSE '-r' END END"""


def _sided_pages(spark, sf):
    tail = F.element_at(F.array(*[F.lit(t) for t in ("", "-R", "-l", "-L", "-r")]), (F.col("vec_id") % 5 + 1).cast("int"))
    name = F.when(F.col("volume_id") % 3 == 0, F.col("name")).otherwise(F.concat("name", tail))
    return embedding_pages(spark, sf).withColumn("name", name)


@query(
    "side_named_pairs",
    f"""WITH {EMBEDDING_PAGES_SQL}, named AS (SELECT volume_id, page, {_SIDED} AS name FROM embedding_pages),
    flagged AS (SELECT volume_id, bool_or(upper(name) LIKE '%-R%' OR upper(name) LIKE '%-L%') AS sided
      FROM named GROUP BY 1),
    near AS (SELECT a.volume_id, a.page AS p, a.name AS first, b.name AS second, sided,
        upper(a.name) LIKE '%-R%' AND upper(b.name) LIKE '%-L%' AS forward,
        upper(a.name) LIKE '%-L%' AND upper(b.name) LIKE '%-R%' AS backward
      FROM named a JOIN named b ON a.volume_id = b.volume_id AND b.page = a.page + 1
      JOIN flagged f ON f.volume_id = a.volume_id)
    SELECT volume_id,
      CASE WHEN sided AND NOT forward THEN p + 1 ELSE p END AS right_page,
      CASE WHEN sided AND NOT forward THEN p ELSE p + 1 END AS left_page,
      CASE WHEN sided AND NOT forward THEN second ELSE first END AS right_name,
      CASE WHEN sided AND NOT forward THEN first ELSE second END AS left_name
    FROM near WHERE NOT sided OR forward OR backward""",
)
def side_named(spark, sf):
    return pairs.side_named_pairs(_sided_pages(spark, sf))


@query(
    "expected_pairs",
    f"""WITH {EMBEDDING_PAGES_SQL}, named AS (
      SELECT volume_id, page, 'T' || (page // 2) || '-' || name AS name FROM embedding_pages),
    truth AS (SELECT DISTINCT 'T' || (n_nationkey * 2) AS token FROM nation)
    SELECT a.volume_id, a.name AS right_name, b.name AS left_name,
      regexp_extract(a.name, 'T[0-9]+') = regexp_extract(b.name, 'T[0-9]+')
        AND regexp_extract(a.name, 'T[0-9]+') IN (SELECT token FROM truth) AS expected
    FROM named a JOIN named b ON a.volume_id = b.volume_id AND b.page = a.page + 1""",
)
def expected_pairs(spark, sf):
    token = F.concat(F.lit("T"), F.expr("page div 2").cast("string"))
    pages = embedding_pages(spark, sf).withColumn("name", F.concat(token, F.lit("-"), "name"))
    truth = table(spark, sf, "nation").select(F.concat(F.lit("T"), (F.col("n_nationkey") * 2).cast("string")).alias("token"))
    return pairs.mark_expected(pairs.adjacent_pairs(pages), truth).select(
        "volume_id", "right_name", "left_name", "expected"
    )


# Page heights in the offset queries: 26 .. 65, so some pairs lose offsets and some lose all.
_HEIGHTS_SQL = f"""{EMBEDDING_PAGES_SQL}, sized AS (
  SELECT volume_id, page, name, (20 + vec_id % 40)::INTEGER AS height, embedding FROM embedding_pages),
candidates AS (
  SELECT a.volume_id, a.name AS right_name, b.name AS left_name, a.page AS right_page, o::INTEGER AS "offset",
    least(b.height - greatest(0, o), a.height - greatest(0, -o))::INTEGER AS overlap,
    a.embedding AS e
  FROM sized a JOIN sized b ON a.volume_id = b.volume_id AND b.page = a.page + 1
  CROSS JOIN (SELECT unnest(generate_series(-18, 18)) AS o)
  WHERE least(b.height - greatest(0, o), a.height - greatest(0, -o)) > 24),
coarse AS (
  SELECT *, {", ".join(
      f"{c01(f'(e[{p} + (o18 % 16)]::DOUBLE + 0.3) / 0.45')} AS {n}"
      for n, p in (("color", 1), ("gradient", 11), ("profile", 21), ("edge", 31), ("barrier", 41))
  )}
  FROM (SELECT *, "offset" + 18 AS o18 FROM candidates)),
coarse_scored AS (
  SELECT *, {c01('''(0.13 * color + 0.15 * gradient + 0.13 * profile + 0.09 * edge + 0.12 * 0.5 + 0.09 * 0.5
    + 0.07 * 0.5 + 0.10 * 0.5 + 0.04 * 0.5 + 0.07 * 0.5 + 0.06 * 0.5) * (1.0 - 0.46 * barrier)''')} AS coarse_score
  FROM coarse),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY volume_id, right_name, left_name ORDER BY coarse_score DESC,
    "offset" DESC, color DESC, gradient DESC, profile DESC, edge DESC, barrier DESC) AS coarse_rank
  FROM coarse_scored)"""


def _offset_candidates(spark, sf):
    pages = embedding_pages(spark, sf)
    sized = pages.select("volume_id", "page", (F.lit(20) + F.col("vec_id") % 40).cast("int").alias("height"))
    found = pairs.adjacent_pairs(pages)
    found = found.join(sized.withColumnsRenamed({"page": "right_page", "height": "right_height"}), ["volume_id", "right_page"])
    found = found.join(sized.withColumnsRenamed({"page": "left_page", "height": "left_height"}), ["volume_id", "left_page"])
    return pairs.offset_candidates(found)


def _coarse(spark, sf):
    vectors = embedding_pages(spark, sf).select("volume_id", F.col("page").alias("right_page"), "embedding")
    rows = _offset_candidates(spark, sf).join(vectors, ["volume_id", "right_page"])
    place = F.col("offset") + 18
    for name, start in (("color", 0), ("gradient", 10), ("profile", 20), ("edge", 30), ("barrier", 40)):
        value = F.element_at("embedding", (F.pmod(place, F.lit(16)) + start + 1).cast("int")).cast("double")
        rows = rows.withColumn(name, formulas.clamp01((value + 0.3) / 0.45))
    half = {n: F.lit(0.5) for n in ("ink", "energy", "orientation", "line", "texture", "corr", "color_style")}
    return rows.withColumns(half).withColumn("coarse_score", formulas.combine()).drop("embedding", *half)


@query(
    "offset_candidates",
    f"""WITH {_HEIGHTS_SQL} SELECT volume_id, right_name, left_name, "offset", overlap FROM candidates""",
)
def offset_candidates(spark, sf):
    return _offset_candidates(spark, sf).select("volume_id", "right_name", "left_name", "offset", "overlap")


@query(
    "coarse_topk",
    f"""WITH {_HEIGHTS_SQL} SELECT volume_id, right_name, left_name, "offset", coarse_rank::INTEGER AS coarse_rank,
    {r6('coarse_score')} FROM ranked WHERE coarse_rank <= 7""",
)
def coarse_topk(spark, sf):
    top = pairs.coarse_topk(_coarse(spark, sf))
    return rounded(top, ["coarse_score"]).select(
        "volume_id", "right_name", "left_name", "offset", "coarse_rank", "coarse_score"
    )


@query(
    "best_offset",
    f"""WITH {_HEIGHTS_SQL}, best AS (SELECT *, row_number() OVER (PARTITION BY volume_id, right_name, left_name
      ORDER BY coarse_score * (1.0 - barrier) DESC, coarse_rank) AS r FROM ranked WHERE coarse_rank <= 7)
    SELECT a.volume_id, a.name AS right_name, b.name AS left_name, coalesce(c."offset", 0) AS "offset",
      round(coalesce(c.coarse_score * (1.0 - c.barrier), 0), 6) AS spread,
      round(coalesce(c.barrier, 1.0), 6) AS barrier, round(coalesce(c.color, 0), 6) AS color
    FROM sized a JOIN sized b ON a.volume_id = b.volume_id AND b.page = a.page + 1
    LEFT JOIN best c ON c.r = 1 AND c.volume_id = a.volume_id AND c.right_name = a.name""",
)
def best_offset(spark, sf):
    scored = pairs.coarse_topk(_coarse(spark, sf)).withColumns(
        {
            "spread": F.col("coarse_score") * (F.lit(1.0) - F.col("barrier")),
            "total": F.col("coarse_score"),
            "review_score": F.col("coarse_score"),
            **{n: F.lit(0.0) for n in formulas.FEATURES if n not in ("color", "gradient", "profile", "edge", "barrier")},
        }
    )
    every = pairs.adjacent_pairs(embedding_pages(spark, sf))
    filled = pairs.fill_empty_scores(every, pairs.best_offset(scored))
    return rounded(filled, ["spread", "barrier", "color"]).select(
        "volume_id", "right_name", "left_name", "offset", "spread", "barrier", "color"
    )


@query(
    "signed_corr01",
    """WITH v AS (SELECT vec_id, [x::DOUBLE FOR x IN embedding[1:32]] AS a, [x::DOUBLE FOR x IN embedding[33:64]] AS b
      FROM embeddings),
    flat AS (SELECT vec_id, a, CASE WHEN vec_id % 7 = 0 THEN [0.25::DOUBLE FOR x IN b] WHEN vec_id % 7 = 1 THEN b[1:3]
      ELSE b END AS b FROM v)
    SELECT vec_id, round(CASE WHEN len(b) < 4 THEN 0.25 WHEN vec_id % 7 = 0 THEN 0.35
      ELSE (SELECT (corr(x, y) + 1) / 2 FROM (SELECT unnest(a) AS x, unnest(b) AS y)) END, 6) AS corr,
      round(exp(-greatest(0, a[1]) / 0.18), 6) AS near FROM flat""",
)
def signed_corr01(spark, sf):
    from leafwise.functions.numeric import exp_score, signed_corr01 as corr01

    wide = F.transform("embedding", lambda x: x.cast("double"))
    halves = table(spark, sf, "embeddings").select("vec_id", F.slice(wide, 1, 32).alias("a"), F.slice(wide, 33, 32).alias("b"))
    b = (
        F.when(F.col("vec_id") % 7 == 0, F.transform("b", lambda x: F.lit(0.25)))
        .when(F.col("vec_id") % 7 == 1, F.slice("b", 1, 3))
        .otherwise(F.col("b"))
    )
    return halves.withColumn("b", b).select(
        "vec_id",
        F.round(corr01(F.col("a"), F.col("b")), 6).alias("corr"),
        F.round(exp_score(F.col("a")[0], 0.18), 6).alias("near"),
    )


# --- score formulas -------------------------------------------------------------------------------

_SUPPORT = "greatest(patch, seam_activity, seam_contact)"
_HELD = f"greatest({_SUPPORT}, 0.86 * composition)"
SCORES_SQL = f"""{PAIR_FEATURES_SQL},
totals AS (
  SELECT *, {c01('''(0.13 * color + 0.15 * gradient + 0.13 * profile + 0.09 * edge + 0.12 * ink + 0.09 * energy
      + 0.07 * orientation + 0.10 * line + 0.04 * texture + 0.07 * corr + 0.06 * color_style)
      * (1.0 - 0.46 * barrier)''')} AS total,
    greatest({c01('(barrier - 0.72) / 0.25')}, {c01('(inner_gutter - 0.82) / 0.18')}
      * {c01('(0.30 - greatest(seam_activity, seam_contact)) / 0.30')} * (1.0 - 0.55 * page_panel)) AS gate
  FROM pair_features),
spreads AS (
  SELECT *, {c01(f'''greatest(
      (0.44 * (0.16 * color + 0.16 * gradient + 0.14 * profile + 0.10 * edge + 0.10 * ink + 0.08 * energy
        + 0.08 * orientation + 0.09 * line + 0.04 * corr + 0.04 * color_style) + 0.16 * total
        + 0.13 * seam_activity + 0.18 * patch + 0.09 * composition)
      * (1.0 - (0.24 * panel * (1.0 - {_SUPPORT}) + 0.24 * page_panel * (1.0 - 0.55 * {_HELD})
        + 0.20 * inner_gutter * (1.0 - 0.70 * {_HELD}) + 0.36 * barrier * (1.0 - 0.35 * {_HELD}))),
      gate * composition * (0.74 + 0.18 * greatest(color, gradient, profile)
          + 0.08 * greatest(texture, corr, color_style))
        * (1.0 - 0.10 * page_panel * greatest(0.0, 1.0 - composition))
        * (1.0 - 0.08 * panel * greatest(0.0, 1.0 - seam_contact)))''')} AS spread
  FROM totals),
designs AS (
  SELECT *, 0.18 * color + 0.18 * gradient + 0.18 * profile + 0.14 * orientation + 0.10 * texture
    + 0.10 * color_style + 0.12 * total AS design
  FROM spreads),
scores AS (
  SELECT *, {c01('''greatest(
      greatest(spread, 0.58 * design + 0.22 * (0.40 * patch + 0.34 * seam_activity + 0.13 * seam_contact
          + 0.13 * composition)
        + 0.12 * inner_gutter * greatest(color, profile)
          * greatest(0.0, 1.0 - greatest(seam_activity, seam_contact)) * (1.0 - 0.65 * page_panel))
      * (1.0 - 0.52 * page_panel * inner_gutter * greatest(0.0, 1.0 - seam_contact)
          * greatest(0.35, 1.0 - 0.50 * seam_activity))
      * (1.0 - 0.18 * barrier),
      gate * composition * (0.76 + 0.16 * design + 0.08 * greatest(color, gradient, profile))
      * (1.0 - 0.18 * page_panel))''')} AS review_score
  FROM designs)"""

KEY = ["volume_id", "right_name", "left_name"]
KEY_SQL = "volume_id, right_name, left_name"


def _scores(spark, sf):
    return score_pairs(pair_features(spark, sf))


@query("combine", f"WITH {SCORES_SQL} SELECT {KEY_SQL}, {r6('total')} FROM scores")
def combine(spark, sf):
    return pair_features(spark, sf).select(*KEY, F.round(formulas.combine(), 6).alias("total"))


@query("blank_composition_gate", f"WITH {SCORES_SQL} SELECT {KEY_SQL}, {r6('gate')} FROM scores")
def gate(spark, sf):
    return pair_features(spark, sf).select(*KEY, F.round(formulas.blank_composition_gate(), 6).alias("gate"))


@query("score_pairs", f"WITH {SCORES_SQL} SELECT {KEY_SQL}, {r6('total', 'spread', 'review_score')} FROM scores")
def scored_pairs(spark, sf):
    return rounded(_scores(spark, sf), ["total", "spread", "review_score"]).select(
        *KEY, "total", "spread", "review_score"
    )


@query(
    "raw_scores",
    f"""WITH {SCORES_SQL} SELECT {KEY_SQL}, round(spread, 6) AS raw_spread, round(review_score, 6) AS raw_review_score,
    0.0::DOUBLE AS local_margin, 0.0::DOUBLE AS context_penalty, 0.0::DOUBLE AS context_boost FROM scores""",
)
def raw_scores(spark, sf):
    return rounded(adjust.attach_raw_scores(_scores(spark, sf)), ["raw_spread", "raw_review_score"]).select(
        *KEY, "raw_spread", "raw_review_score", "local_margin", "context_penalty", "context_boost"
    )


@query(
    "adjacent_spans",
    f"""WITH {EMBEDDING_PAGES_SQL}, named AS (SELECT volume_id, page, CASE WHEN page % 5 = 0 THEN 'cover'
        WHEN page % 7 = 0 THEN 'v2-' || (page + 3) ELSE name END AS name FROM embedding_pages),
    p AS (SELECT a.volume_id, a.name AS right_name, b.name AS left_name,
        try_cast(nullif(regexp_extract(a.name, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS r,
        try_cast(nullif(regexp_extract(b.name, '([0-9]+)[^0-9]*$', 1), '') AS BIGINT) AS l
      FROM named a JOIN named b ON a.volume_id = b.volume_id AND b.page = a.page + 1),
    s AS (SELECT *, CASE WHEN abs(r - l) = 1 THEN least(r, l) END AS span_start FROM p)
    SELECT volume_id, right_name, left_name, span_start, coalesce(span_start <= 21 AND 20 <= span_start + 1, false) AS over_20
    FROM s""",
)
def adjacent_spans(spark, sf):
    name = (
        F.when(F.col("page") % 5 == 0, "cover")
        .when(F.col("page") % 7 == 0, F.concat(F.lit("v2-"), (F.col("page") + 3).cast("string")))
        .otherwise(F.col("name"))
    )
    found = pairs.adjacent_pairs(embedding_pages(spark, sf).withColumn("name", name))
    found = found.withColumn("span_start", adjust.span_start())
    over = adjust.spans_overlap(F.col("span_start"), F.col("span_start") + 1, F.lit(20), F.lit(21))
    return found.select(*KEY, "span_start", F.coalesce(over, F.lit(False)).alias("over_20"))


# --- adjustment -----------------------------------------------------------------------------------

CONTEXT_SQL = f"""{SCORES_SQL},
rivals AS (
  SELECT a.volume_id, a.right_name, a.left_name, max(b.spread) AS top,
    count(CASE WHEN b.spread >= a.spread - 0.05 THEN 1 END) AS ties
  FROM scores a JOIN scores b ON a.volume_id = b.volume_id AND a.right_name <> b.right_name
    AND a.right_page <= b.left_page AND b.right_page <= a.left_page
  GROUP BY ALL),
losses AS (
  SELECT s.*, r.top, CASE WHEN r.top IS NULL THEN 0.0::DOUBLE ELSE s.spread - r.top END AS local_margin,
    CASE WHEN r.top IS NULL THEN 0.0::DOUBLE ELSE {c01(
        c01("(0.04 - (s.spread - r.top)) / 0.12") + " * 0.10 + " + c01("(r.ties - 1) / 3.0::DOUBLE") + " * 0.04"
    )} END AS loss,
    CASE WHEN r.top IS NULL THEN 0.0::DOUBLE ELSE {c01("(s.spread - r.top - 0.12) / 0.10")} * 0.015 END AS peak
  FROM scores s LEFT JOIN rivals r USING (volume_id, right_name, left_name)),
context AS (
  SELECT * EXCLUDE (spread, review_score), spread AS raw_spread, review_score AS raw_review_score,
    {c01("spread * (1.0 - loss) + peak")} AS spread,
    {c01("review_score * (1.0 - loss * 0.72) + peak")} AS review_score,
    CASE WHEN spread <= 0 THEN 0.0::DOUBLE ELSE greatest(0.0, 1.0 - {c01("spread * (1.0 - loss) + peak")} / spread) END
      AS context_penalty,
    greatest(0.0, {c01("spread * (1.0 - loss) + peak")} - spread) AS context_boost
  FROM losses)"""


def _context(spark, sf):
    return adjust.contextual_adjustment(_scores(spark, sf))


@query(
    "contextual_adjustment",
    f"""WITH {CONTEXT_SQL} SELECT {KEY_SQL}, {r6('spread', 'review_score', 'raw_spread', 'raw_review_score',
    'local_margin', 'context_penalty', 'context_boost')} FROM context""",
)
def contextual_adjustment(spark, sf):
    names = ["spread", "review_score", "raw_spread", "raw_review_score", "local_margin", "context_penalty", "context_boost"]
    return rounded(_context(spark, sf), names).select(*KEY, *names)


PROBES_SQL = f"""{CONTEXT_SQL},
gated AS (SELECT * FROM context WHERE greatest(spread, review_score) >= 0.47),
probes AS (
  SELECT volume_id, right_name, left_name, spread FROM gated
  UNION ALL SELECT volume_id, right_name, left_name, spread * (1.0 - texture * 0.2) FROM gated WHERE right_page % 3 <> 0
  UNION ALL SELECT volume_id, right_name, left_name, spread * (1.0 - line * 0.1) FROM gated WHERE right_page % 3 = 2),
stabilities AS (
  SELECT volume_id, right_name, left_name, CASE WHEN count(*) <= 1 THEN 1.0::DOUBLE ELSE
    {c01("1.0 - (max(spread) - min(spread)) / 0.35 - stddev_pop(spread) / 0.22")} END AS stability
  FROM probes GROUP BY ALL)"""


@query("stability_gate", f"WITH {PROBES_SQL} SELECT {KEY_SQL} FROM gated")
def stability_gate(spark, sf):
    return adjust.stability_gate(_context(spark, sf)).select(*KEY)


@query("stability_from_probes", f"WITH {PROBES_SQL} SELECT {KEY_SQL}, {r6('stability')} FROM stabilities")
def stability_from_probes(spark, sf):
    return rounded(adjust.stability_from_probes(probe_scores(_context(spark, sf))), ["stability"])


RELIABLE_SQL = f"""{PROBES_SQL},
medians AS (SELECT volume_id, median(spread) AS m FROM context GROUP BY 1),
mads AS (SELECT c.volume_id, any_value(m) AS m, median(abs(spread - m)) AS mad
  FROM context c JOIN medians USING (volume_id) GROUP BY 1),
relatives AS (
  SELECT c.*, {c01("((spread - m) / greatest(0.035, 1.4826 * mad) + 0.6) / 3.2")} AS relative_score, s.stability
  FROM context c JOIN mads USING (volume_id) LEFT JOIN stabilities s USING (volume_id, right_name, left_name)),
adjustments AS (
  SELECT *, CASE WHEN stability IS NULL THEN 0.0::DOUBLE ELSE {c01("(0.55 - stability) / 0.55")} * 0.055 END
      AS reliability_penalty,
    {c01("(relative_score - 0.74) / 0.26")} * 0.020 + CASE WHEN stability IS NULL THEN 0.0::DOUBLE ELSE
      {c01("(stability - 0.88) / 0.12")} * 0.012 * {c01("(relative_score - 0.74) / 0.16")} END AS reliability_boost
  FROM relatives),
final AS (
  SELECT * EXCLUDE (spread, review_score, raw_spread, raw_review_score),
    CASE WHEN raw_spread = 0 THEN spread ELSE raw_spread END AS raw_spread,
    CASE WHEN raw_review_score = 0 THEN review_score ELSE raw_review_score END AS raw_review_score,
    coalesce(stability, 0.0) AS stability_score,
    {c01("spread * (1.0 - reliability_penalty) + reliability_boost")} AS spread,
    {c01("review_score * (1.0 - reliability_penalty * 0.7) + reliability_boost")} AS review_score
  FROM adjustments)"""


def final_scores(spark, sf):
    """Pair features through every adjustment stage."""
    # The medians, the probes and the adjustment all read the scores, ranks read the outcome again: each stored once.
    context = durable(_context(spark, sf))
    return durable(adjust.reliability_adjustment(context, adjust.stability_from_probes(probe_scores(context))))


@query("robust_relative", f"WITH {RELIABLE_SQL} SELECT {KEY_SQL}, {r6('relative_score')} FROM relatives")
def robust_relative(spark, sf):
    return rounded(adjust.robust_relative(durable(_context(spark, sf))), ["relative_score"]).select(*KEY, "relative_score")


_FINAL = ["spread", "review_score", "raw_spread", "stability_score", "relative_score", "reliability_penalty", "reliability_boost"]


@query("reliability_adjustment", f"WITH {RELIABLE_SQL} SELECT {KEY_SQL}, {r6(*_FINAL)} FROM final")
def reliability_adjustment(spark, sf):
    return rounded(final_scores(spark, sf), _FINAL).select(*KEY, *_FINAL)


# --- selection ------------------------------------------------------------------------------------

_SAFE_SQL = """(NOT (barrier > 0.72 AND greatest(seam_activity, seam_contact) < 0.30) AND local_margin >= 0.04
  AND NOT (greatest(seam_activity, seam_contact) > 0.70 AND least(profile, edge, ink) < 0.18 AND patch < 0.70)
  AND (greatest(seam_activity, seam_contact) >= 0.45 OR barrier < 0.45))"""
SELECT_SQL = f"""{RELIABLE_SQL},
safe AS (SELECT *, {_SAFE_SQL} AS auto_safe, right_page AS span_start FROM final),
ranked AS (
  SELECT *, row_number() OVER w AS rank, spread - lead(spread, 1, 0.0) OVER w AS margin_to_next
  FROM safe WINDOW w AS (PARTITION BY volume_id ORDER BY spread DESC, review_score DESC, right_name, left_name))"""


@query("rank_scores", f"WITH {SELECT_SQL} SELECT {KEY_SQL}, rank FROM ranked")
def rank_scores(spark, sf):
    return select.rank_scores(final_scores(spark, sf)).select(*KEY, "rank")


@query(
    "safety_predicates",
    f"""WITH {SELECT_SQL} SELECT {KEY_SQL}, auto_safe,
    barrier > 0.72 AND greatest(seam_activity, seam_contact) < 0.30 AS blank_case,
    greatest(seam_activity, seam_contact) > 0.70 AND least(profile, edge, ink) < 0.18 AND patch < 0.70 AS weak_case
    FROM safe""",
)
def safety_predicates(spark, sf):
    return final_scores(spark, sf).select(
        *KEY,
        formulas.is_auto_safe().alias("auto_safe"),
        formulas.is_blank_composition_case().alias("blank_case"),
        formulas.is_weak_seam_case().alias("weak_case"),
    )


@query(
    "review_decisions",
    f"""WITH {SELECT_SQL} SELECT {KEY_SQL}, rank, {r6('margin_to_next')},
    CASE WHEN spread >= 0.53 AND margin_to_next >= 0.08 AND auto_safe THEN 'auto'
      WHEN spread >= 0.53 OR review_score >= 0.53 THEN 'review'
      WHEN spread >= 0.53::DOUBLE - 0.06::DOUBLE OR review_score >= 0.53::DOUBLE - 0.04::DOUBLE THEN 'borderline'
      ELSE 'reject' END AS decision
    FROM ranked""",
)
def review_decisions(spark, sf):
    return rounded(select.review_decisions(final_scores(spark, sf)), ["margin_to_next"]).select(
        *KEY, "rank", "margin_to_next", "decision"
    )


_ITEMS_SQL = "items AS (SELECT * FROM safe WHERE spread >= 0.53 OR review_score >= 0.53)"
_EDGE_SQL = """book AS (SELECT volume_id, count(*) AS page_count FROM embedding_pages GROUP BY 1),
edge_items AS (SELECT s.* FROM safe s JOIN book USING (volume_id) WHERE spread >= 0.53
  OR ((span_start <= 3 OR span_start + 1 >= page_count - 2) AND review_score >= 0.53::DOUBLE - 0.01::DOUBLE))"""


def _cluster_sql(source: str) -> str:
    return f"""flagged AS (SELECT *, CASE WHEN span_start <= max(span_start + 1) OVER (PARTITION BY volume_id
      ORDER BY span_start, right_name, left_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END
      AS opens FROM {source}),
    clustered AS (SELECT *, (sum(opens) OVER (PARTITION BY volume_id ORDER BY span_start, right_name, left_name))::BIGINT
      AS cluster FROM flagged),
    members AS (SELECT *, row_number() OVER c AS rank_in_cluster, spread - lead(spread, 1, 0.0) OVER c AS margin
      FROM clustered WINDOW c AS (PARTITION BY volume_id, cluster ORDER BY spread DESC, review_score DESC, span_start))"""


@query("candidate_items", f"WITH {SELECT_SQL}, {_ITEMS_SQL} SELECT {KEY_SQL}, span_start FROM items")
def candidate_items(spark, sf):
    return select.candidate_items(final_scores(spark, sf), 0.53).select(*KEY, "span_start")


def _page_counts(spark, sf):
    return table(spark, sf, "embeddings").groupBy(F.col("label").alias("volume_id")).agg(F.count(F.lit(1)).alias("page_count"))


@query("candidate_items_edge", f"WITH {SELECT_SQL}, {_EDGE_SQL} SELECT {KEY_SQL}, span_start FROM edge_items")
def candidate_items_edge(spark, sf):
    items = select.candidate_items_edge(final_scores(spark, sf), 0.53, 0.53 - 0.01, _page_counts(spark, sf))
    return items.select(*KEY, "span_start")


@query("clusters", f"WITH {SELECT_SQL}, {_ITEMS_SQL}, {_cluster_sql('items')} SELECT {KEY_SQL}, cluster FROM clustered")
def clusters(spark, sf):
    return select.clusters(select.candidate_items(final_scores(spark, sf), 0.53)).select(*KEY, "cluster")


@query(
    "cluster_table",
    f"""WITH {SELECT_SQL}, {_EDGE_SQL}, {_cluster_sql('edge_items')}
    SELECT {KEY_SQL}, cluster, rank_in_cluster, span_start, round(margin, 6) AS margin_to_next,
      CASE WHEN rank_in_cluster = 1 AND spread >= 0.53 AND margin >= 0.04 AND auto_safe THEN 'auto' ELSE 'review' END
      AS decision FROM members""",
)
def cluster_table(spark, sf):
    found = select.cluster_table(final_scores(spark, sf), 0.53, _page_counts(spark, sf))
    return rounded(found, ["margin_to_next"]).select(
        *KEY, "cluster", "rank_in_cluster", "span_start", "margin_to_next", "decision"
    )


@query(
    "select_non_overlapping",
    f"""WITH {SELECT_SQL}, {_ITEMS_SQL}, {_cluster_sql('items')} SELECT {KEY_SQL}, cluster, {r6('spread')}
    FROM members WHERE rank_in_cluster = 1 AND spread >= 0.53 AND margin >= 0.04 AND auto_safe""",
)
def select_non_overlapping(spark, sf):
    return rounded(select.select_non_overlapping(final_scores(spark, sf)), ["spread"]).select(*KEY, "cluster", "spread")


@query(
    "mutual_best_pairs",
    f"""WITH {SCORES_SQL}, crossed AS (
      SELECT volume_id, right_name, left_name, spread, review_score FROM scores WHERE spread >= 0.3
      UNION ALL SELECT volume_id, left_name, right_name, spread * 0.97, review_score FROM scores
        WHERE spread * 0.97 >= 0.3),
    r AS (SELECT *, row_number() OVER (PARTITION BY volume_id, right_name
        ORDER BY spread DESC, review_score DESC, left_name) AS by_right,
      row_number() OVER (PARTITION BY volume_id, left_name
        ORDER BY spread DESC, review_score DESC, right_name) AS by_left FROM crossed)
    SELECT {KEY_SQL}, {r6('spread')} FROM r WHERE by_right = 1 AND by_left = 1""",
)
def mutual_best_pairs(spark, sf):
    scored = _scores(spark, sf).select(*KEY, "spread", "review_score")
    swapped = scored.select(
        "volume_id",
        F.col("left_name").alias("right_name"),
        F.col("right_name").alias("left_name"),
        (F.col("spread") * 0.97).alias("spread"),
        "review_score",
    )
    return rounded(select.mutual_best_pairs(scored.unionByName(swapped), 0.3), ["spread"]).select(*KEY, "spread")


# --- score files ----------------------------------------------------------------------------------

def _through(spark, rows, write, fields):
    """The rows after writing them as score files and reading these back."""
    path = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    write(rows, path)
    back = tables.read_table(spark, path, fields)
    names = {"right": "right_name", "left": "left_name", "start_page": "span_start"}
    return back.withColumn("volume_id", F.col("volume_id").cast(dict(rows.dtypes)["volume_id"])).withColumnsRenamed(
        {old: new for old, new in names.items() if old in fields}
    )


def _file_rows(spark, sf):
    """Final scores with the columns that only files have."""
    return final_scores(spark, sf).withColumn("expected", F.lit(False))


@query("score_files", f"WITH {SELECT_SQL} SELECT {KEY_SQL}, rank, {r6(*_FINAL)} FROM ranked")
def score_files(spark, sf):
    back = _through(spark, select.rank_scores(_file_rows(spark, sf)), tables.write_scores, tables.SCORE_FIELDS)
    return back.select(*KEY, "rank", *_FINAL)


@query("review_files", ORACLES["review_decisions"])
def review_files(spark, sf):
    back = _through(spark, select.review_decisions(_file_rows(spark, sf)), tables.write_review, tables.REVIEW_FIELDS)
    return back.select(*KEY, "rank", "margin_to_next", "decision")


@query("cluster_files", ORACLES["cluster_table"])
def cluster_files(spark, sf):
    found = select.cluster_table(_file_rows(spark, sf), 0.53, _page_counts(spark, sf))
    back = _through(spark, found, tables.write_clusters, tables.CLUSTER_FIELDS)
    return back.select(*KEY, "cluster", "rank_in_cluster", "span_start", "margin_to_next", "decision")


@query("spread_candidates", f"""WITH {SELECT_SQL}, {_EDGE_SQL}, {_cluster_sql('edge_items')}
    SELECT volume_id::VARCHAR AS volume_id, lpad(span_start::VARCHAR, 3, '0') || '-' || lpad((span_start + 1)::VARCHAR, 3, '0') AS pair_id,
      span_start::INT AS start_page, (span_start + 1)::INT AS end_page, {r6('spread', 'review_score')}, 'spread-continuity' AS source,
      CASE WHEN rank_in_cluster = 1 AND spread >= 0.53 AND margin >= 0.04 AND auto_safe THEN 'auto' ELSE 'review' END
      AS decision FROM members""")  # fmt: skip
def spread_candidates(spark, sf):
    """Cluster files read as candidates; half of the volumes have their columns in another order."""
    found = select.cluster_table(_file_rows(spark, sf), 0.53, _page_counts(spark, sf)).withColumnRenamed("span_start", "start_page")
    found = found.withColumn("end_page", F.col("start_page") + 1).withColumn("_odd", F.crc32(F.col("volume_id").cast("string").cast("binary")) % 2 == 1)
    path = f"{checkpoint_folder(spark)}/files-{uuid.uuid4().hex}"
    for odd, columns in ((False, tables.SPREAD_COLUMNS), (True, tables.SPREAD_COLUMNS[::-1])):
        part = found.where(F.col("_odd") == odd).select("volume_id", *columns)
        part.write.mode("append").partitionBy("volume_id").option("header", "true").csv(path)
    volume = F.regexp_extract("file", "/volume_id=([^/]*)/", 1)
    read = tables.spread_candidates(tables.read_named(spark, path, tables.SPREAD_COLUMNS).withColumn("volume", volume))
    return rounded(read.withColumnsRenamed({"volume": "volume_id", "score": "spread"}), ["spread", "review_score"])


@query("selected_files", f"""WITH {SELECT_SQL}, {_ITEMS_SQL}, {_cluster_sql('items')} SELECT {KEY_SQL}, {r6('spread')}
    FROM members WHERE rank_in_cluster = 1 AND spread >= 0.53 AND margin >= 0.04 AND auto_safe""")  # fmt: skip
def selected_files(spark, sf):
    back = _through(spark, select.select_non_overlapping(_file_rows(spark, sf)), tables.write_selected, tables.MATCHING_FIELDS)
    return back.select(*KEY, "spread")


@query("matching_files", ORACLES["reliability_adjustment"])
def matching_files(spark, sf):
    return _through(spark, _file_rows(spark, sf), tables.write_matching, tables.MATCHING_FIELDS).select(*KEY, *_FINAL)
