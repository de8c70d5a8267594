"""Queries for reviewing spreads and diagnosing layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.functions.names import pair_id
from leafwise.operators import diagnose
from leafwise.plans.inputs import (
    CONFIRMED_SQL,
    INSERT_GAPS_SQL,
    ORDER_SPINE_SQL,
    SPREAD_MARKS_SQL,
    confirmed,
    insert_gaps,
    order_spine,
    spread_marks,
    stored_spine,
    table,
)
from leafwise.plans.registry import query


BASE = f"{ORDER_SPINE_SQL}, {SPREAD_MARKS_SQL}, {INSERT_GAPS_SQL}, {CONFIRMED_SQL}"
# Volumes with an even id are shown with a cover gap.
PLACED = f"""{BASE},
placed AS (
  SELECT volume_id, source_index, entry_index,
    entry_index + CASE WHEN volume_id % 2 = 0 AND entry_index >= 1 THEN 1 ELSE 0 END AS preview_index
  FROM order_spine WHERE source_index IS NOT NULL),
damage AS (
  SELECT c.volume_id, pair_id, start_page, end_page, s.entry_index AS start_entry_index, e.entry_index AS end_entry_index,
    CASE WHEN s.entry_index IS NULL OR e.entry_index IS NULL THEN 'missing'
      WHEN s.preview_index + 1 <> e.preview_index OR s.preview_index // 2 <> e.preview_index // 2 THEN 'damaged'
      ELSE 'intact' END AS status,
    CASE WHEN s.entry_index IS NULL AND e.entry_index IS NULL
        THEN printf('Page %d and Page %d missing from current layout', start_page, end_page)
      WHEN s.entry_index IS NULL THEN printf('Page %d missing from current layout', start_page)
      WHEN e.entry_index IS NULL THEN printf('Page %d missing from current layout', end_page)
      WHEN s.preview_index + 1 <> e.preview_index
        THEN 'Confirmed pages are in different preview spreads or wrong order'
      WHEN s.preview_index // 2 <> e.preview_index // 2 THEN 'Confirmed pages are in different preview spreads'
      ELSE 'Confirmed spread is paired in the current preview' END AS reason
  FROM confirmed c LEFT JOIN placed s ON s.volume_id = c.volume_id AND s.source_index = start_page
    LEFT JOIN placed e ON e.volume_id = c.volume_id AND e.source_index = end_page)"""

# Brute force: every candidate against every confirmed spread with shifted indexes.
WHAT_IF = f"""{PLACED},
located AS (
  SELECT g.*, CASE WHEN b.entry_index = a.entry_index + 1 THEN b.entry_index END AS ins, i.pair_id AS inside_pair
  FROM insert_gaps g LEFT JOIN placed a ON a.volume_id = g.volume_id AND a.source_index = after_page
    LEFT JOIN placed b ON b.volume_id = g.volume_id AND b.source_index = before_page
    LEFT JOIN confirmed i ON i.volume_id = g.volume_id AND i.start_page = after_page AND i.end_page = before_page
  WHERE substr(label, 1, 2) IN ('A ', 'B ', 'C ', 'D ')),
shifted AS (
  SELECT l.volume_id, l.gap_id, d.pair_id, d.status,
    start_entry_index + CASE WHEN start_entry_index >= ins THEN 1 ELSE 0 END AS s,
    end_entry_index + CASE WHEN end_entry_index >= ins THEN 1 ELSE 0 END AS e
  FROM located l JOIN damage d ON d.volume_id = l.volume_id WHERE ins IS NOT NULL AND d.status <> 'missing'),
tested AS (
  SELECT *, s + CASE WHEN volume_id % 2 = 0 AND s >= 1 THEN 1 ELSE 0 END + 1
      = e + CASE WHEN volume_id % 2 = 0 AND e >= 1 THEN 1 ELSE 0 END
    AND (s + CASE WHEN volume_id % 2 = 0 AND s >= 1 THEN 1 ELSE 0 END) % 2 = 0 AS intact_after
  FROM shifted),
effects AS (
  SELECT volume_id, gap_id, min(CASE WHEN status = 'intact' AND NOT intact_after THEN pair_id END) AS broken,
    min(CASE WHEN status = 'damaged' AND intact_after THEN pair_id END) AS fixed,
    count(CASE WHEN status = 'damaged' AND intact_after THEN 1 END) AS fixes
  FROM tested GROUP BY ALL),
classified AS (
  SELECT l.*, broken, fixed, fixes, CASE WHEN ins IS NULL THEN 'stale'
      WHEN inside_pair IS NOT NULL OR broken IS NOT NULL THEN 'protected' WHEN fixed IS NOT NULL THEN 'suggested' END AS kind
  FROM located l LEFT JOIN effects e USING (volume_id, gap_id)),
points AS (
  SELECT volume_id, kind, gap_id, after_page, before_page, ins AS insertion_index, ins - 1 AS marker_entry_index,
    safe_insert_score AS score, label,
    CASE WHEN kind = 'stale' THEN NULL
      WHEN inside_pair IS NOT NULL THEN 'Gap is inside confirmed spread ' || inside_pair
      WHEN broken IS NOT NULL THEN 'Insertion would damage confirmed spread ' || broken
      ELSE 'Repairs confirmed spread ' || fixed END AS reason,
    CASE WHEN kind = 'suggested' THEN fixes ELSE 0 END AS fix_count, CASE WHEN kind = 'suggested' THEN fixed END AS first_fix
  FROM classified WHERE kind IS NOT NULL)"""


def _gap():
    return F.col("volume_id") % 2 == 0


def _volumes(spine):
    return spine.groupBy("volume_id").agg(F.count(F.lit(1)).alias("source_page_count"))


def _damage(spark, sf):
    spine = stored_spine(spark, sf)
    return diagnose.diagnose_damage(spine, confirmed(spine), _gap())


def _points(spark, sf):
    spine = stored_spine(spark, sf)
    return diagnose.what_if_insert(spine, confirmed(spine), insert_gaps(spine), _gap())


@query(
    "check_pairs",
    f"""WITH {BASE}, sizes AS (SELECT volume_id, count(*) AS n FROM order_spine GROUP BY 1)
    SELECT volume_id, start_page, end_page, score,
      CASE WHEN start_page < 1 OR end_page > n THEN 'Spread pair is outside the source page range'
        WHEN end_page <> start_page + 1 THEN 'Spread pair must use adjacent source pages' END AS error
    FROM spread_marks JOIN sizes USING (volume_id)""",
)
def check_pairs(spark, sf):
    spine = order_spine(spark, sf)
    checked = diagnose.check_pairs(spread_marks(spine), _volumes(spine))
    return checked.select("volume_id", "start_page", "end_page", "score", "error")


_LOADED = """loaded AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume_id, pair_id
  ORDER BY score, review_score, decision) AS r FROM spread_marks) WHERE r = 1)"""


@query(
    "load_candidates",
    f"WITH {BASE}, {_LOADED} SELECT volume_id, pair_id, start_page, end_page, score, review_score, decision FROM loaded",
)
def load_candidates(spark, sf):
    return diagnose.load_candidates(spread_marks(order_spine(spark, sf)))


# Review marks from the event stream: an event marks one pair of the order it names.
_MARKS = """marks AS (
  SELECT event_id % (SELECT max(o_orderkey) + 1 FROM orders) AS volume_id,
    printf('%03d-%03d', 1 + user_id % 4, 2 + user_id % 4) AS pair_id, event_id AS seq,
    CASE event_type WHEN 'click' THEN 'true' WHEN 'purchase' THEN 'true' WHEN 'view' THEN 'false'
      WHEN 'signup' THEN 'pending' ELSE 'maybe' END AS status
  FROM events)"""


def _marks(spark, sf):
    top = table(spark, sf, "orders").agg((F.max("o_orderkey") + 1).alias("top")).scalar()
    status = (
        F.when(F.col("event_type").isin("click", "purchase"), "true")
        .when(F.col("event_type") == "view", "false")
        .when(F.col("event_type") == "signup", "pending")
        .otherwise("maybe")
    )
    start = F.lit(1) + F.col("user_id") % 4
    return table(spark, sf, "events").select(
        (F.col("event_id") % top).alias("volume_id"),
        pair_id(start, start + 1).alias("pair_id"),
        F.col("event_id").alias("seq"),
        status.alias("status"),
    )


_REVIEWED = f"""{_LOADED}, {_MARKS},
newest AS (SELECT volume_id, pair_id, arg_max(status, seq) AS status FROM marks
  WHERE status IN ('pending', 'true', 'false') GROUP BY 1, 2),
reviewed AS (SELECT l.*, coalesce(n.status, 'pending') AS status FROM loaded l LEFT JOIN newest n USING (volume_id, pair_id))"""


def _reviewed(spark, sf):
    loaded = diagnose.load_candidates(spread_marks(order_spine(spark, sf)))
    return diagnose.apply_review_marks(loaded, _marks(spark, sf))


@query("apply_review_marks", f"WITH {BASE}, {_REVIEWED} SELECT volume_id, pair_id, score, status FROM reviewed")
def apply_review_marks(spark, sf):
    return _reviewed(spark, sf).select("volume_id", "pair_id", "score", "status")


@query(
    "rejected_marks",
    f"""WITH {BASE}, {_REVIEWED} SELECT m.volume_id, m.pair_id, seq, m.status,
      CASE WHEN m.status NOT IN ('pending', 'true', 'false') THEN 'Unsupported spread candidate status'
        ELSE 'Unknown spread pair' END AS error
    FROM marks m LEFT JOIN loaded l USING (volume_id, pair_id)
    WHERE m.status NOT IN ('pending', 'true', 'false') OR l.pair_id IS NULL""",
)
def rejected_marks(spark, sf):
    loaded = diagnose.load_candidates(spread_marks(order_spine(spark, sf)))
    return diagnose.rejected_marks(loaded, _marks(spark, sf)).select("volume_id", "pair_id", "seq", "status", "error")


_MANUAL = """manual AS (SELECT DISTINCT volume_id, entry_index + 1 AS start_page, entry_index + 2 AS end_page
  FROM order_spine WHERE quantity % 17 = 0)"""


@query(
    "add_manual_spreads",
    f"""WITH {BASE}, {_REVIEWED}, {_MANUAL},
    named AS (SELECT *, printf('%03d-%03d', start_page, end_page) AS pair_id FROM manual)
    SELECT volume_id, pair_id, start_page, end_page, score, review_score, decision, status FROM reviewed r
      WHERE NOT EXISTS (SELECT 1 FROM named n WHERE n.volume_id = r.volume_id AND n.pair_id = r.pair_id)
    UNION ALL SELECT volume_id, pair_id, start_page, end_page, 1.0::DOUBLE, 1.0::DOUBLE, 'manual', 'true' FROM named""",
)
def add_manual_spreads(spark, sf):
    page = F.col("entry_index") + 1
    manual = order_spine(spark, sf).where(F.col("quantity") % 17 == 0)
    manual = manual.select("volume_id", page.alias("start_page"), (page + 1).alias("end_page"))
    return diagnose.add_manual_spreads(_reviewed(spark, sf), manual)


@query(
    "manual_pair_check",
    f"""WITH {BASE}, picks AS (SELECT volume_id, entry_index AS first_index,
        entry_index + CASE part % 5 WHEN 0 THEN 2 WHEN 1 THEN -1 ELSE 1 END AS second_index FROM order_spine),
      pages AS (SELECT * FROM order_spine WHERE kind <> 'blank')
    SELECT p.volume_id, first_index, second_index, a.source_index AS start_page, b.source_index AS end_page,
      coalesce(b.entry_index = a.entry_index + 1 AND b.source_index = a.source_index + 1, false) AS accepted
    FROM picks p
    LEFT JOIN pages a ON a.volume_id = p.volume_id AND a.entry_index = least(first_index, second_index)
    LEFT JOIN pages b ON b.volume_id = p.volume_id AND b.entry_index = greatest(first_index, second_index)""",
)
def manual_pair_check(spark, sf):
    spine = order_spine(spark, sf)
    step = F.when(F.col("part") % 5 == 0, 2).when(F.col("part") % 5 == 1, -1).otherwise(1)
    picks = spine.select(
        "volume_id", F.col("entry_index").alias("first_index"), (F.col("entry_index") + step).alias("second_index")
    )
    return diagnose.manual_pair_check(spine, picks)


@query(
    "confirmed_spreads",
    f"WITH {BASE}, {_REVIEWED} SELECT volume_id, pair_id, start_page, end_page FROM reviewed WHERE status = 'true'",
)
def confirmed_spreads(spark, sf):
    found = diagnose.confirmed_spreads(_reviewed(spark, sf))
    return found.select("volume_id", "pair_id", "start_page", "end_page")


@query(
    "review_summary",
    f"""WITH {BASE}, {_REVIEWED} SELECT volume_id, count(*) AS total,
      count(*) FILTER (status = 'pending') AS pending_count, count(*) FILTER (status = 'true') AS true_count,
      count(*) FILTER (status = 'false') AS false_count FROM reviewed GROUP BY 1""",
)
def review_summary(spark, sf):
    return diagnose.review_summary(_reviewed(spark, sf))


@query(
    "placements",
    f"""WITH {PLACED} SELECT volume_id, source_index, entry_index, preview_index, preview_index // 2 AS preview_pair_index
    FROM placed""",
)
def placements(spark, sf):
    return diagnose.placements(order_spine(spark, sf), _gap())


@query(
    "preview_pairs",
    f"""WITH {BASE}, shown AS (
      SELECT volume_id, entry_index, entry_index + CASE WHEN entry_index >= 1 THEN 1 ELSE 0 END AS preview_index,
        false AS is_gap FROM order_spine
      UNION ALL SELECT volume_id, NULL, 1, true FROM order_spine WHERE entry_index = 0)
    SELECT *, preview_index // 2 AS pair_index, CASE WHEN (preview_index % 2 = 0) = (preview_index // 2 <> 0)
      THEN 'right' ELSE 'left' END AS side FROM shown""",
)
def preview_pairs(spark, sf):
    return diagnose.preview_pairs(order_spine(spark, sf), True)


@query(
    "preview_pairs_no_gap",
    f"""WITH {BASE} SELECT volume_id, entry_index, entry_index AS preview_index, false AS is_gap,
      entry_index // 2 AS pair_index, CASE WHEN entry_index % 2 = 0 THEN 'right' ELSE 'left' END AS side
    FROM order_spine""",
)
def preview_pairs_no_gap(spark, sf):
    return diagnose.preview_pairs(order_spine(spark, sf), False)


@query(
    "diagnose_damage",
    f"""WITH {PLACED} SELECT volume_id, pair_id, start_page, end_page, status, reason, start_entry_index, end_entry_index
    FROM damage""",
)
def diagnose_damage(spark, sf):
    return _damage(spark, sf)


@query("insertion_index", f"WITH {WHAT_IF} SELECT volume_id, gap_id, ins AS insertion_index FROM located")
def insertion_index(spark, sf):
    spine = order_spine(spark, sf)
    gaps = insert_gaps(spine).where(diagnose.is_reviewable(F.col("label")))
    return diagnose.insertion_index(gaps, spine).select("volume_id", "gap_id", "insertion_index")


@query("protected_gaps", f"WITH {WHAT_IF} SELECT volume_id, gap_id, inside_pair FROM located")
def protected_gaps(spark, sf):
    spine = order_spine(spark, sf)
    gaps = insert_gaps(spine).where(diagnose.is_reviewable(F.col("label")))
    return diagnose.protected_gaps(gaps, confirmed(spine)).select("volume_id", "gap_id", "inside_pair")


@query("what_if_insert", f"WITH {WHAT_IF} SELECT * FROM points")
def what_if_insert(spark, sf):
    return _points(spark, sf)


@query(
    "repair_ranges",
    f"""WITH {PLACED}, last AS (SELECT volume_id, max(start_entry_index) FILTER (status = 'intact') AS last
        FROM damage GROUP BY 1)
    SELECT volume_id, pair_id, greatest(coalesce(last, 0) + 1, 1) AS repair_from, start_entry_index AS repair_to
    FROM damage JOIN last USING (volume_id) WHERE status = 'damaged' AND end_entry_index = start_entry_index + 1
      AND (start_entry_index + CASE WHEN volume_id % 2 = 0 AND start_entry_index >= 1 THEN 1 ELSE 0 END) % 2 = 1
      AND start_entry_index >= greatest(coalesce(last, 0) + 1, 1)""",
)
def repair_ranges(spark, sf):
    return diagnose.repair_ranges(_damage(spark, sf), _gap())


@query(
    "insert_point_fixes",
    f"""WITH {WHAT_IF}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY volume_id
        ORDER BY score DESC, insertion_index, gap_id) AS r FROM points WHERE kind = 'suggested') WHERE r = 1)
    SELECT b.volume_id, b.gap_id, t.pair_id FROM best b JOIN tested t USING (volume_id, gap_id)
    WHERE t.status = 'damaged' AND t.intact_after""",
)
def insert_point_fixes(spark, sf):
    spine = stored_spine(spark, sf)
    marked = confirmed(spine)
    points = diagnose.what_if_insert(spine, marked, insert_gaps(spine), _gap())
    ranges = diagnose.repair_ranges(diagnose.diagnose_damage(spine, marked, _gap()), _gap())
    return diagnose.expand_fixes(diagnose.best_suggestion(points), ranges)


@query(
    "what_if_fixes",
    f"""WITH {WHAT_IF}, fixed AS (SELECT volume_id, gap_id, list_sort(list(DISTINCT pair_id)) AS fixes
        FROM tested WHERE status = 'damaged' AND intact_after GROUP BY ALL)
    SELECT p.volume_id, p.gap_id, p.kind, p.fix_count,
      CASE WHEN p.kind = 'suggested' THEN array_to_string(f.fixes, ' ') ELSE '' END AS fixes
    FROM points p LEFT JOIN fixed f USING (volume_id, gap_id)""",
)
def what_if_fixes(spark, sf):
    """Every insertion point with the list of spreads that it repairs."""
    spine = stored_spine(spark, sf)
    marked = confirmed(spine)
    points = diagnose.what_if_insert(spine, marked, insert_gaps(spine), _gap())
    ranges = diagnose.repair_ranges(diagnose.diagnose_damage(spine, marked, _gap()), _gap())
    found = diagnose.with_fixes(points, ranges)
    return found.select("volume_id", "gap_id", "kind", "fix_count", F.array_join("fixes", " ").alias("fixes"))


@query(
    "order_insert_points",
    f"""WITH {WHAT_IF} SELECT volume_id, kind, gap_id, row_number() OVER (PARTITION BY volume_id, kind ORDER BY
      CASE WHEN kind = 'suggested' THEN -score ELSE insertion_index END,
      CASE WHEN kind = 'suggested' THEN insertion_index ELSE -score END, gap_id) AS place
    FROM points WHERE kind <> 'stale'""",
)
def order_insert_points(spark, sf):
    return diagnose.order_insert_points(_points(spark, sf)).select("volume_id", "kind", "gap_id", "place")


@query(
    "spine_markers",
    f"""WITH {WHAT_IF} SELECT volume_id, marker_entry_index, kind, gap_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY volume_id, marker_entry_index
        ORDER BY kind = 'suggested' DESC, score, gap_id DESC) AS r FROM points WHERE kind <> 'stale') WHERE r = 1""",
)
def spine_markers(spark, sf):
    return diagnose.spine_markers(_points(spark, sf))


@query(
    "damage_summary",
    f"""WITH {WHAT_IF}, s AS (SELECT volume_id, status AS s FROM damage UNION ALL SELECT volume_id, kind FROM points)
    SELECT volume_id, {", ".join(f"count(*) FILTER (s = '{n}') AS {n}" for n in
      ("damaged", "intact", "missing", "suggested", "protected", "stale"))} FROM s GROUP BY 1""",
)
def damage_summary(spark, sf):
    return diagnose.damage_summary(_damage(spark, sf), _points(spark, sf))


@query(
    "stale_results",
    """WITH r AS (SELECT o_orderkey AS volume_id, o_orderkey % 7000 AS computed_seq FROM orders),
    e AS (SELECT user_id AS volume_id, max(event_id) AS seq FROM events GROUP BY 1)
    SELECT r.volume_id, computed_seq, coalesce(seq > computed_seq, false) AS stale FROM r LEFT JOIN e USING (volume_id)""",
)
def stale_results(spark, sf):
    results = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("volume_id"), (F.col("o_orderkey") % 7000).alias("computed_seq")
    )
    edits = table(spark, sf, "events").select(F.col("user_id").alias("volume_id"), F.col("event_id").alias("seq"))
    return diagnose.stale_results(results, edits)
