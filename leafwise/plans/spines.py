"""Queries for page-order edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.operators import spine as ops
from leafwise.plans.inputs import ORDER_SPINE_SQL, order_spine, stored_spine, table
from leafwise.plans.registry import query
from leafwise.session import durable

BASE = ORDER_SPINE_SQL
COLUMNS = ", ".join(ops.SPINE_COLUMNS)


def _spine(spark, sf):
    return order_spine(spark, sf).select(*ops.SPINE_COLUMNS, "part", "supp", "quantity")


def _stored(spark, sf):
    return stored_spine(spark, sf).select(*ops.SPINE_COLUMNS, "part", "supp", "quantity")


# Blank points: up to two per entry, some past the end of the volume.
_POINTS = """points AS (SELECT volume_id, entry_index + CASE WHEN part % 40 = 0 THEN 9 ELSE 0 END AS idx,
  entry_index * 10 + k AS seq FROM (SELECT *, unnest(generate_series(1, supp % 3)) AS k FROM order_spine)),
sizes AS (SELECT volume_id, count(*) AS n, count(*) FILTER (kind <> 'blank') AS pages FROM order_spine GROUP BY 1)"""


def _points(spine):
    rows = spine.where(F.col("supp") % 3 > 0).withColumn(
        "k", F.explode(F.sequence(F.lit(1), (F.col("supp") % 3).cast("int")))
    )
    return rows.select(
        "volume_id",
        (F.col("entry_index") + F.when(F.col("part") % 40 == 0, 9).otherwise(0)).alias("index"),
        (F.col("entry_index") * 10 + F.col("k")).alias("seq"),
    )


@query(
    "check_blank_points",
    f"""WITH {BASE}, {_POINTS} SELECT volume_id, idx AS "index", seq,
      CASE WHEN idx < 0 OR idx > n THEN 'Blank insertion index out of range'
        WHEN pages = 0 THEN 'Cannot insert blank page into an empty layout' END AS error
    FROM points JOIN sizes USING (volume_id)""",
)
def check_blank_points(spark, sf):
    spine = _spine(spark, sf)
    return ops.check_points(spine, _points(spine)).select("volume_id", "index", "seq", "error")


@query(
    "insert_blanks",
    f"""WITH {BASE}, {_POINTS},
    valid AS (SELECT p.* FROM points p JOIN sizes USING (volume_id) WHERE idx BETWEEN 0 AND n AND pages > 0),
    pages AS (SELECT * FROM order_spine WHERE kind <> 'blank'),
    sized AS (SELECT v.volume_id, v.idx, v.seq,
        coalesce(max(p.entry_index) FILTER (p.entry_index < v.idx), min(p.entry_index)) AS ref
      FROM valid v LEFT JOIN pages p ON p.volume_id = v.volume_id GROUP BY ALL),
    every AS (
      SELECT volume_id, entry_index AS idx, 1 AS side, 0 AS seq, kind, source_index, item_id, inserted_path, width, height,
        ext FROM order_spine
      UNION ALL SELECT s.volume_id, s.idx, 0, s.seq, 'blank', NULL, NULL, NULL, p.width, p.height, NULL
      FROM sized s LEFT JOIN pages p ON p.volume_id = s.volume_id AND p.entry_index = s.ref)
    SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY idx, side, seq) - 1 AS entry_index, kind,
      source_index, item_id, inserted_path, width, height, ext FROM every""",
)
def insert_blanks(spark, sf):
    spine = _spine(spark, sf)
    return ops.insert_blanks(spine, _points(spine))


_IMAGES = """images AS (SELECT volume_id, entry_index AS idx, entry_index AS seq, 640 + quantity AS w, 800 + supp AS h,
  '/new/' || part || CASE part % 4 WHEN 0 THEN '.jpg' WHEN 1 THEN '.JPEG' WHEN 2 THEN '.png' ELSE '.gif' END AS path
  FROM order_spine WHERE quantity % 3 = 0),
fitting AS (SELECT *, CASE WHEN part_ext = 'jpeg' THEN 'jpg' ELSE part_ext END AS ext FROM (
  SELECT *, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS part_ext FROM images) WHERE part_ext <> 'gif')"""


def _images(spine):
    kinds = F.array(*[F.lit(x) for x in (".jpg", ".JPEG", ".png", ".gif")])
    tail = F.element_at(kinds, (F.col("part") % 4 + 1).cast("int"))
    return spine.where(F.col("quantity") % 3 == 0).select(
        "volume_id",
        F.col("entry_index").alias("index"),
        F.col("entry_index").alias("seq"),
        F.concat(F.lit("/new/"), F.col("part").cast("string"), tail).alias("path"),
        (F.col("quantity") + 640).alias("width"),
        (F.col("supp") + 800).alias("height"),
    )


@query(
    "insert_images",
    f"""WITH {BASE}, {_IMAGES},
    used AS (SELECT volume_id, max(try_cast(substr(item_id, 10) AS BIGINT)) AS used FROM order_spine
      WHERE kind = 'inserted' GROUP BY 1),
    named AS (SELECT f.*, 'inserted-' || printf('%04d', coalesce(used, 0) + row_number() OVER (
        PARTITION BY f.volume_id ORDER BY seq)) AS item_id FROM fitting f LEFT JOIN used USING (volume_id)),
    every AS (
      SELECT volume_id, entry_index AS idx, 1 AS side, 0 AS seq, kind, source_index, item_id, inserted_path, width, height,
        ext FROM order_spine
      UNION ALL SELECT volume_id, idx, 0, seq, 'inserted', NULL, item_id, path, w, h, ext FROM named)
    SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY idx, side, seq) - 1 AS entry_index, kind,
      source_index, item_id, inserted_path, width, height, ext FROM every""",
)
def insert_images(spark, sf):
    spine = _spine(spark, sf)
    return ops.insert_images(spine, _images(spine))


# Ranges: one or more per volume, some invalid, some past the end.
_RANGES = """ranges AS (SELECT volume_id, entry_index - CASE WHEN part % 31 = 0 THEN 50 ELSE 0 END AS first,
    entry_index + CASE WHEN part % 13 = 0 THEN -1 ELSE supp % 3 END AS last
  FROM order_spine WHERE quantity % 4 = 0),
counts AS (SELECT volume_id, count(*) AS n FROM order_spine GROUP BY 1),
valid AS (SELECT r.*, least(last, n - 1) AS til FROM ranges r JOIN counts USING (volume_id)
  WHERE first >= 0 AND last >= 0 AND first <= last AND first < n)"""


def _ranges(spine):
    at = F.col("entry_index")
    return spine.where(F.col("quantity") % 4 == 0).select(
        "volume_id",
        (at - F.when(F.col("part") % 31 == 0, 50).otherwise(0)).alias("start"),
        (at + F.when(F.col("part") % 13 == 0, -1).otherwise(F.col("supp") % 3)).alias("end"),
    )


@query(
    "check_delete_ranges",
    f"""WITH {BASE}, {_RANGES} SELECT volume_id, first AS start, least(last, n - 1) AS "end",
      CASE WHEN first < 0 OR last < 0 THEN 'Delete range cannot be negative'
        WHEN first > last THEN 'Delete range start must be before end'
        WHEN first >= n THEN 'Delete range starts after the end of the layout' END AS error
    FROM ranges JOIN counts USING (volume_id)""",
)
def check_delete_ranges(spark, sf):
    spine = _spine(spark, sf)
    return ops.check_ranges(spine, _ranges(spine)).select("volume_id", "start", "end", "error")


_KEPT = f"""kept AS (SELECT s.* FROM order_spine s WHERE NOT EXISTS (SELECT 1 FROM valid v
  WHERE v.volume_id = s.volume_id AND s.entry_index BETWEEN first AND til))"""


@query(
    "delete_entries",
    f"""WITH {BASE}, {_RANGES}, {_KEPT} SELECT volume_id,
      row_number() OVER (PARTITION BY volume_id ORDER BY entry_index) - 1 AS entry_index,
      kind, source_index, item_id, inserted_path, width, height, ext FROM kept""",
)
def delete_entries(spark, sf):
    spine = _spine(spark, sf)
    return ops.delete_entries(spine, _ranges(spine))[0]


@query(
    "deleted_entries",
    f"""WITH {BASE}, {_RANGES} SELECT {COLUMNS} FROM order_spine s WHERE EXISTS (SELECT 1 FROM valid v
      WHERE v.volume_id = s.volume_id AND s.entry_index BETWEEN first AND til)""",
)
def deleted_entries(spark, sf):
    spine = _spine(spark, sf)
    return ops.delete_entries(spine, _ranges(spine))[1]


def _counts(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("volume_id"), (F.col("o_custkey") % 3 + 1).alias("count")
    )


@query(
    "delete_first_last",
    f"""WITH {BASE}, c AS (SELECT o_orderkey AS volume_id, o_custkey % 3 + 1 AS k FROM orders),
    n AS (SELECT volume_id, count(*) AS n FROM order_spine GROUP BY 1),
    cut AS (SELECT s.*, k, row_number() OVER (PARTITION BY volume_id ORDER BY entry_index) - 1 AS i, n - k AS left_n
      FROM order_spine s JOIN c USING (volume_id) JOIN n USING (volume_id) WHERE entry_index >= k)
    SELECT volume_id, i AS entry_index, source_index, kind FROM cut WHERE i < left_n - k""",
)
def delete_first_last(spark, sf):
    counts = _counts(spark, sf)
    spine = _spine(spark, sf)
    left = ops.delete_entries(spine, ops.first_ranges(counts))[0]
    left = ops.delete_entries(left, ops.last_ranges(left, counts))[0]
    return left.select("volume_id", "entry_index", "source_index", "kind")


_MOVES = """moves AS (SELECT o_orderkey AS volume_id, o_custkey % 4 AS src, o_orderkey % 5 AS dst FROM orders)"""


def _moves(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("volume_id"),
        (F.col("o_custkey") % 4).alias("from_index"),
        (F.col("o_orderkey") % 5).alias("to_index"),
    )


@query(
    "move_entries",
    f"""WITH {BASE}, {_MOVES}, n AS (SELECT volume_id, count(*) AS n FROM order_spine GROUP BY 1),
    ok AS (SELECT volume_id, src, dst FROM moves JOIN n USING (volume_id) WHERE src < n AND dst < n),
    keyed AS (SELECT s.*, CASE WHEN src IS NULL OR entry_index <> src THEN entry_index::DOUBLE
        WHEN dst > src THEN dst + 0.5 WHEN dst < src THEN dst - 0.5 ELSE dst END AS place
      FROM order_spine s LEFT JOIN ok USING (volume_id))
    SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY place) - 1 AS entry_index, kind, source_index,
      item_id, inserted_path, width, height, ext FROM keyed""",
)
def move_entries(spark, sf):
    return ops.move_entries(_spine(spark, sf), _moves(spark, sf))


@query("recover_deleted", f"WITH {BASE} SELECT {COLUMNS} FROM order_spine")
def recover_deleted(spark, sf):
    """Deleting and recovering gives the old spine back."""
    spine = _stored(spark, sf)
    kept, deleted = ops.delete_entries(spine, _ranges(spine))
    return ops.recover_deleted(durable(kept), durable(deleted))


@query(
    "recover_deleted_clamped",
    f"""WITH {BASE}, gone AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY entry_index) - 1 AS k
        FROM order_spine WHERE quantity % 2 = 0),
    kept AS (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY entry_index) - 1 AS i
        FROM order_spine WHERE quantity % 2 = 1 AND quantity % 5 <> 0),
    n AS (SELECT volume_id, count(*) AS n FROM kept GROUP BY 1),
    placed AS (SELECT g.volume_id, source_index, kind, least(greatest(entry_index, 0), coalesce(n, 0) + k) AS place
      FROM gone g LEFT JOIN n USING (volume_id)),
    every AS (SELECT volume_id, source_index, kind, (place - row_number() OVER (PARTITION BY volume_id ORDER BY place)
        + 1) AS behind, 0 AS side, place FROM placed
      UNION ALL SELECT volume_id, source_index, kind, i, 1, i FROM kept)
    SELECT volume_id, source_index, kind, row_number() OVER (PARTITION BY volume_id ORDER BY behind, side, place) - 1
      AS entry_index FROM every""",
)
def recover_deleted_clamped(spark, sf):
    """Recovery after further deletions: old indexes past the end are appended."""
    spine = _stored(spark, sf)
    at = F.col("entry_index")
    gone = spine.where(F.col("quantity") % 2 == 0)
    cut = spine.where((F.col("quantity") % 2 == 0) | (F.col("quantity") % 5 == 0))
    kept, _ = ops.delete_entries(spine, cut.select("volume_id", at.alias("start"), at.alias("end")))
    back = ops.recover_deleted(durable(kept), gone.select(*ops.SPINE_COLUMNS))
    return back.select("volume_id", "entry_index", "source_index", "kind")


_NORMAL = """normal AS (SELECT *, count(*) OVER (PARTITION BY volume_id) AS n,
    sum(CASE WHEN kind = 'blank' THEN 1 ELSE 0 END) OVER (PARTITION BY volume_id ORDER BY entry_index) AS b
  FROM order_spine),
normal_spine AS (SELECT volume_id, entry_index + 1 AS page_index, kind, source_index, item_id AS original_id,
    CASE WHEN kind = 'blank' THEN 'blank-' || printf('%04d', b::BIGINT) ELSE 'page-' || printf('%04d', entry_index + 1) END
      AS item_id,
    CASE WHEN kind <> 'blank' THEN 'images/page-' || lpad((entry_index + 1)::VARCHAR, greatest(4, len(n::VARCHAR))::INT, '0')
      || '.' || ext END AS image_href,
    'xhtml/' || CASE WHEN kind = 'blank' THEN 'blank-' || printf('%04d', b::BIGINT)
      ELSE 'page-' || lpad((entry_index + 1)::VARCHAR, greatest(4, len(n::VARCHAR))::INT, '0') END || '.xhtml' AS page_href,
    width, height, ext FROM normal)"""


@query("normalize_spine", f"WITH {BASE}, {_NORMAL} SELECT * FROM normal_spine")
def normalize_spine(spark, sf):
    return ops.normalize_spine(_spine(spark, sf))


@query(
    "page_counts",
    f"""WITH {BASE} SELECT volume_id, count(*) FILTER (ext = 'jpg') AS jpg, count(*) FILTER (ext = 'png') AS png,
      count(*) FILTER (kind = 'blank') AS blank FROM order_spine GROUP BY 1""",
)
def page_counts(spark, sf):
    return ops.page_counts(_spine(spark, sf))


_META = """meta AS (SELECT o_orderkey AS volume_id, o_custkey % 6 AS source_page_count,
  CASE WHEN o_custkey % 3 = 0 THEN 'inserted-' || printf('%04d', o_custkey % 4 + 1) END AS cover_entry_id,
  CASE WHEN o_custkey % 3 = 1 THEN o_orderkey % 5 + 1 END AS cover_source_index, o_custkey % 2 = 0 AS exclude_cover
  FROM orders),
covers AS (SELECT m.volume_id, any_value(exclude_cover) AS exclude_cover, coalesce(
    min(entry_index) FILTER (item_id = cover_entry_id), min(entry_index) FILTER (source_index = cover_source_index),
    min(entry_index) FILTER (source_index IS NOT NULL)) AS cover_entry_index
  FROM meta m LEFT JOIN (SELECT * FROM order_spine WHERE kind <> 'blank') s USING (volume_id) GROUP BY 1)"""


def _meta(spark, sf):
    cust, key = F.col("o_custkey"), F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        key.alias("volume_id"),
        (cust % 6).alias("source_page_count"),
        F.when(cust % 3 == 0, F.format_string("inserted-%04d", cust % 4 + 1)).alias("cover_entry_id"),
        F.when(cust % 3 == 1, key % 5 + 1).alias("cover_source_index"),
        (cust % 2 == 0).alias("exclude_cover"),
    )


def _covers(spark, sf):
    meta = _meta(spark, sf)
    covers = ops.resolve_cover(_spine(spark, sf), meta)
    return covers.join(meta.select("volume_id", "exclude_cover", "source_page_count"), "volume_id")


@query("resolve_cover", f"WITH {BASE}, {_META} SELECT volume_id, cover_entry_index FROM covers")
def resolve_cover(spark, sf):
    return ops.resolve_cover(_spine(spark, sf), _meta(spark, sf))


@query(
    "reading_pages",
    f"""WITH {BASE}, {_META} SELECT {", ".join("s." + c for c in ops.SPINE_COLUMNS)}
    FROM order_spine s LEFT JOIN covers c USING (volume_id)
    WHERE NOT coalesce(exclude_cover AND entry_index = cover_entry_index, false)""",
)
def reading_pages(spark, sf):
    return ops.reading_pages(_spine(spark, sf), _covers(spark, sf))[0].select(*ops.SPINE_COLUMNS)


@query(
    "no_reading_pages",
    f"""WITH {BASE}, {_META} SELECT volume_id, 'No reading pages remain' AS error FROM order_spine s
    LEFT JOIN covers c USING (volume_id) GROUP BY 1
    HAVING count(*) FILTER (NOT coalesce(exclude_cover AND entry_index = cover_entry_index, false)) = 0""",
)
def no_reading_pages(spark, sf):
    return ops.reading_pages(_spine(spark, sf), _covers(spark, sf))[1]


@query(
    "spread_properties",
    f"""WITH {BASE} SELECT volume_id, entry_index, 'rendition:page-spread-center' AS centred,
      CASE WHEN kind <> 'blank' AND entry_index = 0 THEN 'rendition:page-spread-right'
        WHEN kind <> 'blank' AND entry_index = 1 THEN 'rendition:page-spread-left' END AS paired
    FROM order_spine""",
)
def spread_properties(spark, sf):
    index, blank = F.col("entry_index") + 1, ops.is_blank()
    return _spine(spark, sf).select(
        "volume_id",
        "entry_index",
        ops.spread_property(index, blank, True, False).alias("centred"),
        ops.spread_property(index, blank, False, True).alias("paired"),
    )


@query(
    "extract_entries",
    f"""WITH {BASE} SELECT volume_id, entry_index AS position, kind, source_index,
      CASE WHEN kind = 'inserted' THEN inserted_path END AS path, CASE WHEN kind = 'inserted' THEN item_id END AS entry_id
    FROM order_spine""",
)
def extract_entries(spark, sf):
    return ops.extract_entries(_spine(spark, sf))


@query(
    "deleted_sources",
    f"""WITH {BASE}, {_META}, wanted AS (SELECT volume_id, unnest(generate_series(1, source_page_count)) AS source_index
      FROM meta)
    SELECT volume_id, source_index FROM wanted w WHERE NOT EXISTS (SELECT 1 FROM order_spine s
      WHERE s.volume_id = w.volume_id AND s.source_index = w.source_index)""",
)
def deleted_sources(spark, sf):
    return ops.deleted_sources(_spine(spark, sf), _meta(spark, sf))


@query(
    "blank_positions",
    f"WITH {BASE} SELECT volume_id, entry_index AS position FROM order_spine WHERE kind = 'blank'",
)
def blank_positions(spark, sf):
    return ops.blank_positions(_spine(spark, sf))


# Selections repeat some indexes and run past the end.
_PICKS = """picks AS (SELECT volume_id, entry_index + CASE WHEN part % 6 = 0 THEN 1 ELSE 0 END AS idx,
  entry_index * 4 + k AS seq FROM (SELECT *, unnest(generate_series(0, supp % 4)) AS k FROM order_spine)),
sizes AS (SELECT volume_id, count(*) AS n FROM order_spine GROUP BY 1),
chosen AS (SELECT p.volume_id, idx, seq, lpad((idx + 1)::VARCHAR, greatest(4, len(n::VARCHAR))::INT, '0') AS stem, ext,
    row_number() OVER (PARTITION BY p.volume_id, idx ORDER BY seq) - 1 AS nth
  FROM picks p JOIN order_spine s ON s.volume_id = p.volume_id AND s.entry_index = idx AND kind <> 'blank'
  JOIN sizes z ON z.volume_id = p.volume_id)"""


def _picks(spine):
    rows = spine.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("supp") % 4).cast("int"))))
    return rows.select(
        "volume_id",
        (F.col("entry_index") + F.when(F.col("part") % 6 == 0, 1).otherwise(0)).alias("index"),
        (F.col("entry_index") * 4 + F.col("k")).alias("seq"),
    )


@query(
    "selected_image_names",
    f"""WITH {BASE}, {_PICKS} SELECT volume_id, idx AS "index", seq,
      stem || CASE WHEN nth > 0 THEN '-' || nth ELSE '' END || '.' || ext AS file_name FROM chosen""",
)
def selected_image_names(spark, sf):
    spine = _stored(spark, sf)
    return ops.selected_image_names(spine, _picks(spine))


@query(
    "selected_image_names_existing",
    f"""WITH {BASE}, {_PICKS},
    there AS (SELECT DISTINCT volume_id, idx, nth AS used FROM chosen WHERE (idx + nth) % 2 = 0),
    free AS (SELECT volume_id, idx, s, row_number() OVER (PARTITION BY volume_id, idx ORDER BY s) - 1 AS nth FROM (
        SELECT DISTINCT c.volume_id, c.idx, s FROM chosen c, (SELECT unnest(generate_series(0, 40)) AS s)
        WHERE NOT EXISTS (SELECT 1 FROM there t WHERE t.volume_id = c.volume_id AND t.idx = c.idx AND t.used = s)))
    SELECT c.volume_id, c.idx AS "index", seq, stem || CASE WHEN s > 0 THEN '-' || s ELSE '' END || '.' || ext AS file_name
    FROM chosen c JOIN free f ON f.volume_id = c.volume_id AND f.idx = c.idx AND f.nth = c.nth""",
)
def selected_image_names_existing(spark, sf):
    """Names that avoid files already in the folder."""
    spine = _stored(spark, sf)
    plain = ops.selected_image_names(spine, _picks(spine))
    suffix = F.coalesce(F.nullif(F.regexp_extract("file_name", r"-([0-9]+)\.", 1), F.lit("")).cast("int"), F.lit(0))
    there = plain.where((F.col("index") + suffix) % 2 == 0).select("volume_id", F.col("file_name").alias("name"))
    return ops.selected_image_names(spine, _picks(spine), there)


@query(
    "skipped_blanks",
    f"""WITH {BASE}, {_PICKS} SELECT p.volume_id, count(*) AS skipped FROM picks p JOIN order_spine s
      ON s.volume_id = p.volume_id AND s.entry_index = idx AND kind = 'blank' GROUP BY 1""",
)
def skipped_blanks(spark, sf):
    spine = _spine(spark, sf)
    return ops.skipped_blanks(spine, _picks(spine))


@query(
    "blanks_around_cover",
    f"""WITH {BASE}, {_META}, spots AS (SELECT c.volume_id, coalesce(cover_entry_index, 0) AS cover,
        source_page_count % 3 AS nb, source_page_count % 2 AS na FROM covers c JOIN meta USING (volume_id)
        WHERE c.volume_id IN (SELECT volume_id FROM order_spine WHERE kind <> 'blank')),
    every AS (
      SELECT volume_id, entry_index AS idx, 1 AS side, 0 AS k, kind, source_index FROM order_spine
      UNION ALL SELECT volume_id, cover, 0, unnest(generate_series(1, nb)), 'blank', NULL FROM spots
      UNION ALL SELECT volume_id, cover + 1, 0, unnest(generate_series(1, na)), 'blank', NULL FROM spots)
    SELECT volume_id, row_number() OVER (PARTITION BY volume_id ORDER BY idx, side, k) - 1 AS entry_index, kind, source_index
    FROM every""",
)
def blanks_around_cover(spark, sf):
    covers = _covers(spark, sf).withColumns(
        {"before": F.col("source_page_count") % 3, "after": F.col("source_page_count") % 2}
    )
    edited = ops.insert_blanks(_spine(spark, sf), ops.cover_blank_points(covers))
    return edited.select("volume_id", "entry_index", "kind", "source_index")


@query(
    "has_saved_layout",
    f"""WITH {BASE}, {_META}, s AS (SELECT volume_id, count(*) AS n,
        count(*) FILTER (kind <> 'source' OR source_index <> entry_index + 1) AS changed FROM order_spine GROUP BY 1)
    SELECT volume_id, coalesce(changed, 0) > 0 OR coalesce(n, 0) <> source_page_count AS saved
    FROM meta LEFT JOIN s USING (volume_id)""",
)
def has_saved_layout(spark, sf):
    return ops.has_saved_layout(_spine(spark, sf), _meta(spark, sf))


@query(
    "member_names",
    """WITH p AS (SELECT source AS volume_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page,
        CASE WHEN n_chars % 2 = 0 THEN 'jpg' ELSE 'png' END AS ext, count(*) OVER (PARTITION BY source) AS n FROM documents)
    SELECT volume_id, page, ext, 'page-' || printf('%04d', page) AS item_id,
      'images/page-' || lpad(page::VARCHAR, greatest(4, len(n::VARCHAR))::INT, '0') || '.' || ext AS image_href,
      'xhtml/page-' || lpad(page::VARCHAR, greatest(4, len(n::VARCHAR))::INT, '0') || '.xhtml' AS page_href FROM p""",
)
def member_names(spark, sf):
    from leafwise.operators.ordered import number_rows

    docs = table(spark, sf, "documents").select(
        F.col("source").alias("volume_id"),
        "doc_id",
        F.when(F.col("n_chars") % 2 == 0, "jpg").otherwise("png").alias("ext"),
    )
    pages = number_rows(docs, ["volume_id"], "doc_id", "page", first=1).drop("doc_id")
    return ops.member_names(pages)
