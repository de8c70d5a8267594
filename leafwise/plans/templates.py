"""Queries for layout templates and edit logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.operators import presets
from leafwise.operators import spine as ops
from leafwise.operators.ordered import spread
from leafwise.plans.catalogue import VOLUMES, _scopes, volumes
from leafwise.plans.inputs import ORDER_SPINE_SQL, order_spine, stored_spine, table
from leafwise.plans.registry import query

# One template per supplier, as the JSON text a preset file holds.
_TEXT = (
    "{{\"version\": {version}, \"source_page_count\": {pages}, \"metadata\": {{\"title\": \"{name}\", \"language\": \"\"}}, "
    "\"cover\": {{\"kind\": \"{cover}\", \"source_index\": {source}}}, \"entries\": [{{\"kind\": \"blank\"}}, "
    "{{\"kind\": \"source\", \"source_index\": 2}}, {{\"kind\": \"source\", \"source_index\": {source}}}, "
    "{{\"kind\": \"inserted\", \"path\": \"{path}\"}}, "
    "{{\"kind\": \"inserted\", \"path\": \"/art/0.png\", \"entry_id\": \"{entry}\"}}, {{\"kind\": \"blank\"}}, "
    "{{\"kind\": \"inserted\", \"path\": \"/art/1.png\"}}]}}"
)


def preset_texts(spark, sf):
    key = F.col("s_suppkey")
    number = key.cast("string")
    values = {
        "version": F.when(key % 7 == 6, "3").otherwise("2"),
        "pages": F.when(key % 5 == 4, "null").otherwise((key % 3 + 3).cast("string")),
        "name": F.col("s_name"),
        "cover": F.when(key % 2 == 0, "source").otherwise("inserted"),
        "source": (key % 4 + 1).cast("string"),
        "path": F.concat(F.when(key % 9 == 8, "/lost/").otherwise("/art/"), number, F.lit(".png")),
        "entry": F.concat(F.lit("inserted-"), F.format_string("%04d", key % 4)),
    }
    text = F.lit(_TEXT.replace("{{", "{").replace("}}", "}"))
    for name, value in values.items():
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return table(spark, sf, "supplier").select(key.alias("preset_id"), text.alias("json"))


def good_presets(spark, sf):
    # Parsing is costly for its few bytes.
    return presets.parse_presets(spread(preset_texts(spark, sf), "preset_id")).where(F.col("error").isNull())


def art_files(spark, sf):
    key = F.col("s_suppkey")
    path = F.concat(F.lit("/art/"), key.cast("string"), F.lit(".png"))
    return table(spark, sf, "supplier").select(path.alias("path"), (key + 300).alias("width"), (key + 400).alias("height"))


TEMPLATES = """templates AS (SELECT s_suppkey AS preset_id, s_name AS title, s_suppkey % 7 <> 6 AS good,
    CASE WHEN s_suppkey % 5 = 4 THEN greatest(2, s_suppkey % 4 + 1) ELSE s_suppkey % 3 + 3 END AS template_pages,
    s_suppkey % 2 = 0 AS source_cover, s_suppkey % 4 + 1 AS cover_source,
    CASE WHEN s_suppkey % 9 = 8 THEN '/lost/' ELSE '/art/' END || s_suppkey || '.png' AS art, s_suppkey % 4 AS entry_number
  FROM supplier),
template_entries AS (
  SELECT preset_id, 0::BIGINT AS position, 'blank' AS kind, NULL::BIGINT AS source_index, NULL AS path, NULL AS entry_id
    FROM templates WHERE good
  UNION ALL SELECT preset_id, 1, 'source', 2, NULL, NULL FROM templates WHERE good
  UNION ALL SELECT preset_id, 2, 'source', cover_source, NULL, NULL FROM templates WHERE good
  UNION ALL SELECT preset_id, 3, 'inserted', NULL, art, NULL FROM templates WHERE good
  UNION ALL SELECT preset_id, 4, 'inserted', NULL, '/art/0.png', 'inserted-' || printf('%04d', entry_number)
    FROM templates WHERE good
  UNION ALL SELECT preset_id, 5, 'blank', NULL, NULL, NULL FROM templates WHERE good
  UNION ALL SELECT preset_id, 6, 'inserted', NULL, '/art/1.png', NULL FROM templates WHERE good)"""
TARGETS = """targets AS (SELECT DISTINCT volume_id, volume_id % (SELECT count(*) FROM supplier) AS preset_id FROM order_spine)"""


def _targets(spark, sf, spine):
    total = table(spark, sf, "supplier").agg(F.count(F.lit(1)).alias("n")).scalar()
    return spine.select("volume_id").distinct().select("volume_id", (F.col("volume_id") % total).alias("preset_id"))


@query(
    "parse_presets",
    f"""WITH {TEMPLATES} SELECT preset_id, CASE WHEN NOT good THEN 'Unsupported preset version' END AS error,
      template_pages, title, 'zh-Hant' AS language, 7::BIGINT AS entry_total, CASE WHEN source_cover THEN 'source' ELSE 'inserted' END
      AS cover_kind FROM templates""",
)
def parse_presets(spark, sf):
    parsed = presets.parse_presets(preset_texts(spark, sf))
    meta = presets.preset_meta(parsed).select("preset_id", "template_pages", "title", "language", "entry_total", "cover_kind")
    return parsed.select("preset_id", "error").join(meta, "preset_id")


@query("preset_entries", f"WITH {TEMPLATES} SELECT * FROM template_entries")
def preset_entries(spark, sf):
    return presets.preset_entries(good_presets(spark, sf))


_APPLIED = f"""{ORDER_SPINE_SQL}, {TEMPLATES}, {TARGETS},
usable AS (SELECT * FROM targets WHERE preset_id IN (SELECT preset_id FROM templates WHERE good AND art LIKE '/art/%')),
art AS (SELECT '/art/' || s_suppkey || '.png' AS path, s_suppkey + 300 AS width, s_suppkey + 400 AS height FROM supplier),
numbered AS (SELECT preset_id, 3 AS position, 'inserted-0001' AS item_id FROM templates
  UNION ALL SELECT preset_id, 4, 'inserted-' || printf('%04d', entry_number) FROM templates
  UNION ALL SELECT preset_id, 6, 'inserted-' || printf('%04d', greatest(1, entry_number) + 1) FROM templates),
merged AS (
  SELECT u.volume_id, e.position AS pos, 'source' AS kind, s.source_index, s.item_id, s.inserted_path, s.width, s.height, s.ext
    FROM usable u JOIN template_entries e USING (preset_id)
    JOIN order_spine s ON s.volume_id = u.volume_id AND s.source_index = e.source_index WHERE e.kind = 'source'
  UNION ALL SELECT volume_id, position, 'blank', NULL, NULL, NULL, NULL, NULL, NULL
    FROM usable JOIN template_entries USING (preset_id) WHERE kind = 'blank'
  UNION ALL SELECT volume_id, e.position, 'inserted', NULL, n.item_id, e.path, a.width, a.height, 'png'
    FROM usable u JOIN template_entries e USING (preset_id) JOIN numbered n USING (preset_id, position)
    JOIN art a USING (path) WHERE e.kind = 'inserted'
  UNION ALL SELECT s.volume_id, 7 + s.entry_index, s.kind, s.source_index, s.item_id, s.inserted_path, s.width, s.height, s.ext
    FROM order_spine s JOIN usable u USING (volume_id) JOIN templates t USING (preset_id)
    WHERE s.source_index > template_pages AND s.source_index NOT IN (2, cover_source)),
pages AS (SELECT * FROM merged WHERE kind <> 'blank'),
firsts AS (SELECT volume_id, arg_min(width, entry_index) AS width, arg_min(height, entry_index) AS height FROM order_spine
  WHERE kind <> 'blank' GROUP BY 1),
sized AS (SELECT m.*, (SELECT max(p.pos) FROM pages p WHERE p.volume_id = m.volume_id AND p.pos < m.pos) AS ref FROM merged m),
applied AS (SELECT z.volume_id, row_number() OVER (PARTITION BY z.volume_id ORDER BY z.pos) - 1 AS entry_index, z.kind,
    z.source_index, z.item_id, z.inserted_path,
    CASE WHEN z.kind = 'blank' THEN coalesce(p.width, f.width) ELSE z.width END AS width,
    CASE WHEN z.kind = 'blank' THEN coalesce(p.height, f.height) ELSE z.height END AS height, z.ext
  FROM sized z LEFT JOIN pages p ON p.volume_id = z.volume_id AND p.pos = z.ref LEFT JOIN firsts f ON f.volume_id = z.volume_id)"""


def _applied(spark, sf):
    spine = stored_spine(spark, sf).select(*ops.SPINE_COLUMNS)
    targets = _targets(spark, sf, spine).join(good_presets(spark, sf).select("preset_id"), "preset_id", "left_semi")
    spines, errors = presets.apply_preset_v2(spine, targets, good_presets(spark, sf), art_files(spark, sf))
    usable = targets.join(errors, "volume_id", "left_anti").select("volume_id")
    return spines.join(usable, "volume_id", "left_semi"), targets


@query("apply_preset_v2", f"WITH {_APPLIED} SELECT * FROM applied")
def apply_preset_v2(spark, sf):
    return _applied(spark, sf)[0]


_UNTOUCHED = """SELECT volume_id, entry_index, kind, source_index, item_id, inserted_path, width, height, ext
    FROM order_spine WHERE volume_id NOT IN (SELECT volume_id FROM usable)"""


@query("apply_preset_v2_all", f"WITH {_APPLIED} SELECT * FROM applied UNION ALL {_UNTOUCHED}")
def apply_preset_v2_all(spark, sf):
    """All spines, also those that no template changes."""
    spine = stored_spine(spark, sf).select(*ops.SPINE_COLUMNS)
    targets = _targets(spark, sf, spine)
    return presets.apply_preset_v2(spine, targets, good_presets(spark, sf), art_files(spark, sf))[0]


@query(
    "preset_missing_images",
    f"""WITH {_APPLIED} SELECT volume_id, 'Inserted image not found: ' || art AS error FROM targets JOIN templates
    USING (preset_id) WHERE good AND art NOT LIKE '/art/%'""",
)
def preset_missing_images(spark, sf):
    spine = order_spine(spark, sf)
    return presets.missing_images(_targets(spark, sf, spine), good_presets(spark, sf), art_files(spark, sf))


@query(
    "preset_covers",
    f"""WITH {_APPLIED}, marked AS (SELECT t.volume_id, p.source_cover, p.cover_source FROM targets t JOIN templates p
      USING (preset_id) WHERE good)
    SELECT m.volume_id, CASE WHEN source_cover THEN coalesce(min(entry_index) FILTER (source_index = cover_source),
        min(entry_index) FILTER (source_index IS NOT NULL)) ELSE min(entry_index) FILTER (kind = 'inserted') END
      AS cover_entry_index
    FROM marked m LEFT JOIN applied a ON a.volume_id = m.volume_id GROUP BY m.volume_id, source_cover""",
)
def preset_covers(spark, sf):
    applied, targets = _applied(spark, sf)
    return presets.preset_covers(applied, targets, good_presets(spark, sf))


# Version 1 templates: some sources dropped, two blanks inserted one after the other.
_V1 = """v1 AS (SELECT s_suppkey AS preset_id, s_suppkey % 3 + 1 AS gone, s_suppkey % 4 - 1 AS p1,
  CASE WHEN s_suppkey % 2 = 0 THEN 0 ELSE 99 END AS p2 FROM supplier)"""


@query(
    "apply_preset_v1",
    f"""WITH {ORDER_SPINE_SQL}, {TARGETS}, {_V1},
    kept AS (SELECT s.*, t.preset_id, row_number() OVER (PARTITION BY volume_id ORDER BY entry_index) - 1 AS i
      FROM order_spine s JOIN targets t USING (volume_id) JOIN v1 USING (preset_id)
      WHERE source_index IS NULL OR source_index NOT IN (gone, 4)),
    n AS (SELECT volume_id, preset_id, count(*) AS n FROM kept GROUP BY ALL HAVING count(*) FILTER (kind <> 'blank') > 0),
    spots AS (SELECT volume_id, least(greatest(p1, 0), n) AS b1, least(greatest(p2, 0), n + 1) AS b2
      FROM n JOIN v1 USING (preset_id)),
    fixed AS (SELECT volume_id, b1 + CASE WHEN b2 <= b1 THEN 1 ELSE 0 END AS b1, b2 FROM spots)
    SELECT volume_id, kind, source_index, i + CASE WHEN b1 IS NULL THEN 0 WHEN b2 <= b1 THEN CASE WHEN i >= b2 THEN 1 ELSE 0 END
          + CASE WHEN i + 1 >= b1 THEN CASE WHEN i >= b1 - 1 THEN 1 ELSE 0 END ELSE 0 END
        ELSE CASE WHEN i >= b1 THEN 1 ELSE 0 END + CASE WHEN i + 1 >= b2 AND i >= b1 THEN CASE WHEN i + 1 >= b2 THEN 1
          ELSE 0 END ELSE 0 END END AS entry_index
    FROM kept LEFT JOIN fixed USING (volume_id)
    UNION ALL SELECT volume_id, 'blank', NULL, b1 FROM fixed UNION ALL SELECT volume_id, 'blank', NULL, b2 FROM fixed""",
)
def apply_preset_v1(spark, sf):
    spine = stored_spine(spark, sf).select(*ops.SPINE_COLUMNS)
    key = F.col("s_suppkey")
    text = F.concat(
        F.lit('{"version": 1, "deleted_source_pages": ['), (key % 3 + 1).cast("string"), F.lit(', 4], "blank_positions": ['),
        (key % 4 - 1).cast("string"), F.when(key % 2 == 0, ", 0]}").otherwise(", 99]}"),
    )
    texts = table(spark, sf, "supplier").select(key.alias("preset_id"), text.alias("json"))
    applied = presets.apply_preset_v1(spine, _targets(spark, sf, spine), presets.parse_presets(texts))
    return applied.select("volume_id", "entry_index", "kind", "source_index")


@query(
    "apply_preset_to_scope",
    f"""WITH {VOLUMES} SELECT series_id, volume_id, CASE WHEN CASE series_id % 6 WHEN 0 THEN true
        WHEN 1 THEN volume_number IN (1, 3, 7) WHEN 2 THEN volume_number BETWEEN 2 AND 5 WHEN 3 THEN false WHEN 4 THEN false
        ELSE volume_number IN (9, 10, 11, 12, 1, 3, 4) END THEN 'Edited' ELSE status END AS status,
      title || ' Vol.' || printf('%02d', volume_number) AS book_title FROM volumes""",
)
def apply_preset_to_scope(spark, sf):
    return _scoped(spark, sf)[1].select("series_id", "volume_id", "status", "book_title")


def _scoped(spark, sf):
    """Each series takes one of the first five templates, all of which can be applied."""
    rows = volumes(spark, sf)
    preset_of = rows.select("series_id").distinct().withColumn("preset_id", F.col("series_id") % 5)
    spine = stored_spine(spark, sf).select(*ops.SPINE_COLUMNS)
    return presets.apply_preset_to_scope(rows, _scopes(spark, sf), preset_of, spine, good_presets(spark, sf), art_files(spark, sf))


_SCOPE_TARGETS = f"""{VOLUMES}, targets AS (SELECT volume_id, series_id % 5 AS preset_id FROM volumes
  WHERE CASE series_id % 6 WHEN 0 THEN true WHEN 1 THEN volume_number IN (1, 3, 7) WHEN 2 THEN volume_number BETWEEN 2 AND 5
    WHEN 3 THEN false WHEN 4 THEN false ELSE volume_number IN (9, 10, 11, 12, 1, 3, 4) END)"""


@query(
    "apply_preset_to_scope_spines",
    f"WITH {_APPLIED.replace(TARGETS, _SCOPE_TARGETS)} SELECT * FROM applied UNION ALL {_UNTOUCHED}",
)
def apply_preset_to_scope_spines(spark, sf):
    """Spines of all volumes after the templates of their series."""
    return _scoped(spark, sf)[0]
