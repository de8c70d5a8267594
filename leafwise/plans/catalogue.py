"""Queries for names, paths and the series catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.functions import names, paths
from leafwise.operators import series
from leafwise.plans.inputs import table
from leafwise.plans.registry import query

# --- names ----------------------------------------------------------------------------------------

# Archive members made from the parts: some in resource forks, some hidden, some directories.
MEMBERS = """members AS (
  SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN '__MACOSX/' WHEN 1 THEN 'ch\\' WHEN 2 THEN '.' ELSE 'art/' END
    || p_name || ' ' || p_partkey || CASE p_size % 8 WHEN 0 THEN '.JPG' WHEN 1 THEN '.png' WHEN 2 THEN '.txt'
      WHEN 3 THEN '.webp' WHEN 4 THEN '' WHEN 5 THEN '.heic' WHEN 6 THEN '.jfif' ELSE '/' END AS member_name,
    p_size % 8 = 7 AS is_dir
  FROM part)"""


def members(spark, sf):
    key, size = F.col("p_partkey"), F.col("p_size") % 8
    lead = F.when(key % 11 == 0, "__MACOSX/").when(key % 11 == 1, "ch\\").when(key % 11 == 2, ".").otherwise("art/")
    tails = F.array(*[F.lit(t) for t in (".JPG", ".png", ".txt", ".webp", "", ".heic", ".jfif", "/")])
    return table(spark, sf, "part").select(
        "p_partkey",
        F.concat(lead, "p_name", F.lit(" "), key.cast("string"), F.element_at(tails, size + 1)).alias("member_name"),
        (size == 7).alias("is_dir"),
    )


_EXTS = ", ".join(f"'{e}'" for e in names.IMAGE_EXTENSIONS)


@query(
    "image_members",
    f"""WITH {MEMBERS}, clean AS (SELECT *, replace(member_name, '\\', '/') AS n FROM members)
    SELECT p_partkey, n AS member_name FROM clean WHERE NOT is_dir AND NOT list_contains(string_split(n, '/'), '__MACOSX')
      AND NOT starts_with(regexp_extract(n, '([^/]*)$', 1), '.')
      AND lower(regexp_extract(n, '\\.([^./]+)$', 1)) IN ({_EXTS})""",
)
def image_members(spark, sf):
    name = F.col("member_name")
    return members(spark, sf).where(names.is_image_member(name, F.col("is_dir"))).select(
        "p_partkey", names.slashes(name).alias("member_name")
    )


@query(
    "classify_media",
    f"""WITH {MEMBERS}, e AS (SELECT p_partkey, lower(regexp_extract(member_name, '[^/]\\.([^./\\\\]+)$', 1)) AS ext FROM members)
    SELECT p_partkey, ext, CASE WHEN ext IN ('jpg', 'jpeg', 'jpe', 'jfif') THEN 'jpg' WHEN ext IN ({_EXTS}) THEN 'png' END
      AS out_ext, ext IN ('webp', 'heic') AS converted,
      CASE WHEN ext IN ('jpg', 'jpeg', 'jpe', 'jfif') THEN 'image/jpeg' WHEN ext IN ({_EXTS}) THEN 'image/png' END
      AS media_type FROM e WHERE ext <> ''""",
)
def classify_media(spark, sf):
    ext = names.extension(F.col("member_name"))
    rows = members(spark, sf).where(~F.col("is_dir")).select("p_partkey", ext.alias("ext")).where(F.col("ext") != "")
    out = names.output_extension(F.col("ext"))
    return rows.select(
        "p_partkey", "ext", out.alias("out_ext"), names.is_converted(F.col("ext")).alias("converted"),
        names.media_type(out).alias("media_type"),
    )


_KEYED = """named AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN p_size || p_name
    WHEN p_partkey % 3 = 1 THEN upper(p_name) || ' 0' || p_partkey ELSE p_brand || '-' || p_name || p_size END AS name
  FROM part),
keyed AS (SELECT *, list_transform(regexp_extract_all(name, '[0-9]+|[^0-9]+'), lambda c:
    CASE WHEN regexp_matches(c, '^[0-9]') THEN '0' || lpad(len(coalesce(nullif(ltrim(c, '0'), ''), '0'))::VARCHAR, 10, '0')
      || coalesce(nullif(ltrim(c, '0'), ''), '0') ELSE '1' || lower(c) END) AS key FROM named)"""


def _named(spark, sf):
    key = F.col("p_partkey") % 3
    size = F.col("p_size").cast("string")
    name = (
        F.when(key == 0, F.concat(size, "p_name"))
        .when(key == 1, F.concat(F.upper("p_name"), F.lit(" 0"), F.col("p_partkey").cast("string")))
        .otherwise(F.concat("p_brand", F.lit("-"), "p_name", size))
    )
    return table(spark, sf, "part").select("p_partkey", "p_brand", name.alias("name"))


@query("natural_key", f"WITH {_KEYED} SELECT p_partkey, name, array_to_string(key, '|') AS natural_key FROM keyed")
def natural_key(spark, sf):
    return _named(spark, sf).select(
        "p_partkey", "name", F.array_join(names.natural_key(F.col("name")), "|").alias("natural_key")
    )


@query(
    "natural_order",
    f"""WITH {_KEYED} SELECT k.p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY key, k.p_partkey) AS place
    FROM keyed k JOIN part p USING (p_partkey)""",
)
def natural_order(spark, sf):
    from leafwise.operators.ordered import ranked

    rows, name = _named(spark, sf), F.col("name")
    order = [names.natural_key(name), F.col("p_partkey")]
    placed = ranked(rows, ["p_brand"], order, "place")
    return placed.select("p_partkey", "p_brand", "place")


@query(
    "page_number",
    f"""WITH {_KEYED} SELECT p_partkey, try_cast(list_last(regexp_extract_all(name, '[0-9]+')) AS BIGINT) AS page_number
    FROM keyed""",
)
def page_number(spark, sf):
    return _named(spark, sf).select("p_partkey", names.page_number(F.col("name")).alias("page_number"))


# File stems with every naming habit the inference knows.
STEMS = """stems AS (SELECT p_partkey, p_brand, p_size, CASE p_partkey % 6
    WHEN 0 THEN p_name || ' Vol.' || p_size WHEN 1 THEN '[' || p_name || '][' || p_type || '] volume ' || p_size
    WHEN 2 THEN p_name || '  ' || p_size || ' ' WHEN 3 THEN p_name || ', tales  ' || p_type || ' vol ' || p_size
    WHEN 4 THEN 'vol' || p_size || 'b ' || p_name ELSE 'Vol.' || p_size END AS stem FROM part)"""


def stems(spark, sf):
    kind, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    text = (
        F.when(kind == 0, F.concat("p_name", F.lit(" Vol."), size))
        .when(kind == 1, F.concat(F.lit("["), "p_name", F.lit("]["), "p_type", F.lit("] volume "), size))
        .when(kind == 2, F.concat("p_name", F.lit("  "), size, F.lit(" ")))
        .when(kind == 3, F.concat("p_name", F.lit(", tales  "), "p_type", F.lit(" vol "), size))
        .when(kind == 4, F.concat(F.lit("vol"), size, F.lit("b "), "p_name"))
        .otherwise(F.concat(F.lit("Vol."), size))
    )
    return table(spark, sf, "part").select("p_partkey", "p_brand", "p_size", text.alias("stem"))


_NUMBER = r"""coalesce(try_cast(nullif(regexp_extract(stem, '(?i)\b(?:vol(?:ume)?\.?\s*)(\d+)\b', 1), '') AS BIGINT),
  try_cast(nullif(regexp_extract(stem, '(\d+)\s*$', 1), '') AS BIGINT), {fallback})"""
_BARE = r"""trim(regexp_replace(regexp_replace(stem, '(?i)\b(?:vol(?:ume)?\.?\s*)\d+\b', '', 'g'), '\s+', ' ', 'g'))"""


@query(
    "infer_volume_number",
    f"WITH {STEMS} SELECT p_partkey, {_NUMBER.format(fallback='p_partkey')} AS volume_number FROM stems",
)
def infer_volume_number(spark, sf):
    return stems(spark, sf).select(
        "p_partkey", names.volume_number(F.col("stem"), F.col("p_partkey")).alias("volume_number")
    )


_TITLED = rf"""bare AS (SELECT *, {_BARE} AS bare FROM stems),
titled AS (SELECT p_partkey, stem,
  CASE WHEN regexp_matches(stem, '^\s*\[([^\]]+)\]\s*\[([^\]]+)\]') THEN regexp_extract(stem, '^\s*\[([^\]]+)\]\s*\[([^\]]+)\]', 1)
    WHEN regexp_matches(regexp_extract(bare, '^(.*\S)\s+(\S+)$', 1), '[,:]') THEN regexp_extract(bare, '^(.*\S)\s+(\S+)$', 1)
    WHEN bare = '' THEN stem ELSE bare END AS title,
  CASE WHEN regexp_matches(stem, '^\s*\[([^\]]+)\]\s*\[([^\]]+)\]') THEN regexp_extract(stem, '^\s*\[([^\]]+)\]\s*\[([^\]]+)\]', 2)
    WHEN regexp_matches(regexp_extract(bare, '^(.*\S)\s+(\S+)$', 1), '[,:]') THEN regexp_extract(bare, '^(.*\S)\s+(\S+)$', 2)
    ELSE '' END AS author FROM bare)"""


@query("stem_title_author", f"WITH {STEMS}, {_TITLED} SELECT p_partkey, title, author FROM titled")
def stem_title_author(spark, sf):
    title, author = names.series_title_author(F.col("stem"))
    return stems(spark, sf).select("p_partkey", title.alias("title"), author.alias("author"))


_FIRST = """firsts AS (SELECT p_brand AS series_id, arg_min(p_partkey, {key: list_transform(
    regexp_extract_all(stem, '[0-9]+|[^0-9]+'), lambda c: CASE WHEN regexp_matches(c, '^[0-9]')
      THEN '0' || lpad(len(coalesce(nullif(ltrim(c, '0'), ''), '0'))::VARCHAR, 10, '0')
        || coalesce(nullif(ltrim(c, '0'), ''), '0') ELSE '1' || lower(c) END),
    path: '/shelf/' || p_partkey || '/' || stem || '.cbz'}) AS p_partkey FROM stems GROUP BY 1)"""


def _files(spark, sf):
    path = F.concat(F.lit("/shelf/"), F.col("p_partkey").cast("string"), F.lit("/"), "stem", F.lit(".cbz"))
    return stems(spark, sf).select(F.col("p_brand").alias("series_id"), path.alias("path"))


@query("series_metadata", f"WITH {STEMS}, {_TITLED}, {_FIRST} SELECT series_id, title, author FROM firsts JOIN titled USING (p_partkey)")
def series_metadata(spark, sf):
    return series.series_metadata(_files(spark, sf))


@query(
    "build_series",
    f"""WITH {STEMS}, k AS (SELECT *, '/shelf/' || p_partkey || '/' || stem || '.cbz' AS path, list_transform(
      regexp_extract_all(stem, '[0-9]+|[^0-9]+'), lambda c: CASE WHEN regexp_matches(c, '^[0-9]')
      THEN '0' || lpad(len(coalesce(nullif(ltrim(c, '0'), ''), '0'))::VARCHAR, 10, '0')
        || coalesce(nullif(ltrim(c, '0'), ''), '0') ELSE '1' || lower(c) END) AS key FROM stems),
    o AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY key, path) AS position FROM k)
    SELECT p_brand AS series_id, path, position, {_NUMBER.format(fallback='position')} AS volume_number FROM o""",
)
def build_series(spark, sf):
    return series.build_series(_files(spark, sf))


@query(
    "titles_and_filenames",
    f"""WITH {STEMS}, t AS (SELECT p_partkey, stem, p_size, CASE WHEN p_partkey % 4 = 0 THEN 'A: "B"?  <' || stem || '>'
        END AS given, CASE WHEN p_partkey % 4 = 1 THEN p_brand END AS series_title FROM stems),
    c AS (SELECT *, CASE WHEN given IS NOT NULL THEN given WHEN series_title IS NOT NULL
        THEN series_title || ' Vol.' || printf('%02d', {_NUMBER.format(fallback='1')}) ELSE stem END AS title FROM t)
    SELECT p_partkey, title, CASE WHEN trim(regexp_replace(regexp_replace(title, '[\\\\/:*?"<>|]+', '_', 'g'), '\\s+', ' ', 'g'))
      = '' THEN 'Untitled' ELSE trim(regexp_replace(regexp_replace(title, '[\\\\/:*?"<>|]+', '_', 'g'), '\\s+', ' ', 'g')) END
      AS file_name FROM c""",
)
def titles_and_filenames(spark, sf):
    key = F.col("p_partkey") % 4
    given = F.when(key == 0, F.concat(F.lit('A: "B"?  <'), "stem", F.lit(">")))
    title = names.choose_title(given, F.when(key == 1, F.col("p_brand")), F.lit(None).cast("bigint"), F.col("stem"))
    rows = stems(spark, sf).select("p_partkey", title.alias("title"))
    return rows.withColumn("file_name", names.safe_filename(F.col("title")))


@query(
    "stable_book_id",
    """WITH h AS (SELECT page_id, url, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(url)) AS h FROM pages)
    SELECT page_id, 'urn:uuid:' || h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-'
      || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS book_id FROM h""",
)
def stable_book_id(spark, sf):
    return table(spark, sf, "pages").select("page_id", names.book_id(F.col("url")).alias("book_id"))


@query(
    "page_range",
    """WITH p AS (SELECT conv_id, turn + 1 AS page, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations),
    r AS (SELECT *, 1 + conv_id % 3 AS lo, CASE WHEN conv_id % 4 = 0 THEN n ELSE conv_id % 4 + 1 END AS hi FROM p)
    SELECT conv_id AS volume_id, page FROM r WHERE lo >= 1 AND hi <= n AND lo < hi AND page BETWEEN lo AND hi""",
)
def page_range(spark, sf):
    from leafwise.operators.ranges import page_range as ranged

    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("volume_id"), (F.col("turn") + 1).alias("page"))
    key = F.col("volume_id")
    wanted = pages.select("volume_id").distinct().select(
        "volume_id", (key % 3 + 1).alias("page_from"),
        F.when(key % 4 == 0, 0).otherwise(key % 4 + 1).alias("page_to"),
    )
    return ranged(pages, wanted)[0]


@query(
    "invalid_page_ranges",
    """WITH p AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1),
    r AS (SELECT *, 1 + conv_id % 3 AS lo, CASE WHEN conv_id % 4 = 0 THEN n ELSE conv_id % 4 + 1 END AS hi FROM p)
    SELECT conv_id AS volume_id, printf('invalid page range %d-%d; volume has %d pages', lo, hi, n) AS error FROM r
    WHERE NOT (lo >= 1 AND hi <= n AND lo < hi)""",
)
def invalid_page_ranges(spark, sf):
    from leafwise.operators.ranges import page_range as ranged

    pages = table(spark, sf, "conversations").select(F.col("conv_id").alias("volume_id"), (F.col("turn") + 1).alias("page"))
    key = F.col("volume_id")
    wanted = pages.select("volume_id").distinct().select(
        "volume_id", (key % 3 + 1).alias("page_from"),
        F.when(key % 4 == 0, 0).otherwise(key % 4 + 1).alias("page_to"),
    )
    return ranged(pages, wanted)[1]


# --- sources and paths ----------------------------------------------------------------------------

@query(
    "route_sources",
    """WITH f AS (SELECT p_partkey, p_name || CASE p_partkey % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.cbz' WHEN 2 THEN '.Zip'
        WHEN 3 THEN '.rar' ELSE '' END AS path FROM part)
    SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN 'archive' WHEN 2 THEN 'archive' END AS source_kind,
      CASE WHEN p_partkey % 5 >= 3 THEN 'Unsupported source file: ' || path END AS error FROM f""",
)
def route_sources(spark, sf):
    tails = F.array(*[F.lit(t) for t in (".PDF", ".cbz", ".Zip", ".rar", "")])
    path = F.concat("p_name", F.element_at(tails, (F.col("p_partkey") % 5 + 1).cast("int")))
    return table(spark, sf, "part").select(
        "p_partkey", names.source_kind(path).alias("source_kind"), names.source_error(path).alias("error")
    )


@query(
    "project_paths",
    """WITH f AS (SELECT p_partkey, '/lib/' || p_type || '/' || p_name || '/' || p_partkey || '.cbz' AS path,
      '/lib/' || CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_type || '/' || p_name ELSE 'books/new' END AS folder
      FROM part)
    SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN substr(path, len(folder) + 2) WHEN 1 THEN substr(path, len(folder) + 2)
        ELSE '../../' || substr(path, 6) END AS stored, path AS loaded FROM f""",
)
def project_paths(spark, sf):
    key = F.col("p_partkey") % 3
    path = F.concat(F.lit("/lib/./"), "p_type", F.lit("/x/../"), "p_name", F.lit("//"), F.col("p_partkey").cast("string"), F.lit(".cbz"))
    folder = F.when(key == 0, F.col("p_type")).when(key == 1, F.concat("p_type", F.lit("/"), "p_name")).otherwise("books/new")
    rows = table(spark, sf, "part").select(
        "p_partkey", path.alias("path"), F.concat(F.lit("/lib/"), folder, F.lit("/series.json")).alias("project")
    )
    rows = rows.withColumn("stored", paths.stored_path(F.col("path"), F.col("project")))
    return rows.select("p_partkey", "stored", paths.loaded_path(F.col("stored"), F.col("project")).alias("loaded"))


# --- series validation and export -----------------------------------------------------------------

# One series per customer, one volume per order.
VOLUMES = """volumes AS (SELECT o_custkey AS series_id, o_orderkey AS volume_id, 'Tales: ' || o_custkey AS title,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS position,
    1 + o_orderkey % 12 AS volume_number, '/shelf/' || o_orderkey || '.cbz' AS path,
    CASE o_orderstatus WHEN 'O' THEN 'Ready' WHEN 'F' THEN 'Edited' ELSE 'Unreviewed' END AS status,
    o_orderkey % 13 <> 0 AS source_exists, CASE WHEN o_orderkey % 17 = 0 THEN 0 ELSE o_orderkey % 4 + 1 END AS image_count,
    o_orderkey % 2 = 0 AS saved_layout, o_orderkey % 5 = 0 AS exclude_cover,
    CASE WHEN o_orderkey % 19 = 0 THEN '/art/' || o_orderkey || '.png' END AS missing_image
  FROM orders)"""


def volumes(spark, sf):
    from leafwise.operators.ordered import ranked

    key = F.col("o_orderkey")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus")
    placed = ranked(orders, ["o_custkey"], ["o_orderdate", "o_orderkey"], "position")
    return placed.select(
        F.col("o_custkey").alias("series_id"),
        key.alias("volume_id"),
        F.concat(F.lit("Tales: "), F.col("o_custkey").cast("string")).alias("title"),
        "position",
        (key % 12 + 1).alias("volume_number"),
        F.concat(F.lit("/shelf/"), key.cast("string"), F.lit(".cbz")).alias("path"),
        F.when(F.col("o_orderstatus") == "O", "Ready")
        .when(F.col("o_orderstatus") == "F", "Edited")
        .otherwise("Unreviewed")
        .alias("status"),
        (key % 13 != 0).alias("source_exists"),
        F.when(key % 17 == 0, 0).otherwise(key % 4 + 1).alias("image_count"),
        (key % 2 == 0).alias("saved_layout"),
        (key % 5 == 0).alias("exclude_cover"),
        F.when(key % 19 == 0, F.concat(F.lit("/art/"), key.cast("string"), F.lit(".png"))).alias("missing_image"),
    )


def _validated_sql(ready_only: bool) -> str:
    only = "status = 'Ready'" if ready_only else "true"
    return f"""{VOLUMES},
scope AS (SELECT *, 'Tales_ ' || series_id || ' Vol.' || printf('%02d', volume_number) || '.epub' AS output_name
  FROM volumes WHERE {only}),
base AS (SELECT series_id, arg_min(image_count, position) FILTER (source_exists AND missing_image IS NULL) AS baseline
  FROM scope GROUP BY 1),
flags AS (SELECT s.*, baseline, count(*) OVER (PARTITION BY s.series_id, output_name) > 1 AS collides,
    count(*) OVER (PARTITION BY s.series_id, volume_number) > 1 AS repeats FROM scope s LEFT JOIN base USING (series_id)),
checked AS (SELECT *, concat_ws(' / ',
    CASE WHEN collides THEN 'Output filename collision: ' || output_name END,
    CASE WHEN repeats THEN 'Duplicate volume number: ' || volume_number END,
    CASE WHEN source_exists AND missing_image IS NOT NULL THEN 'Missing inserted image: ' || missing_image END,
    CASE WHEN source_exists AND missing_image IS NULL AND image_count > 0 AND saved_layout AND image_count <> baseline
      THEN printf('Applied layout image count differs from baseline: %d != %d', image_count, baseline) END) AS warnings,
    CASE WHEN NOT source_exists THEN 'Source file not found: ' || path
      WHEN missing_image IS NOT NULL THEN 'Inserted image not found: ' || missing_image
      WHEN image_count = 0 THEN 'Cannot export an EPUB without image pages'
      WHEN exclude_cover AND image_count <= 1 THEN 'Cover-only export would leave no reading pages'
      WHEN collides THEN 'Output filename collision: ' || output_name END AS error FROM flags),
validated AS (SELECT * EXCLUDE (status), CASE WHEN error IS NOT NULL THEN 'Failed' ELSE status END AS status FROM checked)"""


@query(
    "validate_volumes",
    f"WITH {_validated_sql(False)} SELECT series_id, volume_id, output_name, status, warnings, error FROM validated",
)
def validate_volumes(spark, sf):
    return series.validate_volumes(volumes(spark, sf)).select(
        "series_id", "volume_id", "output_name", "status", F.array_join("warnings", " / ").alias("warnings"), "error"
    )


@query(
    "validate_ready_volumes",
    f"WITH {_validated_sql(True)} SELECT series_id, volume_id, output_name, status, warnings, error FROM validated",
)
def validate_ready_volumes(spark, sf):
    return series.validate_volumes(volumes(spark, sf), True).select(
        "series_id", "volume_id", "output_name", "status", F.array_join("warnings", " / ").alias("warnings"), "error"
    )


@query("baseline_page_count", f"WITH {_validated_sql(False)} SELECT series_id, baseline FROM base")
def baseline_page_count(spark, sf):
    return series.baseline_page_count(volumes(spark, sf))


@query(
    "validation_summary",
    f"""WITH {_validated_sql(False)} SELECT series_id, count(*) FILTER (status <> 'Failed') AS ready,
      count(*) FILTER (status = 'Failed') AS failed, count(*) FILTER (warnings <> '') AS warnings FROM validated GROUP BY 1""",
)
def validation_summary(spark, sf):
    return series.validation_summary(series.validate_volumes(volumes(spark, sf)))


_SCOPES = """scopes AS (SELECT c_custkey AS series_id, CASE c_custkey % 6 WHEN 0 THEN ' ALL ' WHEN 1 THEN '1, 3,7'
    WHEN 2 THEN '2-5' WHEN 3 THEN '' WHEN 4 THEN '1,x' ELSE '9-12, 1 ,3 - 4' END AS scope FROM customer)"""


def _scopes(spark, sf):
    texts = F.array(*[F.lit(t) for t in (" ALL ", "1, 3,7", "2-5", "", "1,x", "9-12, 1 ,3 - 4")])
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("series_id"), F.element_at(texts, (F.col("c_custkey") % 6 + 1).cast("int")).alias("scope")
    )


@query(
    "volumes_in_scope",
    f"""WITH {VOLUMES} SELECT series_id, volume_id, volume_number FROM volumes
    WHERE CASE series_id % 6 WHEN 0 THEN true WHEN 1 THEN volume_number IN (1, 3, 7)
      WHEN 2 THEN volume_number BETWEEN 2 AND 5 WHEN 3 THEN false WHEN 4 THEN false
      ELSE volume_number IN (9, 10, 11, 12, 1, 3, 4) END""",
)
def volumes_in_scope(spark, sf):
    chosen = series.volumes_in_scope(volumes(spark, sf), _scopes(spark, sf))
    return chosen.select("series_id", "volume_id", "volume_number")


@query(
    "scope_errors",
    f"WITH {_SCOPES} SELECT series_id, 'Invalid volume scope: x' AS error FROM scopes WHERE series_id % 6 = 4",
)
def scope_errors(spark, sf):
    return series.scope_tokens(_scopes(spark, sf)).where(F.col("error").isNotNull()).select("series_id", "error")


_EXISTING = "existing AS (SELECT DISTINCT output_name FROM validated WHERE volume_id % 7 = 0)"


def _existing(validated):
    return validated.where(F.col("volume_id") % 7 == 0).select("output_name")


@query(
    "export_plan",
    f"""WITH {_validated_sql(False)}, {_EXISTING} SELECT series_id, volume_id, volume_number, output_name,
      CASE WHEN status = 'Failed' OR (status = 'Ready' AND output_name IN (SELECT output_name FROM existing)) THEN 'failed'
        WHEN status = 'Ready' THEN 'started' ELSE 'skipped' END AS event,
      CASE WHEN status = 'Ready' AND output_name IN (SELECT output_name FROM existing)
        THEN 'Refusing to overwrite existing file: ' || output_name END AS error FROM validated""",
)
def export_plan(spark, sf):
    validated = series.validate_volumes(volumes(spark, sf))
    return series.export_plan(validated, _existing(validated))


_EVENTS = """SELECT user_id AS series_id, CASE event_type WHEN 'purchase' THEN 'exported' WHEN 'error' THEN 'failed'
    WHEN 'view' THEN 'skipped' ELSE 'started' END AS event, event_id % 3 = 0 AS was_failed, value > 20 AS warned FROM events"""


def export_events(spark, sf):
    kind = F.col("event_type")
    event = F.when(kind == "purchase", "exported").when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("started")
    return table(spark, sf, "events").select(
        F.col("user_id").alias("series_id"), event.alias("event"), (F.col("event_id") % 3 == 0).alias("was_failed"),
        (F.col("value") > 20).alias("warned"),
    )


@query(
    "export_summary",
    f"""SELECT series_id, count(*) FILTER (event = 'exported') AS exported,
      count(*) FILTER (event = 'failed' AND NOT was_failed) AS failed, count(*) FILTER (event = 'skipped') AS skipped,
      count(*) FILTER (warned) AS warnings FROM ({_EVENTS}) GROUP BY 1""",
)
def export_summary(spark, sf):
    return series.export_summary(export_events(spark, sf))


@query(
    "preflight_report",
    f"""WITH {_validated_sql(False)}, {_EXISTING}, lines AS (
      SELECT series_id, 'warning' AS kind, position, nth, printf('Vol.%02d: ', volume_number) || w AS line FROM (
        SELECT *, unnest(string_split(warnings, ' / ')) AS w, generate_subscripts(string_split(warnings, ' / '), 1) AS nth
        FROM validated WHERE warnings <> '')
      UNION ALL SELECT series_id, 'existing_output', position, 0, printf('Vol.%02d: ', volume_number)
        || 'output exists and will not be overwritten: ' || output_name
      FROM validated WHERE status = 'Ready' AND output_name IN (SELECT output_name FROM existing))
    SELECT series_id, kind, line_number::INTEGER AS line_number, line FROM (SELECT *, row_number() OVER (PARTITION BY series_id, kind
      ORDER BY position, nth) AS line_number FROM lines) WHERE line_number <= 20""",
)
def preflight_report(spark, sf):
    validated = series.validate_volumes(volumes(spark, sf))
    return series.preflight_report(validated, _existing(validated))


# Ready marks and their undo history from the event stream.
_HISTORY = f"""{VOLUMES}, tagged AS (SELECT series_id, volume_id, position, status FROM volumes),
history AS (SELECT t.series_id, t.volume_id, event_id AS batch_seq,
    CASE WHEN event_id % 2 = 0 THEN 'Edited' ELSE 'Unreviewed' END AS previous_status
  FROM tagged t JOIN events e ON e.user_id = t.series_id AND e.event_id % 9 = t.position % 9)"""


def _history(spark, sf):
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("series_id"), F.col("event_id").alias("batch_seq"), (F.col("event_id") % 9).alias("_slot")
    )
    rows = volumes(spark, sf).select("series_id", "volume_id", (F.col("position") % 9).alias("_slot"))
    previous = F.when(F.col("batch_seq") % 2 == 0, "Edited").otherwise("Unreviewed")
    return rows.join(events, ["series_id", "_slot"]).select(
        "series_id", "volume_id", "batch_seq", previous.alias("previous_status")
    )


@query(
    "mark_ready",
    f"""WITH {_HISTORY} SELECT t.series_id, t.volume_id, CASE WHEN h.volume_id IS NULL THEN status ELSE 'Ready' END AS status
    FROM tagged t LEFT JOIN (SELECT DISTINCT series_id, volume_id FROM history) h USING (series_id, volume_id)""",
)
def mark_ready(spark, sf):
    rows = volumes(spark, sf).withColumn("error", F.lit(None).cast("string"))
    return series.mark_ready(rows, _history(spark, sf))[0].select("series_id", "volume_id", "status")


@query(
    "unready_selected",
    f"""WITH {_HISTORY}, b AS (SELECT series_id, volume_id, arg_max(previous_status, batch_seq) AS back FROM history
      WHERE volume_id % 2 = 0 GROUP BY 1, 2)
    SELECT t.series_id, t.volume_id, coalesce(back, status) AS status FROM tagged t LEFT JOIN b USING (series_id, volume_id)""",
)
def unready_selected(spark, sf):
    rows = volumes(spark, sf).withColumn("error", F.lit(None).cast("string"))
    selected = rows.where(F.col("volume_id") % 2 == 0)
    return series.unready(rows, _history(spark, sf), selected).select("series_id", "volume_id", "status")


@query(
    "unready_last_batch",
    f"""WITH {_HISTORY}, l AS (SELECT series_id, max(batch_seq) AS batch_seq FROM history GROUP BY 1),
    b AS (SELECT h.series_id, h.volume_id, arg_max(previous_status, batch_seq) AS back
      FROM history h JOIN l USING (series_id, batch_seq) GROUP BY 1, 2)
    SELECT t.series_id, t.volume_id, coalesce(back, status) AS status FROM tagged t LEFT JOIN b USING (series_id, volume_id)""",
)
def unready_last_batch(spark, sf):
    rows = volumes(spark, sf).withColumn("error", F.lit(None).cast("string"))
    return series.unready(rows, _history(spark, sf)).select("series_id", "volume_id", "status")


@query(
    "status_summary",
    f"""WITH {_validated_sql(False)} SELECT series_id, count(*) AS volumes, count(*) FILTER (status = 'Ready') AS ready,
      count(*) FILTER (status = 'Edited') AS edited, count(*) FILTER (status = 'Failed') AS failed FROM validated GROUP BY 1""",
)
def status_summary(spark, sf):
    return series.status_summary(series.validate_volumes(volumes(spark, sf)))


@query(
    "template_batch_check",
    f"""WITH {VOLUMES}, i AS (SELECT series_id, position, volume_number || '.epub' AS output_name,
        CASE WHEN volume_id % 11 <> 0 THEN image_count END AS n FROM volumes),
    w AS (SELECT *, concat_ws(' / ', CASE WHEN row_number() OVER (PARTITION BY series_id, output_name ORDER BY position) > 1
        THEN 'Output filename collision: ' || output_name END,
        CASE WHEN n <> 3 THEN printf('Page count differs: expected 3, got %d', n) END) AS warnings FROM i)
    SELECT series_id, position, output_name, warnings,
      CASE WHEN n IS NULL THEN 'Failed' WHEN warnings <> '' THEN 'Warning' ELSE 'Ready' END AS status FROM w""",
)
def template_batch_check(spark, sf):
    items = volumes(spark, sf).select(
        "series_id", "position",
        F.concat(F.lit("/in/"), F.col("volume_number").cast("string"), F.lit(".pdf")).alias("path"),
        F.when(F.col("volume_id") % 11 != 0, F.col("image_count")).alias("page_count"),
    )
    return series.template_batch_check(items, F.lit(3)).select(
        "series_id", "position", "output_name", F.array_join("warnings", " / ").alias("warnings"), "status"
    )
