"""Queries for package integrity."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.operators import package
from leafwise.operators import spine as spine_ops
from leafwise.plans.inputs import ORDER_SPINE_SQL, order_spine, stored_spine, table
from leafwise.plans.registry import query
from leafwise.plans.spines import _META, _NORMAL, _covers, _spine
from leafwise.session import durable

# One book per order: the entries, manifest and references of its lines, with faults mixed in.
BOOKS = f"""{ORDER_SPINE_SQL},
entries AS (
  SELECT volume_id AS book_id, entry_index + 1 AS ordinal, 'EPUB/images/p' || (supp % 6) || '.jpg' AS name,
    8 AS compress_type, NULL AS content FROM order_spine
  UNION ALL SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 THEN 99 ELSE 0 END, 'mimetype', CASE WHEN o_custkey % 13 = 0 THEN 8
    ELSE 0 END, CASE WHEN o_custkey % 17 = 0 THEN 'text/plain' ELSE 'application/epub+zip' END FROM orders
    WHERE o_custkey % 23 <> 0
  UNION ALL SELECT o_orderkey, 100, 'META-INF/container.xml', 8, NULL FROM orders WHERE o_custkey % 19 <> 0
  UNION ALL SELECT o_orderkey, 101, 'EPUB/content.opf', 8, NULL FROM orders
  UNION ALL SELECT o_orderkey, 102, 'EPUB/nav.xhtml', 8, NULL FROM orders),
manifest AS (
  SELECT volume_id AS book_id, 'i' || entry_index AS item_id, CASE WHEN part % 4 = 0 THEN './x/../images/p' ELSE 'images/p' END
      || (part % 6) || CASE WHEN part % 5 = 0 THEN '.png' ELSE '.jpg' END AS href,
    CASE WHEN quantity % 6 = 0 THEN 'application/xhtml+xml' WHEN quantity % 6 = 1 THEN 'image/png' ELSE 'image/jpeg' END
      AS media_type,
    CASE WHEN entry_index = 0 THEN 'x cover-image' WHEN part % 40 = 0 THEN 'cover-image' END AS properties FROM order_spine
  UNION ALL SELECT o_orderkey, 'nav', CASE WHEN o_custkey % 7 = 0 THEN 'toc.xhtml' ELSE 'nav.xhtml' END,
    'application/xhtml+xml', 'nav' FROM orders WHERE o_custkey % 5 <> 0),
resolved AS (SELECT *, 'EPUB/' || replace(href, './x/../', '') AS archive_path FROM manifest),
spine_refs AS (SELECT volume_id AS book_id, 'i' || CASE WHEN part % 9 = 0 THEN entry_index + 50 ELSE entry_index END AS idref
  FROM order_spine),
page_refs AS (SELECT DISTINCT volume_id AS book_id, 'i' || entry_index AS item_id,
    'EPUB/images/p' || (supp % 7) || '.jpg' AS path FROM order_spine)"""


def entries(spark, sf, spine):
    image = spine.select(
        F.col("volume_id").alias("book_id"),
        (F.col("entry_index") + 1).alias("ordinal"),
        F.concat(F.lit("EPUB/images/p"), (F.col("supp") % 6).cast("string"), F.lit(".jpg")).alias("name"),
        F.lit(8).alias("compress_type"),
        F.lit(None).cast("string").alias("content"),
    )
    cust = F.col("o_custkey")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("book_id"), "o_custkey")

    def one(ordinal, name, compress=None, content=None):
        return F.struct(
            F.lit(ordinal).cast("bigint").alias("ordinal") if isinstance(ordinal, int) else ordinal.cast("bigint").alias("ordinal"),
            F.lit(name).alias("name"),
            (F.lit(8) if compress is None else compress).alias("compress_type"),
            (F.lit(None).cast("string") if content is None else content).alias("content"),
        )

    mime = one(
        F.when(cust % 11 == 0, 99).otherwise(0),
        "mimetype",
        F.when(cust % 13 == 0, 8).otherwise(0),
        F.when(cust % 17 == 0, "text/plain").otherwise("application/epub+zip"),
    )
    files = F.array(
        F.when(cust % 23 != 0, mime),
        F.when(cust % 19 != 0, one(100, "META-INF/container.xml")),
        one(101, "EPUB/content.opf"),
        one(102, "EPUB/nav.xhtml"),
    )
    found = orders.select("book_id", F.explode(files).alias("file")).where(F.col("file").isNotNull())
    return image.unionByName(found.select("book_id", "file.*"))


def manifest(spark, sf, spine):
    part, quantity = F.col("part"), F.col("quantity")
    href = F.concat(
        F.when(part % 4 == 0, "./x/../images/p").otherwise("images/p"),
        (part % 6).cast("string"),
        F.when(part % 5 == 0, ".png").otherwise(".jpg"),
    )
    kind = F.when(quantity % 6 == 0, package.XHTML).when(quantity % 6 == 1, "image/png").otherwise("image/jpeg")
    cover = F.when(F.col("entry_index") == 0, "x cover-image").when(part % 40 == 0, "cover-image")
    items = spine.select(
        F.col("volume_id").alias("book_id"),
        F.concat(F.lit("i"), F.col("entry_index").cast("string")).alias("item_id"),
        href.alias("href"),
        kind.alias("media_type"),
        cover.alias("properties"),
    )
    nav = table(spark, sf, "orders").where(F.col("o_custkey") % 5 != 0).select(
        F.col("o_orderkey").alias("book_id"),
        F.lit("nav").alias("item_id"),
        F.when(F.col("o_custkey") % 7 == 0, "toc.xhtml").otherwise("nav.xhtml").alias("href"),
        F.lit(package.XHTML).alias("media_type"),
        F.lit("nav").alias("properties"),
    )
    return items.unionByName(nav)


def spine_refs(spine):
    at = F.col("entry_index") + F.when(F.col("part") % 9 == 0, 50).otherwise(0)
    return spine.select(
        F.col("volume_id").alias("book_id"), F.concat(F.lit("i"), at.cast("string")).alias("idref")
    )


def page_refs(spine):
    return spine.select(
        F.col("volume_id").alias("book_id"),
        F.concat(F.lit("i"), F.col("entry_index").cast("string")).alias("item_id"),
        F.concat(F.lit("EPUB/images/p"), (F.col("supp") % 7).cast("string"), F.lit(".jpg")).alias("path"),
    ).distinct()


def _tables(spark, sf, spine):
    return entries(spark, sf, spine), manifest(spark, sf, spine), spine_refs(spine), page_refs(spine)


_CHECKS = {
    "duplicate_entries": """SELECT book_id, 'duplicate_entry' AS rule, 'Duplicate EPUB zip entry: ' || name AS detail
      FROM entries GROUP BY book_id, name HAVING count(*) > 1""",
    "container_files": """SELECT book_id, 'container' AS rule, detail FROM (
        SELECT book_id, arg_min(name, ordinal) AS f, any_value(compress_type) FILTER (name = 'mimetype') AS z,
          any_value(content) FILTER (name = 'mimetype') AS c, count(*) FILTER (name = 'META-INF/container.xml') AS x
        FROM entries GROUP BY 1), LATERAL (
        SELECT 'EPUB mimetype must be the first zip entry' AS detail WHERE f <> 'mimetype'
        UNION ALL SELECT 'EPUB mimetype must be stored without compression' WHERE z <> 0
        UNION ALL SELECT 'EPUB mimetype has invalid content' WHERE c <> 'application/epub+zip'
        UNION ALL SELECT 'Required EPUB file missing: META-INF/container.xml' WHERE x = 0)""",
    "missing_hrefs": """SELECT book_id, 'missing_href' AS rule, 'Manifest href missing from EPUB: ' || archive_path AS detail
      FROM resolved r WHERE NOT EXISTS (SELECT 1 FROM entries e WHERE e.book_id = r.book_id AND e.name = archive_path)""",
    "navigation": """SELECT book_id, 'navigation' AS rule, 'EPUB nav item must reference EPUB/nav.xhtml' AS detail
      FROM resolved WHERE properties = 'nav' AND archive_path <> 'EPUB/nav.xhtml'
      UNION ALL SELECT book_id, 'navigation', 'EPUB nav item missing' FROM resolved GROUP BY book_id
        HAVING count(*) FILTER (properties = 'nav') <> 1""",
    "unknown_idrefs": """SELECT book_id, 'unknown_idref' AS rule, 'Spine itemref ' || idref || ' has no manifest item' AS detail
      FROM spine_refs s WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE m.book_id = s.book_id AND m.item_id = s.idref)""",
    "page_images": """SELECT p.book_id, 'page_image' AS rule, CASE WHEN k.image IS NULL
        THEN 'Reading page image missing from manifest: ' ELSE 'Reading page image is not an image manifest item: ' END
        || p.path AS detail
      FROM page_refs p LEFT JOIN (SELECT book_id, archive_path, bool_or(media_type LIKE 'image/%') AS image FROM resolved
        GROUP BY 1, 2) k ON k.book_id = p.book_id AND k.archive_path = p.path
      WHERE coalesce(k.image, false) = false
        AND EXISTS (SELECT 1 FROM manifest m WHERE m.book_id = p.book_id AND m.item_id = p.item_id
          AND m.media_type = 'application/xhtml+xml')
        AND EXISTS (SELECT 1 FROM spine_refs s WHERE s.book_id = p.book_id AND s.idref = p.item_id)""",
    "cover_items": """SELECT book_id, 'cover' AS rule, 'EPUB must have exactly one cover image' AS detail FROM resolved
      GROUP BY book_id HAVING count(*) FILTER (properties LIKE '%cover-image') <> 1
      UNION ALL SELECT book_id, 'cover', 'Cover item ' || item_id || ' is not an image' FROM resolved
      WHERE properties LIKE '%cover-image' AND media_type NOT LIKE 'image/%'""",
    "media_types": """SELECT book_id, 'media_type' AS rule, 'Image media type mismatch for ' || archive_path || ': '
        || media_type || ' != ' || CASE WHEN archive_path LIKE '%.png' THEN 'image/png' ELSE 'image/jpeg' END AS detail
      FROM resolved WHERE media_type LIKE 'image/%'
        AND media_type <> CASE WHEN archive_path LIKE '%.png' THEN 'image/png' ELSE 'image/jpeg' END""",
}


def _check(name, entry_rows, manifest_rows, refs, images):
    if name == "duplicate_entries":
        return package.duplicate_entries(entry_rows)
    if name == "container_files":
        return package.container_files(entry_rows)
    if name == "missing_hrefs":
        return package.missing_hrefs(manifest_rows, entry_rows)
    if name == "unknown_idrefs":
        return package.unknown_idrefs(refs, manifest_rows)
    if name == "page_images":
        return package.page_images(images, refs, manifest_rows)
    if name in ("navigation", "cover_items"):
        # These two queries ask about the books of the manifest rows; package_all_books about all.
        return getattr(package, name)(manifest_rows, manifest_rows.select("book_id"))
    return getattr(package, name)(manifest_rows)


def _register(name):
    @query(f"package_{name}", f"WITH {BOOKS} {_CHECKS[name]}")
    def run(spark, sf):
        return _check(name, *_tables(spark, sf, order_spine(spark, sf)))


for _name in _CHECKS:
    _register(_name)


_BARE = "SELECT book_id FROM entries EXCEPT SELECT book_id FROM resolved"


@query(
    "package_all_books",
    f"""WITH {BOOKS}, bare AS ({_BARE}), v AS ({_CHECKS["navigation"]} UNION ALL {_CHECKS["cover_items"]}
      UNION ALL SELECT book_id, 'navigation', 'EPUB nav item missing' FROM bare
      UNION ALL SELECT book_id, 'cover', 'EPUB must have exactly one cover image' FROM bare)
    SELECT book_id, rule, detail FROM v""",
)
def package_all_books(spark, sf):
    """Navigation and cover of every book that has a file, also of books without any manifest row."""
    entry_rows, items, _, _ = _tables(spark, sf, stored_spine(spark, sf))
    books = entry_rows.select("book_id").unionByName(items.select("book_id"))
    return package.navigation(items, books).unionByName(package.cover_items(items, books))


@query(
    "package_violations",
    f"WITH {BOOKS}, v AS ({' UNION ALL '.join(_CHECKS.values())}) SELECT rule, count(*) AS violations FROM v GROUP BY 1",
)
def package_violations(spark, sf):
    # Both tables are read by several checks: stored once, with the columns that the books derive from.
    spine = durable(order_spine(spark, sf).select("volume_id", "entry_index", "part", "supp", "quantity"))
    entry_rows, items, refs, images = _tables(spark, sf, spine)
    items = durable(package.resolve_manifest(items).drop("href"))
    found = package.all_violations([_check(name, entry_rows, items, refs, images) for name in _CHECKS])
    return found.groupBy("rule").agg(F.count(F.lit(1)).alias("violations"))


@query(
    "package_page_languages",
    """SELECT doc_id % 20 AS book_id, 'language' AS rule, 'XHTML language mismatch for d' || doc_id AS detail FROM documents
    WHERE (doc_id % 20) % 4 <> 3 AND (lang <> (['en', 'de', 'fr'])[(doc_id % 20) % 4 + 1]
      OR doc_id % 3 = 0)""",
)
def package_page_languages(spark, sf):
    book = F.col("doc_id") % 20
    docs = table(spark, sf, "documents").select(
        book.alias("book_id"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"),
        "lang",
        F.when(F.col("doc_id") % 3 != 0, F.col("lang")).alias("xml_lang"),
    )
    wanted = F.element_at(F.array(*[F.lit(x) for x in ("en", "de", " fr ", "")]), (F.col("book_id") % 4 + 1).cast("int"))
    books = docs.select("book_id").distinct().withColumn("language", wanted)
    return package.page_languages(docs, books)


@query(
    "extract_refs",
    """WITH p AS (SELECT page_id, regexp_replace(split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]+', ''), '?', 1), '#', 1),
        '/[^/]*$', '') AS folder, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS ref FROM pages)
    SELECT DISTINCT page_id AS book_id, 'p' || page_id AS item_id, CASE WHEN starts_with(ref, '/')
        THEN '/' || trim(regexp_replace(ref, '/+', '/', 'g'), '/') ELSE folder || '/' || ref END AS path
    FROM p WHERE ref <> '' AND NOT contains(split_part(ref, '/', 1), ':')""",
)
def extract_refs(spark, sf):
    return package.extract_refs(_page_texts(spark, sf), 'href="([^"]*)"')


@query(
    "extract_image_refs",
    """WITH p AS (SELECT page_id, regexp_replace(split_part(split_part(regexp_replace(url, '^[a-z]+://[^/]+', ''), '?', 1), '#', 1),
        '/[^/]*$', '') AS folder, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS ref FROM pages)
    SELECT DISTINCT page_id AS book_id, 'p' || page_id AS item_id, CASE WHEN starts_with(ref, '/')
        THEN '/' || trim(regexp_replace(ref, '/+', '/', 'g'), '/') ELSE folder || '/' || ref END AS path
    FROM p WHERE ref <> '' AND NOT contains(split_part(ref, '/', 1), ':') AND page_id % 3 <> 2""",
)
def extract_image_refs(spark, sf):
    """Links turned into images: of every three pages one has them with a prefix, one plainly, and one keeps its links."""
    turned = F.when(F.col("book_id") % 3 == 0, F.replace("text", F.lit("<a href="), F.lit("<svg:image width='1' xlink:href = "))).otherwise(
        F.when(F.col("book_id") % 3 == 1, F.replace("text", F.lit("<a href="), F.lit("<image\nhref="))).otherwise(F.col("text"))
    )
    return package.extract_refs(_page_texts(spark, sf).withColumn("text", turned), package.IMAGE_REF)


def _page_texts(spark, sf):
    path = F.regexp_replace("url", r"^[a-z]+://[^/]+", "")
    path = F.split_part(F.split_part(path, F.lit("?"), F.lit(1)), F.lit("#"), F.lit(1))
    return table(spark, sf, "pages").select(
        F.col("page_id").alias("book_id"),
        F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("item_id"),
        path.alias("page_path"),
        F.col("html").alias("text"),
    )


_READ = f"""{ORDER_SPINE_SQL}, {_NORMAL}, {_META},
books AS (SELECT n.*, coalesce(NOT (exclude_cover AND page_index - 1 = cover_entry_index), true) AS is_read,
    page_index - 1 = cover_entry_index AS is_cover
  FROM normal_spine n LEFT JOIN covers USING (volume_id))"""


def _books(spark, sf):
    covers = _covers(spark, sf).select("volume_id", "cover_entry_index", "exclude_cover")
    pages = spine_ops.normalize_spine(_spine(spark, sf)).join(covers, "volume_id", "left")
    cover = F.col("page_index") - 1 == F.col("cover_entry_index")
    pages = durable(pages.withColumn("is_read", F.coalesce(~(F.col("exclude_cover") & cover), F.lit(True))))
    ids = pages.where(cover).select("volume_id", F.col("item_id").alias("cover_id"))
    return pages, ids


@query(
    "manifest_rows",
    f"""WITH {_READ} SELECT volume_id AS book_id, 'img-' || printf('%04d', page_index) AS item_id, image_href AS href,
      CASE WHEN ext = 'jpg' THEN 'image/jpeg' ELSE 'image/png' END AS media_type, CASE WHEN is_cover THEN 'cover-image' END
      AS properties FROM books WHERE kind <> 'blank'
    UNION ALL SELECT volume_id, item_id, page_href, 'application/xhtml+xml', CASE WHEN kind <> 'blank' THEN 'svg' END
      FROM books WHERE is_read
    UNION ALL SELECT DISTINCT volume_id, 'nav', 'nav.xhtml', 'application/xhtml+xml', 'nav' FROM books
    UNION ALL SELECT DISTINCT volume_id, 'css-page', 'styles/page.css', 'text/css', NULL FROM books""",
)
def manifest_rows(spark, sf):
    return package.manifest_rows(*_books(spark, sf))


@query(
    "spine_rows",
    f"""WITH {_READ} SELECT volume_id AS book_id, page_index, item_id AS idref,
      CASE WHEN kind <> 'blank' AND page_index = 1 THEN 'rendition:page-spread-right'
        WHEN kind <> 'blank' AND page_index = 2 THEN 'rendition:page-spread-left' END AS properties
    FROM books WHERE is_read""",
)
def spine_rows(spark, sf):
    pages, _ = _books(spark, sf)
    side = spine_ops.spread_property(F.col("page_index"), F.col("kind") == "blank", False, True)
    return package.spine_rows(pages, side)
