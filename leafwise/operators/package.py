"""Package integrity over entry, manifest, spine and page-reference tables.

Every check returns violations (book_id, rule, detail). All of them are reported, not only the
first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.functions.frames import settle
from leafwise.functions.names import extension, padded4
from leafwise.functions.paths import directory, folded_path, join_path, shortened_path

# Names, types and texts a package must use.
MIMETYPE_NAME = "mimetype"
MIMETYPE_CONTENT = "application/epub+zip"
REQUIRED_FILES = ("META-INF/container.xml", "EPUB/content.opf")
PACKAGE_FOLDER = "EPUB"
NAV_PATH = "EPUB/nav.xhtml"
XHTML = "application/xhtml+xml"
IMAGE_TYPES = {
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "png": "image/png",
    "gif": "image/gif",
    "svg": "image/svg+xml",
    "webp": "image/webp",
    "bmp": "image/bmp",
    "tif": "image/tiff",
    "tiff": "image/tiff",
}


def _found(rows: DataFrame, rule: str, detail: Column) -> DataFrame:
    return rows.select("book_id", F.lit(rule).alias("rule"), detail.alias("detail"))


def has_property(name: str) -> Column:
    text = F.coalesce("properties", F.lit(""))
    # Only a text that holds the name anywhere is split.
    return text.contains(name) & F.array_contains(F.split(text, r"\s+"), name)


def resolve_manifest(manifest: DataFrame) -> DataFrame:
    """Usable items with ``archive_path``; items without an id or href are skipped.

    Several checks read the result: store it once and pass it in place of the manifest.
    """
    if "archive_path" in manifest.columns:
        return manifest
    usable = (F.coalesce("item_id", F.lit("")) != "") & (F.coalesce("href", F.lit("")) != "")
    path = shortened_path(F.concat(F.lit(f"{PACKAGE_FOLDER}/"), F.col("href")))
    return settle(manifest.where(usable), {"archive_path": path}).withColumn("archive_path", folded_path(F.col("archive_path")))


def duplicate_entries(entries: DataFrame) -> DataFrame:
    twice = entries.groupBy("book_id", "name").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)
    return _found(twice, "duplicate_entry", F.concat(F.lit("Duplicate EPUB zip entry: "), "name"))


def container_files(entries: DataFrame) -> DataFrame:
    """mimetype first, stored and exact; required files present.

    ``entries(book_id, ordinal, name, compress_type, content)``; compress_type 0 means stored and
    content only matters for the mimetype entry.
    """
    mime = F.col("name") == MIMETYPE_NAME
    # Values of fixed width, no strings: Spark then aggregates by hash and need not sort the entries.
    state = entries.groupBy("book_id").agg(
        F.min_by(mime, "ordinal").alias("_first"),
        F.max_by("compress_type", F.when(mime, F.col("ordinal"))).alias("_compress"),
        F.max_by(F.col("content") == MIMETYPE_CONTENT, F.when(mime, F.col("ordinal"))).alias("_content"),
        F.count_if(mime).alias("_mime"),
        *[F.count_if(F.col("name") == name).alias(f"_file{i}") for i, name in enumerate(REQUIRED_FILES)],
    )
    there = F.col("_mime") > 0
    problems = F.array(
        F.when(~F.col("_first"), "EPUB mimetype must be the first zip entry"),
        F.when(there & (F.col("_compress") != 0), "EPUB mimetype must be stored without compression"),
        F.when(there & ~F.col("_content"), "EPUB mimetype has invalid content"),
        *[
            F.when(F.col(f"_file{i}") == 0, f"Required EPUB file missing: {name}")
            for i, name in enumerate(REQUIRED_FILES)
        ],
    )
    found = state.select("book_id", F.lit("container").alias("rule"), F.explode(problems).alias("detail"))
    return found.where(F.col("detail").isNotNull())


def missing_hrefs(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    there = entries.select("book_id", F.col("name").alias("archive_path"))
    lost = resolve_manifest(manifest).join(there, ["book_id", "archive_path"], "left_anti")
    return _found(lost, "missing_href", F.concat(F.lit("Manifest href missing from EPUB: "), "archive_path"))


def _marked(items: DataFrame, name: str, books: DataFrame) -> DataFrame:
    """How many items of each book have a property; ``books(book_id)`` names all books, also those without any manifest row."""
    count = items.groupBy("book_id").agg(F.count_if(has_property(name)).alias("_n"))
    return books.select("book_id").distinct().join(count, "book_id", "full").select("book_id", F.coalesce("_n", F.lit(0)).alias("_n"))


def navigation(manifest: DataFrame, books: DataFrame) -> DataFrame:
    """Exactly one navigation item, with the right path and type."""
    items = resolve_manifest(manifest)
    wrong = has_property("nav") & ((F.col("archive_path") != NAV_PATH) | (F.col("media_type") != XHTML))
    bad = _found(items.where(wrong), "navigation", F.lit(f"EPUB nav item must reference {NAV_PATH}"))
    count = _marked(items, "nav", books)
    return bad.unionByName(_found(count.where(F.col("_n") != 1), "navigation", F.lit("EPUB nav item missing")))


def unknown_idrefs(spine_refs: DataFrame, manifest: DataFrame) -> DataFrame:
    known = resolve_manifest(manifest).select("book_id", F.col("item_id").alias("idref"))
    lost = spine_refs.where(F.coalesce("idref", F.lit("")) != "").join(known, ["book_id", "idref"], "left_anti")
    return _found(lost, "unknown_idref", F.concat(F.lit("Spine itemref "), "idref", F.lit(" has no manifest item")))


def page_images(page_refs: DataFrame, spine_refs: DataFrame, manifest: DataFrame) -> DataFrame:
    """Images used by spine pages must be image items of the manifest.

    ``page_refs(book_id, item_id, path)`` as made by ``extract_refs``.
    """
    items = resolve_manifest(manifest)
    pages = items.where(F.col("media_type") == XHTML).select("book_id", "item_id")
    read = spine_refs.select("book_id", F.col("idref").alias("item_id")).distinct()
    used = page_refs.join(pages, ["book_id", "item_id"], "left_semi").join(read, ["book_id", "item_id"], "left_semi")
    known = items.groupBy("book_id", F.col("archive_path").alias("path")).agg(
        F.bool_or(F.col("media_type").startswith("image/")).alias("_image")
    )
    seen = used.join(known, ["book_id", "path"], "left").where(~F.coalesce("_image", F.lit(False)))
    text = F.when(F.col("_image").isNull(), "Reading page image missing from manifest: ").otherwise(
        "Reading page image is not an image manifest item: "
    )
    return _found(seen, "page_image", F.concat(text, "path"))


def cover_items(manifest: DataFrame, books: DataFrame) -> DataFrame:
    """Exactly one cover item, and it is an image."""
    items = resolve_manifest(manifest)
    cover = has_property("cover-image")
    count = _marked(items, "cover-image", books)
    several = _found(count.where(F.col("_n") != 1), "cover", F.lit("EPUB must have exactly one cover image"))
    plain = items.where(cover & ~F.col("media_type").startswith("image/"))
    return several.unionByName(
        _found(plain, "cover", F.concat(F.lit("Cover item "), "item_id", F.lit(" is not an image")))
    )


def media_types(manifest: DataFrame) -> DataFrame:
    """Image items whose media type does not belong to their extension."""
    types = F.create_map(*[F.lit(text) for item in IMAGE_TYPES.items() for text in item])
    expected = F.try_element_at(types, extension(F.col("archive_path")))
    # A filter on the formula would find the extension once for each mention.
    rows = settle(resolve_manifest(manifest).where(F.col("media_type").startswith("image/")), {"_expected": expected})
    off = rows.where(F.col("_expected") != F.col("media_type"))
    text = F.concat(
        F.lit("Image media type mismatch for "), "archive_path", F.lit(": "), "media_type", F.lit(" != "), "_expected"
    )
    return _found(off, "media_type", text)


def page_languages(pages: DataFrame, books: DataFrame) -> DataFrame:
    """``pages(book_id, path, lang, xml_lang)`` against ``books(book_id, language)``; blank means any."""
    wanted = books.select("book_id", F.trim("language").alias("_want")).where(F.col("_want") != "")
    same = lambda c: F.coalesce(F.col(c) == F.col("_want"), F.lit(False))
    off = pages.join(wanted, "book_id").where(~same("lang") | ~same("xml_lang"))
    return _found(off, "language", F.concat(F.lit("XHTML language mismatch for "), "path"))


def extract_refs(pages: DataFrame, pattern: str) -> DataFrame:
    """``path`` of every local reference in ``pages(book_id, item_id, page_path, text)``.

    ``pattern`` has one group around the reference. References with a scheme are skipped, the
    rest is resolved against the folder of the page.
    """
    refs = pages.select("book_id", "item_id", "page_path", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("_ref"))
    local = refs.where((F.col("_ref") != "") & ~F.contains(F.split_part("_ref", F.lit("/"), F.lit(1)), F.lit(":")))
    return local.select("book_id", "item_id", join_path(directory(F.col("page_path")), F.col("_ref")).alias("path")).distinct()


IMAGE_REF = r"<(?:[A-Za-z]+:)?image\b[^>]*?\s(?:[A-Za-z]+:)?href\s*=\s*[\"']([^\"']*)[\"']"


def _item(item_id: str, href: str, kind: str, properties: str | None) -> Column:
    return F.struct(
        F.lit(item_id).alias("item_id"),
        F.lit(href).alias("href"),
        F.lit(kind).alias("media_type"),
        F.lit(properties).cast("string").alias("properties"),
    )


def manifest_rows(pages: DataFrame, covers: DataFrame) -> DataFrame:
    """Manifest of each book from its normalised pages; ``covers(volume_id, cover_id)``.

    ``pages`` needs ``is_read`` to tell which pages get a reading page.
    """
    rows = pages.join(covers.select("volume_id", "cover_id"), "volume_id", "left")
    blank = F.col("kind") == "blank"
    ext = F.col("ext")
    image = F.when(
        ~blank,
        F.struct(
            F.concat(F.lit("img-"), padded4(F.col("page_index"))).alias("item_id"),
            F.col("image_href").alias("href"),
            F.when(ext == "jpg", "image/jpeg").otherwise("image/png").alias("media_type"),
            F.when(F.col("item_id") == F.col("cover_id"), "cover-image").alias("properties"),
        ),
    )
    page = F.when(
        F.col("is_read"),
        F.struct(
            F.col("item_id"),
            F.col("page_href").alias("href"),
            F.lit(XHTML).alias("media_type"),
            F.when(~blank, "svg").alias("properties"),
        ),
    )
    items = rows.select(F.col("volume_id").alias("book_id"), F.inline(F.array_compact(F.array(image, page))))
    always = F.array(
        _item("nav", "nav.xhtml", XHTML, "nav"),
        _item("css-page", "styles/page.css", "text/css", None),
    )
    books = pages.select(F.col("volume_id").alias("book_id")).distinct()
    fixed = books.select("book_id", F.inline(always))
    return fixed.unionByName(items)


def spine_rows(pages: DataFrame, properties: Column) -> DataFrame:
    """Reading order of each book with its page-spread property."""
    return pages.where("is_read").select(
        F.col("volume_id").alias("book_id"), "page_index", F.col("item_id").alias("idref"), properties.alias("properties")
    )


def all_violations(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)
