"""Names, numbers and titles as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Image extensions taken as they are, and those converted to PNG.
JPEG_EXTENSIONS = ("jpg", "jpeg", "jpe", "jfif")
PNG_EXTENSIONS = ("png", "apng")
CONVERTED_EXTENSIONS = (
    "webp", "bmp", "tif", "tiff", "gif", "avif", "avifs", "jp2",
    "j2k", "j2c", "jpc", "jpf", "jpx", "heic", "heif", "hif",
)
IMAGE_EXTENSIONS = JPEG_EXTENSIONS + PNG_EXTENSIONS + CONVERTED_EXTENSIONS
# Label prefixes worth a reviewer's time, and separators between title and author.
REVIEWABLE_PREFIXES = ("A ", "B ", "C ", "D ")
TITLE_SEPARATORS = (",", "，", "、", "：", ":")
# Name-based UUID namespace for URLs (RFC 9562).
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def pair_id(start: Column, end: Column) -> Column:
    return F.format_string("%03d-%03d", start, end)


def is_reviewable(label: Column) -> Column:
    return F.substring(label, 1, 2).isin(*REVIEWABLE_PREFIXES)


# --- paths -------------------------------------------------------------------------------------

def slashes(path: Column) -> Column:
    return F.regexp_replace(path, r"\\", "/")


def base_name(path: Column) -> Column:
    # Tried where a part begins only, and without going back: else once for every letter of the path.
    return F.regexp_extract(path, r"(?<![^/])([^/]*+)/*+$", 1)


def extension(path: Column) -> Column:
    """Lower-case suffix without the dot; a leading dot alone is not a suffix."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+\.([^.]+)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    cut = F.regexp_extract(name, r"^(.+)\.[^.]+$", 1)
    return F.when(cut == "", name).otherwise(cut)


def is_image_member(path: Column, is_dir: Column) -> Column:
    """Keep supported images outside resource-fork folders; drop directories and dot files."""
    clean = slashes(path)
    in_fork = F.array_contains(F.split(clean, "/"), "__MACOSX")
    return ~is_dir & ~in_fork & ~base_name(clean).startswith(".") & extension(clean).isin(*IMAGE_EXTENSIONS)


def output_extension(ext: Column) -> Column:
    """Extension after import: JPEG kinds stay jpg, every other supported kind becomes png."""
    return F.when(ext.isin(*JPEG_EXTENSIONS), "jpg").when(ext.isin(*IMAGE_EXTENSIONS), "png")


def is_converted(ext: Column) -> Column:
    return ext.isin(*CONVERTED_EXTENSIONS)


def media_type(ext: Column) -> Column:
    low = F.lower(ext)
    return F.when(low.isin("jpg", "jpeg"), "image/jpeg").when(low == "png", "image/png")


def source_kind(path: Column) -> Column:
    suffix = extension(path)
    return F.when(suffix == "pdf", "pdf").when(suffix.isin("cbz", "zip"), "archive")


def source_error(path: Column) -> Column:
    return F.when(source_kind(path).isNull(), F.concat(F.lit("Unsupported source file: "), path))


# --- ordering and numbers ----------------------------------------------------------------------

def natural_key(name: Column) -> Column:
    """Orderable array: digit runs compare as numbers and before text, text ignores case."""
    # A string has less than 2^31 characters: ten digits hold the length of any digit run.
    chunks = F.regexp_extract_all(name, F.lit("([0-9]+|[^0-9]+)"), F.lit(1))

    def encode(chunk: Column) -> Column:
        digits = F.regexp_replace(chunk, "^0+(?=.)", "")
        number = F.concat(F.lit("0"), F.lpad(F.length(digits).cast("string"), 10, "0"), digits)
        return F.when(chunk.rlike("^[0-9]"), number).otherwise(F.concat(F.lit("1"), F.lower(chunk)))

    return F.transform(chunks, encode)


def page_number(name: Column) -> Column:
    """Last digit run of a name, or null; null too for a number beyond 64 bits."""
    runs = F.regexp_extract_all(name, F.lit("([0-9]+)"), F.lit(1))
    return F.try_element_at(runs, F.lit(-1)).try_cast("bigint")


def token_prefix(name: Column) -> Column:
    """First ``T<digits>`` token, or null."""
    return F.nullif(F.regexp_extract(name, "(T[0-9]+)", 1), F.lit(""))


def volume_number(file_stem: Column, fallback: Column) -> Column:
    """Number after vol / volume, else trailing digits, else ``fallback``; numbers beyond 64 bits are passed over."""
    named = F.regexp_extract(file_stem, r"(?iU)\b(?:vol(?:ume)?\.?\s*)(\d+)\b", 1)
    trailing = F.regexp_extract(file_stem, r"(\d+)\s*$", 1)
    return F.coalesce(
        F.nullif(named, F.lit("")).try_cast("bigint"), F.nullif(trailing, F.lit("")).try_cast("bigint"), fallback
    )


# --- titles ------------------------------------------------------------------------------------

def without_volume(file_stem: Column) -> Column:
    bare = F.regexp_replace(file_stem, r"(?iU)\b(?:vol(?:ume)?\.?\s*)\d+\b", "")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def series_title_author(file_stem: Column) -> tuple[Column, Column]:
    """(title, author) from ``[title][author]``, a separated title, or the stem itself."""
    brackets = r"^\s*\[([^\]]+)\]\s*\[([^\]]+)\]"
    bare = without_volume(file_stem)
    head = F.regexp_extract(bare, r"^(.*\S)\s+(\S+)$", 1)
    tail = F.regexp_extract(bare, r"^(.*\S)\s+(\S+)$", 2)
    separated = head.rlike("[" + "".join(TITLE_SEPARATORS) + "]")
    bracketed = file_stem.rlike(brackets)
    plain = F.when(bare == "", file_stem).otherwise(bare)
    title = (
        F.when(bracketed, F.trim(F.regexp_extract(file_stem, brackets, 1))).when(separated, F.trim(head)).otherwise(plain)
    )
    author = F.when(bracketed, F.trim(F.regexp_extract(file_stem, brackets, 2))).when(separated, F.trim(tail)).otherwise("")
    return title, author


def generated_title(series_title: Column, number: Column) -> Column:
    return F.format_string("%s Vol.%02d", series_title, number)


def safe_filename(title: Column) -> Column:
    cleaned = F.regexp_replace(title, r'[\\/:*?"<>|]+', "_")
    cleaned = F.trim(F.regexp_replace(cleaned, r"(?U)\s+", " "))
    return F.when(cleaned == "", "Untitled").otherwise(cleaned)


def choose_title(title: Column, series_title: Column, number: Column, file_stem: Column) -> Column:
    """Explicit title, else series title with its volume number, else the stem."""
    numbered = generated_title(series_title, F.coalesce(number, volume_number(file_stem, F.lit(1).cast("bigint"))))
    return (
        F.when(F.coalesce(title, F.lit("")) != "", title)
        .when(F.coalesce(series_title, F.lit("")) != "", numbered)
        .otherwise(file_stem)
    )


# --- identifiers -------------------------------------------------------------------------------

def padded(number: Column, count: Column) -> Column:
    """Zero-padded number; the width is that of ``count``, at least four."""
    width = F.greatest(F.lit(4), F.length(count.cast("string")))
    text = number.cast("string")
    # lpad would cut a longer number.
    return F.when(F.length(text) >= width, text).otherwise(
        F.concat(F.repeat(F.lit("0"), width - F.length(text)), text)
    )


def padded4(number: Column) -> Column:
    return padded(number, F.lit(0))


def book_id(uri: Column) -> Column:
    """Name-based (version 5) UUID of the source URI as a URN."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(uri, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.lit("urn:uuid:"),
        F.substring(digest, 1, 8),
        F.lit("-"),
        F.substring(digest, 9, 4),
        F.lit("-5"),
        F.substring(digest, 14, 3),
        F.lit("-"),
        variant,
        F.substring(digest, 18, 3),
        F.lit("-"),
        F.substring(digest, 21, 12),
    )
