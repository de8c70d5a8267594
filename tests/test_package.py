import posixpath
import random

import pytest
from pyspark.sql import functions as F

from leafwise.functions import names, paths
from leafwise.operators import package

ENTRIES = "book_id long, ordinal long, name string, compress_type int, content string"
MANIFEST = "book_id long, item_id string, href string, media_type string, properties string"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_container_files_need_no_sort(spark):
    rows = [
        (1, 0, "mimetype", 0, "application/epub+zip"), (1, 1, "META-INF/container.xml", 8, None), (1, 2, "EPUB/content.opf", 8, None),
        (2, 5, "mimetype", 8, "text/plain"), (2, 1, "a", 8, None), (2, 2, "EPUB/content.opf", 8, None),
        (3, 0, "mimetype", None, None), (3, None, "META-INF/container.xml", 8, None), (3, 2, "EPUB/content.opf", 8, None),
        (4, 0, None, 0, None), (4, 1, "META-INF/container.xml", 8, None), (4, 2, "EPUB/content.opf", 8, None),
        (None, 0, "mimetype", 0, "application/epub+zip"),
    ]
    found = package.container_files(spark.createDataFrame(rows, ENTRIES))
    assert "SortAggregate" not in plan(found)
    missing = "Required EPUB file missing: "
    assert sorted(map(tuple, found.collect()), key=str) == sorted(
        [
            (2, "container", "EPUB mimetype must be the first zip entry"),
            (2, "container", "EPUB mimetype must be stored without compression"),
            (2, "container", "EPUB mimetype has invalid content"),
            (2, "container", f"{missing}META-INF/container.xml"),
            (None, "container", f"{missing}META-INF/container.xml"),
            (None, "container", f"{missing}EPUB/content.opf"),
        ],
        key=str,
    )


HREFS = [
    "a.jpg", "./x/../a.jpg", "x/y/../../a.jpg", "../a.jpg", "../../../a.jpg", "x//a.jpg", "x/./a.jpg", "x/", "x/.", "x/..", "x/../", "..x/../a",
    ".x/a", "x/...", ".../../a", "x/.././../a", "//a", "/", ".", "./", "..", "../..", "a/../b/../c", "a/b/../c/../../d", "x./a", "x../a/..",
]


@pytest.mark.parametrize("prefix", ["", "/", "EPUB/"])
def test_paths_shortened_first_are_normal(spark, prefix):
    rows = spark.createDataFrame([(prefix + href,) for href in HREFS], "path string")
    got = rows.select("path", paths.normalize_path(F.col("path")).alias("n")).collect()
    assert {r.path: r.n for r in got} == {r.path: posixpath.normpath(r.path).replace("//", "/") for r in got}


def test_manifest_is_resolved_by_compiled_code(spark):
    rows = [(1, f"i{n}", href, "image/png", None) for n, href in enumerate(HREFS)] + [(1, "", "a", "image/png", None), (1, "i", None, None, None)]
    items = package.resolve_manifest(spark.createDataFrame(rows, MANIFEST))
    # The fold is interpreted: an operator that holds it is not compiled, so no generator may.
    assert not [line for line in plan(items).splitlines() if "Generate inline" in line and "lambdafunction" in line]
    got = {(r.item_id, r.archive_path) for r in items.collect()}
    assert got == {(f"i{n}", posixpath.normpath(f"EPUB/{href}")) for n, href in enumerate(HREFS)}


def test_properties_are_words(spark):
    texts = ["nav", "x nav", "navy", "x-nav", "nav\tx", None, ""]
    rows = spark.createDataFrame([(t,) for t in texts], "properties string")
    assert [r[0] for r in rows.select(package.has_property("nav")).collect()] == [True, True, False, False, True, False, False]


def test_base_names_are_sought_where_a_part_begins(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("a./\n\rb ") for _ in range(rng.randint(0, 9))) for _ in range(2000)]
    rows = spark.createDataFrame([(t,) for t in [*texts, "a/b.jpg", "a/b//", "///", "", None]], "path string")
    got = names.base_name(F.col("path"))
    assert "(?<![^/])" in got._jc.toString()
    assert rows.where(~got.eqNullSafe(F.regexp_extract("path", "([^/]*)/*$", 1))).count() == 0
