"""Nulls, odd names and bad commands have a defined result."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from leafwise.functions import names
from leafwise.functions.numeric import clamp01
from leafwise.functions.scores import FEATURES, score_pairs
from leafwise.operators import package, series
from leafwise.operators import spine as ops
from tests.conftest import rows_of
from tests.test_layout import entries, page, table

FEATURE_DDL = "id long, " + ", ".join(f"{name} double" for name in FEATURES)


def test_a_score_is_null_exactly_where_an_input_is(spark):
    rows = [(0, *[0.4] * len(FEATURES))] + [(i + 1, *[None if j == i else 0.4 for j in range(len(FEATURES))]) for i in range(len(FEATURES))]
    got = {r.id: r for r in score_pairs(spark.createDataFrame(rows, FEATURE_DDL)).collect()}
    assert None not in (got[0].total, got[0].spread, got[0].review_score)
    for i, name in enumerate(FEATURES):
        row = got[i + 1]
        in_total = name in "color gradient profile edge ink energy orientation line texture corr color_style barrier".split()
        assert (row.total is None) == in_total, name
        assert row.spread is None, name
        assert row.review_score is None, name
    assert rows_of(spark.range(1).select(clamp01(F.lit(None).cast("double")), clamp01(F.lit(2.0)))) == [(None, 1.0)]


def test_long_digit_runs(spark):
    long = "9" * 40
    df = spark.createDataFrame([(f"p{long}.jpg",), ("p7.jpg",), (f"v {long}",)], "name string")
    assert rows_of(df.select(names.page_number(F.col("name")))) == [(None,), (7,), (None,)]
    assert rows_of(df.select(names.volume_number(F.col("name"), F.lit(3).cast("bigint"))))[2] == (3,)


def test_all_is_a_whole_scope_only(spark):
    scopes = spark.createDataFrame([(1, " ALL "), (2, "all,3"), (3, "2-3,5"), (4, "9" * 30)], "series_id long, scope string")
    volumes = spark.createDataFrame([(s, n) for s in range(1, 5) for n in range(1, 7)], "series_id long, volume_number long")
    got = {}
    for s, n in rows_of(series.volumes_in_scope(volumes, scopes)):
        got.setdefault(s, set()).add(n)
    assert got == {1: {1, 2, 3, 4, 5, 6}, 3: {2, 3, 5}}
    errors = {r.series_id for r in series.scope_tokens(scopes).where(F.col("error").isNotNull()).collect()}
    assert errors == {2, 4}


def test_several_moves_of_a_volume_change_nothing(spark):
    volumes = {1: [page(n) for n in range(4)], 2: [page(n) for n in range(4)]}
    moves = spark.createDataFrame([(1, 0, 2), (1, 3, 0), (2, 0, 2)], "volume_id long, from_index long, to_index long")
    got = entries(ops.move_entries(table(spark, volumes), moves))
    assert got[1] == volumes[1] and got[2] == [volumes[2][i] for i in (1, 2, 0, 3)]
    errors = rows_of(ops.check_moves(table(spark, volumes), moves).where(F.col("error").isNotNull()).select("volume_id", "error"))
    assert errors == [(1, "Only one move for each volume")] * 2


@pytest.mark.usefixtures("tiny_chunks")
def test_overlapping_ranges_are_merged(spark):
    ranges = spark.createDataFrame([(1, 0, 5), (1, 2, 3), (1, 4, 9), (1, 12, 12), (1, 10, 10), (2, 1, 1)], "volume_id long, start long, end long")
    assert sorted(rows_of(ops.merged_ranges(ranges).select("volume_id", "start", "end"))) == [(1, 0, 10), (1, 12, 12), (2, 1, 1)]


def test_books_without_manifest_rows_are_violations(spark):
    manifest = spark.createDataFrame(
        [(1, "nav", "nav.xhtml", "application/xhtml+xml", "nav"), (1, "c", "a.png", "image/png", "cover-image")],
        "book_id long, item_id string, href string, media_type string, properties string",
    )
    books = spark.createDataFrame([(1,), (2,)], "book_id long")
    assert {r.book_id for r in package.navigation(manifest, books).where("detail LIKE '%missing'").collect()} == {2}
    assert {r.book_id for r in package.cover_items(manifest, books).collect()} == {2}


def test_workers_need_no_source_folder(tmp_path):
    """A session started elsewhere still runs Python operators: the package is sent along."""
    root = Path(__file__).resolve().parents[1]
    code = f"""
import importlib.util, sys
sys.path.insert(0, {str(root)!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.checkpoint.dir', {str(tmp_path / "c")!r}).getOrCreate()
print('rows', __spark_entry__.queries()['score_rasters'](spark, '/root/testdata/sf0.001').count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows" in run.stdout, run.stderr[-2000:]
