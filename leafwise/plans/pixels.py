"""Queries over page rasters derived from the embedding vectors."""

from __future__ import annotations

from pyspark.sql import functions as F

from leafwise.functions.frames import rounded, settle
from leafwise.functions.numeric import clamp01
from leafwise.operators import rasters
from leafwise.operators.ordered import spread
from leafwise.plans.inputs import EMBEDDING_PAGES_SQL, embedding_pages
from leafwise.plans.registry import query
from leafwise.plans.sqltext import c01, r6
from leafwise.session import durable


def _pixels(spark, sf, width: int, height: int, place: str):
    """Pages whose pixel ``i`` is the grey value of vector place ``place`` (an expression of i)."""
    grey = lambda x: F.floor(clamp01((x.cast("double") + 0.55) / 1.1) * 255).cast("int")
    pages = settle(embedding_pages(spark, sf), {"_p": F.transform("embedding", grey)})
    digits = F.expr(f"transform(sequence(0, {width * height - 1}), i -> lpad(hex(_p[cast({place} as int)]), 2, '0'))")
    return pages.select(
        F.col("volume_id").cast("bigint").alias("volume_id"),
        "page",
        F.lit(width).alias("width"),
        F.lit(height).alias("height"),
        F.unhex(F.array_join(digits, "")).alias("gray"),
    )


def small_rasters(spark, sf):
    return _pixels(spark, sf, 8, 8, "i")


def tall_rasters(spark, sf):
    """48 x 48 pages, tall enough for every vertical offset."""
    pages = _pixels(spark, sf, 48, 48, "(i div 48 * 7 + i % 48 * (1 + i div 480)) % 64")
    return pages


_FEATURES = ("ink_ratio", "edge_density", "blank_ratio", "dark_ratio", "center_ink_ratio", "border_ink_ratio", "bottom_activity",
             "content_density", "title_likeness")


@query(
    "page_features",
    f"""WITH {EMBEDDING_PAGES_SQL},
    cells AS (SELECT volume_id, page, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM embedding_pages),
    pix AS (SELECT volume_id, page, i // 8 AS y, i % 8 AS x,
      floor(255 * greatest(0.0, least(1.0, (e::DOUBLE + 0.55) / 1.1))) AS v FROM cells),
    steps AS (SELECT *, greatest(coalesce(abs(v - lag(v) OVER r), 0), coalesce(abs(v - lag(v) OVER c), 0)) > 30.6 AS busy,
      greatest(coalesce(abs(v - lag(v) OVER r), 0), CASE WHEN y > 6 THEN abs(v - lag(v) OVER c) ELSE 0 END) > 30.6 AS low_busy
      FROM pix WINDOW r AS (PARTITION BY volume_id, page, y ORDER BY x), c AS (PARTITION BY volume_id, page, x ORDER BY y)),
    f AS (SELECT volume_id, page, avg((v < 214.2)::INT) AS ink_ratio, avg(busy::INT) AS edge_density,
        avg((v > 239.7)::INT) AS blank_ratio, avg((v < 56.1)::INT) AS dark_ratio,
        avg((v < 214.2)::INT) FILTER (y BETWEEN 2 AND 5 AND x BETWEEN 1 AND 5) AS center_ink_ratio,
        avg((v < 214.2)::INT) FILTER (y IN (0, 7) OR x IN (0, 7)) AS border_ink_ratio,
        (avg((v < 214.2)::INT) FILTER (y >= 6) + avg(low_busy::INT) FILTER (y >= 6)) / 2 AS bottom_activity
      FROM steps GROUP BY 1, 2),
    g AS (SELECT *, {c01('ink_ratio * 0.55 + edge_density * 0.45')} AS content_density,
      {c01(c01("(blank_ratio - 0.62) / 0.35") + " * 0.34 + greatest(0.0::DOUBLE, 1.0 - abs(ink_ratio - 0.05) / 0.18) * 0.24 + "
        + c01("(center_ink_ratio - border_ink_ratio) * 5.0") + " * 0.26 + " + c01("1.0 - edge_density * 5.0") + " * 0.16")}
        AS title_likeness FROM f)
    SELECT volume_id::BIGINT AS volume_id, page, {r6(*_FEATURES)} FROM g""",
)
def page_features(spark, sf):
    found = rasters.page_features(small_rasters(spark, sf))
    return rounded(found, _FEATURES).select("volume_id", "page", *_FEATURES)


@query("content_crop")
def content_crop(spark, sf):
    return rasters.content_crop(tall_rasters(spark, sf))


@query("seam_features")
def seam_features(spark, sf):
    return rasters.seam_features(rasters.strip_pairs(tall_rasters(spark, sf)))


@query("score_rasters")
def score_rasters(spark, sf):
    return rasters.score_rasters(tall_rasters(spark, sf))


@query(
    "rejected_rasters",
    f"""WITH {EMBEDDING_PAGES_SQL}
    SELECT volume_id::BIGINT AS volume_id, page, 'raster of ' || CASE WHEN page % 10 = 0 THEN 'no' ELSE '63' END || ' bytes for 8 x 8' AS error
    FROM embedding_pages WHERE page % 5 = 0""",
)
def rejected_rasters(spark, sf):
    """Every fifth page lost its last byte, every tenth all of them."""
    broken = F.when(F.col("page") % 10 == 0, F.lit(None).cast("binary")).when(F.col("page") % 5 == 0, F.substring("gray", 1, 63))
    pages = small_rasters(spark, sf)
    return rasters.rejected_rasters(pages.withColumn("gray", F.when(F.col("page") % 5 != 0, F.col("gray")).otherwise(broken)))


@query("trimmed_probes")
def trimmed_probes(spark, sf):
    """Probes of all pairs of pages with white margins."""
    pages = _framed_rasters(spark, sf)
    return rasters.trimmed_probes(pages, rasters.score_rasters(pages).select("volume_id", "right_page", "left_page"))


def _framed_rasters(spark, sf):
    """48 x 48 pages; two of three have a white frame of ten pixels."""
    inside = "(i div 48) BETWEEN 10 AND 37 AND (i % 48) BETWEEN 10 AND 37"
    place = "(i div 48 * 7 + i % 48 * (1 + i div 480)) % 64"
    grey = lambda x: F.floor(clamp01((x.cast("double") + 0.55) / 1.1) * 255).cast("int")
    # Pixels are costly for the few bytes they come from.
    found = spread(embedding_pages(spark, sf), "volume_id", "page")
    pages = settle(found, {"_p": F.transform("embedding", grey)})
    digits = F.expr(
        f"transform(sequence(0, 2303), i -> CASE WHEN page % 3 = 0 OR {inside} THEN lpad(hex(_p[cast({place} as int)]), 2, '0') ELSE 'FF' END)"
    )
    return pages.select(
        F.col("volume_id").cast("bigint").alias("volume_id"),
        "page",
        F.lit(48).alias("width"),
        F.lit(48).alias("height"),
        F.unhex(F.array_join(digits, "")).alias("gray"),
    )


_SCANNED = ("spread", "review_score", "stability_score", "relative_score")


@query("scan_rasters")
def scan_rasters(spark, sf):
    """The whole scan in both reading directions."""
    pages = durable(_framed_rasters(spark, sf))  # read four times
    found = [rasters.scan_rasters(pages, reading).withColumn("reading", F.lit(reading)) for reading in ("rtl", "ltr")]
    columns = ("reading", "volume_id", "right_page", "left_page", *_SCANNED, "rank", "cluster", "rank_in_cluster", "decision", "selected")
    return rounded(found[0].unionByName(found[1]), _SCANNED).select(*columns)
