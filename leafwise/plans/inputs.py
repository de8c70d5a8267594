"""Catalogue tables derived from the driver's parquet files, in Spark and as SQL text.

Every ``*_SQL`` constant is the body of one or more common table expressions that yields the
same rows as the function next to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwise.functions.numeric import clamp01
from leafwise.operators.ordered import number_rows
from leafwise.session import durable


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# --- page features: one volume per document source -------------------------------------------

def page_features(spark: SparkSession, sf: str) -> DataFrame:
    """Measured page ratios; a document stands for a page."""
    docs = table(spark, sf, "documents").select(F.col("source").alias("volume_id"), "doc_id", "n_chars")
    pages = number_rows(docs, ["volume_id"], "doc_id", "page", first=1)
    n = F.col("n_chars")
    return pages.select(
        "volume_id",
        "page",
        F.lit(100).alias("width"),
        F.lit(150).alias("height"),
        (n % 997 / 997.0).alias("ink_ratio"),
        ((n * 7 + F.col("doc_id")) % 101 / 101.0 * F.when(n % 5 == 0, 0.1).otherwise(1.0)).alias("edge_density"),
        (F.lit(1.0) - n % 997 / 997.0).alias("blank_ratio"),
        (n % 89 / 89.0).alias("dark_ratio"),
        (n % 83 / 83.0).alias("center_ink_ratio"),
        (n % 53 / 53.0 * 0.5).alias("border_ink_ratio"),
        (n % 71 / 71.0).alias("bottom_activity"),
    )


PAGE_FEATURES_SQL = """
page_features AS (
  SELECT source AS volume_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page,
    100 AS width, 150 AS height,
    (n_chars % 997) / 997.0::DOUBLE AS ink_ratio,
    ((n_chars * 7 + doc_id) % 101) / 101.0::DOUBLE
      * CASE WHEN n_chars % 5 = 0 THEN 0.1::DOUBLE ELSE 1.0::DOUBLE END AS edge_density,
    1.0::DOUBLE - (n_chars % 997) / 997.0::DOUBLE AS blank_ratio,
    (n_chars % 89) / 89.0::DOUBLE AS dark_ratio,
    (n_chars % 83) / 83.0::DOUBLE AS center_ink_ratio,
    (n_chars % 53) / 53.0::DOUBLE * 0.5::DOUBLE AS border_ink_ratio,
    (n_chars % 71) / 71.0::DOUBLE AS bottom_activity
  FROM documents)"""


# --- pair features: one volume per embedding label ---------------------------------------------

# (feature, vector place, low, span): feature = clamp01((vector[place] + low) / span)
PAIR_FEATURES = (
    ("color", 0, 0.3, 0.45),
    ("gradient", 1, 0.3, 0.45),
    ("profile", 2, 0.3, 0.45),
    ("edge", 3, 0.3, 0.45),
    ("ink", 4, 0.3, 0.45),
    ("energy", 5, 0.3, 0.45),
    ("orientation", 6, 0.3, 0.45),
    ("line", 7, 0.3, 0.45),
    ("texture", 8, 0.3, 0.45),
    ("corr", 9, 0.3, 0.45),
    ("color_style", 10, 0.3, 0.45),
    ("panel", 11, 0.1, 0.5),
    ("page_panel", 12, 0.1, 0.5),
    ("inner_gutter", 13, 0.2, 0.35),
    ("composition", 14, 0.25, 0.5),
    ("seam_activity", 15, 0.3, 0.45),
    ("seam_contact", 16, 0.2, 0.5),
    ("patch", 17, 0.3, 0.4),
    ("barrier", 18, 0.1, 0.35),
)


def embedding_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages with a name; a vector stands for a page of the volume named by its label."""
    vectors = table(spark, sf, "embeddings").select(F.col("label").alias("volume_id"), "vec_id", "embedding")
    pages = number_rows(vectors, ["volume_id"], "vec_id", "page", first=1)
    return pages.withColumn("name", F.format_string("page-%03d", "page"))


EMBEDDING_PAGES_SQL = """
embedding_pages AS (
  SELECT label AS volume_id, vec_id, embedding,
    row_number() OVER (PARTITION BY label ORDER BY vec_id) AS page,
    printf('page-%03d', row_number() OVER (PARTITION BY label ORDER BY vec_id)) AS name
  FROM embeddings)"""


def pair_features(spark: SparkSession, sf: str) -> DataFrame:
    """Adjacent pairs with the 19 features read off the right page's vector."""
    from leafwise.operators.pairs import adjacent_pairs

    pages = embedding_pages(spark, sf)
    pairs = adjacent_pairs(pages)
    features = pages.select(
        "volume_id",
        F.col("page").alias("right_page"),
        *[
            clamp01((F.col("embedding")[place].cast("double") + low) / span).alias(name)
            for name, place, low, span in PAIR_FEATURES
        ],
    )
    return pairs.join(features, ["volume_id", "right_page"]).withColumn("offset", F.lit(0))


_FEATURE_SQL = ",\n    ".join(
    f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, (embedding[{place + 1}]::DOUBLE + {low}) / {span})) AS {name}"
    for name, place, low, span in PAIR_FEATURES
)
PAIR_FEATURES_SQL = f"""{EMBEDDING_PAGES_SQL},
pair_features AS (
  SELECT * FROM (SELECT volume_id, page AS right_page, page + 1 AS left_page, name AS right_name,
    lead(name) OVER (PARTITION BY volume_id ORDER BY page) AS left_name,
    {_FEATURE_SQL}
  FROM embedding_pages) WHERE left_name IS NOT NULL)"""


def probe_scores(scores: DataFrame) -> DataFrame:
    """Probe scorings of the gated pairs: the base score and up to two shifted ones."""
    from leafwise.operators.adjust import PAIR_KEYS, stability_gate

    gated = stability_gate(scores)
    first = F.when(F.col("right_page") % 3 != 0, F.col("spread") * (F.lit(1.0) - F.col("texture") * 0.2))
    second = F.when(F.col("right_page") % 3 == 2, F.col("spread") * (F.lit(1.0) - F.col("line") * 0.1))
    return gated.select(*PAIR_KEYS, F.explode(F.array_compact(F.array("spread", first, second))).alias("spread"))


# --- spines ---------------------------------------------------------------------------------------

LINE_ORDER = (
    "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount", "l_tax",
    "l_shipdate", "l_returnflag", "l_linestatus",
)


def order_spine(spark: SparkSession, sf: str) -> DataFrame:
    """One volume per order, one entry per order line; also the columns later tables derive from."""
    # The lines of one order are few.
    rank = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*LINE_ORDER)).cast("bigint")
    lines = table(spark, sf, "lineitem").withColumn("_rank", rank)
    index = (F.col("_rank") - 1).cast("bigint")
    kind = (
        F.when(F.col("l_returnflag") == "R", "blank")
        .when(F.col("l_quantity") % 10 == 7, "inserted")
        .otherwise("source")
    )
    rows = lines.withColumns({"entry_index": index, "kind": kind, "page": F.col("_rank")})
    number = F.format_string("%04d", "page")
    shown = F.col("kind") != "blank"
    return rows.select(
        F.col("l_orderkey").alias("volume_id"),
        "entry_index",
        "kind",
        F.when(F.col("kind") == "source", F.col("page")).alias("source_index"),
        F.concat(
            F.when(F.col("kind") == "blank", "blank-").when(F.col("kind") == "inserted", "inserted-").otherwise("page-"),
            number,
        ).alias("item_id"),
        F.when(F.col("kind") == "inserted", F.concat(F.lit("/art/"), number, F.lit(".png"))).alias("inserted_path"),
        (F.col("l_partkey") % 7 * 10 + 1000).alias("width"),
        (F.col("l_suppkey") % 5 * 10 + 1500).alias("height"),
        F.when(shown & (F.col("l_linestatus") == "O"), "jpg").when(shown, "png").alias("ext"),
        F.col("l_partkey").alias("part"),
        F.col("l_suppkey").alias("supp"),
        F.col("l_quantity").cast("bigint").alias("quantity"),
    )


def stored_spine(spark: SparkSession, sf: str) -> DataFrame:
    """``order_spine`` written once, for queries that read it many times (a real spine is a table)."""
    return durable(order_spine(spark, sf))


ORDER_SPINE_SQL = f"""
order_lines AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(LINE_ORDER)}) AS page,
    CASE WHEN l_returnflag = 'R' THEN 'blank' WHEN l_quantity % 10 = 7 THEN 'inserted' ELSE 'source' END AS kind
  FROM lineitem),
order_spine AS (
  SELECT l_orderkey AS volume_id, page - 1 AS entry_index, kind,
    CASE WHEN kind = 'source' THEN page END AS source_index,
    CASE kind WHEN 'blank' THEN 'blank-' WHEN 'inserted' THEN 'inserted-' ELSE 'page-' END || printf('%04d', page)
      AS item_id,
    CASE WHEN kind = 'inserted' THEN '/art/' || printf('%04d', page) || '.png' END AS inserted_path,
    l_partkey % 7 * 10 + 1000 AS width, l_suppkey % 5 * 10 + 1500 AS height,
    CASE WHEN kind = 'blank' THEN NULL WHEN l_linestatus = 'O' THEN 'jpg' ELSE 'png' END AS ext,
    l_partkey AS part, l_suppkey AS supp, l_quantity::BIGINT AS quantity
  FROM order_lines)"""


def spread_marks(spine: DataFrame) -> DataFrame:
    """Scanned spread candidates of the spine's volumes; every pair appears up to three times."""
    from leafwise.functions.names import pair_id

    start = F.col("entry_index") + 1
    base = spine.select(
        "volume_id",
        start.alias("start_page"),
        (start + 1 + F.when(F.col("part") % 50 == 0, 1).otherwise(0)).alias("end_page"),
        F.explode(F.sequence(F.lit(0), (F.col("part") % 3).cast("int"))).alias("copy"),
        "part",
        "supp",
    )
    return base.select(
        "volume_id",
        pair_id(F.col("start_page"), F.col("end_page")).alias("pair_id"),
        "start_page",
        "end_page",
        ((F.col("supp") * 7 + F.col("copy") * 13) % 100 / 100.0).alias("score"),
        ((F.col("supp") * 3 + F.col("copy")) % 100 / 100.0).alias("review_score"),
        F.when(F.col("copy") == 0, "auto").otherwise("review").alias("decision"),
    )


SPREAD_MARKS_SQL = """
spread_marks AS (
  SELECT volume_id, printf('%03d-%03d', start_page, end_page) AS pair_id, start_page, end_page,
    (supp * 7 + copy * 13) % 100 / 100.0::DOUBLE AS score, (supp * 3 + copy) % 100 / 100.0::DOUBLE AS review_score,
    CASE WHEN copy = 0 THEN 'auto' ELSE 'review' END AS decision
  FROM (SELECT volume_id, entry_index + 1 AS start_page,
      entry_index + 2 + CASE WHEN part % 50 = 0 THEN 1 ELSE 0 END AS end_page,
      unnest(generate_series(0, part % 3)) AS copy, part, supp FROM order_spine))"""


def insert_gaps(spine: DataFrame) -> DataFrame:
    """Insertion candidates: the gap behind every entry but the last positions' missing pages."""
    from leafwise.functions.names import pair_id

    page = F.col("entry_index") + 1
    letter = (F.col("quantity") % 6 + 1).cast("int")
    labels = ["A chapter_boundary", "B low_content_pause", "C scene_change", "D visual_discontinuity",
              "E risky_continuity", "F do_not_insert"]
    return spine.select(
        "volume_id",
        pair_id(page, page + 1).alias("gap_id"),
        page.alias("after_page"),
        (page + 1).alias("before_page"),
        (F.col("supp") * 11 % 100 / 100.0).alias("safe_insert_score"),
        F.element_at(F.array(*[F.lit(x) for x in labels]), letter).alias("label"),
    )


INSERT_GAPS_SQL = """
insert_gaps AS (
  SELECT volume_id, printf('%03d-%03d', entry_index + 1, entry_index + 2) AS gap_id, entry_index + 1 AS after_page,
    entry_index + 2 AS before_page, supp * 11 % 100 / 100.0::DOUBLE AS safe_insert_score,
    (['A chapter_boundary', 'B low_content_pause', 'C scene_change', 'D visual_discontinuity',
      'E risky_continuity', 'F do_not_insert'])[quantity % 6 + 1] AS label
  FROM order_spine)"""


def confirmed(spine: DataFrame) -> DataFrame:
    """Confirmed spreads: about half of all neighbouring pages."""
    from leafwise.functions.names import pair_id

    start = F.col("entry_index") + 1
    return spine.where(F.col("part") % 2 == 0).select(
        "volume_id",
        pair_id(start, start + 1).alias("pair_id"),
        start.alias("start_page"),
        (start + 1).alias("end_page"),
        (F.col("supp") % 10).alias("supp"),
    )


CONFIRMED_SQL = """
confirmed AS (
  SELECT volume_id, printf('%03d-%03d', entry_index + 1, entry_index + 2) AS pair_id, entry_index + 1 AS start_page,
    entry_index + 2 AS end_page FROM order_spine WHERE part % 2 = 0)"""
