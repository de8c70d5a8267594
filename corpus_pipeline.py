"""A training corpus from raw documents: clean, identify, deduplicate twice, pack.

Every stage takes ``(spark, docs, sf_dir)`` and works on all documents its predecessor kept. All but the last return
the columns of ``documents``. Rows with null texts go with the first stage, which also rejects empty ones; an
empty table stays empty through all stages. ``doc_id`` names a document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm import crf_lang, icws, line_clean, packing, substring
from leafwise.llm.encoders import tokenizer_path
from leafwise.llm.store import stored
from leafwise.session import ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
LEAST_LANGUAGE_SHARE = 0.5


def _with_text(rows: DataFrame, text: str) -> DataFrame:
    """The columns of ``documents`` with another text and its length."""
    new = F.col(text)
    return rows.select("doc_id", new.alias("text"), "lang", "source", F.char_length(new).cast("long").alias("n_chars"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove failing lines; documents that fail the base rules or lose too much go."""
    return _with_text(line_clean.clean_lines(docs.select(*COLUMNS)).filter("kept"), "clean_text")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language that most of their words agree on go; a missing ``lang`` is filled in.

    If nothing can be learned, as when all rows lack a ``lang``, there is nothing to reject by and all documents go on unchanged.
    """
    rows = docs.select(*COLUMNS)
    model = crf_lang.fit(rows.select("lang", "text"))
    if model is None:
        return rows
    known = crf_lang.identify(rows, model).filter(
        (F.col("lang_pred") != crf_lang.UNKNOWN) & (F.col("score") >= LEAST_LANGUAGE_SHARE)
    )
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every class of near-duplicates the document with the smallest id stays."""
    rows = docs.select(*COLUMNS)
    copies = icws.classes(rows).filter("class_id <> doc_id").select(F.col("doc_id").alias("copy_id"))
    return rows.join(copies, F.col("doc_id") == F.col("copy_id"), "left_anti")


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by windows that also start in an earlier document go; untouched texts stay as they are."""
    return _with_text(substring.remove_repeats(docs.select(*COLUMNS), rebuilt=False), "kept_text")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their places in sequences of 1024 tokens."""
    return packing.pack(packing.cut_pieces(docs, tokenizer_path("byte_bpe_50k.json")))


STAGES = [
    ("quality rules", quality),
    ("language ID", language),
    ("near-duplicates", near_duplicates),
    ("substring dedup", substrings),
    ("packing", pack),
]

#: No SQL: the language field and the sampling are no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    ship_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
