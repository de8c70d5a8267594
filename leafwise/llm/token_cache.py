"""Token counts through a cache keyed by digests of normalised content and of the tokenizer version."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from leafwise.llm.encoders import ENCODE_SLICE, encoder, version_digest
from leafwise.llm.words import slices

CACHE_SCHEMA = "digest string, version string, n_tokens long"


def normalised(text: Column) -> Column:
    """The content that decides the count: runs of blanks become one space, outer blanks go, null is empty.

    The tokenizer drops blanks and never looks across them, so texts with equal normal forms
    have equal counts. Only for tokenizers that do so (``word_bpe_49k.json``).
    """
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " "))


def read_cache(spark: SparkSession, cache_dir: str, version: str) -> DataFrame:
    """Stored counts of one tokenizer version; empty if there is no cache yet.

    Two appends at the same time may store a digest twice: both counts are equal, one is kept. Grouping by
    both keys leaves the later join an exchange of its own, which adaptive execution can split for a hot digest.
    """
    try:
        cache = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        cache = spark.createDataFrame([], CACHE_SCHEMA)
    stored = cache.filter(F.col("version") == version)
    return stored.groupBy("digest", "version").agg(F.min("n_tokens").alias("n_tokens")).drop("version")


def count_tokens(
    docs: DataFrame, tokenizer: str, cache_dir: str, collapse_blanks: bool = True, text: str = "text"
) -> DataFrame:
    """Add ``n_tokens`` to ``docs``, encoding only content that the cache does not hold.

    1. Digests (SHA-256) of the normalised texts are joined to the cache in ``cache_dir``.
    2. Content without a count is reduced to one row a digest, ahead of the shuffle as far as a
       partition goes, and encoded.
    3. The new counts are appended to the cache, from which all rows then take theirs.

    ``tokenizer`` is a tokenizers file; its digest with the library's version is part of the key, so
    another file or version never meets old counts. A null text counts as empty and has 0 tokens;
    repeated rows keep their number; an empty table gives an empty result. Other columns are kept; a
    column of ``docs`` called ``n_tokens`` is replaced.
    """
    spark = docs.sparkSession
    version = version_digest(tokenizer)
    content = normalised(F.col(text)) if collapse_blanks else F.coalesce(F.col(text), F.lit(""))
    digest = F.sha2(content, 256)
    new = (
        docs.select(digest.alias("digest"), F.col(text).alias("text"))
        .join(read_cache(spark, cache_dir, version), "digest", "left_anti")
        .groupBy("digest")
        .agg(F.first("text").alias("text"))
    )

    def encode(batches):
        counts = encoder(tokenizer).counts
        for batch in batches:
            for part in slices(batch, limit=ENCODE_SLICE):
                yield pa.RecordBatch.from_arrays(
                    [part.column("digest"), pa.array(counts(part.column("text")))], ["digest", "n_tokens"]
                )

    fresh = new.mapInArrow(encode, "digest string, n_tokens long")
    fresh.select("digest", F.lit(version).alias("version"), "n_tokens").write.mode("append").parquet(cache_dir)
    counts = read_cache(spark, cache_dir, version).select(F.col("digest").alias("__digest"), "n_tokens")
    kept = [c for c in docs.columns if c != "n_tokens"]
    keyed = docs.select(*[F.col(f"`{c}`") for c in kept], digest.alias("__digest"))
    return keyed.join(counts, "__digest", "left").select(*[F.col(f"`{c}`") for c in kept], "n_tokens")
