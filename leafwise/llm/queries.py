"""One query for each operator over the given tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafwise.llm import (
    class_lm,
    crf_lang,
    filter_audit,
    icws,
    line_clean,
    onebit,
    orc_ids,
    packing,
    ranked_search,
    sharding,
    substring,
    token_cache,
    tree_bpe,
)
from leafwise.llm.encoders import tokenizer_path
from leafwise.llm.store import shared_path

LLM_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
LLM_ORACLES: dict[str, str] = {}


def _query(fn: Callable[[SparkSession, str], DataFrame]):
    LLM_QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


@_query
def op1_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a class model of six of seven of them."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = _remainder(7) == 2
    model, counts = class_lm.fit(docs.filter(~held_out))
    return class_lm.score(docs, model, counts, {"held_out": held_out})


@_query
def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents. The cache starts empty, so every distinct text is encoded once."""
    n_bytes = F.octet_length(F.coalesce("text", F.lit(""))).cast("long")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", n_bytes.alias("n_bytes"))
    counted = token_cache.count_tokens(docs, tokenizer_path("word_bpe_49k.json"), shared_path(spark, "token-cache"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


@_query
def op3_onebit_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth vector."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return onebit.search(vectors, F.col("vec_id") % 50 == 0, k=5)


@_query
def op4_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of all documents by tree concatenation, and what they decode to, as digests."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = tokenizer_path("word_bpe_49k.json")
    return tree_bpe.encode_documents(docs, path, then=tree_bpe.digests, schema=tree_bpe.DIGESTS)


@_query
def op5_line_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of line-first cleaning for all documents."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_clean.clean_lines(docs).select(*line_clean.OUT.split(", "))


LLM_ORACLES["op5_line_clean"] = line_clean.SQL


@_query
def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without words that earlier documents hold in windows of 13."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return substring.with_digest(substring.remove_repeats(docs))


LLM_ORACLES["op6_substring_dedup"] = substring.SQL


@_query
def op7_icws_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return icws.classes(_table(spark, sf_dir, "documents").select("doc_id", "text"))


@_query
def op8_orc_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token ids to ORC and read back."""
    path = shared_path(spark, "orc-ids")
    orc_ids.write_ids(_table(spark, sf_dir, "documents"), path, tokenizer_path("byte_bpe_50k.json"))
    return orc_ids.with_crc32(orc_ids.read_ids(spark, path))


@_query
def op9_crf_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of all documents by a field that learns from three of four labelled ones."""
    docs = _table(spark, sf_dir, "documents")
    held_out = _remainder(4) == 2
    model = crf_lang.fit(docs.filter(~held_out).select("lang", "text"))
    found = crf_lang.identify(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@_query
def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    pieces = packing.cut_pieces(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return packing.pack(pieces)


@_query
def op11_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of equal weight, read back from the shards' files."""
    path = shared_path(spark, "shards")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    sharding.write_shards(docs, path, [1.0] * sharding.N_SHARDS, grown=[1.0])
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    return sharding.read_shards(spark, path).select("doc_id", "size", crc, "law", "shard", "slot", "grown_shard")


LLM_ORACLES["op11_rendezvous"] = sharding.SQL


@_query
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What five filters remove from each language, in all orders of applying them."""
    return filter_audit.audit_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


LLM_ORACLES["op12_filter_audit"] = filter_audit.SQL


@_query
def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for every benchmark item."""
    return ranked_search.search_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


LLM_ORACLES["op13_ranked_search"] = ranked_search.SQL
