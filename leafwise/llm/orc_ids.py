"""Token ids as ORC: integer run-length encoding, row indexes and Bloom filters on document ids.

Layout of an output folder: ``ids/part=<k>/*.orc`` with one file for each range of document ids, rows in
ascending ``doc_id`` order, and ``parts/*.orc`` with the rows and ids of every range. A row keeps its
place inside the range; adding the ids of the ranges before gives the place in the whole corpus, so
no task ever numbers more than its own range.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwise.llm.encoders import ENCODE_SLICE, encoder
from leafwise.llm.words import slices

END_ID = 2
BYTES_PER_PART = 32 << 20  # text bytes in one range
ORC_OPTIONS = {
    "compression": "zlib",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "orc.create.index": "true",
    "orc.row.index.stride": "10000",
    "orc.stripe.size": str(64 << 20),
    "orc.compress.size": str(256 << 10),
}


def ranges(docs: DataFrame, bytes_per_part: int = BYTES_PER_PART) -> list[int]:
    """Lower ends of all ranges but the first: quantiles of ``doc_id``, read from that column alone."""
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    parts = min(100_000, size // bytes_per_part + 1)
    if parts == 1:
        return []
    shares = [k / parts for k in range(1, parts)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 10 * parts).alias("cuts")).first()["cuts"]
    return sorted(set(cuts or []))


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, bytes_per_part: int = BYTES_PER_PART
) -> None:
    """Encode every text, append ``end_id`` and write the ids in ascending ``doc_id`` order.

    Null texts count as empty (only the end id); a null ``doc_id`` comes first; rows with equal
    ids stay together, ordered by text. Other columns of ``docs`` are ignored. An empty table gives empty files.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cuts = ranges(rows, bytes_per_part)
    part = F.lit(0)
    if cuts:
        # Binary search over the literal quantiles: they are sorted, and none is null.
        part = F.coalesce(F.expr(_bucket(cuts, 0, len(cuts))), F.lit(0))
    placed = rows.withColumn("part", part.cast("int"))
    sorted_rows = placed.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "doc_id", "text")

    def encode(batches):
        encode_texts = encoder(tokenizer).encode
        part_now, total = None, 0
        for batch in batches:
            for rows_ in slices(batch, limit=ENCODE_SLICE):
                ids, bounds = encode_texts(rows_.column("text"))
                n = rows_.num_rows
                flat = np.insert(ids.astype(np.int32), bounds[1:], end_id)
                ends = bounds + np.arange(n + 1)
                parts = rows_.column("part").to_numpy()
                starts = np.empty(n, np.int64)
                for k in np.unique(parts):
                    at = np.flatnonzero(parts == k)
                    if k != part_now:
                        part_now, total = k, 0
                    starts[at] = ends[at] - ends[at[0]] + total
                    total += int(ends[at[-1] + 1] - ends[at[0]])
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat))
                columns = [rows_.column("doc_id"), pa.array(starts), pa.array(np.diff(ends)), lists, rows_.column("part")]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "local_start", "n_tokens", "ids", "part"])

    schema = "doc_id long, local_start long, n_tokens long, ids array<int>, part int"
    out = sorted_rows.mapInArrow(encode, schema)
    out.write.options(**ORC_OPTIONS).partitionBy("part").orc(f"{path}/ids")
    spark = docs.sparkSession
    totals = _files(spark, path).groupBy("part").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_ids"))
    # One row for each file: the only ordering over all of them.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("ids_before", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    totals.coalesce(1).write.orc(f"{path}/parts")


def _bucket(cuts: list[int], low: int, high: int) -> str:
    if low == high:
        return str(low)
    mid = (low + high) // 2
    return f"IF(doc_id >= {cuts[mid]}L, {_bucket(cuts, mid + 1, high)}, {_bucket(cuts, low, mid)})"


def _files(spark: SparkSession, path: str) -> DataFrame:
    schema = "doc_id long, local_start long, n_tokens long, ids array<int>, part int"
    return spark.read.schema(schema).orc(f"{path}/ids")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` from the files; ``start`` is the number of ids of all rows before.

    Filters on ``doc_id`` are pushed to ORC: stripes and row groups go by their minima and maxima,
    equality also by the Bloom filters. Stripes are read in parallel.
    """
    parts = spark.read.schema("part int, n_docs long, n_ids long, ids_before long").orc(f"{path}/parts")
    rows = _files(spark, path).join(parts.select("part", "ids_before"), "part")
    return rows.select("doc_id", (F.col("local_start") + F.col("ids_before")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def digest(batches):
        for batch in batches:
            lists = batch.column("ids")
            ends = np.frombuffer(lists.buffers()[1], np.int32)[lists.offset : lists.offset + len(lists) + 1]
            flat = lists.values.to_numpy(zero_copy_only=False).astype("<u4")
            crcs = [zlib.crc32(flat[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            columns = [batch.column(c) for c in ("doc_id", "start", "n_tokens")] + [pa.array(crcs, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, schema)
