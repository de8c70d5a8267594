"""Nearest vectors through randomly rotated one-bit codes with error bounds.

A unit vector is turned by a fixed random rotation into a larger space and kept as the signs of its coordinates,
packed, with one scalar: its inner product with its own code. From both, the inner product with a
query is estimated without bias, and the scalar gives the width of an interval around the
estimate. Only vectors whose upper end reaches the query's k-th best exact value are compared exactly.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwise.llm.store import stored

BITS_PER_DIM = 4  # code bits for each dimension: halves the error of one bit a dimension
EPSILON = 2.6  # width of the interval in units of the estimate's spread
QUERY_BLOCK = 1024
CODE_BLOCK = 16_384


@lru_cache(4)
def rotation(dim: int, seed: int) -> np.ndarray:
    """``dim`` orthonormal rows in a space of ``BITS_PER_DIM * dim`` dimensions, at least 64, a multiple of eight."""
    wide = -(-max(64, BITS_PER_DIM * dim) // 8) * 8
    turned, upper = np.linalg.qr(np.random.default_rng(seed).standard_normal((wide, dim)))
    return np.ascontiguousarray((turned * np.sign(np.diag(upper))).T)


def encode(unit: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed sign bits of rotated unit vectors, and their inner products with their own codes."""
    turned = unit @ rotation(unit.shape[1], seed)
    return np.packbits(turned > 0, axis=1), np.abs(turned).sum(axis=1) / np.sqrt(turned.shape[1])


def estimate(codes: np.ndarray, own: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated inner products (code x query), and the half width of each code's interval."""
    wide = codes.shape[1] * 8
    signs = np.unpackbits(codes, axis=1).astype(np.float32) * 2 - 1
    found = (signs @ queries.T.astype(np.float32)) / (own[:, None] * np.sqrt(wide)).astype(np.float32)
    return found, EPSILON * np.sqrt(np.maximum(0.0, 1 - own**2) / own**2 / (wide - 1))


def usable(vector: Column) -> Column:
    """Not null, not zero, without null or non-finite components."""
    value = vector.cast("array<double>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(value, finite) & F.exists(value, lambda x: x != 0.0)


def _norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda total, x: total + x * x))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda total, x: total + x)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    seed: int = 11,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest other rows of each query row by cosine.

    Equal vectors are searched once: a distinct vector keeps its ``k + 1`` smallest ids, more can never be
    among ``k`` results. The work is (distinct query vectors) x (distinct vectors) over their codes, in blocks of
    fixed size; what is broadcast is nothing.

    1. Every pair of blocks gives each query its best candidates by estimate; their exact values
       set a floor under the query's result.
    2. A second pass over the blocks keeps all candidates whose interval reaches the floor; these are compared
       exactly.

    Vectors that are null, zero or hold null or non-finite components take no part; vectors of different
    length are never compared. Rows with a null id take no part. A row id that repeats with the same vector counts
    once. No usable rows give an empty result; other columns are ignored. Ties go to the smaller id.
    """
    rows = (
        vectors.select(
            F.col(id_col).cast("long").alias("id"),
            F.col(vector_col).cast("array<double>").alias("v"),
            is_query.alias("q"),
        )
        .filter(F.col("id").isNotNull() & usable(F.col("v")))
        .distinct()
    )
    keyed = rows.withColumn("key", F.sha2(F.to_json(F.struct("v")), 256))
    order = F.row_number().over(_by("key", "id"))
    ids = keyed.select("key", "id").withColumn("r", order).filter(F.col("r") <= k + 1)
    ids = stored(ids.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")), "ann-ids")
    asked = stored(keyed.filter("q").select("key", F.col("id").alias("query_id")), "ann-queries")
    # One row for each distinct vector; `wanted` marks those that some query holds.
    marks = keyed.groupBy("key").agg(F.first("v").alias("v"), F.max("q").alias("wanted"))
    distinct = stored(marks.withColumn("dim", F.size("v")), "ann-vectors")
    counts = distinct.agg(F.count("*").alias("n"), F.count_if("wanted").alias("q")).first()
    code_blocks = max(1, -(-counts["n"] // CODE_BLOCK))
    query_blocks = max(1, -(-counts["q"] // QUERY_BLOCK))
    codes = stored(_codes(distinct, code_blocks, seed), "ann-codes")
    queries = distinct.filter("wanted").select("key", "v", "dim")
    near = _pass(codes, queries.withColumn("floor", F.lit(None).cast("double")), code_blocks, query_blocks, k + 1, seed)
    first = stored(_exact(near, distinct, ids, k), "ann-first")
    floor = first.groupBy("qkey").agg(F.sort_array(F.collect_list("cosine"), asc=False).alias("c"))
    # A row of `first` stands for at least one id, so the k-th value of its list is a lower bound.
    floor = floor.select(F.col("qkey").alias("key"), F.get("c", F.lit(k)).alias("floor"))
    second = _pass(codes, queries.join(floor, "key", "left"), code_blocks, query_blocks, None, seed)
    found = _exact(second.unionByName(near).dropDuplicates(["qkey", "key"]), distinct, ids, k)
    pairs = found.select("qkey", "cosine", F.explode("ids").alias("vec_id"))
    best = pairs.withColumn("r", F.row_number().over(_by("qkey", F.desc("cosine"), "vec_id"))).filter(F.col("r") <= k + 1)
    mine = asked.join(best.withColumnRenamed("qkey", "key"), "key").filter("query_id <> vec_id")
    ranked = mine.withColumn("rank", F.row_number().over(_by("query_id", F.desc("cosine"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("cosine").alias("score"))


def _by(key: str, *order: str | Column):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(*order)


def _codes(distinct: DataFrame, blocks: int, seed: int) -> DataFrame:
    """Vectors as packed codes, gathered into blocks of about ``CODE_BLOCK``."""
    schema = "key string, dim int, block int, code binary, own double"

    def encode_rows(batches):
        for batch in batches:
            frame = pd.DataFrame({c: batch.column(c).to_pylist() for c in ("key", "dim")})
            lists = batch.column("v")
            for dim in sorted(set(frame["dim"])):
                at = np.flatnonzero(frame["dim"] == dim)
                v = lists.take(pa.array(at)).flatten().to_numpy().reshape(-1, dim)
                v = v / np.abs(v).max(axis=1, keepdims=True)
                code, own = encode(v / np.linalg.norm(v, axis=1, keepdims=True), seed)
                yield pa.RecordBatch.from_pydict(
                    {
                        "key": [frame["key"][i] for i in at],
                        "dim": pa.array([dim] * len(at), pa.int32()),
                        "block": pa.array([int(frame["key"][i][:12], 16) % blocks for i in at], pa.int32()),
                        "code": [c.tobytes() for c in code],
                        "own": own,
                    }
                )

    return distinct.select("key", "dim", "v").mapInArrow(encode_rows, schema)


def _pass(codes: DataFrame, queries: DataFrame, code_blocks: int, query_blocks: int, top: int | None, seed: int) -> DataFrame:
    """Pairs ``qkey, key`` of one pass over all pairs of blocks.

    With ``top`` the best of every block by estimate; else all whose interval reaches the query's floor.
    """
    block = F.pmod(F.xxhash64("key"), F.lit(query_blocks)).cast("int")
    left = queries.select(
        "dim", block.alias("qb"), F.explode(F.sequence(F.lit(0), F.lit(code_blocks - 1))).alias("cb"), "key", "v", "floor"
    )
    right = codes.select(
        "dim", F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.col("block").alias("cb"), "key", "code", "own"
    )

    def compare(asked: pd.DataFrame, coded: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(coded):
            return pd.DataFrame({"qkey": [], "key": []}, dtype=str)
        v = np.stack(asked["v"].to_numpy())
        v = v / np.abs(v).max(axis=1, keepdims=True)
        turned = (v / np.linalg.norm(v, axis=1, keepdims=True)) @ rotation(v.shape[1], seed)
        bits = np.frombuffer(b"".join(coded["code"]), np.uint8).reshape(len(coded), -1)
        qkeys, keys = asked["key"].to_numpy(object), coded["key"].to_numpy(object)
        floors = asked["floor"].to_numpy(float)
        out_q, out_k = [], []
        for low in range(0, len(asked), 128):  # bounds the table of estimates
            found, width = estimate(bits, coded["own"].to_numpy(), turned[low : low + 128])
            if top is not None:
                n = min(top, len(coded))
                at = np.argpartition(-found, n - 1, axis=0)[:n]
                cols = np.broadcast_to(np.arange(found.shape[1]), at.shape)
                at, cols = at.ravel(), cols.ravel()
            else:
                upper = found + width[:, None].astype(np.float32)
                bound = floors[low : low + 128]
                at, cols = np.nonzero(~(upper < np.where(np.isnan(bound), -np.inf, bound)[None, :] - 1e-6))
            out_k.append(keys[at])
            out_q.append(qkeys[low + cols])
        return pd.DataFrame({"qkey": np.concatenate(out_q), "key": np.concatenate(out_k)})

    grouped = left.groupBy("dim", "qb", "cb").cogroup(right.groupBy("dim", "qb", "cb"))
    return grouped.applyInPandas(compare, "qkey string, key string")


def _exact(pairs: DataFrame, distinct: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Cosines of the original vectors, with the ids that a vector stands for."""
    own = distinct.select("key", "v").join(ids, "key")
    asked = distinct.filter("wanted").select(F.col("key").alias("qkey"), F.col("v").alias("qv"))
    both = pairs.join(own, "key").join(asked, "qkey")
    cosine = _dot(F.col("v"), F.col("qv")) / (_norm(F.col("v")) * _norm(F.col("qv")))
    return both.select("qkey", "key", "ids", cosine.alias("cosine"))
