"""Weighted shards by rendezvous hashing of record keys.

Every shard draws a number from the digest of (key, shard); the shard whose draw, scaled by its weight, is
best owns the record. A draw depends on nothing else, so a shard that is added, removed or given
another weight only takes rows into itself or gives its own away.

Layout of an output folder: ``rows/shard=<s>/*.parquet``, each file a run of the shard's shuffled order, and
``parts/*.parquet`` with the rows, bytes and first slot of every run, ``schema`` with the columns. A row keeps its place in its run; adding
the run's first slot gives its slot in the shard, so no task numbers more than one run.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafwise.functions.frames import settle

DIGITS = 13  # hexadecimal digits of a digest that make a draw
ROW_BYTES = 16  # what a record takes besides its text
PART_BYTES = 128 << 20
MOST_CUTS = 100_000  # runs whose cuts are sent to all tasks (about 2 MB)
ADDED = ("shard", "grown_shard", "size", "law", "slot", "part", "place")


def draw(text: Column) -> Column:
    """A number strictly between 0 and 1 from the MD5 digest of ``text``."""
    digits = F.conv(F.substring(F.md5(text), 1, DIGITS), 16, 10).cast("double")
    return (digits + 0.5) / float(16**DIGITS)


def key_text(key: Column) -> Column:
    """The text that stands for a key; null is a key of its own."""
    return F.when(key.isNull(), F.lit("n")).otherwise(F.concat(F.lit("k"), key.cast("string")))


def _checked(weights: Sequence[float]) -> list[float]:
    if not any(w > 0 for w in weights) or not all(0 <= w < float("inf") for w in weights):
        raise ValueError("weights must be finite and not negative, and one of them above 0")
    return [float(w) for w in weights]


def assign(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] = (), key: str = "doc_id") -> DataFrame:
    """Add ``shard`` (int) to ``docs``, and ``grown_shard``: the shard if ``grown`` more shards stood behind the others.

    Weight 0 gives a shard no rows; equal draws go to the smaller shard number. Rows with equal keys share a
    shard, those with a null key too; nothing but the key and the weights decides. Other columns are kept,
    those called ``shard`` or ``grown_shard`` are replaced; an empty table stays empty.
    """
    shares = _checked([*_checked(weights), *grown])
    kept = [c for c in docs.columns if c not in ("shard", "grown_shard")]
    shards = F.array(*[F.struct(F.lit(s).alias("s"), F.lit(w).alias("w")) for s, w in enumerate(shares) if w > 0])
    first = sum(w > 0 for w in weights)
    name = key_text(F.col(f"`{key}`"))
    scored = F.transform(
        shards, lambda x: F.struct((-F.ln(draw(F.concat(name, F.lit(":"), x["s"].cast("string")))) / x["w"]).alias("d"), x["s"].alias("s"))
    )
    rows = settle(docs.select(*[F.col(f"`{c}`") for c in kept]), {"__draws": scored})
    return rows.select(
        *[F.col(f"`{c}`") for c in kept],
        F.array_min(F.slice("__draws", 1, first))["s"].alias("shard"),
        F.array_min("__draws")["s"].alias("grown_shard"),
    )


def moved(docs: DataFrame, before: Sequence[float], after: Sequence[float], key: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that another set of weights puts elsewhere, with ``from_shard`` and ``to_shard``.

    Shards keep their numbers: a removed shard gets weight 0.
    """
    kept = [c for c in docs.columns if c not in ("from_shard", "to_shard", "shard", "grown_shard")]
    old = assign(docs.select(*[F.col(f"`{c}`") for c in kept]), before, key=key).withColumnRenamed("shard", "from_shard")
    new = assign(old, after, key=key).withColumnRenamed("shard", "to_shard")
    return new.filter(F.col("from_shard") != F.col("to_shard")).drop("grown_shard")


def write_shards(
    docs: DataFrame,
    path: str,
    weights: Sequence[float],
    grown: Sequence[float] = (),
    key: str = "doc_id",
    text: str = "text",
    part_bytes: int = PART_BYTES,
) -> None:
    """Write ``docs`` with ``shard, grown_shard, size`` to a folder of shards.

    Inside a shard rows stand in the order of a digest of key and text. Its share of the bytes, in runs of about
    ``part_bytes``, gives the number of runs. A run that holds twice as much, as where one row is repeated over and
    over, is dealt over more runs, each ordered in itself. ``size`` is the UTF-8 bytes of the text (null: none) and
    16. Columns called as in ``ADDED`` are replaced, others are written as they are. An empty table gives empty files.
    """
    shares = _checked(weights)
    rows = assign(docs.drop(*ADDED), weights, grown, key)
    total = docs.agg(F.sum(F.octet_length(F.coalesce(F.col(text), F.lit(""))) + F.lit(ROW_BYTES).cast("long")).alias("n"))
    total = total.first()["n"] or 0
    runs = [max(1, round(total * w / sum(shares) / part_bytes)) for w in shares]
    firsts = [sum(runs[:s]) for s in range(len(runs))]
    size = (F.octet_length(F.coalesce(F.col(text), F.lit(""))) + ROW_BYTES).cast("long")
    mark = F.md5(F.concat(key_text(F.col(f"`{key}`")), F.lit(":"), F.coalesce(F.col(text), F.lit(""))))
    here = (F.conv(F.substring("__mark", 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)) * F.get(F.lit(runs), F.col("shard"))
    marked = settle(rows.withColumn("size", size), {"__mark": mark}).withColumn(
        "part", (F.get(F.lit(firsts), F.col("shard")) + F.floor(here)).cast("int")
    )
    placed, n = _cut(marked, part_bytes, sum(runs))
    inside = Window.partitionBy("__run").orderBy("part", "__mark", F.col(f"`{key}`"))
    numbered = placed.repartitionById(n, F.col("__run")).withColumn("place", F.row_number().over(inside) - 1)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in ADDED]
    out = numbered.select(*kept, "size", "grown_shard", F.col("__run").alias("part"), "place", "shard", F.col("part").alias("__of"))
    out.write.partitionBy("shard").parquet(f"{path}/rows")
    spark = docs.sparkSession
    spark.createDataFrame([], out.schema).write.parquet(f"{path}/schema")
    written = spark.read.schema("part int, __of int, shard int, size long").parquet(f"{path}/rows")
    parts = written.groupBy("shard", "part").agg(F.min("__of").alias("of"), F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"))
    before = Window.partitionBy("shard").orderBy("of", "part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("first_slot", F.coalesce(F.sum("n_rows").over(before), F.lit(0)))
    parts.drop("of").write.parquet(f"{path}/parts")


def _cut(marked: DataFrame, part_bytes: int, n: int) -> tuple[DataFrame, int]:
    """``marked`` with ``__run``, the part or one of the further runs of a part that holds too much, and the number of runs."""
    spark = marked.sparkSession
    full = marked.groupBy("part").agg(F.sum("size").alias("b"), F.count("*").alias("c")).filter((F.col("b") > 2 * part_bytes) & (F.col("c") > 1))
    full = full.select("part", F.least(F.col("c"), F.ceil(F.col("b") / part_bytes)).cast("int").alias("cuts")).orderBy("part")
    extra, cuts = n, []
    for part, k in full.toLocalIterator():  # parts of over twice their share: at most half as many as there are runs
        cuts.append((part, k, extra))
        extra += k - 1
    if not cuts:
        return marked.withColumn("__run", F.col("part")), n
    table = spark.createDataFrame(cuts, "part int, __cuts int, __first int")
    table = F.broadcast(table) if len(cuts) <= MOST_CUTS else table
    dealt = marked.withColumn("__deal", F.monotonically_increasing_id()).join(table, "part", "left")
    k = F.pmod("__deal", F.col("__cuts"))
    run = F.when(F.col("__cuts").isNull() | (k == 0), F.col("part")).otherwise(F.col("__first") + k - 1)
    return dealt.withColumn("__run", run.cast("int")), extra


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """The written rows with ``shard``, ``slot`` (gapless from 0 in every shard) and ``law``; filters on ``shard`` prune folders."""
    # The columns of the files and, last, the shard, whose type no folder name may decide.
    fields = spark.read.parquet(f"{path}/schema").schema.fields
    schema = T.StructType([f for f in fields if f.name != "shard"] + [T.StructField("shard", T.IntegerType())])
    rows = spark.read.schema(schema).parquet(f"{path}/rows")
    parts = spark.read.schema("shard int, part int, first_slot long").parquet(f"{path}/parts").select("part", "first_slot")
    slot = (F.col("first_slot") + F.col("place")).alias("slot")
    kept = [F.col(f"`{c}`") for c in rows.columns if c not in ("part", "place", "__of", "shard")]
    return rows.join(parts, "part").select(*kept, "shard", slot, F.lit("key").alias("law"))


N_SHARDS = 40

#: CRC-32 bytewise over a table built from its polynomial; draws and slots as above.
SQL = f"""
WITH tab_ AS (SELECT list(v ORDER BY i) AS tab FROM (
    SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v FROM range(256) r(i))),
  rows_ AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t,
    CASE WHEN doc_id IS NULL THEN 'n' ELSE 'k' || doc_id END AS k FROM documents),
  draw_ AS (SELECT rid, s, -ln((('0x' || substr(md5(k || ':' || s), 1, {DIGITS}))::UBIGINT + 0.5) / {16**DIGITS}) AS d
            FROM rows_, range({N_SHARDS + 1}) r(s)),
  best_ AS (SELECT rid, arg_min(s, d) FILTER (s < {N_SHARDS}) AS shard, arg_min(s, d) AS grown FROM draw_ GROUP BY rid),
  byte_ AS (SELECT rid, list_transform(regexp_extract_all(hex(encode(t)), '..'), lambda x: ('0x' || x)::UBIGINT) AS bytes
            FROM rows_),
  crc_ AS (SELECT rid, xor(list_reduce(list_concat([4294967295::UBIGINT], bytes),
      lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255)::BIGINT + 1])), 4294967295)::BIGINT AS crc FROM byte_, tab_)
SELECT doc_id, strlen(t)::BIGINT + {ROW_BYTES} AS size, crc AS text_crc32, 'key' AS law, shard::INT AS shard,
  row_number() OVER (PARTITION BY shard ORDER BY md5(k || ':' || t), doc_id) - 1 AS slot, grown::INT AS grown_shard
FROM rows_ JOIN best_ USING (rid) JOIN crc_ USING (rid)"""
