"""Ordered-sequence primitives that never need a whole sequence in one task.

A plain ``Window.partitionBy("volume_id")`` sorts one volume in one task, so a single
volume holding a large share of the rows stalls the job. The functions here split every
sequence into chunks of consecutive positions and combine the chunks:

* ``halo`` / ``with_neighbours`` copy the few rows at a chunk border into the next chunk,
  so lag, lead and short range frames need one exchange on (keys, chunk);
* ``running`` carries sums and nearest values across chunks through a small summary table;
* ``ranked`` and ``number_rows`` number rows along any order. Rows are bucketed by splitters of the whole
  sort key, group included, that come from a sample: a group with a large share of the rows takes as large a share
  of the splitters and is sorted in that many tasks, whatever its keys have in common;
* ``group_median`` is the exact median through value counts, on buckets of the same kind.

One plan serves every group size, and building it starts no job.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafwise.functions.frames import settle

CHUNK_BITS_CONF = "leafwise.chunkBits"
DEFAULT_CHUNK_BITS = 14
BUCKETS = 256
SAMPLED = 16  # sampled rows for each bucket


def chunk_bits(spark: SparkSession) -> int:
    """log2 of the number of positions in one chunk."""
    return int(spark.conf.get(CHUNK_BITS_CONF, str(DEFAULT_CHUNK_BITS)))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over a fixed number of partitions, ahead of costly work on few bytes.

    Adaptive execution sizes partitions by bytes and would put such rows into one task.
    """
    spark = df.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    return df.repartition(tasks, *keys)


def halo(
    df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int, bits: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Rows with ``_chunk``, plus copies of border rows (``_copy`` true) for the adjacent chunks.

    Each chunk then holds the ``before`` positions ahead of it and the ``after`` positions behind
    it. Returns the rows and the column list to partition a window by.
    """
    bits = chunk_bits(df.sparkSession) if bits is None else bits
    size = 1 << bits
    if max(before, after) > size:
        raise ValueError("the halo is wider than a chunk")
    rest = F.col(pos).bitwiseAND(F.lit(size - 1))
    shifts = F.array_compact(
        F.array(
            F.lit(0),
            F.when(rest < after, F.lit(-1)),
            F.when(rest >= size - before, F.lit(1)),
        )
    )
    rows = (
        df.withColumn("_shift", F.explode(shifts))
        .withColumn("_chunk", F.shiftright(F.col(pos), bits) + F.col("_shift"))
        .withColumn("_copy", F.col("_shift") != 0)
        .drop("_shift")
    )
    return rows, [*keys, "_chunk"]


def own_rows(rows: DataFrame) -> DataFrame:
    """Drop the border copies made by ``halo``."""
    return rows.where(~F.col("_copy")).drop("_copy", "_chunk")


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    shifts: Mapping[str, int],
    payload: Sequence[str],
    bits: int | None = None,
    costly: bool = False,
) -> DataFrame:
    """Attach the rows ``shift`` places away as struct columns (null beyond the ends).

    ``pos`` must be dense and unique within ``keys``. Large rows want small chunks (``bits``);
    ``costly`` work behind the lookup wants a fixed number of tasks.
    """
    rows, parts = halo(df, keys, pos, max(0, -min(shifts.values())), max(0, max(shifts.values())), bits)
    if costly:
        rows = spread(rows, *parts)
    order = Window.partitionBy(*parts).orderBy(pos)
    value = F.struct(*payload)
    return own_rows(
        rows.withColumns(
            {
                name: (F.lag(value, -shift) if shift < 0 else F.lead(value, shift)).over(order)
                for name, shift in shifts.items()
            }
        )
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    pos: str,
    sums: Mapping[str, Column] | None = None,
    before: Mapping[str, Column] | None = None,
    after: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    later_sums: Mapping[str, Column] | None = None,
    later_mins: Mapping[str, Column] | None = None,
    maxes: Mapping[str, Column] | None = None,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Add running values along ``pos`` (then ``tie``).

    ``sums`` and ``maxes`` are inclusive running values; ``before`` is the nearest non-null value strictly
    earlier; ``after`` the nearest non-null value at or later; ``totals`` are whole-group sums;
    ``later_sums`` and ``later_mins`` cover the rows from the current one to the end.
    """
    sums, before, after, totals = sums or {}, before or {}, after or {}, totals or {}
    later_sums, later_mins, maxes = later_sums or {}, later_mins or {}, maxes or {}
    bits = chunk_bits(df.sparkSession)
    wanted = {**sums, **before, **after, **totals, **later_sums, **later_mins, **maxes}
    inputs = {f"_in_{n}": c for n, c in wanted.items()}
    rows = df.withColumns({**inputs, "_chunk": F.shiftright(F.col(pos), bits)})
    rank = F.struct(pos, *tie)

    aggs = [F.sum(f"_in_{n}").alias(f"_part_{n}") for n in [*sums, *totals, *later_sums]]
    aggs += [F.min(f"_in_{n}").alias(f"_part_{n}") for n in later_mins]
    aggs += [F.max(f"_in_{n}").alias(f"_part_{n}") for n in maxes]
    aggs += [F.max_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), rank)).alias(f"_part_{n}") for n in before]
    aggs += [F.min_by(f"_in_{n}", F.when(F.col(f"_in_{n}").isNotNull(), rank)).alias(f"_part_{n}") for n in after]
    rows = rows.where(_all_known([*keys, "_chunk"]))
    chunks = rows.groupBy(*keys, "_chunk").agg(*aggs)
    # A group inside one chunk carries nothing: its row is left out, and often the table is small enough for a broadcast.
    chunks = chunks.withColumn("_chunks", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where(F.col("_chunks") > 1)
    along = Window.partitionBy(*keys).orderBy("_chunk")
    earlier = along.rowsBetween(Window.unboundedPreceding, -1)
    later = along.rowsBetween(1, Window.unboundedFollowing)
    carried = chunks.select(
        *keys,
        "_chunk",
        *[F.coalesce(F.sum(f"_part_{n}").over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in sums],
        *[F.last(f"_part_{n}", ignorenulls=True).over(earlier).alias(f"_carry_{n}") for n in before],
        *[F.first(f"_part_{n}", ignorenulls=True).over(later).alias(f"_carry_{n}") for n in after],
        *[F.sum(f"_part_{n}").over(Window.partitionBy(*keys)).alias(f"_carry_{n}") for n in totals],
        *[F.coalesce(F.sum(f"_part_{n}").over(later), F.lit(0)).alias(f"_carry_{n}") for n in later_sums],
        *[F.min(f"_part_{n}").over(later).alias(f"_carry_{n}") for n in later_mins],
        *[F.max(f"_part_{n}").over(earlier).alias(f"_carry_{n}") for n in maxes],
    )

    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos, *tie)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = inside.rowsBetween(Window.unboundedPreceding, -1)
    behind = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    local = {f"_here_{n}": F.sum(f"_in_{n}").over(upto) for n in sums}
    local |= {f"_here_{n}": F.last(f"_in_{n}", ignorenulls=True).over(ahead) for n in before}
    local |= {f"_here_{n}": F.first(f"_in_{n}", ignorenulls=True).over(behind) for n in after}
    local |= {f"_here_{n}": F.sum(f"_in_{n}").over(behind) for n in later_sums}
    local |= {f"_here_{n}": F.min(f"_in_{n}").over(behind) for n in later_mins}
    local |= {f"_here_{n}": F.max(f"_in_{n}").over(upto) for n in maxes}
    local |= {f"_here_{n}": F.sum(f"_in_{n}").over(Window.partitionBy(*keys, "_chunk")) for n in totals}
    joined = rows.withColumns(local).join(carried, [*keys, "_chunk"], "left")
    out = {n: F.coalesce(f"_carry_{n}", F.lit(0)) + F.col(f"_here_{n}") for n in [*sums, *later_sums]}
    out |= {n: F.least(f"_here_{n}", f"_carry_{n}") for n in later_mins}
    out |= {n: F.greatest(f"_here_{n}", f"_carry_{n}") for n in maxes}
    out |= {n: F.coalesce(f"_here_{n}", f"_carry_{n}") for n in [*before, *after]}
    out |= {n: F.coalesce(f"_carry_{n}", f"_here_{n}") for n in totals}
    kept = [c for c in df.columns if c not in out]
    return joined.select(*kept, *[c.alias(n) for n, c in out.items()])


def _all_known(columns: Sequence[str]) -> Column:
    """No null among the columns: rows without a group or a place are dropped."""
    known = F.lit(True)
    for name in columns:
        known = known & F.col(name).isNotNull()
    return known


def falling(number: Column | str) -> list[Column]:
    """Sort keys for a number from high to low, nulls last."""
    value = F.col(number) if isinstance(number, str) else number
    return [value.isNull(), -value]


def _keyed(df: DataFrame, order: Sequence[Column | str]) -> tuple[DataFrame, DataFrame]:
    """Rows with ``_key``, the values of ``order`` as one struct, and one row with ``_cuts``, the bounds of the buckets.

    Bounds are sampled keys: those with the smallest hashes, a number of rows that does not grow with the input.
    """
    settled = settle(df, {"_key": F.struct(*[(F.col(c) if isinstance(c, str) else c).alias(f"k{i}") for i, c in enumerate(order)])})
    n = _bucket_count(df.sparkSession)
    sample = settled.select("_key").orderBy(F.xxhash64("_key")).limit(SAMPLED * n)
    sampled = sample.agg(F.sort_array(F.collect_list("_key")).alias("_all"), F.count(F.lit(1)).alias("_n"))
    at = F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda k: F.get("_all", F.floor(k * F.col("_n") / n).cast("int")))
    return settled, sampled.select(F.when(F.col("_n") > 0, F.array_distinct(at)).alias("_cuts"))


def _bucket_count(spark: SparkSession) -> int:
    return 1 << (max(BUCKETS, int(spark.conf.get("spark.sql.shuffle.partitions"))) - 1).bit_length()


def _placed(keyed: DataFrame, cuts: DataFrame) -> DataFrame:
    """``_bucket``: the number of bounds below the key, by binary search."""
    n = _bucket_count(keyed.sparkSession)
    steps = F.array(*[F.lit(n >> k) for k in range(1, n.bit_length())])
    place = F.aggregate(
        steps,
        F.lit(0),
        lambda found, step: F.when(F.get("_cuts", found + step - 1) < F.col("_key"), found + step).otherwise(found),
    )
    return settle(keyed.withColumn("_cuts", cuts.scalar()), {"_bucket": place}).drop("_cuts")


def bucketed(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Rows with ``_key``, the values of ``order`` as one struct, and ``_bucket``, which never falls along it.

    Buckets are of about equal size over the whole table. Their bounds are found by a scalar subquery; keys are
    formed once a row, and a binary search finds the bucket.
    """
    return _placed(*_keyed(df, order))


def split_groups(cuts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The groups that may stand in several buckets: those of the bounds, fewer than the buckets."""
    bound = F.explode("_cuts").alias("_cut")
    return cuts.select(bound).select(*[F.col(f"_cut.k{i}").alias(name) for i, name in enumerate(keys)]).distinct()


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str, first: int = 1) -> DataFrame:
    """Dense numbers from ``first`` along ascending ``order``, which must be unique within ``keys``.

    Nulls come first; ``falling`` gives the sort keys of a descending number.
    """
    keyed, cuts = _keyed(df.where(_all_known(keys)), [*keys, *order])
    # Only a group with a bound inside goes on from bucket to bucket; no other group needs to be counted.
    split = keyed.join(split_groups(cuts, keys), list(keys), "left_semi") if keys else keyed
    sizes = _placed(split, cuts).groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*keys, "_bucket").orderBy("_key")
    return (
        _placed(keyed, cuts)
        .withColumn("_place", F.row_number().over(inside))
        .drop("_key")
        .join(offsets.where(F.col("_offset") > 0), [*keys, "_bucket"], "left")
        .withColumn(out, (F.coalesce("_offset", F.lit(0)) + F.col("_place") - 1 + first).cast("bigint"))
        .drop("_bucket", "_offset", "_place")
    )


def number_rows(
    df: DataFrame, keys: Sequence[str], key: str, out: str, tie: Sequence[Column | str] = (), first: int = 0
) -> DataFrame:
    """Dense numbers from ``first`` along ``key`` (then ``tie``), dense or sparse."""
    return ranked(df, keys, [key, *tie], out, first)


def ranked_with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], out: str, nexts: Mapping[str, str]
) -> DataFrame:
    """``ranked`` plus columns of the next-ranked row: ``nexts`` maps new names to columns."""
    rows = with_neighbours(ranked(df, keys, order, out), keys, out, {"_behind": 1}, [*nexts.values()])
    return rows.withColumns({name: F.col(f"_behind.{column}") for name, column in nexts.items()}).drop("_behind")


def group_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Exact median of ``value`` per group, one row per group; null where a group has no value.

    Values are counted first; the bucket that holds the middle ranks is found from bucket totals, and only
    that bucket's values are looked at in order.
    """
    groups = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    counts = bucketed(counts, [*keys, value]).drop("_key")
    upto = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    buckets = (
        counts.groupBy(*keys, "_bucket")
        .agg(F.sum("_c").alias("_c"))
        .withColumn("_to", F.sum("_c").over(upto))
        .withColumn("_from", F.col("_to") - F.col("_c"))
        .drop("_c")
        .join(groups, list(keys))
        .withColumns({"_low": F.expr("(_n - 1) div 2"), "_high": F.expr("_n div 2")})
        .where("(_low >= _from AND _low < _to) OR (_high >= _from AND _high < _to)")
    )
    inside = (
        Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    placed = (
        counts.join(buckets, [*keys, "_bucket"])
        .withColumn("_end", F.col("_from") + F.sum("_c").over(inside))
        .withColumn("_begin", F.col("_end") - F.col("_c"))
    )
    low = F.max(F.when((F.col("_low") >= F.col("_begin")) & (F.col("_low") < F.col("_end")), F.col(value)))
    high = F.max(F.when((F.col("_high") >= F.col("_begin")) & (F.col("_high") < F.col("_end")), F.col(value)))
    middle = placed.groupBy(*keys).agg(((low + high) / 2).alias(out))
    return groups.select(*keys).join(middle, list(keys), "left")
