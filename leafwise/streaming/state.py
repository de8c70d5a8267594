"""Keyed state of a stream as files: a base that holds all keys, and the changes since.

``base=<n>`` holds the newest state of every key up to micro-batch n, ``delta=<n>`` the keys that micro-batch n changed.
Changes are merged into a new base every so many micro-batches, so what a reader opens depends on the number of keys and on
that interval, not on how long the stream has run. A folder counts once its ``_SUCCESS`` marker stands.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

MERGE_EVERY = 16


def upsert_state(
    result: DataFrame, keys: list[str], folder: str, checkpoint: str, merge_every: int = MERGE_EVERY
) -> StreamingQuery:
    """Run the stream ``result`` over all that has arrived and keep the newest row of each key in ``folder``.

    A micro-batch that is repeated after a failure replaces its own changes by the same rows, and finds a base that it had
    already merged. Folders are deleted one merge late: a reader has ``merge_every`` micro-batches to end.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("_epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{folder}/delta={epoch}")
        if (epoch + 1) % merge_every == 0:
            merge_state(batch.sparkSession, keys, folder, epoch)

    writer = result.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(write).trigger(availableNow=True).start()


def current_state(spark: SparkSession, keys: list[str], folder: str) -> DataFrame:
    """The newest row of every key, from the last base and the changes after it."""
    return _newest(_rows(spark, folder), keys).drop("_epoch")


def merge_state(spark: SparkSession, keys: list[str], folder: str, epoch: int) -> None:
    """Write ``base=<epoch>`` unless it is there, and delete what only bases before the last one needed."""
    bases, deltas = _folders(spark, folder)
    if epoch not in bases:
        _newest(_rows(spark, folder), keys).write.mode("overwrite").parquet(f"{folder}/base={epoch}")
    kept = max((b for b in bases if b < epoch), default=None)
    if kept is None:
        return
    system, root = _system(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in [f"base={b}" for b in bases if b < kept] + [f"delta={d}" for d in deltas if d <= kept]:
        system.delete(path(root, name), True)


def _newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    rest = [c for c in rows.columns if c not in (*keys, "_epoch")]
    newest = F.max_by(F.struct(*rest), "_epoch").alias("_s")
    return rows.groupBy(*keys).agg(newest, F.max("_epoch").alias("_epoch")).select(*keys, "_s.*", "_epoch")


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    bases, deltas = _folders(spark, folder)
    last = max(bases, default=-1)
    names = [f"base={last}"] * (last >= 0) + [f"delta={d}" for d in sorted(deltas) if d > last]
    if not names:
        raise ValueError(f"no state under {folder}")
    return spark.read.parquet(*[f"{folder}/{name}" for name in names])


def _system(spark: SparkSession, folder: str):
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return root.getFileSystem(spark._jsc.hadoopConfiguration()), root


def _folders(spark: SparkSession, folder: str) -> tuple[set[int], set[int]]:
    """Numbers of the whole bases and of the whole changes: a few dozen folders at any time."""
    system, root = _system(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path
    found: dict[str, set[int]] = {"base": set(), "delta": set()}
    for status in system.listStatus(root) if system.exists(root) else ():
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and number.isdigit() and system.exists(path(status.getPath(), "_SUCCESS")):
            found[kind].add(int(number))
    return found["base"], found["delta"]
