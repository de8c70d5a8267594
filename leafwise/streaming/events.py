"""Progress, export and review events, as streams or as batches.

Every function takes a DataFrame and works on a streaming or a static one. The aggregations keep
one state row per job, series or pair, and no event time is involved: the newest event wins by its
sequence number, so late rows need no watermark. Run them in ``update`` mode (``complete`` for
small summaries) with a checkpoint location; ``streaming.state`` keeps their result as files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: marker in front of a progress line.
PROGRESS_MARKER = "MTE_PROGRESS "
PROGRESS_TYPE = "struct<completed:bigint,total:bigint,message:string>"


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines of a growing folder as a stream with the file each line came from."""
    return spark.readStream.text(path).withColumn("job", F.input_file_name())


def parse_progress(lines: DataFrame, text: str = "value") -> DataFrame:
    """Add ``event`` for lines with the marker and a JSON object behind it, else null."""
    marked = F.col(text).startswith(PROGRESS_MARKER)
    payload = F.substring(F.col(text), len(PROGRESS_MARKER) + 1, 1 << 30)
    # Malformed JSON parses to a struct of nulls; a map parse tells it from an empty object.
    valid = F.from_json(payload, "map<string,string>").isNotNull() & F.trim(payload).startswith("{")
    return lines.withColumn("event", F.when(marked & valid, F.from_json(payload, PROGRESS_TYPE)))


def progress_events(lines: DataFrame, text: str = "value") -> DataFrame:
    return parse_progress(lines, text).where(F.col("event").isNotNull())


def log_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Every line that is not a progress event stays in the log."""
    return parse_progress(lines, text).where(F.col("event").isNull()).drop("event")


def progress_latest(events: DataFrame) -> DataFrame:
    """Newest progress of each job; events without a positive total are ignored.

    ``events(job, seq, completed, total, message)``.
    """
    usable = events.where(F.coalesce("total", F.lit(0)) > 0)
    newest = usable.groupBy("job").agg(F.max_by(F.struct("completed", "total", "message"), "seq").alias("_e"))
    done = F.greatest(F.lit(0), F.least(F.coalesce("_e.completed", F.lit(0)), F.col("_e.total")))
    return newest.select("job", done.alias("completed"), F.col("_e.total").alias("total"), F.col("_e.message").alias("message"))


def export_rollup(events: DataFrame) -> DataFrame:
    """Running count of export events per series and status."""
    return events.groupBy("series_id", "event").agg(F.count(F.lit(1)).alias("events"))


def review_state(marks: DataFrame) -> DataFrame:
    """Newest valid review mark of each pair."""
    from leafwise.operators.diagnose import REVIEW_STATUSES

    valid = marks.where(F.col("status").isin(*REVIEW_STATUSES))
    return valid.groupBy("volume_id", "pair_id").agg(F.max_by("status", "seq").alias("status"))
