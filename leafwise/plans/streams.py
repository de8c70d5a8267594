"""Batch forms of the event queries, and one query that runs as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from leafwise.plans.catalogue import _EVENTS, export_events
from leafwise.plans.diagnosis import _MARKS, _marks
from leafwise.plans.inputs import table
from leafwise.plans.registry import query
from leafwise.streaming import events, state

# Worker output made from the event table: progress lines, broken lines and plain log lines.
LINES = """lines AS (SELECT event_id, user_id, CASE event_type
    WHEN 'view' THEN 'MTE_PROGRESS {"completed": ' || (event_id % 70) || ', "total": ' || (user_id % 60) || ', "message": "m'
      || event_id || '"}'
    WHEN 'click' THEN 'MTE_PROGRESS {"completed": ' || event_id WHEN 'error' THEN 'MTE_PROGRESS not json'
    ELSE 'plain ' || props END AS value FROM events)"""


def lines(spark, sf):
    kind = F.col("event_type")
    text = lambda c: F.col(c).cast("string")
    progress = F.concat(
        F.lit('MTE_PROGRESS {"completed": '), (F.col("event_id") % 70).cast("string"), F.lit(', "total": '),
        (F.col("user_id") % 60).cast("string"), F.lit(', "message": "m'), text("event_id"), F.lit('"}'),
    )
    value = (
        F.when(kind == "view", progress)
        .when(kind == "click", F.concat(F.lit('MTE_PROGRESS {"completed": '), text("event_id")))
        .when(kind == "error", "MTE_PROGRESS not json")
        .otherwise(F.concat(F.lit("plain "), "props"))
    )
    return table(spark, sf, "events").select("event_id", "user_id", value.alias("value"))


@query(
    "parse_progress",
    """SELECT event_id, event_id % 70 AS completed, user_id % 60 AS total, 'm' || event_id AS message FROM events
    WHERE event_type = 'view'""",
)
def parse_progress(spark, sf):
    return events.progress_events(lines(spark, sf)).select("event_id", "event.completed", "event.total", "event.message")


@query("log_lines", f"WITH {LINES} SELECT event_id, value FROM lines WHERE value NOT LIKE 'MTE_PROGRESS {{%}}'")
def log_lines(spark, sf):
    return events.log_lines(lines(spark, sf)).select("event_id", "value")


@query(
    "progress_latest",
    """WITH p AS (SELECT user_id AS job, event_id AS seq, event_id % 70 AS completed, user_id % 60 AS total FROM events
      WHERE event_type = 'view' AND user_id % 60 > 0)
    SELECT job, greatest(0, least(arg_max(completed, seq), arg_max(total, seq))) AS completed, arg_max(total, seq) AS total,
      'm' || max(seq) AS message FROM p GROUP BY 1""",
)
def progress_latest(spark, sf):
    found = events.progress_events(lines(spark, sf))
    return events.progress_latest(
        found.select(F.col("user_id").alias("job"), F.col("event_id").alias("seq"), "event.*")
    )


@query("export_rollup", f"SELECT series_id, event, count(*) AS events FROM ({_EVENTS}) GROUP BY ALL")
def export_rollup(spark, sf):
    return events.export_rollup(export_events(spark, sf))


@query(
    "export_rollup_stream",
    f"SELECT series_id, event, count(*) AS events FROM ({_EVENTS}) GROUP BY ALL",
)
def export_rollup_stream(spark, sf):
    """The same roll-up run as a stream over the event file."""
    from leafwise.session import checkpoint_folder

    static = table(spark, sf, "events")
    # One file or a folder of part files: a pattern takes both, a plain path only a folder.
    arriving = spark.readStream.schema(static.schema).parquet(f"{sf}/events.parque[t]")
    kind = F.col("event_type")
    event = F.when(kind == "purchase", "exported").when(kind == "error", "failed").when(kind == "view", "skipped").otherwise("started")
    rolled = events.export_rollup(arriving.select(F.col("user_id").alias("series_id"), event.alias("event")))
    run = uuid.uuid4().hex
    folder = f"{checkpoint_folder(spark)}/export-rollup-{run}"
    stream = state.upsert_state(rolled, ["series_id", "event"], f"{folder}/state", f"{folder}/offsets")
    stream.awaitTermination()
    return state.current_state(spark, ["series_id", "event"], f"{folder}/state")


@query(
    "review_state",
    f"""WITH {_MARKS} SELECT volume_id, pair_id, arg_max(status, seq) AS status FROM marks
    WHERE status IN ('pending', 'true', 'false') GROUP BY 1, 2""",
)
def review_state(spark, sf):
    return events.review_state(_marks(spark, sf))
