"""Event-time windows of a topic whose rows come late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, TimestampNTZType

from millrace.catalogue.inputs import row, table
from millrace.catalogue.registry import query
from millrace.operators.capture import snapshot_to_events, topic_name
from millrace.operators.decode import decode_rows
from millrace.sinks.topics import append_events, claimed_end
from millrace.sources.topics import event_log_stream
from millrace.streaming.sinks import finish
from millrace.streaming.windows import late_rows, start_windows, windows
from millrace.workspace import new_folder

CLICKS = topic_name("shop", "public", "events")
CLICK = row(event_id=LongType, ts=TimestampNTZType, who=LongType, value=DoubleType)
ROUNDS = 4
HOUR = 3600
DELAY = 12 * HOUR
MEASURES = {"n": ("count", "*"), "ids": ("sum", "event_id"), "least": ("min", "value"), "most": ("max", "value")}

# A third of all events is of one user. The month comes in three rounds, and a tenth of each a round late.
_ARRIVED = f"""
    e AS (
      SELECT event_id, ts, epoch_us(ts) AS us, value, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS who,
             (ts >= TIMESTAMP '2024-01-11')::INT + (ts >= TIMESTAMP '2024-01-21')::INT + (event_id % 10 = 0)::INT AS round
      FROM events
    ), ends AS (
      SELECT round, max(us) AS last FROM e GROUP BY round
    ), marks AS (
      SELECT round, coalesce(max(last) OVER (ORDER BY round ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - {DELAY}000000 AS mark
      FROM ends
    ), marked AS (
      SELECT e.*, mark FROM e JOIN marks USING (round)
    ), final AS (SELECT max(us) - {DELAY}000000 AS mark FROM e)
"""
_MEASURED = "count(*) AS n, sum(event_id)::BIGINT AS ids, min(value) AS least, max(value) AS most"


def _run(spark: SparkSession, sf_dir: str, **shape) -> str:
    """The folder of windows over the events, each round of which comes before another start of the stream."""
    folder = new_folder(spark)
    log = f"{folder}/log"
    events = table(spark, sf_dir, "events")
    ts, late = F.col("ts"), (F.col("event_id") % 10 == 0).cast("int")
    third = sum((ts >= F.expr(f"TIMESTAMP_NTZ'2024-01-{day}'")).cast("int") for day in (11, 21))
    events = events.withColumn("who", F.when(F.col("event_id") % 3 == 0, -1).otherwise(F.col("user_id")))
    events = events.withColumn("round", third + late)
    for n in range(ROUNDS):
        rows = events.where(F.col("round") == n).select(*CLICK.names)
        with claimed_end(spark, log, CLICKS) as end:
            append_events(snapshot_to_events(rows, ["event_id"], CLICKS), log, CLICKS, first_offset=end)
        stream = decode_rows(event_log_stream(spark, log, CLICKS), CLICK)
        finish(start_windows(stream, f"{folder}/windows", ["who"], "ts", MEASURES, delay=DELAY, bounded=True, **shape))
    return f"{folder}/windows"


@query(
    f"""
    WITH {_ARRIVED}, placed AS (
      SELECT marked.*, us - us % {6 * HOUR}000000 - k * {6 * HOUR}000000 AS start
      FROM marked, (SELECT unnest(range(4)) AS k)
    )
    SELECT who, make_timestamp(start) AS window_start, make_timestamp(start + {24 * HOUR}000000) AS window_end, {_MEASURED},
           start + {24 * HOUR}000000 <= any_value(final.mark) AS closed
    FROM placed, final WHERE start + {24 * HOUR}000000 > placed.mark GROUP BY who, start
    """
)
def windows_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A day of each user, every six hours, over the rows that came in time for it."""
    return windows(spark, _run(spark, sf_dir, seconds=24 * HOUR, slide=6 * HOUR))


@query(
    f"""
    WITH {_ARRIVED}, taken AS (
      SELECT *, us - lag(us) OVER (PARTITION BY who ORDER BY us) >= {HOUR}000000 AS apart
      FROM marked WHERE us + {HOUR}000000 > mark
    ), numbered AS (
      SELECT *, sum(coalesce(apart, false)::INT) OVER (PARTITION BY who ORDER BY us) AS nth FROM taken
    )
    SELECT who, make_timestamp(min(us)) AS window_start, make_timestamp(max(us) + {HOUR}000000) AS window_end, {_MEASURED},
           max(us) + {2 * HOUR}000000 <= any_value(final.mark) AS closed
    FROM numbered, final GROUP BY who, nth
    """
)
def windows_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user, an hour apart."""
    return windows(spark, _run(spark, sf_dir, seconds=HOUR, sessions=True))


@query(
    f"""
    WITH {_ARRIVED}
    SELECT event_id, ts, who, value FROM marked WHERE us - us % {HOUR}000000 + {HOUR}000000 <= mark
    """
)
def windows_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events that came when their hour was closed."""
    return late_rows(spark, _run(spark, sf_dir, seconds=HOUR))
