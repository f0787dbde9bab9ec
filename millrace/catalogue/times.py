"""Joins by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalogue.inputs import table
from millrace.catalogue.registry import query
from millrace.operators.asof import asof_join
from millrace.operators.overlap import overlap_join

# A third of all events is of one user.
_USERS = "SELECT *, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS who FROM events"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    who = F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id"))
    return table(spark, sf_dir, "events").withColumn("who", who)


def _views(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'view'").select("who", F.col("ts").alias("view_ts"), F.col("event_id").alias("view_id"), F.col("value").alias("view_value"))


@query(
    f"""
    WITH e AS ({_USERS}), views AS (
      SELECT who, ts AS view_ts, max(event_id) AS view_id, arg_max(value, event_id) AS view_value
      FROM e WHERE event_type = 'view' GROUP BY who, ts
    )
    SELECT e.event_id, e.who, e.ts, view_ts, view_id, view_value FROM e ASOF LEFT JOIN views ON e.who = views.who AND e.ts >= view_ts
    WHERE e.event_type <> 'view'
    """
)
def asof_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event that is no view, with the last view of its user before it, over many buckets of time."""
    events = _events(spark, sf_dir)
    others = events.where("event_type <> 'view'").select("event_id", "who", "ts")
    return asof_join(others, _views(events), ["who"], "ts", "view_ts", order=["view_id"], rows_a_bucket=500)


@query(
    f"""
    WITH e AS ({_USERS}), views AS (
      SELECT who, ts AS view_ts, max(event_id) AS view_id, arg_max(value, event_id) AS view_value
      FROM e WHERE event_type = 'view' GROUP BY who, ts
    )
    SELECT e.event_id, e.who, e.ts, view_ts, view_id, view_value FROM e ASOF JOIN views ON e.who = views.who AND e.ts >= view_ts
    WHERE e.event_type <> 'view'
    """
)
def asof_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``asof_left``, without the events that no view precedes, in buckets of the default size."""
    events = _events(spark, sf_dir)
    others = events.where("event_type <> 'view'").select("event_id", "who", "ts")
    return asof_join(others, _views(events), ["who"], "ts", "view_ts", how="inner", order=["view_id"])


def _spans(events: DataFrame, kind: str, start: str, end: str, seconds: str) -> DataFrame:
    until = F.expr(f"timestampadd(SECOND, CAST({seconds} AS INT), ts)")
    return events.where(F.col("event_type") == kind).select("who", F.col("ts").alias(start), until.alias(end), F.col("event_id").alias(f"{kind}_id"))


@query(
    f"""
    WITH e AS ({_USERS}), views AS (
      SELECT who, event_id, ts AS viewed, ts + to_seconds(CAST(floor(value * 60) AS BIGINT)) AS closed FROM e WHERE event_type = 'view'
    ), errors AS (
      SELECT who, event_id, ts AS broken, ts + to_seconds(CASE WHEN event_id % 20 = 0 THEN 21600 ELSE event_id % 50 END) AS mended
      FROM e WHERE event_type = 'error'
    )
    SELECT views.who, viewed, closed, views.event_id AS view_id, broken, mended, errors.event_id AS error_id
    FROM views JOIN errors ON views.who = errors.who AND viewed < mended AND broken < closed AND viewed < closed AND broken < mended
    """
)
def overlap_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every view with the errors of its user that were open while it was, some of them for hours."""
    events = _events(spark, sf_dir)
    views = _spans(events, "view", "viewed", "closed", "floor(value * 60)")
    errors = _spans(events, "error", "broken", "mended", "CASE WHEN event_id % 20 = 0 THEN 21600 ELSE event_id % 50 END")
    return overlap_join(views, errors, ("viewed", "closed"), ("broken", "mended"), ["who"], rows_a_cell=200)
