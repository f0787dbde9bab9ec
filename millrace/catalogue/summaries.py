"""Summaries of the events by day, rolled up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalogue.inputs import table
from millrace.catalogue.registry import query
from millrace.plans.summaries import rolled_up, shared_members, summarise
from millrace.workspace import new_folder

DIMS = ["event_type", "third"]
MEASURES = {"n": ("count", "*"), "least": ("min", "event_id"), "users": ("distinct", "user_id"), "middle": ("quantiles", "value"), "who": ("members", "user_id")}
# Some four standard errors of distinct counts and of members, and of ranks.
DISTINCT_ERROR, MEMBER_ERROR, RANK_ERROR = 0.035, 0.07, 0.03


def _kept(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The events, and their summaries: half of the days, then the others, and some of the first ones once more."""
    events = table(spark, sf_dir, "events").withColumns({"day": F.to_date("ts"), "third": F.col("event_id") % 3})
    folder, day = f"{new_folder(spark)}/days", F.dayofmonth("ts")
    for some in (day <= 15, day > 15, day <= 3):
        summarise(events.where(some), folder, "day", DIMS, MEASURES)
    return events, folder


@query(
    """
    SELECT event_type, event_id % 3 AS third, grouping_id(event_type, event_id % 3) AS level, count(*) AS n, min(event_id) AS least,
           true AS users_close, true AS middle_close
    FROM events GROUP BY CUBE (event_type, event_id % 3)
    """
)
def summary_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every grouping from summaries by day, and whether estimates are as near the rows' own numbers as they should be."""
    events, folder = _kept(spark, sf_dir)
    found = rolled_up(spark, folder, DIMS, MEASURES)
    near = F.percentile("value", F.array(F.lit(0.5 - RANK_ERROR), F.lit(0.5 + RANK_ERROR))).alias("near")
    exact = events.cube(*DIMS).agg(F.grouping_id().alias("level"), F.countDistinct("user_id").alias("exact"), near)
    same = [found[c].eqNullSafe(exact[c]) for c in (*DIMS, "level")]
    middle = F.col("middle")[0]
    return found.join(exact, same).select(
        *(found[c] for c in (*DIMS, "level", "n", "least")),
        (F.abs(F.col("users") - F.col("exact")) <= 1 + DISTINCT_ERROR * F.col("exact")).alias("users_close"),
        ((middle >= F.col("near")[0]) & (middle <= F.col("near")[1])).alias("middle_close"),
    )


@query(
    """
    SELECT count(*) AS users, true AS close FROM (
      SELECT user_id FROM events GROUP BY user_id HAVING bool_or(event_type = 'view') AND bool_or(event_type = 'error')
    )
    """
)
def summary_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users of both views and errors, from summaries by day, against the rows' own number."""
    events, folder = _kept(spark, sf_dir)
    one, other = (F.col("event_type") == kind for kind in ("view", "error"))
    users = events.groupBy("user_id").agg((F.max(one.cast("int")) + F.max(other.cast("int"))).alias("sides"))
    exact = users.agg(F.count(F.when(F.col("sides") == 2, 1)).alias("users"))
    found = shared_members(spark, folder, "who", one, other)
    close = F.abs(F.col("shared") - F.col("users")) <= 1 + MEMBER_ERROR * F.col("users")
    return found.withColumn("k", F.lit(1)).join(exact.withColumn("k", F.lit(1)), "k").select("users", close.alias("close"))
