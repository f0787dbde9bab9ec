"""Joins of two streams whose times lie near each other."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType


def join_within(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    right_time: str,
    seconds: int,
    delay: str = "0 seconds",
    how: str = "inner",
) -> DataFrame:
    """Each row of ``left`` with the rows of ``right`` that have its keys and follow in at most ``seconds``.

    Both streams have a watermark of ``delay``, which may be any time that rows
    come late; rows later than that are dropped by it. A row is held until the watermark shows that
    nothing more can match it. With ``how="left"`` a row without a match comes out
    then, with NULLs; rows at the end of the streams wait for later ones. Rows
    whose key or time is NULL are left out. Times are timestamps, with a zone or without; the result has
    the columns of ``left`` and those of ``right`` but the keys, and no other column
    may be in both.

    The state is dealt by keys and by cells of ``seconds``: a left row is in one
    cell, a right row in its own and the one before. So a key of any share of the rows is
    dealt to as many tasks as it has cells, and each pair comes out once.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"a join of streams is inner or left, not {how}")
    if seconds < 1:
        raise ValueError("rows follow within a second at least")
    if clash := sorted((set(left.columns) & set(right.columns)) - set(keys)):
        raise ValueError(f"columns in both streams: {clash}")

    def usable(rows: DataFrame, at: str, cells) -> DataFrame:
        # A watermark needs a time with a zone; here it is UTC whatever the session says.
        without_zone = isinstance(rows.schema[at].dataType, TimestampNTZType)
        moment = F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{at}`))") if without_zone else F.col(f"`{at}`")
        rows = rows.dropna("any", subset=[f"`{c}`" for c in (*keys, at)]).withColumn("__at", moment).withWatermark("__at", delay)
        start = F.unix_seconds("__at") - F.pmod(F.unix_seconds("__at"), F.lit(seconds))
        return rows.withColumn("__cell", cells(start))

    ours = usable(left, time, lambda start: start).alias("l")
    theirs = usable(right, right_time, lambda start: F.explode(F.array(start - seconds, start))).alias("r")
    near = F.col("l.__cell") == F.col("r.__cell")
    for c in keys:
        near &= F.col(f"l.`{c}`") == F.col(f"r.`{c}`")
    near &= (F.col("r.__at") >= F.col("l.__at")) & (F.col("r.__at") <= F.col("l.__at") + F.expr(f"INTERVAL {int(seconds)} SECONDS"))
    own = [F.col(f"l.`{c}`") for c in left.columns]
    return ours.join(theirs, near, how).select(*own, *(F.col(f"r.`{c}`") for c in right.columns if c not in keys))
