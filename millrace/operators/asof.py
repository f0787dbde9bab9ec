"""As-of join: each row with the last one of another table that is not later than it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_A_BUCKET = 1_000_000
# Buckets of either table, at most; those of both bound the rows of a key in what is carried on.
MOST_BUCKETS = 1024


def _bounds(rows: DataFrame, time: Column, rows_a_bucket: int) -> list[Column]:
    """Ascending times that cut the rows into parts of about equal size."""
    n = min(MOST_BUCKETS // 2, rows.count() // rows_a_bucket + 1)
    if n == 1:
        return []
    shares = F.array(*(F.lit(i / n) for i in range(1, n)))
    times = rows.select(time.alias("t"))
    # As text, which does not depend on the time zone of Python.
    found = times.agg(F.percentile_approx("t", shares, F.lit(20 * n)).cast("array<string>")).first()[0]
    return [F.lit(b).cast(times.schema["t"].dataType) for b in dict.fromkeys(found or [])]


def _place(time: Column, bounds: list[Column], first: int = 0) -> Column:
    """How many of the bounds are not after a time, by halves."""
    if not bounds:
        return F.lit(first)
    half = len(bounds) // 2
    return F.when(time < bounds[half], _place(time, bounds[:half], first)).otherwise(_place(time, bounds[half + 1 :], first + half + 1))


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    time: str,
    right_time: str | None = None,
    how: str = "left",
    order: Sequence[str] = (),
    rows_a_bucket: int = ROWS_A_BUCKET,
) -> DataFrame:
    """The rows of ``left`` with the columns of the last row of ``right`` that has their keys and is not later.

    Rows of ``right`` at the same time are ordered by its columns ``order``, the
    greatest wins; without it one of them is taken. A row that has none before it,
    or whose key or time is NULL, gets NULLs, or is left out with ``how="inner"``.
    No column but the keys may be in both tables.

    No range condition is joined. Times are cut into buckets of equal numbers of
    rows, at quantiles of both tables, so a key of any share of the rows is dealt
    to as many tasks as it has buckets. In a bucket both tables are sorted
    together, and the last row of ``right`` is carried on. What a bucket inherits
    comes from one row a key and bucket. Both tables are shuffled once. Rows of
    one key and one time are never cut apart.
    """
    right_time = right_time or time
    own = [c for c in right.columns if c not in keys]
    if clash := sorted(set(own) & set(left.columns)):
        raise ValueError(f"columns in both tables: {clash}")
    if how not in ("left", "inner"):
        raise ValueError(f"an as-of join is left or inner, not {how}")

    def name(c: str) -> Column:
        return F.col(f"`{c}`")

    usable = [name(c).isNotNull() for c in keys]
    whole = F.lit(True)
    for condition in usable:
        whole = whole & condition
    of_left = _bounds(left, name(time), rows_a_bucket)
    of_right = _bounds(right, name(right_time), rows_a_bucket)
    key_columns = [name(c).alias(f"__k{i}") for i, c in enumerate(keys)]
    place = [f"__k{i}" for i in range(len(keys))]

    def bucket(t: Column) -> Column:
        # Ascends with time, as both places do.
        return (_place(t, of_left) * (len(of_right) + 1) + _place(t, of_right)).alias("__bucket")

    given = F.struct(*map(name, own))
    ranks = F.struct(*map(name, order)) if order else F.lit(0)
    earlier = right.where(whole & name(right_time).isNotNull())
    earlier = earlier.select(*key_columns, bucket(name(right_time)), name(right_time).alias("__t"), F.lit(0).alias("__side"), ranks.alias("__order"), given.alias("__right"))
    # Rows that match nothing are dealt out by number.
    alone = (-1 - F.pmod(F.monotonically_increasing_id(), F.lit(MOST_BUCKETS))).cast("int")
    own_bucket = F.when(whole & name(time).isNotNull(), bucket(name(time))).otherwise(alone).alias("__bucket")
    later = left.select(*key_columns, own_bucket, name(time).alias("__t"), F.lit(1).alias("__side"), F.struct(*map(name, left.columns)).alias("__left"))
    both = earlier.unionByName(later, allowMissingColumns=True)
    here = Window.partitionBy(*place, "__bucket").orderBy("__t", "__side", "__order")
    rows = both.withColumn("__found", F.last("__right", ignorenulls=True).over(here)).where("__side = 1")
    # The last row of each bucket, and what later buckets inherit of it.
    ends = both.groupBy(*place, "__bucket").agg(F.max_by("__right", F.when(F.col("__right").isNotNull(), F.struct("__t", "__order"))).alias("__end"))
    before = Window.partitionBy(*place).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("__inherited", F.last("__end", ignorenulls=True).over(before)).drop("__end")
    found = rows.join(ends, [*place, "__bucket"], "left").select("__left.*", F.coalesce("__found", "__inherited").alias("__found"))
    if how == "inner":
        found = found.where("__found IS NOT NULL")
    return found.select(*map(name, left.columns), "__found.*")
