"""Event-time windows of a stream, with what came too late beside them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import TimestampNTZType

from millrace.workspace import file_system

SECOND = 1_000_000
# Before every time that a timestamp has.
NEVER = -(1 << 62)
# Sessions are first found within cells of so many gaps.
CELL_GAPS = 64
_FIRST = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
_AGAIN = {**_FIRST, "count": F.sum}
_OWN = ("window_start", "window_end", "closed", "in_batch")


def _micros(rows: DataFrame, time: str) -> Column:
    if isinstance(rows.schema[time].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{time}`)")
    return F.unix_micros(F.col(f"`{time}`"))


def _moment(micros: str, zoned: bool) -> Column:
    if zoned:
        return F.timestamp_micros(micros).alias(micros)
    seconds = f"CAST(CAST({micros} AS DECIMAL(20, 0)) / {SECOND} AS DECIMAL(18, 6))"
    return F.expr(f"TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, {seconds})").alias(micros)


def start_windows(
    rows: DataFrame,
    folder: str,
    keys: Sequence[str],
    time: str,
    measures: Mapping[str, tuple[str, str]],
    seconds: int,
    slide: int | None = None,
    sessions: bool = False,
    delay: int = 0,
    bounded: bool = False,
) -> StreamingQuery:
    """Aggregate a stream by keys and windows of ``time``; ``windows`` and ``late_rows`` read the result.

    Windows are tumbling, with ``slide`` sliding by so many seconds, or with
    ``sessions`` the times of a key that lie less than ``seconds`` apart, up to
    ``seconds`` after the last. They hold their start and not their end. ``measures`` are named pairs
    of ``count``, ``sum``, ``min`` or ``max`` and a column (``*`` counts rows).

    The watermark is the latest time of all batches before, less ``delay`` seconds.
    A window whose end it has reached takes no more rows and is closed; a session is closed when no row
    that is still taken can reach it, so that the order of arrival never cuts one. A row
    that no window takes any more, or whose time is NULL, is a late row, kept as it
    came. A NULL key is a key. Started again with the same folder the stream goes on; the
    folder belongs to one set of arguments.

    Each batch merges its rows' partial results with the windows that were open,
    and writes these, the late rows and the watermark under its number, the
    watermark last: a batch that is repeated writes the same again. Rows are
    read twice and aggregated before they are shuffled; sessions are found by key and
    cell of ``CELL_GAPS`` gaps, so that a key with most rows is many tasks, and
    only a row for each session and cell meets at its key.
    """
    if seconds < 1 or delay < 0 or (slide is not None and not 1 <= slide <= seconds):
        raise ValueError("windows last a second at least, slide by no more than they last, and wait for no negative time")
    if sessions and slide is not None:
        raise ValueError("sessions do not slide")
    if unknown := sorted({kind for kind, _ in measures.values()} - _FIRST.keys()):
        raise ValueError(f"measures are {', '.join(_FIRST)}, not {unknown}")
    if clash := sorted(set(rows.columns) & set(_OWN)) or sorted(set(measures) & {*keys, *_OWN, "latest"}):
        raise ValueError(f"columns of these names are given by the windows: {clash}")
    spark = rows.sparkSession
    size, step = seconds * SECOND, (slide or seconds) * SECOND
    names = [f"`{k}`" for k in keys]

    def tagged(batch: DataFrame, mark: int) -> DataFrame:
        """Each row with its time and the starts of the windows that take it."""
        at = _micros(batch, time)
        if sessions:
            starts = F.array(at)
        else:
            newest = at - F.pmod(at, F.lit(step))
            starts = F.sequence(newest - (-(-size // step) - 1) * step, newest, F.lit(step).cast("long"))
        taken = F.filter(starts, lambda s: (s + size > at) & (s + size > mark))
        return batch.select("*", at.alias("__at"), F.when(at.isNotNull(), taken).alias("__starts"))

    first = [_FIRST[kind](F.lit(1) if c == "*" else F.col(f"`{c}`")).alias(name) for name, (kind, c) in measures.items()]
    again = [_AGAIN[kind](F.col(f"`{name}`")).alias(name) for name, (kind, _) in measures.items()]

    def panes(batch: DataFrame, mark: int) -> DataFrame:
        """Aggregates by steps, all rows of which are in the same windows, for each of these."""
        at = F.col("__at")
        timed = batch.withColumn("__at", _micros(batch, time)).where(at.isNotNull())
        found = timed.groupBy(*names, (at - F.pmod(at, F.lit(step))).alias("__pane")).agg(*first, F.max("__at").alias("latest"))
        starts = F.sequence(F.col("__pane") - (size - step), F.col("__pane"), F.lit(step).cast("long"))
        found = found.withColumn("window_start", F.explode(F.filter(starts, lambda s: s + size > mark))).drop("__pane")
        return found.withColumn("window_end", F.col("window_start") + size)

    def partial(batch: DataFrame, mark: int) -> DataFrame:
        if not sessions and size % step == 0:
            return panes(batch, mark)
        taken = tagged(batch, mark).withColumn("window_start", F.explode("__starts"))
        if not sessions:
            found = taken.groupBy(*names, "window_start").agg(*first, F.max("__at").alias("latest"))
            return found.withColumn("window_end", F.col("window_start") + size)
        cell = F.floor(F.col("__at") / (CELL_GAPS * size))
        order = Window.partitionBy(*names, "__cell").orderBy("__at")
        apart = F.col("__at") - F.lag("__at").over(order) >= size
        numbered = taken.withColumn("__cell", cell).withColumn("__new", F.coalesce(apart, F.lit(False)).cast("int"))
        numbered = numbered.withColumn("__nth", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        found = numbered.groupBy(*names, "__cell", "__nth").agg(
            *first, F.max("__at").alias("latest"), F.min("__at").alias("window_start")
        )
        return found.drop("__cell", "__nth").withColumn("window_end", F.col("latest") + size)

    def merged(parts: DataFrame) -> DataFrame:
        if not sessions:
            return parts.groupBy(*names, "window_start", "window_end").agg(*again, F.max("latest").alias("latest"))
        order = Window.partitionBy(*names).orderBy("window_start", "window_end")
        reached = F.max("window_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
        numbered = parts.withColumn("__new", F.coalesce(F.col("window_start") >= reached, F.lit(False)).cast("int"))
        numbered = numbered.withColumn("__nth", F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
        ends = [F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end")]
        return numbered.groupBy(*names, "__nth").agg(*again, F.max("latest").alias("latest"), *ends).drop("__nth")

    def write(some: DataFrame, kind: str, n: int) -> None:
        some.write.mode("overwrite").parquet(f"{folder}/{kind}/in_batch={n}")

    def write_mark(mark: int, n: int) -> None:
        wait = size if sessions else 0
        zoned = not isinstance(rows.schema[time].dataType, TimestampNTZType)
        columns = "watermark long, closes long, zoned boolean"
        write(spark.createDataFrame([(mark, max(mark - wait, NEVER), zoned)], columns).coalesce(1), "marks", n)

    order = [*names, "window_start", "window_end", *(f"`{m}`" for m in measures), "latest"]
    empty = spark.createDataFrame([], rows.schema)
    if _last(spark, folder) is None:
        # What was before the first batch.
        write(partial(empty, NEVER).select(*order), "windows", -1)
        write(empty, "late", -1)
        write_mark(NEVER, -1)

    def take(batch: DataFrame, n: int) -> None:
        before = spark.read.parquet(f"{folder}/marks/in_batch={n - 1}").first()
        mark = before["watermark"]
        late = tagged(batch, mark).where(F.coalesce(F.size("__starts"), F.lit(0)) <= 0)
        write(late.select(*(f"`{c}`" for c in rows.columns)), "late", n)
        was_open = spark.read.parquet(f"{folder}/windows/in_batch={n - 1}").where(F.col("window_end") > before["closes"])
        parts = was_open.select(*order).unionByName(partial(batch, mark).select(*order))
        write(merged(parts).select(*order), "windows", n)
        latest = spark.read.parquet(f"{folder}/windows/in_batch={n}").agg(F.max("latest")).first()[0]
        write_mark(mark if latest is None else max(mark, latest - delay * SECOND), n)

    writer = rows.writeStream.option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(take)
    return (writer.trigger(availableNow=True) if bounded else writer).start()


def _last(spark: SparkSession, folder: str) -> int | None:
    """The last batch that is whole."""
    files, path = file_system(spark, f"{folder}/marks")
    found = [status.getPath().toString() for status in files.listStatus(path)] if files.exists(path) else []
    whole = [p for p in found if files.exists(file_system(spark, f"{p}/_SUCCESS")[1])]
    return max((int(p.rpartition("=")[2]) for p in whole), default=None)


def windows(spark: SparkSession, folder: str) -> DataFrame:
    """Each window once, with its keys, ends and measures, and whether it is ``closed``: those that are not may still change."""
    last = _last(spark, folder)
    marks = spark.read.parquet(f"{folder}/marks").where(F.col("in_batch") <= last)
    zoned = marks.first()["zoned"]
    found = spark.read.parquet(f"{folder}/windows").join(marks, "in_batch").withColumn("closed", F.col("window_end") <= F.col("closes"))
    found = found.where(F.col("closed") | (F.col("in_batch") == last))
    ends = {name: _moment(name, zoned) for name in ("window_start", "window_end")}
    return found.withColumns(ends).drop("in_batch", "latest", "watermark", "closes", "zoned")


def late_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The rows that no window has taken, as they came."""
    last = _last(spark, folder)
    return spark.read.parquet(f"{folder}/late").where(F.col("in_batch") <= last).drop("in_batch")
