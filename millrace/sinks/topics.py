"""Topics as targets."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.topics import end_offset
from millrace.workspace import file_system

# monotonically_increasing_id keeps the task in the high bits, the row below.
_ROW_BITS = 33


class TopicClaimed(RuntimeError):
    """Another writer holds the end of a topic."""


@contextmanager
def claimed_end(spark: SparkSession, log: str, topic: str) -> Iterator[int]:
    """The end offset of a topic, which no other writer gets until the block ends.

    A writer leaves a file of its own and then looks for others: of two at once
    at least one sees the other and fails with ``TopicClaimed``, to be run again.
    That needs no lock, only a listing that shows what was written before it. A
    writer that dies leaves its claim; the error names the file to remove, once
    it is known that nothing writes any more.
    """
    files, folder = file_system(spark, f"{log}/_claims/topic={topic}")
    _, own = file_system(spark, f"{log}/_claims/topic={topic}/{uuid.uuid4().hex}")
    files.create(own).close()
    try:
        others = [status.getPath() for status in files.listStatus(folder) if status.getPath().getName() != own.getName()]
        if others:
            raise TopicClaimed(f"{topic} is being written: {others[0]}")
        yield end_offset(spark, log, topic)
    finally:
        files.delete(own, False)


def append_events(
    events: DataFrame, log: str, topic: str | None = None, *, first_offset: int
) -> None:
    """Add events (``key``, ``value``, ``topic``) to a file log, a folder per topic.

    Given a ``topic``, all events go there whatever their own column says. That
    spares the writers the sort by topic which they need for several folders.

    Every task acts as a producer with a partition of its own: it numbers its
    rows by itself, so nothing is shuffled and a topic with most of the events
    is written by as many tasks as there are. A first append to a topic starts at
    ``first_offset=0``, any later one at what ``claimed_end`` gives, which keeps
    (partition, offset) unique.
    """
    row = F.monotonically_increasing_id()
    records = events.select(
        "key",
        "value",
        *([] if topic else ["topic"]),
        F.shiftright(row, _ROW_BITS).cast("int").alias("partition"),
        (F.lit(first_offset) + row.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).alias("offset"),
        F.current_timestamp().alias("timestamp"),
        F.lit(0).alias("timestampType"),
    )
    if topic:
        records.write.mode("append").parquet(f"{log}/topic={topic}")
    else:
        records.write.mode("append").partitionBy("topic").parquet(log)
