"""What a topic says of each key by now."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.envelope import after_row


def latest_events(events: DataFrame) -> DataFrame:
    """The last event of each key of each topic, by offset; the columns of ``events`` stay.

    Each task reduces a key to one event before the shuffle, so that a key with
    most of the events is as many rows as there are tasks.
    """
    rest = [c for c in events.columns if c not in ("topic", "key")]
    last = F.max_by(F.struct(*rest), F.struct("offset", "partition"))
    return events.groupBy("topic", "key").agg(last.alias("last")).select("topic", "key", "last.*").select(*events.columns)


def current_rows(events: DataFrame, row: StructType) -> DataFrame:
    """The rows of a table as its events leave it: the last of each key, without the deleted ones."""
    after = after_row(F.col("value"), row)
    return latest_events(events).select(after.alias("after")).where("after IS NOT NULL").select("after.*")
