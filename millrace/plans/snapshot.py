"""A consistent snapshot of a table whose changes are logged meanwhile."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators.capture import snapshot_to_events
from millrace.sinks.topics import append_events, claimed_end
from millrace.sources.topics import end_offset, event_log
from millrace.workspace import file_system, new_folder


def snapshot_beside_log(
    spark: SparkSession,
    read_chunk: Callable[[int], DataFrame],
    chunks: int,
    keys: Sequence[str],
    log: str,
    topic: str,
    progress: str,
) -> list[int]:
    """Add every row of a table to a topic that receives the table's changes at the same time.

    The table is read in chunks, so that nothing is locked and a restart repeats
    one of them. ``read_chunk(i)`` reads those rows of the table, as it is then,
    that belong to chunk ``i`` of ``chunks``; a key always belongs to the same
    one. Around each read the end of the topic is marked. A row whose key has an
    event between the low and the high mark may be older than that event, which
    wins: the row is left out. All other rows are as of the high mark, where they
    are appended; later events follow them. So the last event of each key is the
    table's last state, see ``current_rows``.

    Rows are read once into a folder of their own. Only keys between the marks
    are shuffled with a chunk's, so choose chunks that a job reads in minutes.
    ``progress`` is a folder that names the chunks that are done; with it a
    second start goes on where the first one ended. A chunk that was appended
    but not yet named is read and appended again, which leaves the same state.
    Returns the chunks that this call did. While a chunk is appended, other
    writers of the topic fail with ``TopicClaimed`` and have to try again.
    """
    done = []
    for chunk in range(chunks):
        files, mark = file_system(spark, f"{progress}/chunk-{chunk:08d}")
        if files.exists(mark):
            continue
        low = end_offset(spark, log, topic)
        rows = read_chunk(chunk)
        path = f"{new_folder(spark)}/chunk"
        rows.write.parquet(path)
        events = snapshot_to_events(spark.read.schema(rows.schema).parquet(path), keys, topic)
        with claimed_end(spark, log, topic) as high:
            changed = event_log(spark, log, topic).where((F.col("offset") >= low) & (F.col("offset") < high))
            append_events(events.join(changed.select("key").distinct(), "key", "left_anti"), log, topic, first_offset=high)
        files.create(mark).close()
        done.append(chunk)
    return done
