"""The current state of a topic in files, kept up by batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.envelope import after_text
from millrace.operators.state import latest_events
from millrace.sources.topics import TOPIC_RECORD, end_offset, event_log
from millrace.workspace import file_system

RANGES = 64


def _versions(spark: SparkSession, state: str) -> list[str]:
    """Committed versions, oldest first."""
    files, folder = file_system(spark, f"{state}/versions")
    if not files.exists(folder):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(folder) if status.getPath().getName().startswith("v"))


def _parts(spark: SparkSession, state: str) -> tuple[int, int, dict[int, str]]:
    """The next offset to merge, the number of ranges, and the folder of each range that has rows."""
    versions = _versions(spark, state)
    if not versions:
        return 0, 0, {}
    rows = spark.read.schema("range int, folder string, next long, ranges int").json(f"{state}/versions/{versions[-1]}").collect()
    return rows[0]["next"], rows[0]["ranges"], {r["range"]: r["folder"] for r in rows if r["folder"] is not None}


def merged_events(spark: SparkSession, state: str) -> DataFrame:
    """The last event of each key that is not deleted, as of the last merge; of no merge, none."""
    _, _, parts = _parts(spark, state)
    if not parts:
        return spark.createDataFrame([], TOPIC_RECORD)
    return spark.read.schema(TOPIC_RECORD).parquet(*(f"{state}/{folder}" for folder in parts.values()))


def merge_topic(spark: SparkSession, log: str, topic: str, state: str, ranges: int = RANGES) -> int:
    """Bring the state of a topic up to the topic's end; returns how many ranges were rewritten.

    Keys are dealt to ``ranges`` by hash, fixed by the first merge: some 1 GB of
    state a range is a good size. A merge finds the ranges of the events since the one
    before, from their keys alone, and rewrites these: each task reduces base rows
    and new events to the last of each key, one shuffle brings these together, and
    deleted keys go. The folders of
    all ranges are then committed in one file, so that a reader sees one version
    and a lost merge leaves none. Older folders stay for readers of older
    versions. Two merges of one state must not run at once.
    """
    first, fixed, parts = _parts(spark, state)
    ranges = fixed or ranges
    end = end_offset(spark, log, topic)
    if end == first:
        return 0
    own = F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int")
    new = event_log(spark, log, topic).where((F.col("offset") >= first) & (F.col("offset") < end))
    run = f"rows/{uuid.uuid4().hex}"
    touched = sorted(r["range"] for r in new.select(own.alias("range")).distinct().collect())
    base = [f"{state}/{parts[r]}" for r in touched if r in parts]
    rows = new.unionByName(spark.read.schema(TOPIC_RECORD).parquet(*base)) if base else new
    merged = latest_events(rows).where(after_text(F.col("value")).isNotNull())
    merged.withColumn("range", own).write.partitionBy("range").parquet(f"{state}/{run}/base")
    files, folder = file_system(spark, f"{state}/{run}/base")
    written = {status.getPath().getName() for status in files.listStatus(folder)}
    for r in touched:
        parts.pop(r, None)
        if f"range={r}" in written:
            parts[r] = f"{run}/base/range={r}"
    _commit(spark, state, parts, end, ranges)
    return len(touched)


def _commit(spark: SparkSession, state: str, parts: dict[int, str], end: int, ranges: int) -> None:
    """Write the next version, and give it its name when it is whole."""
    lines = [(r, folder, end, ranges) for r, folder in sorted(parts.items())] or [(None, None, end, ranges)]
    number = len(_versions(spark, state))
    files, draft = file_system(spark, f"{state}/drafts/{uuid.uuid4().hex}")
    spark.createDataFrame(lines, "range int, folder string, next long, ranges int").coalesce(1).write.json(draft.toString())
    _, name = file_system(spark, f"{state}/versions/v{number:08d}")
    files.mkdirs(name.getParent())
    if not files.rename(draft, name):
        raise RuntimeError(f"another merge has committed {name.toString()}")
