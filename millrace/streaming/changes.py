"""What each event of a topic does to its key, with state that is kept between batches and starts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from millrace.functions.envelope import after_text

# The state of the processor has variables, which this store alone keeps.
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

CLASSED = "topic string, key binary, partition int, offset long, kind string"
BUCKETS = 1 << 11
# The live keys of a bucket, the digests of their rows, and the time of their last events if they are to be forgotten.
KEPT = "keys array<binary>, digests array<binary>, seen array<long>"


def keep_state_on_disk(spark: SparkSession) -> None:
    """Let the streams that this session starts keep their state in RocksDB: on disk, and written in increments."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


class _Classify(StatefulProcessor):
    """Keeps a digest of the row that each live key has, for the keys of one bucket at once."""

    def __init__(self, idle_ms: int | None):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", KEPT, self.idle_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        time = 0 if self.idle_ms is None else timerValues.getCurrentProcessingTimeInMs()
        state = self.last.get()
        kept = {} if state is None else {k: (digest, seen) for k, digest, seen in zip(*state, strict=True)}
        if self.idle_ms is not None:
            kept = {k: own for k, own in kept.items() if own[1] + self.idle_ms > time}
        last = dict(kept)
        # Places and digests only, of one bucket in one batch.
        events = pd.concat(list(rows)).sort_values(["offset", "partition"])
        kinds = []
        for k, now in zip(events["key"], events["digest"], strict=True):
            was = last[k][0] if k in last else None
            if now == was:
                kind = "repeat"
            else:
                kind = "insert" if was is None else "delete" if now is None else "update"
            kinds.append(kind)
            if now is not None:
                last[k] = (now, time)
            else:
                # A closed key is forgotten.
                last.pop(k, None)
        if not last:
            if state is not None:
                self.last.clear()
        elif last != kept or self.idle_ms is not None:
            digests, seen = zip(*last.values(), strict=True)
            self.last.update((list(last), list(digests), list(seen)))
        yield pd.DataFrame({"topic": key[0], **{c: events[c] for c in ("key", "partition", "offset")}, "kind": kinds})

    def close(self) -> None:
        pass


def classed_changes(events: DataFrame, idle_ms: int | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Each event of a stream with what it does to its key: ``insert``, ``update``, ``delete`` or ``repeat``.

    The event before it by offset decides, also one of an earlier batch or start:
    the state of a live key is a digest of its row, and that of a deleted one is
    dropped. An event that leaves the key as it was is a ``repeat``, also the
    deletion of what is not there; an event that cannot be read deletes. With
    ``idle_ms`` a key without events for so long is forgotten, too, and its next
    event inserts. Call ``keep_state_on_disk`` before the stream is started.

    One shuffle by topic and bucket of keys, of places and digests, not of values.
    A batch calls the processor, and reads and writes its state, once for each of the
    ``buckets`` of a topic that it has events of, however many keys these are: some 100,000
    live keys a bucket is a good size, and a checkpoint holds for one number. The events
    of one key meet in one task, since each depends on the one before it.
    """
    after = after_text(F.col("value"))
    digest, bucket = F.unhex(F.sha2(after.cast("binary"), 256)), F.pmod(F.xxhash64("key"), F.lit(buckets))
    narrow = events.select("topic", bucket.alias("bucket"), "key", "partition", "offset", digest.alias("digest"))
    mode = "None" if idle_ms is None else "ProcessingTime"
    return narrow.groupBy("topic", "bucket").transformWithStateInPandas(_Classify(idle_ms), CLASSED, "append", mode)
