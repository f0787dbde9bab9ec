"""Loads that are repeated, topics with several writers, snapshots beside a log, and states by key."""

from __future__ import annotations

import random
import shutil
from pathlib import Path

import pandas as pd
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.catalogue.inputs import database, new_table_name
from millrace.functions.envelope import event_json, json_bytes
from millrace.operators.capture import snapshot_to_events
from millrace.operators.state import current_rows, latest_events
from millrace.plans.merge import merge_topic, merged_events
from millrace.plans.snapshot import snapshot_beside_log
from millrace.sinks.database import ATTEMPT, PART, commit_load, load_once, load_table, stage_load
from millrace.sinks.topics import TopicClaimed, append_events, claimed_end
from millrace.sources.database import read_table
from millrace.sources.topics import end_offset, event_log, event_log_stream
from millrace.streaming.changes import _Classify, classed_changes, keep_state_on_disk
from millrace.streaming.sinks import finish, start_files

TOPIC = "t.public.rows"
ROW = StructType([StructField("id", LongType()), StructField("v", StringType())])


def _rows(spark, rows):
    return spark.createDataFrame(rows, ROW)


def _put(spark, log: str, rows: list[tuple]) -> None:
    """Append events of rows; a row whose value is None is a deletion."""
    frame = _rows(spark, rows).repartition(3)
    after = F.when(F.col("v").isNotNull(), F.struct("id", "v"))
    events = frame.select(json_bytes(F.struct("id")).alias("key"), event_json(after).alias("value"), F.lit(TOPIC).alias("topic"))
    with claimed_end(spark, log, TOPIC) as end:
        append_events(events, log, TOPIC, first_offset=end)


def _plain(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=str)


# Loads


def test_a_run_is_loaded_once(spark):
    target, name = database(spark), new_table_name("once")
    rows = _rows(spark, [(i, f"v{i}") for i in range(50)] + [(None, None)]).repartition(4)
    assert load_once(rows, target, name, "day_1")
    assert not load_once(rows, target, name, "day_1")
    assert load_once(rows.where("id < 10"), target, name, "day_2")
    assert load_once(rows.where("id < 0"), target, name, "day_3")
    found = _plain(read_table(spark, target, name, split_on=["id"]))
    assert found == _plain(rows.union(rows.where("id < 10")))


def test_a_task_that_was_committed_twice_adds_its_rows_once(spark):
    target, name = database(spark), new_table_name("twice")
    # Equal rows in one partition are rows each.
    rows = _rows(spark, [(i // 2, "v") for i in range(40)]).repartition(4)
    load_once(rows.limit(0), target, name, "none")
    stage_load(rows, target, name, "run")
    staged = read_table(spark, target, f"{name}_run")
    again = staged.where(F.col(PART) < 2).withColumn(ATTEMPT, F.col(ATTEMPT) + 1000)
    assert not again.isEmpty()
    load_table(spark.createDataFrame(again.collect(), staged.schema), target, f"{name}_run")
    commit_load(spark, target, name, "run", rows.columns)
    assert _plain(read_table(spark, target, name)) == _plain(rows)
    assert not load_once(rows, target, name, "run")


def test_a_run_that_failed_leaves_nothing_and_is_begun_anew(spark):
    target, name = database(spark), new_table_name("failed")
    rows = _rows(spark, [(i, "v") for i in range(40)]).repartition(4)
    wrong = rows.withColumn("id", F.when(F.col("id") == 33, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long"))
    with pytest.raises(Exception, match="lost"):
        load_once(wrong, target, name, "run")
    assert read_table(spark, target, name).isEmpty()
    assert load_once(rows, target, name, "run")
    assert _plain(read_table(spark, target, name)) == _plain(rows)


def test_rows_and_ledger_are_committed_together(spark):
    target, name = database(spark), new_table_name("both")
    rows = _rows(spark, [(1, "v")])
    load_once(rows, target, name, "first")
    # Another run of the same name was faster: the ledger refuses, and no row is added.
    stage_load(rows, target, name, "first")
    with pytest.raises(Py4JJavaError):
        commit_load(spark, target, name, "first", rows.columns)
    assert read_table(spark, target, name).count() == 1
    with pytest.raises(ValueError, match="run is named"):
        load_once(rows, target, name, "a'; DROP")


# Several writers


def test_the_second_writer_of_a_topic_fails(spark, folder):
    with claimed_end(spark, folder, TOPIC) as end:
        assert end == 0
        with pytest.raises(TopicClaimed, match=TOPIC), claimed_end(spark, folder, TOPIC):
            pass
        with claimed_end(spark, folder, "t.public.other"):
            pass
        # Who failed has not taken the claim of the first away.
        with pytest.raises(TopicClaimed), claimed_end(spark, folder, TOPIC):
            pass
    _put(spark, folder, [(1, "a")])
    with pytest.raises(KeyError), claimed_end(spark, folder, TOPIC):
        raise KeyError
    with claimed_end(spark, folder, TOPIC) as end:
        assert end == end_offset(spark, folder, TOPIC) == 1


# States


def test_latest_events(spark, folder):
    rng = random.Random(1)
    last: dict = {}
    for _ in range(4):
        batch = {rng.randrange(20): rng.choice(["a", "b", None]) for _ in range(12)} | {99: rng.choice("xyz")}
        _put(spark, folder, list(batch.items()))
        last |= batch
    events = event_log(spark, folder, TOPIC)
    assert latest_events(events).columns == events.columns
    assert latest_events(events).count() == len(last)
    assert _plain(current_rows(events, ROW)) == sorted(((k, v) for k, v in last.items() if v is not None), key=str)


def test_snapshot_beside_a_log(spark, folder):
    """Rows that were read before a change, and appended after it, lose; a restart repeats one chunk."""
    log, state = f"{folder}/log", {i: f"old{i}" for i in range(20)}
    reads = []

    def read_chunk(chunk: int):
        reads.append(chunk)
        stale = [(k, v) for k, v in state.items() if k % 3 == chunk]
        # While the rows travel: one changes, one goes, one comes, one of another chunk changes.
        new = {chunk: f"new{chunk}", chunk + 3: None, 30 + chunk: "came", (chunk + 1) % 3 + 6: f"other{chunk}"}
        _put(spark, log, list(new.items()))
        state.update({k: v for k, v in new.items() if v is not None})
        for k, v in new.items():
            if v is None:
                state.pop(k, None)
        if len(reads) == 2:
            raise ConnectionError("the database went away")
        return _rows(spark, stale).repartition(2)

    with pytest.raises(ConnectionError):
        snapshot_beside_log(spark, read_chunk, 3, ["id"], log, TOPIC, f"{folder}/progress")
    assert snapshot_beside_log(spark, read_chunk, 3, ["id"], log, TOPIC, f"{folder}/progress") == [1, 2]
    assert reads == [0, 1, 1, 2]
    assert snapshot_beside_log(spark, read_chunk, 3, ["id"], log, TOPIC, f"{folder}/progress") == []
    events = event_log(spark, log, TOPIC)
    assert _plain(current_rows(events, ROW)) == sorted(state.items(), key=str)
    assert events.select("partition", "offset").distinct().count() == events.count()
    # Appended, but not named as done: the chunk again, to the same state.
    Path(f"{folder}/progress/chunk-00000002").unlink()
    snapshot_beside_log(spark, read_chunk, 3, ["id"], log, TOPIC, f"{folder}/progress")
    assert _plain(current_rows(event_log(spark, log, TOPIC), ROW)) == sorted(state.items(), key=str)


def test_snapshot_of_an_empty_table(spark, folder):
    assert snapshot_beside_log(spark, lambda _: _rows(spark, []), 2, ["id"], f"{folder}/log", TOPIC, f"{folder}/p") == [0, 1]
    assert event_log(spark, f"{folder}/log", TOPIC).count() == 0


def test_classes_over_several_starts(spark, folder):
    rng, log = random.Random(4), f"{folder}/log"
    keep_state_on_disk(spark)
    state, expected = {}, []
    for _ in range(3):
        for _ in range(2):
            batch = {rng.randrange(8): rng.choice(["a", "b", "c", None]) for _ in range(12)}
            _put(spark, log, list(batch.items()))
            for k, v in batch.items():
                was = state.get(k)
                expected.append((k, "repeat" if was == v else "insert" if was is None else "delete" if v is None else "update"))
                state[k] = v
        classed = classed_changes(event_log_stream(spark, log, TOPIC))
        finish(start_files(classed, f"{folder}/out", f"{folder}/checkpoint", bounded=True))
    out = spark.read.parquet(f"{folder}/out").withColumn("id", F.get_json_object(F.col("key").cast("string"), "$.id").cast("long"))
    assert out.count() == len(expected) and {k for _, k in expected} == {"insert", "update", "delete", "repeat"}
    found = {}
    for r in sorted(out.collect(), key=lambda r: (r.offset, r.partition)):
        found.setdefault(r.id, []).append(r.kind)
    wanted = {}
    for k, kind in expected:
        wanted.setdefault(k, []).append(kind)
    assert found == wanted
    # Closed keys have no state.
    kept = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/checkpoint")
    assert kept.count() == sum(v is not None for v in state.values())


def test_many_keys_share_a_bucket(spark, folder):
    log, keys = f"{folder}/log", range(120)
    keep_state_on_disk(spark)
    for n in range(2):
        _put(spark, log, [(k, None if n and k % 3 == 0 else "b" if n and k % 3 == 1 else "a") for k in keys])
        classed = classed_changes(event_log_stream(spark, log, TOPIC), buckets=2)
        finish(start_files(classed, f"{folder}/out", f"{folder}/checkpoint", bounded=True))
    out = spark.read.parquet(f"{folder}/out").withColumn("id", F.get_json_object(F.col("key").cast("string"), "$.id").cast("long"))
    found = {(r.id, r.kind) for r in out.collect()}
    assert out.count() == 240 and found == {(k, "insert") for k in keys} | {(k, ["delete", "update", "repeat"][k % 3]) for k in keys}
    kept = spark.read.format("statestore").option("stateVarName", "last").load(f"{folder}/checkpoint")
    assert kept.count() <= 2


def test_each_key_of_a_bucket_is_forgotten_by_itself():
    class Held:
        value = None

        def getValueState(self, *_):
            return self

        def get(self):
            return self.value

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

    held, classify = Held(), _Classify(idle_ms=10)
    classify.init(held)

    def kinds(time, *events):
        rows = pd.DataFrame([(k, 0, n, d) for n, (k, d) in enumerate(events)], columns=["key", "partition", "offset", "digest"])
        return [k for out in classify.handleInputRows(("t", 1), iter([rows]), TimerValues(time)) for k in out["kind"]]

    assert kinds(0, (b"a", b"1"), (b"b", b"1"), (None, b"1")) == ["insert"] * 3
    assert kinds(6, (b"a", b"1"), (b"c", None), (None, None)) == ["repeat", "repeat", "delete"]
    assert kinds(12, (b"a", b"2"), (b"b", b"1")) == ["update", "insert"]
    assert kinds(13, (b"a", None), (b"b", None)) == ["delete"] * 2 and held.value is None


def test_merge_rewrites_what_a_batch_touches(spark, folder):
    log, state = f"{folder}/log", f"{folder}/state"
    assert merged_events(spark, state).count() == 0
    _put(spark, log, [])
    assert merge_topic(spark, log, TOPIC, state) == 0
    last = {i: f"a{i}" for i in range(200)}
    _put(spark, log, list(last.items()))
    assert merge_topic(spark, log, TOPIC, state, ranges=16) == 16
    older = merged_events(spark, state)
    new = {7: "b", 8: None, 500: "c", 501: None}
    # A key with most of the events.
    for v in "xyz":
        _put(spark, log, [(7, v)])
    _put(spark, log, list(new.items()))
    assert merge_topic(spark, log, TOPIC, state, ranges=999) <= 4
    assert merge_topic(spark, log, TOPIC, state) == 0
    assert _plain(current_rows(older, ROW)) == sorted(last.items(), key=str)
    last = {k: v for k, v in (last | new).items() if v is not None}
    assert _plain(current_rows(merged_events(spark, state), ROW)) == sorted(last.items(), key=str)
    _put(spark, log, [(k, None) for k in last])
    merge_topic(spark, log, TOPIC, state)
    assert merged_events(spark, state).count() == 0
    _put(spark, log, [(1, "back")])
    merge_topic(spark, log, TOPIC, state)
    assert _plain(current_rows(merged_events(spark, state), ROW)) == [(1, "back")]


def test_a_merge_writes_rows_once(spark, folder):
    log, state = f"{folder}/log", f"{folder}/state"
    for rows in ([(i, "a") for i in range(40)], [(3, "b"), (3, "c"), (4, None)]):
        _put(spark, log, rows)
        merge_topic(spark, log, TOPIC, state, ranges=4)
    runs = list(Path(state, "rows").iterdir())
    assert len(runs) == 2 and all([p.name for p in run.iterdir()] == ["base"] for run in runs)
    found = dict(_plain(current_rows(merged_events(spark, state), ROW)))
    assert found.pop(3) in ("b", "c") and found == {i: "a" for i in range(40) if i not in (3, 4)}


def test_a_merge_that_was_lost_is_repeated(spark, folder):
    log, state = f"{folder}/log", f"{folder}/state"
    _put(spark, log, [(1, "a"), (2, "b")])
    merge_topic(spark, log, TOPIC, state)
    _put(spark, log, [(2, None), (3, "c")])
    merge_topic(spark, log, TOPIC, state)
    # As if the second one had not come to its commit.
    shutil.move(f"{state}/versions/v00000001", f"{folder}/lost")
    assert _plain(current_rows(merged_events(spark, state), ROW)) == [(1, "a"), (2, "b")]
    merge_topic(spark, log, TOPIC, state)
    assert _plain(current_rows(merged_events(spark, state), ROW)) == [(1, "a"), (3, "c")]


def test_a_snapshot_event_is_one_of_the_rows(spark):
    events = snapshot_to_events(_rows(spark, [(1, "a"), (2, None)]), ["id"], TOPIC)
    placed = events.withColumns({"partition": F.lit(0), "offset": F.lit(0).cast("long")})
    assert _plain(current_rows(placed, ROW)) == [(1, "a"), (2, None)]
