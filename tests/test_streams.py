"""Streams: start, stop, resume, and the same rows as a bounded read."""

from __future__ import annotations

import glob
import os

import pytest
from pyspark.errors import AnalysisException, StreamingQueryException
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from millrace.functions.envelope import PERSON_DOCUMENT
from millrace.operators.capture import documents_to_events, snapshot_to_events
from millrace.operators.decode import decode_documents, decode_rows
from millrace.plans.topics import documents_to_console, rows_to_console, rows_to_view
from millrace.sinks.topics import append_events
from millrace.sources.topics import event_log, event_log_stream, kafka_stream
from millrace.streaming.sinks import (
    finish,
    named_result,
    start_console,
    start_files,
    start_memory,
)

ROW = StructType([StructField("id", LongType()), StructField("name", StringType())])
TOPIC = "t.a.b"


def _rows(spark, start: int, end: int):
    return spark.range(start, end, numPartitions=2).withColumn("name", F.concat(F.lit("a name of twenty and more letters "), "id"))


def _append(spark, log: str, start: int, end: int, topic: str = TOPIC) -> None:
    append_events(snapshot_to_events(_rows(spark, start, end), ["id"], topic), log, topic, first_offset=start)


def _ids(df) -> list[int]:
    return sorted(r.id for r in df.collect())


def test_stream_equals_batch(spark, folder):
    log = f"{folder}/log"
    _append(spark, log, 0, 500)
    rows = decode_rows(event_log_stream(spark, log, TOPIC), ROW)
    assert rows.isStreaming
    finish(start_files(rows, f"{folder}/out", f"{folder}/checkpoint", bounded=True))
    streamed = spark.read.schema(ROW).parquet(f"{folder}/out").collect()
    batch = decode_rows(event_log(spark, log, TOPIC), ROW).collect()
    assert sorted(streamed) == sorted(batch) and len(batch) == 500


def test_resume_adds_only_what_is_new(spark, folder):
    log = f"{folder}/log"

    def run() -> list[int]:
        rows = decode_rows(event_log_stream(spark, log, TOPIC), ROW)
        finish(start_files(rows, f"{folder}/out", f"{folder}/checkpoint", bounded=True))
        return _ids(spark.read.schema(ROW).parquet(f"{folder}/out"))

    _append(spark, log, 0, 50)
    assert run() == run() == list(range(50))
    _append(spark, log, 50, 80)
    assert run() == run() == list(range(80))


def test_small_batches_lose_nothing(spark, folder):
    log = f"{folder}/log"
    _append(spark, log, 0, 20)
    rows = decode_rows(event_log_stream(spark, log, TOPIC, batch_bytes=1), ROW)
    finish(start_files(rows, f"{folder}/out", f"{folder}/checkpoint", bounded=True))
    assert _ids(spark.read.schema(ROW).parquet(f"{folder}/out")) == list(range(20))
    assert len(glob.glob(f"{folder}/checkpoint/commits/[0-9]*")) == 2


def test_no_file_is_too_old(spark, folder):
    """Files that arrive late but carry a date of years ago are read as well."""
    log = f"{folder}/log"
    known: set[str] = set()
    for i, year in enumerate([2020, 2010, 2000]):
        _append(spark, log, 10 * i, 10 * i + 10)
        files = set(glob.glob(f"{log}/**/*.parquet", recursive=True))
        for path in files - known:
            age = (year - 1970) * 365 * 86400
            os.utime(path, (age, age))
        known = files
        rows = decode_rows(event_log_stream(spark, log, TOPIC), ROW)
        finish(start_files(rows, f"{folder}/out", f"{folder}/checkpoint", bounded=True))
        assert _ids(spark.read.schema(ROW).parquet(f"{folder}/out")) == list(range(10 * i + 10))


def test_only_subscribed_topics(spark, folder):
    for i, topic in enumerate(["t.a.b", "t.a.c", "t.a.d"]):
        _append(spark, folder, 10 * i, 10 * i + 10, topic)
    one = named_result(decode_rows(event_log_stream(spark, folder, "t.a.c"), ROW), "one")
    assert _ids(one) == list(range(10, 20))
    two = event_log_stream(spark, folder, ["t.a.b", "t.a.d"])
    topics = named_result(two.select("topic"), "two").groupBy("topic").count().collect()
    assert sorted(map(tuple, topics)) == [("t.a.b", 10), ("t.a.d", 10)]


def test_named_result_lies_in_files(spark, folder):
    _append(spark, folder, 0, 30)
    for _ in range(2):  # a name can be used again
        df = rows_to_view(event_log_stream(spark, folder, TOPIC), "result", ROW)
        assert _ids(df) == list(range(30))
    assert spark.sql("SELECT count(*) AS n FROM result").first().n == 30
    assert df.inputFiles()


def test_memory_table(spark, folder):
    _append(spark, folder, 0, 30)
    finish(start_memory(decode_rows(event_log_stream(spark, folder, TOPIC), ROW), "held", bounded=True))
    assert _ids(spark.table("held")) == list(range(30)) and not spark.table("held").inputFiles()


def test_topics_named_twice_are_read_once(spark, folder):
    _append(spark, folder, 0, 10)
    rows = decode_rows(event_log_stream(spark, folder, f"{TOPIC},{TOPIC}"), ROW)
    assert _ids(named_result(rows, "once")) == list(range(10))


def test_a_stream_waits_for_the_first_event(spark, folder):
    log = f"{folder}/log"
    query = start_memory(decode_rows(event_log_stream(spark, log, TOPIC), ROW), "waiting")
    try:
        query.processAllAvailable()
        assert _ids(spark.table("waiting")) == []
        _append(spark, log, 0, 5)
        query.processAllAvailable()
        assert _ids(spark.table("waiting")) == list(range(5))
    finally:
        query.stop()


def test_no_checkpoint_is_left_behind(spark, folder, monkeypatch):
    monkeypatch.setattr("millrace.streaming.sinks.new_folder", lambda _: f"{folder}/run-1")
    _append(spark, f"{folder}/log", 0, 3)
    rows = decode_rows(event_log_stream(spark, f"{folder}/log", TOPIC), ROW)
    for start in (start_console, lambda r, bounded: start_memory(r, "gone", bounded)):
        query = start(rows, bounded=True)
        finish(query)
        assert not os.path.exists(f"{folder}/run-1")


def test_named_result_goes_on_in_its_folder(spark, folder):
    log, kept = f"{folder}/log", f"{folder}/kept"
    for end in (10, 25):
        _append(spark, log, 0 if end == 10 else 10, end)
        df = rows_to_view(event_log_stream(spark, log, TOPIC), "kept", ROW, folder=kept)
        assert _ids(df) == list(range(end))


def test_unbounded_query_runs_until_it_is_stopped(spark, folder):
    _append(spark, folder, 0, 10)
    query = start_memory(decode_rows(event_log_stream(spark, folder, TOPIC), ROW), "live")
    try:
        query.processAllAvailable()
        assert _ids(spark.table("live")) == list(range(10))
        _append(spark, folder, 10, 15)
        query.processAllAvailable()
        assert _ids(spark.table("live")) == list(range(15))
        assert query.isActive
        with pytest.raises(TimeoutError):
            finish(query, timeout=0.5)
        assert not query.isActive
    finally:
        query.stop()


def test_every_start_replays_from_the_oldest(spark, folder, capsys):
    _append(spark, folder, 0, 3)
    for _ in range(2):
        finish(rows_to_console(event_log_stream(spark, folder, TOPIC), ROW, bounded=True))
        out = capsys.readouterr().out
        assert "Batch: 0" in out and all(f"a name of twenty and more letters {i}|" in out for i in range(3))


def test_console_cuts_values_and_rows(spark, folder, capsys):
    _append(spark, folder, 0, 25)
    rows = decode_rows(event_log_stream(spark, folder, TOPIC), ROW)
    finish(start_console(rows, bounded=True))
    out = capsys.readouterr().out
    assert out.count("|a name of twenty ...|") == 20 and "only showing top 20 rows" in out


def test_documents_on_the_console(spark, folder, capsys):
    people = spark.createDataFrame(
        [(("65",), "Ana", 23, "2001")], "_id struct<`$oid`:string>, nome string, idade int, date string"
    )
    append_events(documents_to_events(people, TOPIC), folder, first_offset=0)
    finish(documents_to_console(event_log_stream(spark, folder, TOPIC), bounded=True))
    out = capsys.readouterr().out
    assert "|nome|idade|" in out and "| Ana|   23|" in out
    stream = decode_documents(event_log_stream(spark, folder, TOPIC), PERSON_DOCUMENT)
    assert named_result(stream, "people").first().asDict(recursive=True) == {
        "_id": {"$oid": "65"}, "nome": "Ana", "idade": 23,
    }


def test_damaged_events_do_not_stop_a_stream(spark, folder):
    values = [(None, None, TOPIC), (None, bytearray(b"{"), TOPIC), (None, bytearray(b'{"payload":{}}'), TOPIC)]
    append_events(spark.createDataFrame(values, "key binary, value binary, topic string"), folder, first_offset=0)
    _append(spark, folder, 0, 2)
    stream = event_log_stream(spark, folder, TOPIC)
    assert named_result(decode_rows(stream, ROW), "all_rows").count() == 5
    assert _ids(named_result(decode_rows(stream, ROW, drop_empty=True), "full_rows")) == [0, 1]


def test_errors_of_a_query_are_raised(spark, folder):
    _append(spark, folder, 0, 2)
    bad = event_log_stream(spark, folder, TOPIC).select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(StreamingQueryException):
        finish(start_files(bad, f"{folder}/out", f"{folder}/checkpoint", bounded=True))


class _Reader:
    """Stands for a session's stream reader and notes what it is told."""

    def __init__(self):
        self.readStream = self
        self.told = {}

    def format(self, name):
        self.told["format"] = name
        return self

    def option(self, name, value):
        self.told[name] = value
        return self

    def options(self, **options):
        self.told.update(options)
        return self

    def load(self):
        return self.told


def test_broker_source_options():
    assert kafka_stream(_Reader(), "broker:9092", "t.a.b") == {
        "format": "kafka",
        "kafka.bootstrap.servers": "broker:9092",
        "subscribe": "t.a.b",
        "startingOffsets": "earliest",
    }
    told = kafka_stream(_Reader(), "b:1", ["x", "y"], "latest", maxOffsetsPerTrigger="5")
    assert (told["subscribe"], told["startingOffsets"], told["maxOffsetsPerTrigger"]) == ("x,y", "latest", "5")


def test_broker_source_needs_its_package(spark):
    with pytest.raises(AnalysisException, match="kafka"):
        kafka_stream(spark, "broker:9092", ["t.a.b"])
