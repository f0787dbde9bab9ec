"""Topics decoded as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructType, TimestampNTZType

from millrace.catalogue.inputs import ORDER_ROW, PERSON, people, row, table, write_log
from millrace.catalogue.registry import query
from millrace.functions.envelope import PERSON_DOCUMENT
from millrace.operators.capture import documents_to_events, snapshot_to_events, topic_name
from millrace.operators.decode import decode_documents, decode_rows
from millrace.plans.capture import capture_collection
from millrace.plans.topics import documents_to_console, rows_to_console, rows_to_view
from millrace.sinks.files import append_documents
from millrace.sinks.topics import append_events
from millrace.sources.topics import end_offset, event_log, event_log_stream
from millrace.streaming.joins import join_within
from millrace.streaming.sinks import finish, start_files
from millrace.workspace import new_folder

EVENT_ROW = row(
    event_id=LongType, ts=TimestampNTZType, user_id=LongType, event_type=StringType, value=DoubleType, props=StringType
)
ORDERS = topic_name("shop", "public", "orders")
CLICKS = topic_name("shop", "public", "events")
STUDENTS = topic_name("school", "people", "students")


def _orders_log(spark: SparkSession, sf_dir: str) -> str:
    orders = table(spark, sf_dir, "orders", *ORDER_ROW.names)
    return write_log(snapshot_to_events(orders, ["o_orderkey"], ORDERS), ORDERS)


def _filed(rows: DataFrame) -> DataFrame:
    """What a stream writes to files; they stay, as the result is read from them."""
    folder = new_folder(rows.sparkSession)
    finish(start_files(rows, f"{folder}/rows", f"{folder}/checkpoint", bounded=True))
    return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")


def _people_log(spark: SparkSession, sf_dir: str) -> str:
    return write_log(documents_to_events(people(spark, sf_dir), STUDENTS), STUDENTS)


@query("SELECT event_id, ts, user_id, event_type, value, props FROM events")
def stream_pg_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic as a table that SQL names, kept in files like any other."""
    clicks = table(spark, sf_dir, "events", *EVENT_ROW.names)
    log = write_log(snapshot_to_events(clicks, ["event_id"], CLICKS), CLICKS)
    return rows_to_view(event_log_stream(spark, log, CLICKS), "clicks", EVENT_ROW)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def stream_pg_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A topic as a table that SQL names, of rows with dates."""
    log = _orders_log(spark, sf_dir)
    return rows_to_view(event_log_stream(spark, log, ORDERS), "orders_of_topic", ORDER_ROW)


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def stream_pg_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A relational topic on the console, and the rows of the same stream in files beside it."""
    log = _orders_log(spark, sf_dir)
    stream = event_log_stream(spark, log, ORDERS)
    finish(rows_to_console(stream, ORDER_ROW, bounded=True))
    return _filed(decode_rows(stream, ORDER_ROW))


@query("SELECT c_name AS nome, c_nationkey AS idade FROM customer")
def stream_mongo_console(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document topic on the console, and the rows of the same stream in files beside it."""
    log = _people_log(spark, sf_dir)
    stream = event_log_stream(spark, log, STUDENTS)
    finish(documents_to_console(stream, bounded=True))
    return _filed(decode_documents(stream, PERSON_DOCUMENT, {"nome": "nome", "idade": "idade"}))


@query("SELECT c_name AS nome, c_nationkey AS idade FROM customer")
def stream_mongo_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents added to a collection, captured, and their topic decoded into files."""
    folder = new_folder(spark)
    append_documents(people(spark, sf_dir), f"{folder}/students")
    topic = capture_collection(
        spark, f"{folder}/students", PERSON, f"{folder}/log", "school", "people", "students"
    )
    rows = decode_documents(
        event_log_stream(spark, f"{folder}/log", topic),
        PERSON_DOCUMENT,
        {"nome": "nome", "idade": "idade"},
    )
    finish(start_files(rows, f"{folder}/rows", f"{folder}/checkpoint", bounded=True))
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def stream_resume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream started again adds what the log gained and nothing else.

    The log first holds the orders that are not urgent, then the urgent ones as
    well; the third start finds nothing new.
    """
    folder = new_folder(spark)
    log = f"{folder}/log"
    orders = table(spark, sf_dir, "orders", *ORDER_ROW.names)
    urgent = F.col("o_orderpriority") == "1-URGENT"

    def run() -> StructType:
        rows = decode_rows(event_log_stream(spark, log, ORDERS), ORDER_ROW)
        finish(start_files(rows, f"{folder}/rows", f"{folder}/checkpoint", bounded=True))
        return rows.schema

    append_events(snapshot_to_events(orders.where(~urgent), ["o_orderkey"], ORDERS), log, ORDERS, first_offset=0)
    run()
    append_events(
        snapshot_to_events(orders.where(urgent), ["o_orderkey"], ORDERS),
        log,
        ORDERS,
        first_offset=end_offset(spark, log, ORDERS),
    )
    run()
    schema = run()
    return spark.read.schema(schema).parquet(f"{folder}/rows")


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderstatus = 'F'
    """
)
def topic_subscribe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders on a topic per status, of which one is subscribed to."""
    orders = table(spark, sf_dir, "orders", *ORDER_ROW.names)
    status = F.concat(F.lit("orders_"), F.lower("o_orderstatus"))
    log = write_log(
        snapshot_to_events(orders, ["o_orderkey"], topic_name("shop", "public", status))
    )
    finished = topic_name("shop", "public", "orders_f")
    return rows_to_view(event_log_stream(spark, log, finished), "finished_orders", ORDER_ROW)


@query(f"SELECT {', '.join(ORDER_ROW.names)} FROM orders")
def stream_before_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that subscribes before the first event finds nothing, and started again everything."""
    folder = new_folder(spark)
    log = f"{folder}/log"
    orders = table(spark, sf_dir, "orders", *ORDER_ROW.names)
    for events in (None, snapshot_to_events(orders, ["o_orderkey"], ORDERS)):
        if events is not None:
            append_events(events, log, ORDERS, first_offset=0)
        rows = decode_rows(event_log_stream(spark, log, ORDERS), ORDER_ROW)
        finish(start_files(rows, f"{folder}/rows", f"{folder}/checkpoint", bounded=True))
    return spark.read.schema(rows.schema).parquet(f"{folder}/rows")


@query("SELECT 2 * count(*) AS records, 2 * count(*) AS places FROM customer")
def captured_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection captured twice into one topic: as many places in the log as records."""
    folder = new_folder(spark)
    append_documents(people(spark, sf_dir), f"{folder}/students")
    for _ in range(2):
        topic = capture_collection(spark, f"{folder}/students", PERSON, f"{folder}/log", "school", "people", "students")
    return event_log(spark, f"{folder}/log", topic).agg(
        F.count("*").alias("records"), F.countDistinct("partition", "offset").alias("places")
    )


@query(
    """
    WITH e AS (SELECT event_id, ts, event_type, CASE WHEN event_id % 3 = 0 THEN -1 ELSE user_id END AS who FROM events)
    SELECT v.who, v.ts AS viewed, v.event_id AS view_id, f.ts AS failed, f.event_id AS error_id
    FROM e v JOIN e f ON v.who = f.who AND f.ts >= v.ts AND f.ts <= v.ts + INTERVAL 10 MINUTE
    WHERE v.event_type = 'view' AND f.event_type = 'error'
    """
)
def stream_joined_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two topics joined: views with the errors of their user in the ten minutes after them; a third has one user."""
    who = F.when(F.col("event_id") % 3 == 0, F.lit(-1).cast("long")).otherwise(F.col("user_id")).alias("who")
    clicks = table(spark, sf_dir, "events")
    sides = []
    for kind, time, key in (("view", "viewed", "view_id"), ("error", "failed", "error_id")):
        schema = row(**{"who": LongType, time: TimestampNTZType, key: LongType})
        topic = topic_name("shop", "public", kind)
        rows = clicks.where(F.col("event_type") == kind).select(who, F.col("ts").alias(time), F.col("event_id").alias(key))
        log = write_log(snapshot_to_events(rows, [key], topic), topic)
        sides.append(decode_rows(event_log_stream(spark, log, topic), schema))
    # Files of a log come in any order, so rows may be as late as the topics are long.
    return _filed(join_within(*sides, ["who"], "viewed", "failed", 600, delay="3650 days"))
