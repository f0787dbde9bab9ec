"""Events decoded as bounded frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from millrace.catalogue.inputs import ORDER_ROW, people, table, write_log
from millrace.catalogue.registry import query
from millrace.functions.envelope import PERSON_DOCUMENT, event_json, row_json
from millrace.operators.capture import documents_to_events, snapshot_to_events, topic_name
from millrace.operators.decode import decode_documents, decode_rows
from millrace.sources.topics import event_log

TOPIC = topic_name("shop", "public", "orders")


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders", *ORDER_ROW.names)


def _decoded(events: DataFrame, row: StructType) -> DataFrame:
    return decode_rows(event_log(events.sparkSession, write_log(events, TOPIC), TOPIC), row)


def _with_value(orders: DataFrame, value) -> DataFrame:
    return orders.select(
        F.lit(None).cast("binary").alias("key"), value.alias("value"), F.lit(TOPIC).alias("topic")
    )


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def pg_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relational events to rows."""
    orders = _orders(spark, sf_dir)
    after = F.struct(*[F.col(name) for name in ORDER_ROW.names])
    return _decoded(_with_value(orders, event_json(after)), ORDER_ROW)


@query(
    "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders",
    name="snapshot_to_events",
)
def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table as events and back."""
    return _decoded(snapshot_to_events(_orders(spark, sf_dir), ["o_orderkey"], TOPIC), ORDER_ROW)


@query(
    """
    SELECT CASE WHEN o_orderstatus <> 'P' THEN o_orderkey END AS o_orderkey,
           CASE WHEN o_orderstatus <> 'P' THEN o_custkey END AS o_custkey,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS o_orderdate,
           CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS o_orderpriority
    FROM orders
    """
)
def pg_decode_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletions, here the orders with status P, stay as rows of NULLs."""
    after = F.when(F.col("o_orderstatus") != "P", F.struct(*[F.col(name) for name in ORDER_ROW.names]))
    return _decoded(_with_value(_orders(spark, sf_dir), event_json(after)), ORDER_ROW)


@query(
    """
    SELECT CASE WHEN o_orderpriority IN ('2-HIGH', '5-LOW') THEN o_orderkey END AS o_orderkey,
           CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW') THEN o_custkey END AS o_custkey,
           CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW') THEN o_orderstatus END AS o_orderstatus,
           CASE WHEN o_orderpriority IN ('3-MEDIUM', '5-LOW') THEN o_totalprice END AS o_totalprice,
           CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW') THEN o_orderdate END AS o_orderdate,
           CASE WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM', '5-LOW') THEN o_orderpriority END AS o_orderpriority
    FROM orders
    """
)
def pg_decode_permissive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events damaged in ways that depend on the priority of their order.

    1: cut off before its end; 2: the price is text; 3: the key has another
    name; 4: no value at all; 5: intact.
    """
    priority = F.col("o_orderpriority")
    rest = [F.col(name) for name in ("o_custkey", "o_orderstatus")]
    key, price, date = F.col("o_orderkey"), F.col("o_totalprice"), F.col("o_orderdate")
    intact = event_json(F.struct(key, *rest, price, date, priority)).cast("string")
    value = (
        F.when(priority == "1-URGENT", F.substring_index(intact, ",", 1))
        .when(
            priority == "2-HIGH",
            event_json(F.struct(key, *rest, price.cast("string").alias("o_totalprice"), date, priority)).cast("string"),
        )
        .when(
            priority == "3-MEDIUM",
            event_json(F.struct(key.alias("orderkey"), *rest, price, date, priority)).cast("string"),
        )
        .when(priority == "5-LOW", intact)
    )
    return _decoded(_with_value(_orders(spark, sf_dir), value.cast("binary")), ORDER_ROW)


@query(
    """
    SELECT o_orderkey, o_custkey, CAST(NULL AS VARCHAR) AS o_status, o_totalprice, o_orderdate, o_orderpriority
    FROM orders
    """
)
def pg_decode_renamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field declared under a name that the events do not use is NULL throughout."""
    declared = StructType(
        [
            StructField("o_status", f.dataType) if f.name == "o_orderstatus" else f
            for f in ORDER_ROW
        ]
    )
    return _decoded(snapshot_to_events(_orders(spark, sf_dir), ["o_orderkey"], TOPIC), declared)


@query(
    """
    SELECT lpad(printf('%x', c_custkey), 24, '0') AS id, c_name AS nome, c_nationkey AS idade
    FROM customer
    """
)
def mongo_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document events to rows, in two parsing steps."""
    topic = topic_name("school", "people", "students")
    log = write_log(documents_to_events(people(spark, sf_dir), topic), topic)
    return decode_documents(
        event_log(spark, log, topic),
        PERSON_DOCUMENT,
        {"id": "_id.`$oid`", "nome": "nome", "idade": "idade"},
    )


@query(
    """
    SELECT CASE c_mktsegment WHEN 'BUILDING' THEN NULL ELSE c_name END AS nome,
           CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_nationkey END AS idade
    FROM customer
    """
)
def mongo_decode_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in the shapes that occur, depending on the market segment.

    Deleted (BUILDING), numbers wrapped in an object (MACHINERY), an object
    instead of its text (FURNITURE), plain text (all others).
    """
    topic = topic_name("school", "people", "students")
    customers = table(spark, sf_dir, "customer", "c_name", "c_nationkey", "c_mktsegment").select(
        F.col("c_name").alias("nome"), F.col("c_nationkey").alias("idade"), "c_mktsegment"
    )
    segment = F.col("c_mktsegment")
    wrapped = F.to_json(
        F.struct("nome", F.struct(F.col("idade").cast("string").alias("$numberLong")).alias("idade"))
    )
    text = F.when(segment == "MACHINERY", wrapped).when(segment != "BUILDING", row_json(["nome", "idade"]))
    value = F.when(segment == "FURNITURE", event_json(F.struct("nome", "idade"))).otherwise(event_json(text))
    events = customers.select(
        F.lit(None).cast("binary").alias("key"), value.alias("value"), F.lit(topic).alias("topic")
    )
    return decode_documents(
        event_log(spark, write_log(events, topic), topic), PERSON_DOCUMENT, {"nome": "nome", "idade": "idade"}
    )
