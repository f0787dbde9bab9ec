"""Tables and collections as change events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, LongType, StringType

from millrace.catalogue.inputs import ORDER_ROW, PERSON, people, row, table, write_log
from millrace.catalogue.registry import query
from millrace.functions.envelope import after_row
from millrace.operators.capture import capture_tables, diff_to_events, topic_name
from millrace.sinks.files import append_documents
from millrace.sources.files import read_documents
from millrace.sources.topics import event_log
from millrace.workspace import new_folder

ORDERS = topic_name("shop", "public", "orders")


@query(
    """
    WITH old AS (
      SELECT * FROM orders WHERE o_orderstatus <> 'P'
    ), new AS (
      SELECT * REPLACE (
        o_totalprice + CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END AS o_totalprice,
        o_orderdate + CASE WHEN o_orderpriority = '2-HIGH' THEN INTERVAL 7 MICROSECONDS
                           ELSE INTERVAL 0 MICROSECONDS END AS o_orderdate)
      FROM orders WHERE NOT (o_orderstatus = 'F' AND o_orderpriority = '5-LOW')
    )
    SELECT coalesce(new.o_orderkey, old.o_orderkey) AS event_key, new.*
    FROM old FULL OUTER JOIN new ON old.o_orderkey = new.o_orderkey
    WHERE old.o_orderkey IS DISTINCT FROM new.o_orderkey
       OR old.o_totalprice IS DISTINCT FROM new.o_totalprice
       OR old.o_orderdate IS DISTINCT FROM new.o_orderdate
    """,
    name="diff_to_events",
)
def diff_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two states of the orders as events, then decoded with their keys.

    Between the states orders with status P arrive, finished orders of low
    priority leave, urgent orders change their price and those of high priority
    their date, by microseconds.
    """
    orders = table(spark, sf_dir, "orders", *ORDER_ROW.names)
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    old = orders.where(status != "P")
    new = orders.where(~((status == "F") & (priority == "5-LOW"))).withColumns(
        {
            "o_totalprice": F.col("o_totalprice") + F.when(priority == "1-URGENT", 1).otherwise(0),
            "o_orderdate": F.col("o_orderdate")
            + F.when(priority == "2-HIGH", F.expr("INTERVAL '0.000007' SECOND")).otherwise(F.expr("INTERVAL '0' SECOND")),
        }
    )
    log = write_log(diff_to_events(old, new, ["o_orderkey"], ORDERS), ORDERS)
    key = F.from_json(F.col("key").cast("string"), "o_orderkey BIGINT")["o_orderkey"]
    return (
        event_log(spark, log, ORDERS)
        .select(key.alias("event_key"), after_row(F.col("value"), ORDER_ROW).alias("after"))
        .select("event_key", "after.*")
    )


@query(
    """
    WITH documents AS (
      SELECT lpad(printf('%x', c_custkey), 24, '0') AS id, c_name AS nome, c_nationkey AS idade,
             TIMESTAMP '1992-01-01' + to_days((c_custkey % 1000)::INTEGER) + to_microseconds(c_custkey) AS date
      FROM customer
    )
    SELECT * FROM documents UNION ALL SELECT * FROM documents
    """
)
def documents_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A collection to which the same documents were added twice."""
    path = f"{new_folder(spark)}/students"
    append_documents(people(spark, sf_dir), path)
    append_documents(people(spark, sf_dir), path)
    stored = read_documents(spark, path, PERSON)
    return stored.select(F.col("_id.`$oid`").alias("id"), "nome", "idade", "date")


@query(
    """
    SELECT 'shop.public.customer' AS topic, c_custkey AS id, c_name AS name, c_nationkey AS n,
           c_mktsegment AS a, NULL AS b, c_acctbal AS v FROM customer
    UNION ALL
    SELECT 'shop.public.part', p_partkey, p_name, p_size, p_brand, p_type, p_retailprice FROM part
    """
)
def captured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three tables of which two are on the list to capture, each on its own topic."""

    def named(source: str, **columns: str) -> tuple[DataFrame, list[str]]:
        """All columns of a table under the names that the result has."""
        rows = table(spark, sf_dir, source)
        return rows.select(*(F.col(c).alias(to) for to, c in columns.items())), ["id"]

    tables = {
        "customer": named("customer", id="c_custkey", name="c_name", n="c_nationkey", v="c_acctbal", a="c_mktsegment"),
        "part": named("part", id="p_partkey", name="p_name", a="p_brand", b="p_type", n="p_size", v="p_retailprice"),
        "supplier": named("supplier", id="s_suppkey", name="s_name", n="s_nationkey", v="s_acctbal"),
    }
    log = write_log(capture_tables(tables, "shop", "public", include=["customer", "part"]))
    after = after_row(F.col("value"), row(id=LongType, name=StringType, n=IntegerType, a=StringType, b=StringType, v=DoubleType))
    topics = [topic_name("shop", "public", name) for name in tables]
    return event_log(spark, log, topics).select("topic", after.alias("after")).select("topic", "after.*")
