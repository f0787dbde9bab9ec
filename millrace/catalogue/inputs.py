"""Inputs the queries derive from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

from millrace.sinks.topics import append_events
from millrace.sources.database import CONNECTIONS, Database
from millrace.workspace import new_folder

# What the stored documents hold.
PERSON = "_id STRUCT<`$oid`: STRING>, nome STRING, idade INT, date TIMESTAMP_NTZ"


def row(**fields: type[DataType]) -> StructType:
    """A row schema from field names and types."""
    return StructType([StructField(name, kind()) for name, kind in fields.items()])


# The orders as their events declare them.
ORDER_ROW = row(
    o_orderkey=LongType,
    o_custkey=LongType,
    o_orderstatus=StringType,
    o_totalprice=DoubleType,
    o_orderdate=TimestampNTZType,
    o_orderpriority=StringType,
)


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """Columns of a test table, read as it lies."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def money_text(amount: Column) -> Column:
    """An amount as ``R$ 1.234,56``."""
    return F.concat(F.lit("R$ "), F.translate(F.format_number(amount, 2), ",.", ".,"))


def write_delimited(df: DataFrame, folder: str, sep: str = ",") -> str:
    path = f"{folder}/text"
    df.write.csv(path, sep=sep, header=True)
    return path


# The line items as text has them, and as the tables made from it.
EXPENSE_TEXT = row(
    l_orderkey=LongType,
    l_partkey=LongType,
    l_suppkey=LongType,
    l_linenumber=IntegerType,
    l_quantity=DoubleType,
    valor=StringType,
    l_discount=DoubleType,
    l_tax=DoubleType,
    l_returnflag=StringType,
    l_linestatus=StringType,
    l_shipdate=TimestampNTZType,
)
EXPENSE_SQL = """
    SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, round(l_extendedprice, 2) AS valor,
           l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
    FROM lineitem
"""


def expenses_text(spark: SparkSession, sf_dir: str, folder: str) -> str:
    """The line items as ``;``-separated text with their prices as money text."""
    items = table(spark, sf_dir, "lineitem").withColumnRenamed("l_extendedprice", "valor")
    return write_delimited(items.withColumn("valor", money_text(F.col("valor"))), folder, sep=";")


def write_log(events: DataFrame, topic: str | None = None) -> str:
    """Write events out as a new log; see ``append_events`` for ``topic``."""
    log = f"{new_folder(events.sparkSession)}/log"
    append_events(events, log, topic, first_offset=0)
    return log


def people(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers as documents; ``date`` is a field that not all decoders declare."""
    key = F.col("c_custkey").cast("int")
    # The start of the orders, with as many days and microseconds as the key says.
    date = F.make_timestamp_ntz(F.lit(1992), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    date = date + F.make_dt_interval(days=key % 1000, secs=(key / F.lit(1_000_000)).cast("decimal(18,6)"))
    return table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey").select(
        F.struct(F.lpad(F.lower(F.hex("c_custkey")), 24, "0").alias("$oid")).alias("_id"),
        F.col("c_name").alias("nome"),
        F.col("c_nationkey").alias("idade"),
        date.alias("date"),
    )


def database(spark: SparkSession) -> Database:
    """The database the session names, else one in the memory of this process.

    The latter is seen by this process only and serves a local master, whose
    tasks run in it; on a cluster set ``spark.millrace.jdbc.url``, ``.driver``,
    ``.user``, ``.password`` and ``.connections``.
    """

    def setting(name: str) -> str | None:
        return spark.conf.get(f"spark.millrace.jdbc.{name}", None)

    if setting("url"):
        given = [setting(name) for name in ("url", "driver", "user", "password")]
        return Database(*given, connections=int(setting("connections") or CONNECTIONS))
    master = spark.conf.get("spark.master", "")
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.millrace.jdbc.url to a database that every executor reaches")
    return Database(
        f"jdbc:derby:memory:run{uuid.uuid4().hex};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    )


def new_table_name(stem: str) -> str:
    """A table name that no other run uses."""
    return f"{stem}_{uuid.uuid4().hex[:12]}"
