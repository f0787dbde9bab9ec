"""Delimited text, money text, stages, previews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalogue.inputs import EXPENSE_SQL, EXPENSE_TEXT, expenses_text, money_text, table, write_delimited
from millrace.catalogue.registry import query
from millrace.plans.tables import preview_delimited, read_money
from millrace.sinks.files import write_stage
from millrace.sources.files import read_delimited, read_stage
from millrace.workspace import new_folder


def _orders_text(spark: SparkSession, sf_dir: str) -> str:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderdate", F.to_date("o_orderdate"))
    return write_delimited(orders, new_folder(spark))


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
    FROM orders
    """
)
def csv_comma_infer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comma-separated text with inferred types; keys widen with the data."""
    return read_delimited(spark, _orders_text(spark, sf_dir)).withColumns(
        {key: F.col(key).cast("bigint") for key in ("o_orderkey", "o_custkey")}
    )


@query(EXPENSE_SQL)
def csv_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``;``-separated text with a declared schema and a money column."""
    return read_money(
        spark,
        expenses_text(spark, sf_dir, new_folder(spark)),
        money=["valor"],
        schema=EXPENSE_TEXT,
    )


@query("SELECT l_orderkey, l_linenumber, floor(l_extendedprice) AS valor FROM lineitem")
def csv_money_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Money under a header in another case, which inference alone would take for numbers."""
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_extendedprice")
    marked = F.translate(F.format_number(F.floor("l_extendedprice"), 0), ",", ".")
    path = write_delimited(items.select("l_orderkey", "l_linenumber", marked.alias("VALOR")), new_folder(spark), sep=";")
    rows = read_money(spark, path, money=["valor"])
    return rows.select(F.col("l_orderkey").cast("bigint"), "l_linenumber", F.col("valor").alias("valor"))


@query(
    """
    SELECT l_orderkey, l_linenumber, l_returnflag,
           CASE
             WHEN l_linenumber IN (1, 2, 3) THEN round(l_extendedprice, 2)
             WHEN l_linenumber = 4 THEN -round(l_extendedprice, 2)
             WHEN l_linenumber = 5 AND l_returnflag = 'A' THEN round(l_extendedprice * 100, 0)
             WHEN l_linenumber = 5 AND l_returnflag = 'N' THEN round(l_extendedprice * 1000, 0)
           END AS valor
    FROM lineitem
    """
)
def money_edge_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every price in one of the spellings that occur, readable or not."""
    items = table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"
    )
    price = F.col("l_extendedprice")
    bare = F.translate(F.format_number(price, 2), ",.", ".,")
    plain = F.format_number(price, 2)
    line, flag = F.col("l_linenumber"), F.col("l_returnflag")
    text = (
        F.when(line == 1, money_text(price))
        .when(line == 2, bare)
        .when(line == 3, F.concat(F.lit("R$"), bare))
        .when(line == 4, money_text(-price))
        # A point is a thousands mark, wherever it stands.
        .when((line == 5) & (flag == "A"), F.replace(plain, F.lit(","), F.lit("")))
        .when((line == 5) & (flag == "N"), F.replace(F.format_number(price, 3), F.lit(","), F.lit("")))
        .when(line == 5, F.concat(F.lit("-"), money_text(price)))
        .when((line == 6) & (flag == "A"), F.concat(F.lit("("), bare, F.lit(")")))
        .when((line == 6) & (flag == "N"), F.concat(F.lit("US$ "), bare))
        .when(line == 6, F.concat(bare, F.lit(" reais")))
        .when(flag == "A", F.lit(""))
        .when(flag == "N", F.lit("abc"))
    )
    path = write_delimited(
        items.select("l_orderkey", "l_linenumber", "l_returnflag", text.alias("valor")),
        new_folder(spark),
        sep=";",
    )
    return read_money(
        spark,
        path,
        money=["valor"],
        schema="l_orderkey BIGINT, l_linenumber INT, l_returnflag STRING, valor STRING",
    )


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def parquet_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage written twice holds the last content only."""
    stage = f"{new_folder(spark)}/stage"
    customers = table(spark, sf_dir, "customer")
    write_stage(customers.withColumn("c_acctbal", F.col("c_acctbal") + 1), stage)
    write_stage(customers, stage)
    return read_stage(spark, stage)


@query(
    """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
           CAST(o_orderdate AS DATE) AS o_orderdate, o_orderpriority
    FROM orders ORDER BY o_orderkey LIMIT 20
    """
)
def preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First rows of comma-separated text by key."""
    return preview_delimited(spark, _orders_text(spark, sf_dir), order_by="o_orderkey").withColumns(
        {key: F.col(key).cast("bigint") for key in ("o_orderkey", "o_custkey")}
    )
