"""A topic whose rows change their fields and types."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from millrace.catalogue.inputs import row, table, write_log
from millrace.catalogue.registry import query
from millrace.functions.envelope import event_json, json_bytes
from millrace.operators.capture import topic_name
from millrace.operators.drift import drifting_rows, merged_schema, rejected
from millrace.sources.topics import event_log

ORDERS = topic_name("shop", "public", "orders")

_KIND = "o_orderkey % 3"
_LIVE = "o_orderkey % 50 <> 0"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of three generations of their producer, some damaged: a price is an integer, then has a fraction, then is text."""
    orders = table(spark, sf_dir, "orders")
    key, whole = F.col("o_orderkey"), F.floor("o_totalprice").cast("long")
    rows = [
        F.struct(key, whole.alias("price"), "o_orderstatus"),
        F.struct(key, (whole + F.lit(0.5)).alias("price"), "o_orderpriority"),
        F.struct(key, F.concat(F.lit("R$ "), whole).alias("price")),
    ]
    value = F.when(key % 50 == 0, F.lit("{damaged").cast("binary"))
    for n, after in enumerate(rows):
        value = value.when(key % 3 == n, event_json(after))
    events = orders.select(json_bytes(F.struct("o_orderkey")).alias("key"), value.alias("value"), F.lit(ORDERS).alias("topic"))
    return event_log(spark, write_log(events, ORDERS), ORDERS)


@query(
    f"""
    SELECT o_orderkey, CASE {_KIND} WHEN 1 THEN floor(o_totalprice)::BIGINT || '.5' WHEN 2 THEN 'R$ ' || floor(o_totalprice)::BIGINT
             ELSE floor(o_totalprice)::BIGINT::VARCHAR END AS price,
           CASE {_KIND} WHEN 0 THEN o_orderstatus END AS o_orderstatus, CASE {_KIND} WHEN 1 THEN o_orderpriority END AS o_orderpriority,
           0 AS beside
    FROM orders WHERE {_LIVE}
    """
)
def drift_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events under the one schema that their own fields give."""
    events = _events(spark, sf_dir)
    return drifting_rows(events, merged_schema(events)).withColumn("beside", F.size("rest")).drop("rest")


@query(
    f"""
    SELECT o_orderkey, CASE {_KIND} WHEN 0 THEN floor(o_totalprice) WHEN 1 THEN floor(o_totalprice) + 0.5 END AS price,
           CASE {_KIND} WHEN 2 THEN 'R$ ' || floor(o_totalprice)::BIGINT END AS price_text,
           CASE {_KIND} WHEN 0 THEN o_orderstatus END AS status, CASE {_KIND} WHEN 1 THEN o_orderpriority END AS priority,
           NULL::VARCHAR AS reason
    FROM orders WHERE {_LIVE}
    UNION ALL
    SELECT NULL, NULL, NULL, NULL, NULL, 'not JSON' FROM orders WHERE NOT ({_LIVE})
    """
)
def drift_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two declared fields, all others and what does not fit beside them, and the events that cannot be read."""
    events = _events(spark, sf_dir)
    names = {"price_text": "price", "status": "o_orderstatus", "priority": "o_orderpriority"}
    rows = drifting_rows(events, row(o_orderkey=LongType, price=DoubleType))
    rows = rows.select("o_orderkey", "price", *(F.col("rest")[c].alias(name) for name, c in names.items()))
    return rows.unionByName(rejected(events).select("reason"), allowMissingColumns=True)
