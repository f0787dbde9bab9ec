"""What the physical plans must and must not hold."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

from conftest import DATA
from pyspark.sql import functions as F

from millrace.catalogue import QUERIES
from millrace.catalogue.inputs import ORDER_ROW, people, table
from millrace.functions.envelope import PERSON_DOCUMENT
from millrace.operators.capture import diff_to_events, documents_to_events, snapshot_to_events
from millrace.operators.decode import decode_documents, decode_rows
from millrace.operators.preview import preview
from millrace.plans.tables import read_money
from millrace.sinks.topics import append_events
from millrace.sources.topics import event_log

SF = str(DATA / "sf0.001")


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def orders(spark):
    return spark.read.parquet(f"{SF}/orders.parquet").select(*ORDER_ROW.names)


def test_decoding_reads_the_value_and_parses_once(spark, folder):
    append_events(snapshot_to_events(orders(spark), ["o_orderkey"], "t.a.b"), folder, "t.a.b", first_offset=0)
    for drop in (False, True):
        text = plan(decode_rows(event_log(spark, folder, "t.a.b"), ORDER_ROW, drop_empty=drop))
        assert text.count("from_json") == 1
        assert "ReadSchema: struct<value:binary>" in text
        assert "topic=t.a.b]" in text and "topic=t.a.c" not in text
        assert "Exchange" not in text and "Python" not in text


def test_documents_parse_twice_and_no_more(spark, folder):
    append_events(documents_to_events(people(spark, SF), "t.a.b"), folder, "t.a.b", first_offset=0)
    text = plan(decode_documents(event_log(spark, folder, "t.a.b"), PERSON_DOCUMENT))
    assert text.count("from_json") == 2 and "Exchange" not in text


def test_encoding_is_one_projection(spark):
    text = plan(snapshot_to_events(orders(spark).select("o_orderkey", "o_totalprice"), ["o_orderkey"], "t"))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in text
    assert "Exchange" not in text and "Python" not in text


def test_diff_shuffles_each_side_once(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = orders(spark).withColumn("o_totalprice", F.col("o_totalprice") + 1)
        text = plan(diff_to_events(orders(spark), new, ["o_orderkey"], "t"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    tree = text.split("\n\n")[0]
    assert tree.count("Exchange") == 2 and tree.count("Sort (") == 2
    assert "SortMergeJoin" in tree and "FullOuter" in tree
    assert "CartesianProduct" not in text and "BroadcastNestedLoop" not in text


def test_money_is_one_generated_projection(spark, folder):
    spark.createDataFrame([("1,5",)], "valor string").write.csv(f"{folder}/in", sep=";", header=True)
    text = plan(read_money(spark, f"{folder}/in", ["valor"], schema="valor STRING"))
    assert text.split("\n\n")[0].count("Project") == 1 and "* Project" in text
    assert "regexp" not in text


def test_ordered_preview_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(preview(orders(spark), "o_orderkey"))


def test_no_query_leaves_the_jvm(spark):
    for name in ("csv_money", "pg_decode", "mongo_decode", "diff_to_events", "stage_loop"):
        text = plan(QUERIES[name](spark, SF))
        assert "Python" not in text and "Pandas" not in text


def test_tables_are_read_as_they_lie(spark):
    text = plan(table(spark, SF, "orders", "o_orderkey"))
    assert "Exchange" not in text and "ReadSchema: struct<o_orderkey:bigint>" in text
