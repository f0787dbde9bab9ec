"""Envelopes: decoding case by case, encoding, and both together."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import (
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)

from millrace.functions.envelope import EXPENSE_ROW, EXPENSE_ROW_SHORT, PERSON_DOCUMENT
from millrace.operators.capture import (
    capture_tables,
    diff_to_events,
    documents_to_events,
    snapshot_to_events,
    topic_name,
)
from millrace.operators.decode import decode_documents, decode_rows
from millrace.sinks.files import append_documents
from millrace.sinks.topics import append_events
from millrace.sources.files import read_documents
from millrace.sources.topics import end_offset, event_log

NOTHING = (None,) * 5
FULL = {"id_unidade": 1, "unidade": "A", "natureza_despesa": "x", "ano": 2005, "valor": 12.5}


def _event(**changes) -> str:
    return json.dumps({"payload": {"after": {**FULL, **changes}}})


def _without(name: str) -> str:
    return json.dumps({"payload": {"after": {k: v for k, v in FULL.items() if k != name}}})


ROWS = {
    "full": (_event(), (1, "A", "x", 2005, 12.5)),
    "members beside it": (
        json.dumps({"schema": {}, "payload": {"before": FULL, "after": FULL, "op": "u"}}),
        (1, "A", "x", 2005, 12.5),
    ),
    "deleted": ('{"payload":{"after":null}}', NOTHING),
    "no payload": (json.dumps({"after": FULL}), NOTHING),
    "no envelope": (json.dumps(FULL), NOTHING),
    "no value": (None, NOTHING),
    "empty": ("", NOTHING),
    "cut off": (_event()[:40], NOTHING),
    "field missing": (_without("natureza_despesa"), (1, "A", None, 2005, 12.5)),
    "text for int": (_event(ano="2005"), (1, "A", "x", None, 12.5)),
    "int too large": (_event(ano=3000000000), (1, "A", "x", None, 12.5)),
    "fraction for int": (_event(ano=2005.0), (1, "A", "x", None, 12.5)),
    "int for double": (_event(valor=12), (1, "A", "x", 2005, 12.0)),
    "text for double": (_event(valor="12.5"), (1, "A", "x", 2005, None)),
}

DOCUMENT = '{"_id":{"$oid":"65"},"nome":"X","idade":23,"date":"2001"}'
WRAPPED = '{"_id":{"$oid":"65"},"nome":"X","idade":{"$numberLong":"23"}}'
DOCUMENTS = {
    "text": (json.dumps({"payload": {"after": DOCUMENT}}), ("X", 23)),
    "deleted": ('{"payload":{"after":null}}', (None, None)),
    "object": (json.dumps({"payload": {"after": json.loads(DOCUMENT)}}), ("X", 23)),
    "wrapped number": (json.dumps({"payload": {"after": WRAPPED}}), ("X", None)),
    "damaged text": (json.dumps({"payload": {"after": DOCUMENT[:20]}}), (None, None)),
    "no value": (None, (None, None)),
}


def _values(spark, *values):
    rows = [(None if v is None else bytearray(v.encode()),) for v in values]
    return spark.createDataFrame(rows, "value binary")


@pytest.mark.parametrize("case", ROWS)
def test_row_event(spark, case):
    value, expected = ROWS[case]
    df = decode_rows(_values(spark, value), EXPENSE_ROW)
    assert df.columns == EXPENSE_ROW.names
    assert [tuple(r) for r in df.collect()] == [expected]


def test_row_event_other_spelling(spark):
    assert EXPENSE_ROW_SHORT.names == ["id_unidade", "unidade", "natureza", "ano", "valor"]
    df = decode_rows(_values(spark, _event()), EXPENSE_ROW_SHORT)
    assert tuple(df.first()) == (1, "A", None, 2005, 12.5)


def test_empty_rows_can_be_dropped(spark):
    values = [value for value, _ in ROWS.values()]
    df = decode_rows(_values(spark, *values), EXPENSE_ROW, drop_empty=True)
    expected = [row for _, row in ROWS.values() if row != NOTHING]
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, expected))
    assert df.columns == EXPENSE_ROW.names


@pytest.mark.parametrize("case", DOCUMENTS)
def test_document_event(spark, case):
    value, expected = DOCUMENTS[case]
    df = decode_documents(_values(spark, value), PERSON_DOCUMENT, {"nome": "nome", "idade": "idade"})
    assert [tuple(r) for r in df.collect()] == [expected]


def test_document_identifier(spark):
    df = decode_documents(_values(spark, DOCUMENTS["text"][0]), PERSON_DOCUMENT, {"id": "_id.`$oid`"})
    assert df.first().id == "65"
    assert decode_documents(_values(spark, None), PERSON_DOCUMENT).columns == ["_id", "nome", "idade"]


def test_topic_name(spark):
    assert topic_name("shop", "public", "orders") == "shop.public.orders"
    tables = spark.createDataFrame([("a",), ("b",)], "t string")
    topics = tables.select(topic_name("shop", "public", F.col("t")).alias("x")).collect()
    assert [r.x for r in topics] == ["shop.public.a", "shop.public.b"]


SCHEMA = StructType(
    [
        StructField("id", LongType()),
        StructField("n", IntegerType()),
        StructField("d", DoubleType()),
        StructField("s", StringType()),
        StructField("at", StructType([StructField("$x", StringType())])),
    ]
)
TABLE = [
    (1, 7, 0.1, 'quote " and \\ and \n', ("a",)),
    (2, None, None, None, None),
    (3, -1, float("inf"), "çã€ 漢", (None,)),
    (4, 2**31 - 1, 1e-300, "", ("",)),
]


@pytest.mark.parametrize("shape", ["row", "document"])
def test_round_trip_on_disk(spark, folder, shape):
    df = spark.createDataFrame(TABLE, SCHEMA)
    if shape == "row":
        append_events(snapshot_to_events(df, ["id"], "t.a.b"), folder, first_offset=0)
        back = decode_rows(event_log(spark, folder, "t.a.b"), SCHEMA)
    else:
        append_events(documents_to_events(df, "t.a.b", keys=["id"]), folder, first_offset=0)
        back = decode_documents(event_log(spark, folder, "t.a.b"), SCHEMA)
    key = lambda r: r[0]
    assert sorted(map(tuple, back.collect()), key=key) == sorted(map(tuple, df.collect()), key=key)


def test_snapshot_event_text(spark):
    df = spark.createDataFrame([(1, None)], "id int, s string")
    event = snapshot_to_events(df, ["id"], "t.a.b").first()
    assert (bytes(event.key), event.topic) == (b'{"id":1}', "t.a.b")
    assert json.loads(bytes(event.value)) == {"payload": {"after": {"id": 1, "s": None}}}


def test_document_event_holds_text(spark):
    df = spark.createDataFrame([(("65",), "X")], "_id struct<`$oid`:string>, nome string")
    event = documents_to_events(df, "t.a.b").first()
    after = json.loads(bytes(event.value))["payload"]["after"]
    assert json.loads(after) == {"_id": {"$oid": "65"}, "nome": "X"}


def _diff(spark, old, new, keys=("a", "b")):
    schema = "a int, b string, v double, w string"
    events = diff_to_events(
        spark.createDataFrame(old, schema), spark.createDataFrame(new, schema), list(keys), "t"
    ).collect()
    found = {}
    for e in events:
        key = tuple(json.loads(bytes(e.key)).values())
        assert key not in found and e.topic == "t"
        after = json.loads(bytes(e.value))["payload"]["after"]
        found[key] = None if after is None else tuple(after.values())
    return found


def test_diff_by_cases(spark):
    old = [(1, "x", 1.0, "a"), (1, "y", 2.0, None), (2, "x", None, "c"), (3, "x", 3.0, "d"), (4, "x", 4.0, None)]
    new = [(1, "x", 1.0, "a"), (1, "y", 2.0, "b"), (2, "x", None, None), (4, "x", 4.0, None), (5, "x", None, None)]
    assert _diff(spark, old, new) == {
        (1, "y"): (1, "y", 2.0, "b"),
        (2, "x"): (2, "x", None, None),
        (3, "x"): None,
        (5, "x"): (5, "x", None, None),
    }


def test_diff_against_brute_force(spark):
    import random

    rng = random.Random(7)
    for _ in range(3):
        old, new = (
            {
                (a, b): (a, b, rng.choice([None, 1.0, 2.0, float("nan")]), rng.choice([None, "p", "q"]))
                for a in range(12)
                for b in "xyz"
                if rng.random() < 0.7
            }
            for _ in range(2)
        )
        expected = {k: None for k in old.keys() - new.keys()}
        for key, row in new.items():
            if str(old.get(key)) != str(row):
                expected[key] = tuple("NaN" if v != v else v for v in row)
        assert _diff(spark, list(old.values()), list(new.values())) == expected


@pytest.mark.parametrize("side", ["old", "new"])
def test_diff_refuses_keys_that_are_not_unique(spark, side):
    once, twice = [(1, "x", 1.0, "a")], [(1, "x", 1.0, "a"), (1, "x", 2.0, "a")]
    with pytest.raises(Exception, match="more than one row for a key"):
        _diff(spark, twice if side == "old" else once, once if side == "old" else twice)


@pytest.mark.parametrize("side", ["old", "new"])
def test_diff_refuses_keys_that_are_null(spark, side):
    full, empty = [(1, "x", 1.0, "a")], [(None, "x", 1.0, "a")]
    with pytest.raises(Exception, match="NULL in a key"):
        _diff(spark, empty if side == "old" else full, full if side == "old" else empty)


def test_diff_refuses_other_columns(spark):
    with pytest.raises(ValueError, match="more"):
        diff_to_events(spark.range(1).withColumn("more", F.lit(1)), spark.range(1), ["id"], "t")
    with pytest.raises(ValueError, match="more"):
        diff_to_events(spark.range(1), spark.range(1).withColumn("more", F.lit(1)), ["id"], "t")


def test_diff_sees_microseconds(spark):
    old = spark.sql("SELECT id, TIMESTAMP_NTZ '2024-01-01 00:00:00.000001' AS at FROM range(3)")
    new = old.withColumn("at", F.when(F.col("id") == 1, F.col("at") + F.expr("INTERVAL '0.000007' SECOND")).otherwise(F.col("at")))
    events = diff_to_events(old, new, ["id"], "t").collect()
    assert [json.loads(bytes(e.value))["payload"]["after"] for e in events] == [{"id": 1, "at": "2024-01-01T00:00:00.000008"}]


TIMES = "SELECT id, TIMESTAMP_NTZ '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id / 1000000) AS local, TIMESTAMP '2024-07-01 00:00:00' + make_dt_interval(0, 0, 0, id / 1000000) AS instant FROM range(5)"


@pytest.mark.parametrize("shape", ["row", "document", "stored"])
def test_microseconds_survive(spark, folder, shape):
    df = spark.sql(TIMES)
    if shape == "stored":
        append_documents(df, folder)
        back = read_documents(spark, folder, df.schema)
    elif shape == "row":
        back = decode_rows(snapshot_to_events(df, ["id"], "t"), df.schema)
    else:
        back = decode_documents(documents_to_events(df, "t", keys=["id"]), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    keys = snapshot_to_events(df, ["local", "instant"], "t").select("key").distinct()
    assert keys.count() == 5


def test_diff_columns_match_by_name(spark):
    old = spark.createDataFrame([(1.0, 1)], "v double, id int")
    new = spark.createDataFrame([(1, 1.0)], "id int, v double")
    assert diff_to_events(old, new, ["id"], "t").count() == 0


def test_rows_of_nulls_are_not_empty(spark):
    live = json.dumps({"payload": {"after": dict.fromkeys(FULL)}})
    rows = decode_rows(_values(spark, live, '{"payload":{"after":null}}', None, "{"), EXPENSE_ROW, drop_empty=True)
    assert [tuple(r) for r in rows.collect()] == [NOTHING]


def test_a_row_without_a_table_has_no_topic(spark):
    tables = spark.createDataFrame([("a",), (None,)], "t string")
    with pytest.raises(Exception, match="names no table"):
        tables.select(topic_name("shop", "public", F.col("t"))).collect()


def test_captured_tables(spark):
    tables = {
        name: (spark.createDataFrame([(i,)], "id int"), ["id"]) for i, name in enumerate(["a", "b", "c"])
    }
    topics = lambda df: sorted(r.topic for r in df.select("topic").collect())
    assert topics(capture_tables(tables, "p", "n")) == ["p.n.a", "p.n.b", "p.n.c"]
    assert topics(capture_tables(tables, "p", "n", include=["c", "a"])) == ["p.n.a", "p.n.c"]
    with pytest.raises(ValueError):
        capture_tables(tables, "p", "n", include=["z"])


def test_log_has_the_columns_of_a_topic_source(spark, folder):
    rows = spark.range(0, 1000, numPartitions=5).toDF("id")
    events = snapshot_to_events(rows, ["id"], "t.a.b")
    append_events(events, folder, "t.a.b", first_offset=0)
    end = end_offset(spark, folder, "t.a.b")
    append_events(events, folder, "t.a.b", first_offset=end)
    append_events(snapshot_to_events(rows, ["id"], "t.a.c"), folder, first_offset=0)
    log = event_log(spark, folder, "t.a.b")
    assert log.dtypes == [
        ("key", "binary"),
        ("value", "binary"),
        ("topic", "string"),
        ("partition", "int"),
        ("offset", "bigint"),
        ("timestamp", "timestamp"),
        ("timestampType", "int"),
    ]
    assert log.count() == 2000
    assert log.select("partition", "offset").distinct().count() == 2000
    assert end == 200
    assert event_log(spark, folder, ["t.a.b", "t.a.c"]).count() == 3000
    assert event_log(spark, folder, "t.a.b, t.a.c").groupBy("topic").count().count() == 2
    assert event_log(spark, folder, "t.a.x").count() == 0
    assert event_log(spark, folder, "t.a.x, t.a.c,t.a.c").count() == 1000


def test_end_offset_of_an_absent_topic(spark, folder):
    append_events(snapshot_to_events(spark.range(1).toDF("id"), ["id"], "t.a.b"), folder, first_offset=0)
    assert end_offset(spark, folder, "t.a.z") == 0


def test_topic_of_each_row(spark):
    rows = spark.range(4).toDF("id")
    topic = F.when(F.col("id") % 2 == 0, "even").otherwise("odd")
    found = {(bytes(r.key), r.topic) for r in snapshot_to_events(rows, ["id"], topic).collect()}
    assert found == {(b'{"id":%d}' % i, "odd" if i % 2 else "even") for i in range(4)}
