"""Events of drifting fields: every value and every event is found again."""

from __future__ import annotations

import json
from decimal import Decimal

import pytest
from pyspark.sql.types import StructType

from millrace.operators.drift import drifting_rows, field_types, merged_schema, rejected

ROWS = [
    {"a": 1, "b": "x", "c": None},
    {"a": 2.5, "b": True, "big": 2**70},
    {"a": 3, "b": {"deep": [1]}, "big": 4, "na me": "é", "it's": 7},
    {"a": None, "flag": False, "big": None, "d.e": 1},
    {},
]
BAD = [("{broken", "not JSON"), ("", "not JSON"), ('{"a":1,"a":2}', "not JSON"), ("{}", "no row"), ('{"payload":{}}', "no row"),
       ('{"payload":{"after":[1]}}', "not an object"), ('{"payload":{"after":"text"}}', "not an object")]
GONE = [None, '{"payload":{"after":null}}']


@pytest.fixture(scope="module")
def events(spark):
    values = [json.dumps({"payload": {"after": r}}) for r in ROWS[:3]]
    # Documents are JSON in text.
    values += [json.dumps({"payload": {"after": json.dumps(r)}}) for r in ROWS[3:]]
    values += GONE + [text for text, _ in BAD]
    rows = [(n, None if v is None else bytearray(v.encode())) for n, v in enumerate(values)]
    return spark.createDataFrame(rows, "offset long, value binary").repartition(3)


def test_merged_schema(events):
    assert {f.name: f.dataType.simpleString() for f in merged_schema(events)} == {
        "a": "double", "b": "string", "big": "decimal(38,0)", "c": "string", "d.e": "bigint", "flag": "boolean", "it's": "bigint", "na me": "string",
    }
    counts = {(r["field"], r["type"]): r["n"] for r in field_types(events).collect()}
    assert counts["a", "BIGINT"] == 2 and counts["a", "VOID"] == 1 and counts["b", "OBJECT"] == 1


def test_all_is_recovered(events):
    found = {r["offset"]: r.asDict() for r in drifting_rows(events, merged_schema(events), keep=["offset"]).collect()}
    bad = {r["offset"]: r["reason"] for r in rejected(events).collect()}
    assert found.keys() | bad.keys() == set(range(len(ROWS) + len(GONE) + len(BAD))) and not found.keys() & bad.keys()
    assert [bad[n] for n in sorted(bad)] == [reason for _, reason in BAD]
    assert [found[n]["a"] for n in range(4)] == [1.0, 2.5, 3.0, None]
    assert [found[n]["b"] for n in range(4)] == ["x", "true", '{"deep":[1]}', None]
    assert found[1]["big"] == Decimal(2**70) and found[2]["na me"] == "é" and found[2]["it's"] == 7 and found[3]["d.e"] == 1
    assert all(found[n]["rest"] == {} for n in range(5)) and found[3]["flag"] is False
    assert all(v is None for n in (5, 6) for k, v in found[n].items() if k != "offset")


def test_rest(events):
    """Undeclared fields, and values of another type than the declared one."""
    rows = drifting_rows(events, StructType.fromDDL("a BIGINT, b BOOLEAN"), keep=["offset"])
    found = {r["offset"]: r for r in rows.collect()}
    assert found[0]["a"] == 1 and found[0]["b"] is None and found[0]["rest"] == {"b": "x", "c": None}
    assert found[1]["b"] is True and found[1]["rest"]["big"] == str(2**70)
    assert found[2]["rest"] == {"b": '{"deep":[1]}', "big": "4", "na me": "é", "it's": "7"}
    assert found[1]["a"] is None and found[1]["rest"]["a"] == "2.5"


def test_empty_and_refused(spark, events):
    none = events.where("false")
    assert merged_schema(none).names == [] and rejected(none).count() == 0
    assert drifting_rows(none, merged_schema(none)).columns == ["rest"]
    with pytest.raises(ValueError, match="given twice"):
        drifting_rows(events, merged_schema(events), keep=["a"])


def test_each_value_is_parsed_once(events):
    for frame in (field_types(events), drifting_rows(events, StructType([])), rejected(events)):
        plan = frame._jdf.queryExecution().optimizedPlan().toString()
        # The value, and the text that documents are in.
        assert plan.count("parseJson") == 2
