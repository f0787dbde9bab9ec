"""As-of joins against a scan of all rows."""

from __future__ import annotations

import random

import pytest

from millrace.operators.asof import asof_join


def _brute(left, right, how):
    out = []
    for k, t, name in left:
        fits = [r for r in right if None not in (k, t, r[0], r[1]) and r[0] == k and r[1] <= t]
        best = max(fits, key=lambda r: (r[1], r[2]), default=None)
        if best or how == "left":
            out.append((k, t, name, *(best[1:] if best else (None, None, None))))
    return sorted(out, key=str)


def _tables(spark, left, right):
    return (
        spark.createDataFrame(left, "k string, t int, name string").repartition(3),
        spark.createDataFrame(right, "k string, at int, rank int, v double").repartition(3),
    )


@pytest.mark.parametrize("rows_a_bucket", [7, 10**6])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_asof(spark, how, rows_a_bucket):
    """A hot key, ties, nulls, keys of one side alone, and a NULL among the values that are carried."""
    rng = random.Random(rows_a_bucket)
    keys = ["hot", "hot", "hot", "a", "b", "c", None]
    left = [(rng.choice([*keys, "left only"]), rng.choice([None, *range(-9, 60)]), f"n{i}") for i in range(150)]
    right = [(rng.choice([*keys, "right only"]), rng.choice([None, *range(-9, 60)]), i, rng.choice([None, 0.5, 1.5])) for i in range(90)]
    found = asof_join(*_tables(spark, left, right), ["k"], "t", "at", how, order=["rank"], rows_a_bucket=rows_a_bucket)
    assert found.columns == ["k", "t", "name", "at", "rank", "v"]
    assert sorted(map(tuple, found.collect()), key=str) == _brute(left, right, how)


@pytest.mark.parametrize("how", ["left", "inner"])
def test_empty_sides(spark, how):
    rows = [("a", 1, "n")], [("a", 0, 1, 2.0)]
    for left, right in ((rows[0], []), ([], rows[1]), ([], [])):
        found = asof_join(*_tables(spark, left, right), ["k"], "t", "at", how, rows_a_bucket=1)
        assert sorted(map(tuple, found.collect())) == _brute(left, right, how)


def test_the_plan_has_no_range_join(spark):
    left, right = _tables(spark, [("a", i, "n") for i in range(50)], [("a", i, 1, 2.0) for i in range(50)])
    plan = asof_join(left, right, ["k"], "t", "at", rows_a_bucket=5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_columns_of_both_tables(spark):
    left, right = _tables(spark, [], [])
    with pytest.raises(ValueError, match="both tables"):
        asof_join(left, right.withColumnRenamed("v", "name"), ["k"], "t", "at")
    with pytest.raises(ValueError, match="left or inner"):
        asof_join(left, right, ["k"], "t", "at", "outer")
