"""Joins of two streams against all pairs, over several starts of one checkpoint."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming.joins import join_within
from millrace.streaming.sinks import finish, start_files

START = datetime(2024, 1, 1)
LEFT, RIGHT = "k string, at timestamp_ntz, name string", "k string, since timestamp_ntz, v int"


def _streams(spark, folder):
    return (spark.readStream.schema(schema).parquet(f"{folder}/{side}") for side, schema in (("left", LEFT), ("right", RIGHT)))


def _brute(left, right, seconds, how):
    out = []
    for k, at, name in left:
        if None in (k, at):
            continue
        fits = [r for r in right if None not in r[:2] and r[0] == k and at <= r[1] <= at + timedelta(seconds=seconds)]
        out += [(k, at, name, *r[1:]) for r in fits] or ([(k, at, name, None, None)] if how == "left" else [])
    return sorted(out, key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_pairs_over_three_starts(spark, tmp_path, how):
    """A hot key, nulls, repeated rows, both ends of the interval, pairs across starts and cells."""
    rng, folder, left, right = random.Random(how), str(tmp_path), [], []
    for start in range(3):
        def rows(n, value, start=start):
            keys = ["hot", "hot", "hot", "a", "b", None]
            some = [(rng.choice(keys), rng.choice([None] + [START + timedelta(seconds=100 * start + s) for s in range(0, 130)]), value(i)) for i in range(n)]
            return some + some[:3]

        new = rows(50, lambda i: f"n{i}"), rows(40, lambda i: i)
        if start == 2:
            # What comes last moves the watermark on, so that every other row is done with.
            end = START + timedelta(hours=9)
            new = new[0] + [("a", end, "end")], new[1] + [("a", end, -1)]
        for side, schema, all_rows, some in (("left", LEFT, left, new[0]), ("right", RIGHT, right, new[1])):
            spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{side}")
            all_rows += some
        joined = join_within(*_streams(spark, folder), ["k"], "at", "since", 10, "5 minutes", how)
        finish(start_files(joined, f"{folder}/rows", f"{folder}/checkpoint", bounded=True), 120)
    found = spark.read.schema(joined.schema).parquet(f"{folder}/rows")
    assert found.columns == ["k", "at", "name", "since", "v"]
    assert sorted(map(tuple, found.collect()), key=str) == _brute(left, right, 10, how)


def test_refused(spark):
    left, right = spark.createDataFrame([], LEFT), spark.createDataFrame([], RIGHT)
    with pytest.raises(ValueError, match="inner or left"):
        join_within(left, right, ["k"], "at", "since", 5, how="outer")
    with pytest.raises(ValueError, match="both streams"):
        join_within(left, right.withColumnRenamed("v", "name"), ["k"], "at", "since", 5)
    with pytest.raises(ValueError, match="a second"):
        join_within(left, right, ["k"], "at", "since", 0)
