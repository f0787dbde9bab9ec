"""Summaries against the rows: exact measures exactly, sketches of few values too."""

from __future__ import annotations

import statistics
from collections import defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from millrace.plans.summaries import rolled_up, shared_members, summarise

SCHEMA = "day string, kind string, place string, who string, v double"
MEASURES = {
    "n": ("count", "*"), "known": ("count", "v"), "most": ("max", "v"), "people": ("distinct", "who"),
    "middle": ("quantiles", "v"), "set": ("members", "who"),
}


def _rows(day, n):
    return [(day, ["x", "y", None][i % 3], ["p", "q"][i % 2], None if i % 7 == 0 else f"w{(i * i) % 23}", None if i % 5 == 0 or i % 3 == 2 else float(i)) for i in range(n)]


def _brute(rows):
    groups = defaultdict(list)
    for r in rows:
        for kind, place in product((0, 1), repeat=2):
            groups[None if kind else r[1], None if place else r[2], 2 * kind + place].append(r)
    out = []
    for key, some in groups.items():
        v, who = [r[4] for r in some if r[4] is not None], {r[3] for r in some} - {None}
        middle = statistics.median_low(v) if v else None
        out.append((*key, len(some), len(v), max(v, default=None), len(who), middle, len(who)))
    return sorted(out, key=str)


def _found(spark, folder, **more):
    found = rolled_up(spark, folder, ["kind", "place"], MEASURES, **more).withColumn("middle", F.col("middle")[0])
    return sorted(map(tuple, found.collect()), key=str)


def test_parts_are_replaced_and_rolled_up(spark, folder):
    path, days = f"{folder}/days", {"d1": 60, "d2": 45, "d3": 30}
    for day, n in [("d1", 10), ("d2", 45), ("d1", 60), ("d3", 30)]:
        rows = spark.createDataFrame(_rows(day, n), SCHEMA).repartition(3)
        summarise(rows, path, "day", ["kind", "place"], MEASURES)
    kept = [r for day, n in days.items() for r in _rows(day, n)]
    assert _found(spark, path) == _brute(kept)
    assert _found(spark, path, where=F.col("day") == "d2") == _brute(_rows("d2", 45))
    by_place = rolled_up(spark, path, ["day", "place"], {"n": MEASURES["n"]}, sets=[["day"], ["place"]])
    assert {(r["day"], r["place"], r["level"]): r["n"] for r in by_place.collect()} == {
        ("d1", None, 1): 60, ("d2", None, 1): 45, ("d3", None, 1): 30, (None, "p", 2): 68, (None, "q", 2): 67,
    }
    p, q = ({r[3] for r in kept if r[2] == place} - {None} for place in "pq")
    shared = shared_members(spark, path, "set", F.col("place") == "p", F.col("place") == "q")
    assert shared.first()["shared"] == len(p & q)


def test_a_new_part_leaves_others_alone(spark, tmp_path):
    path = str(tmp_path / "days")
    files = []
    for day in ("d1", "d2"):
        summarise(spark.createDataFrame(_rows(day, 9), SCHEMA), path, "day", ["kind", "place"], MEASURES)
        files.append({p.name for p in (tmp_path / "days" / "day=d1").glob("*.parquet")})
    assert files[0] == files[1]
    summarise(spark.createDataFrame([], SCHEMA), path, "day", ["kind", "place"], MEASURES)
    assert _found(spark, path) == _brute(_rows("d1", 9) + _rows("d2", 9))


def test_refused(spark, folder):
    rows = spark.createDataFrame([], SCHEMA)
    with pytest.raises(ValueError, match="measures are"):
        summarise(rows, folder, "day", ["kind"], {"m": ("mode", "v")})
    with pytest.raises(ValueError, match="given twice"):
        summarise(rows, folder, "day", ["kind"], {"kind": ("max", "v")})
