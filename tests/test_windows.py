"""Event-time windows against plain counting, over several starts of one folder."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from millrace.streaming.sinks import finish
from millrace.streaming.windows import late_rows, start_windows, windows

START = datetime(2024, 1, 1)
SCHEMA = "k string, at timestamp_ntz, v long"
MEASURES = {"n": ("count", "*"), "known": ("count", "v"), "total": ("sum", "v"), "most": ("max", "v")}


def _measured(some):
    known = [v for *_, v in some if v is not None]
    return len(some), len(known), sum(known) if known else None, max(known, default=None)


def _brute(rounds, seconds, slide, sessions, delay):
    """Windows by key, and late rows, one row after the other."""
    taken, late, latest = [], [], None
    for rows in rounds:
        mark = None if latest is None else latest - delay
        for r in rows:
            t = None if r[1] is None else int((r[1] - START).total_seconds())
            starts = [] if t is None else [t] if sessions else [s for s in range(t - seconds + 1, t + 1) if s % slide == 0]
            starts = [s for s in starts if mark is None or s + seconds > mark]
            taken += [(r, t, s) for s in starts]
            if not starts:
                late.append(r)
        times = [int((r[1] - START).total_seconds()) for r in rows if r[1] is not None]
        latest = max(times if latest is None else [latest, *times])
    groups = {}
    if sessions:
        last = {}
        for r, t, _ in sorted(taken, key=lambda e: e[1]):
            if r[0] not in last or t - last[r[0]][1] >= seconds:
                last[r[0]] = [t, t]
            last[r[0]][1] = t
            groups.setdefault((r[0], last[r[0]][0]), []).append((r, t))
    else:
        for r, t, s in taken:
            groups.setdefault((r[0], s), []).append((r, t))
    out = []
    for (k, s), some in groups.items():
        end = max(t for _, t in some) + seconds if sessions else s + seconds
        closed = end + (seconds if sessions else 0) <= latest - delay
        out.append((k, START + timedelta(seconds=s), START + timedelta(seconds=end), *_measured([r for r, _ in some]), closed))
    return sorted(out, key=str), sorted(late, key=str)


@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
@pytest.mark.parametrize("seconds, slide, sessions", [(20, None, False), (20, 6, False), (5, None, True)])
def test_windows_over_starts(spark, tmp_path, seconds, slide, sessions, kind):
    """A hot key, nulls in every column, ties, repeated rows, late rows, a start without new rows."""
    rng, folder, rounds = random.Random(seconds), str(tmp_path), []
    schema = SCHEMA.replace("timestamp_ntz", kind)
    for n in range(3):
        times = [None, *(START + timedelta(seconds=80 * n + s) for s in range(-60, 100))]
        some = [(rng.choice(["hot", "hot", "hot", "a", "b", None]), rng.choice(times), rng.choice([None, *range(9)])) for _ in range(70)]
        rounds.append(some + some[:3])
        spark.createDataFrame(rounds[-1], schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
        for _ in range(2):
            stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
            finish(start_windows(stream, f"{folder}/out", ["k"], "at", MEASURES, seconds, slide, sessions, delay=15, bounded=True), 120)
    expected, late = _brute(rounds, seconds, slide or seconds, sessions, 15)
    names = ["k", "window_start", "window_end", *MEASURES, "closed"]
    assert late and {row[-1] for row in expected} == {True, False}
    found = windows(spark, f"{folder}/out")
    assert dict(found.dtypes)["window_end"] == kind
    assert sorted(map(tuple, found.select(*names).collect()), key=str) == expected
    assert sorted(map(tuple, late_rows(spark, f"{folder}/out").collect()), key=str) == late


def test_a_batch_that_is_repeated_changes_nothing(spark, tmp_path):
    """What a lost run leaves of its batch, without its watermark, is written again."""
    folder = str(tmp_path)
    rows = [("a", START + timedelta(seconds=s), s) for s in range(30)]
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{folder}/in")

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(f"{folder}/in")
        finish(start_windows(stream, f"{folder}/out", ["k"], "at", MEASURES, 10, bounded=True), 120)
        return sorted(map(tuple, windows(spark, f"{folder}/out").collect()))

    first = run()
    for part in ("commits/0", "commits/.0.crc"):
        (tmp_path / "out" / "checkpoint" / part).unlink()
    assert run() == first and len(first) == 3


def test_no_rows(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    finish(start_windows(stream, f"{tmp_path}/out", ["k"], "at", MEASURES, 10, bounded=True), 120)
    assert windows(spark, f"{tmp_path}/out").count() == late_rows(spark, f"{tmp_path}/out").count() == 0


def test_refused(spark, tmp_path):
    rows = spark.createDataFrame([], SCHEMA)
    for bad, message in (
        ({"seconds": 0}, "a second"),
        ({"seconds": 5, "slide": 6}, "a second"),
        ({"seconds": 5, "slide": 2, "sessions": True}, "do not slide"),
    ):
        with pytest.raises(ValueError, match=message):
            start_windows(rows, str(tmp_path), ["k"], "at", MEASURES, **bad)
    with pytest.raises(ValueError, match="measures are"):
        start_windows(rows, str(tmp_path), ["k"], "at", {"m": ("mean", "v")}, 5)
    with pytest.raises(ValueError, match="given by the windows"):
        start_windows(rows.withColumnRenamed("v", "closed"), str(tmp_path), ["k"], "at", {}, 5)


@pytest.mark.parametrize("seconds, slide", [(20, 5), (18, 6)])
def test_windows_of_whole_steps(spark, tmp_path, seconds, slide):
    """Rows of one step are counted together, and late for some of its windows."""
    test_windows_over_starts(spark, tmp_path, seconds, slide, False, "timestamp_ntz")
