"""What the operators of this subpackage share."""

from __future__ import annotations

import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.workspace import new_folder

# White space between words, as a Java and RE2 character class.
SPACES = r"\x20\x09-\x0D"
WORD = rf"[^{SPACES}]+"


# Drops a query's shuffle files when it has ended; Spark keeps them until the driver happens to collect garbage.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Queries within it drop their shuffle files when they have ended."""
    before = spark.conf.get(_DROP_SHUFFLES, "false")
    spark.conf.set(_DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_DROP_SHUFFLES, before)


def stored(df: DataFrame) -> DataFrame:
    """The rows written to shared storage and read back.

    Cuts the lineage: a lost executor repeats at most the tasks after it, and
    nothing reads the shuffles before it again, whose files are dropped.
    """
    spark = df.sparkSession
    path = f"{new_folder(spark)}/rows"
    with shuffles_dropped(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def seeded(seed: int, *parts: Column) -> Column:
    """A uniform long from 0 to 2^60, fixed by the seed and the parts, the same on any engine with md5."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


# Seconds after which what a worker holds is dropped: idle workers live on beside other jobs.
IDLE_SECONDS = 10
_held: dict = {}
_used = [0.0]


def _drop_when_idle() -> None:
    while time.monotonic() - _used[0] < IDLE_SECONDS:
        time.sleep(1)
    _held.clear()


def once_a_worker(key, make):
    """What ``make`` builds, kept in this Python worker for its next tasks; only the last key's is kept, while it is used."""
    _used[0] = time.monotonic()
    found = _held.get(key)
    if found is None:
        if not _held:
            threading.Thread(target=_drop_when_idle, daemon=True).start()
        _held.clear()
        _held[key] = found = make()
    return found
