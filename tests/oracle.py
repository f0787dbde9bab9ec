"""Spark and DuckDB results side by side, whatever the order of their rows."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, float) and math.isnan(value):
        return "NaN"
    return value


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def spark_rows(df: DataFrame) -> tuple[list[str], Counter]:
    return sorted(df.columns), rows_of(df.columns, df.collect())


def duck_rows(sf_dir: Path, sql: str) -> tuple[list[str], Counter]:
    with duckdb.connect() as db:
        for path in sf_dir.glob("*.parquet"):
            db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
        result = db.execute(sql)
        columns = [d[0] for d in result.description]
        return sorted(columns), rows_of(columns, result.fetchall())
