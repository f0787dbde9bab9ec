"""Tables and document collections as change events.

Every function returns the columns ``key``, ``value`` (bytes) and ``topic``,
which is what a topic sink takes.
"""

from __future__ import annotations

from collections.abc import Collection, Mapping, Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.envelope import event_json, json_bytes, row_json


def topic_name(prefix: str, namespace: str, table: str | Column) -> str | Column:
    """Topic of one table: ``prefix.namespace.table``, of each row if ``table`` is a column.

    A row whose table is NULL fails: it belongs to no topic.
    """
    if isinstance(table, Column):
        unknown = F.raise_error(F.lit("a row names no table for its topic")).cast("string")
        return F.concat(F.lit(f"{prefix}.{namespace}."), F.coalesce(table, unknown))
    return ".".join((prefix, namespace, table))


def _struct(columns: Sequence[str]) -> Column:
    return F.struct(*[F.col(f"`{c}`") for c in columns])


def _events(
    df: DataFrame, keys: Sequence[str], after: Column, topic: str | Column
) -> DataFrame:
    topic = topic if isinstance(topic, Column) else F.lit(topic)
    return df.select(
        json_bytes(_struct(keys)).alias("key"), event_json(after).alias("value"), topic.alias("topic")
    )


def snapshot_to_events(
    rows: DataFrame, keys: Sequence[str], topic: str | Column
) -> DataFrame:
    """Every row of a table as an event with the row as object in ``after``.

    ``topic`` is a name, or a column that names the topic of each row.
    """
    return _events(rows, keys, _struct(rows.columns), topic)


def documents_to_events(documents: DataFrame, topic: str, keys: Sequence[str] = ("_id",)) -> DataFrame:
    """Every document of a collection as an event with its JSON text in ``after``."""
    return _events(documents, keys, row_json(documents.columns), topic)


def capture_tables(
    tables: Mapping[str, tuple[DataFrame, Sequence[str]]],
    prefix: str,
    namespace: str,
    include: Collection[str] | None = None,
) -> DataFrame:
    """Events of several tables, each on its own topic.

    ``tables`` maps a table name to its rows and keys; ``include`` is the list
    of tables to capture, all of them when it is not given.
    """
    wanted = [name for name in tables if include is None or name in include]
    if not wanted:
        raise ValueError("no table is left to capture")
    frames = [
        snapshot_to_events(rows, keys, topic_name(prefix, namespace, name))
        for name, (rows, keys) in ((name, tables[name]) for name in wanted)
    ]
    events = frames[0]
    for frame in frames[1:]:
        events = events.unionByName(frame)
    return events


def _once(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same rows, or a failure when two of them have one key or one has none.

    Counting by key needs the rows where and as a merge join on the key needs
    them, so it adds neither a shuffle nor a sort to one.
    """
    rows = F.count(F.lit(1)).over(Window.partitionBy(*[f"`{k}`" for k in keys]))
    several = F.raise_error(F.lit(f"more than one row for a key of {list(keys)}"))
    missing = F.raise_error(F.lit(f"NULL in a key of {list(keys)}"))
    empty = reduce(or_, [F.col(f"`{k}`").isNull() for k in keys])
    counted = df.withColumn("__rows", rows)
    return counted.where(
        F.when(empty, missing.cast("boolean")).when(F.col("__rows") > 1, several.cast("boolean")).otherwise(True)
    ).drop("__rows")


def diff_to_events(
    old: DataFrame,
    new: DataFrame,
    keys: Sequence[str],
    topic: str,
) -> DataFrame:
    """Two states of a table as events for inserted, updated and deleted rows.

    ``keys`` is the primary key: never NULL and at most once in each state, so
    the rows spread evenly over the shuffle on it. That shuffle, one a side, is
    the only one; rows that did not change are dropped as the sides are merged.
    The job fails on a key that is NULL or occurs twice. Both states have the
    same columns; a column that only one of them has is an error.
    """
    columns = new.columns
    if odd := sorted(set(old.columns) ^ set(columns)):
        raise ValueError(f"columns in one state only: {odd}")

    def was(name: str) -> Column:
        return F.col(f"`__old_{name}`")

    def now(name: str) -> Column:
        return F.col(f"`{name}`")

    before = old.select(
        *[now(c).alias(f"__old_{c}") for c in columns], F.lit(True).alias("__was")
    )
    after = new.select(*[now(c) for c in columns], F.lit(True).alias("__is"))
    before = _once(before, [f"__old_{k}" for k in keys])
    after = _once(after, keys)
    both = before.join(after, reduce(and_, [was(k) == now(k) for k in keys]), "full")
    unchanged = [was(c).eqNullSafe(now(c)) for c in columns if c not in keys]
    kept = reduce(and_, unchanged, F.col("__was").eqNullSafe(F.col("__is")))
    changed = both.where(~kept)
    key = F.struct(*[F.coalesce(now(k), was(k)).alias(k) for k in keys])
    return changed.select(
        json_bytes(key).alias("key"),
        event_json(F.when(F.col("__is"), _struct(columns))).alias("value"),
        F.lit(topic).alias("topic"),
    )
