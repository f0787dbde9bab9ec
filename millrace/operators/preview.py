"""First rows of a frame."""

from __future__ import annotations

from pyspark.sql import DataFrame

PREVIEW_ROWS = 20


def preview(df: DataFrame, order_by: str | list[str] | None = None, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The first rows, in no given order unless ``order_by`` is set.

    An ordered preview is a top-k: each task keeps its own first rows, nothing
    is sorted as a whole.
    """
    return (df if order_by is None else df.orderBy(order_by)).limit(rows)
