"""Events back to typed rows; the same calls serve batch and streaming frames."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.functions.envelope import after_document, after_row


def decode_rows(events: DataFrame, row: StructType, drop_empty: bool = False) -> DataFrame:
    """Relational events as one row each, with the columns of ``row``.

    Deletions and unreadable events stay in the result as rows of NULLs unless
    ``drop_empty`` is set; a live row stays even if all its declared fields are
    NULL. Dropping goes through a generator, because a filter on the decoded row
    would make Spark parse every event twice.
    """
    after = after_row(F.col("value"), row)
    if not drop_empty:
        return events.select(after.alias("after")).select("after.*")
    return events.select(F.inline(F.filter(F.array(after), lambda item: item.isNotNull())))


def decode_documents(
    events: DataFrame, document: StructType, columns: Mapping[str, str] | None = None
) -> DataFrame:
    """Document events as one row each.

    ``columns`` maps result names to paths in the document, such as
    ``{"id": "_id.`$oid`"}``; without it every declared top-level field is taken.
    """
    paths = columns or {f.name: f"`{f.name}`" for f in document}
    return events.select(after_document(F.col("value"), document).alias("document")).select(
        *[F.col(f"document.{path}").alias(name) for name, path in paths.items()]
    )
