"""The change-event envelope ``{"payload": {"after": ...}}`` as column expressions.

Relational events hold the row as an object in ``after``; document events hold
it as JSON text. A deleted row or document has ``after`` null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

# The fields the expense events and the person documents declare.
EXPENSE_ROW = StructType(
    [
        StructField("id_unidade", IntegerType()),
        StructField("unidade", StringType()),
        StructField("natureza_despesa", StringType()),
        StructField("ano", IntegerType()),
        StructField("valor", DoubleType()),
    ]
)
# The same rows where the producer writes the third field as "natureza".
EXPENSE_ROW_SHORT = StructType(
    [StructField("natureza", f.dataType) if f.name == "natureza_despesa" else f for f in EXPENSE_ROW]
)
PERSON_DOCUMENT = StructType(
    [
        StructField("_id", StructType([StructField("$oid", StringType())])),
        StructField("nome", StringType()),
        StructField("idade", IntegerType()),
    ]
)

# Timestamps are written to the microsecond, which is all that they hold.
TIMESTAMPS = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
# NULL fields are written out, so that a deletion reads {"payload":{"after":null}}.
_WHOLE = {"ignoreNullFields": "false", **TIMESTAMPS}


def _envelope(after) -> StructType:
    return StructType([StructField("payload", StructType([StructField("after", after)]))])


def after_row(value: Column, row: StructType) -> Column:
    """The ``after`` object of a relational event, limited to the fields of ``row``.

    Damaged, empty or missing events and deletions give NULL; a field that is
    missing or of another type is NULL by itself. Nothing raises.
    """
    return F.from_json(value.cast("string"), _envelope(row))["payload"]["after"]


def after_text(value: Column) -> Column:
    """The ``after`` member as text: a string is unquoted, an object keeps its JSON."""
    return F.from_json(value.cast("string"), _envelope(StringType()))["payload"]["after"]


def after_document(value: Column, document: StructType) -> Column:
    """The document held as JSON text in ``after``, limited to declared fields."""
    return F.from_json(after_text(value), document)


def json_bytes(value: Column) -> Column:
    """A struct as a JSON object in bytes."""
    return F.to_json(value, _WHOLE).cast("binary")


def row_json(columns: Sequence[str]) -> Column:
    """All given columns as one JSON object in text."""
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in columns]), _WHOLE)


def event_json(after: Column) -> Column:
    """An event around ``after`` (struct, text or NULL) in bytes."""
    payload = F.struct(after.alias("after"))
    return json_bytes(F.struct(payload.alias("payload")))
