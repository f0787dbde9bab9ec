"""Events whose fields come, go and change their types."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DecimalType, DoubleType, LongType, StringType, StructField, StructType

REST = "rest"
# More fields than these are declared, not found.
FIELDS = 10_000
_TYPES = {
    "bigint": LongType(),
    "decimal(38,0)": DecimalType(38, 0),
    "double": DoubleType(),
    "boolean": BooleanType(),
    "string": StringType(),
}


def _opened(events: DataFrame) -> DataFrame:
    """The events with ``__after``, the row or document as a variant, and ``__reason`` where there is none to be read."""
    value = F.col("value").cast("string")
    # Made by explode: a filter on it is not moved below, where each of its mentions would parse again.
    whole = events.withColumn("__whole", F.explode(F.array(F.try_parse_json(value))))
    whole = whole.withColumn("__field", F.try_variant_get("__whole", "$.payload.after", "variant"))
    # Document events hold JSON in text.
    text = F.schema_of_variant("__field") == "STRING"
    parsed = whole.withColumn("__after", F.when(text, F.try_parse_json(F.try_variant_get("__field", "$", "string"))).otherwise(F.col("__field")))
    gone = F.col("value").isNull() | F.coalesce(F.is_variant_null("__field"), F.lit(False))
    reason = (
        F.when(gone, F.lit(None))
        .when(F.col("__whole").isNull(), "not JSON")
        .when(F.col("__field").isNull(), "no row")
        .when(~F.coalesce(F.schema_of_variant("__after").startswith("OBJECT<"), F.lit(False)), "not an object")
    )
    found = F.struct(F.when(~gone, F.col("__after")).alias("__after"), reason.alias("__reason"))
    parsed = parsed.withColumn("__found", F.explode(F.array(found)))
    return parsed.select(*(f"`{c}`" for c in events.columns), "__found.*")


def _merged(types: Sequence[str]) -> str:
    """The type that holds all values of a field, as Spark's variants name theirs."""
    kinds = {t for t in types if t != "VOID"}
    if len(kinds) == 1 and kinds <= {"BIGINT", "BOOLEAN", "STRING", "DOUBLE"}:
        return kinds.pop().lower()
    if kinds and all(t in ("BIGINT", "DOUBLE") or t.startswith("DECIMAL(") for t in kinds):
        whole = all(t == "BIGINT" or t.endswith(",0)") for t in kinds)
        wide = any(int(t[8:].split(",")[0]) > 18 for t in kinds if t.startswith("DECIMAL("))
        return "decimal(38,0)" if whole and wide else "double"
    return "string"


def field_types(events: DataFrame) -> DataFrame:
    """``field``, ``type`` and ``n`` events: every type that each field of the rows has, ``VOID`` for JSON's null.

    Counted in the tasks before one shuffle of a row a field, type and task.
    Nested values are an ``OBJECT`` or ``ARRAY`` whatever they hold.
    """
    after = _opened(events).where(F.col("__reason").isNull() & F.col("__after").isNotNull()).select("__after")
    fields = after.lateralJoin(after.sparkSession.tvf.variant_explode(F.col("__after").outer()))
    kind = F.schema_of_variant("value")
    kind = F.when(kind.startswith("OBJECT<"), "OBJECT").when(kind.startswith("ARRAY<"), "ARRAY").otherwise(kind)
    return fields.groupBy(F.col("key").alias("field"), kind.alias("type")).agg(F.count("*").alias("n"))


def merged_schema(events: DataFrame) -> StructType:
    """One schema for all events: each field that occurs, by name, with a type that holds all its values.

    Integers stay so, or become decimals beyond 64 bits; with fractions among them
    numbers are doubles. Values of several other types, and nested ones, are text, as is
    a field that is always null. More than ``FIELDS`` fields are an error.
    """
    found = field_types(events).groupBy("field").agg(F.collect_set("type").alias("types"))
    rows = found.limit(FIELDS + 1).collect()
    if len(rows) > FIELDS:
        raise ValueError(f"the events have more than {FIELDS} fields: declare those that are columns")
    fields = sorted((r["field"], _merged(r["types"])) for r in rows)
    return StructType([StructField(name, _TYPES[kind]) for name, kind in fields])


def _texts(after: str) -> Column:
    """The fields of an object as a map of texts, nested values as JSON."""
    return F.from_json(F.to_json(F.col(after)), "map<string,string>")


def drifting_rows(events: DataFrame, row: StructType, keep: Sequence[str] = ()) -> DataFrame:
    """Events as rows of the declared fields, with all else that an event holds in ``rest``.

    ``rest`` is a map from field to text: fields that ``row`` does not declare,
    and declared ones whose value is not of their type, which are NULL in their column. It is empty if there are none.
    Deletions and empty events are rows of NULLs, ``rest`` too. Events that ``rejected`` gives are left
    out, so that both together are all events. ``keep`` names columns of the
    events that the rows get as well. Per row, in batch and in streams.
    """
    if clash := sorted({*keep, REST} & set(row.names)) or [c for c in keep if c == REST]:
        raise ValueError(f"columns given twice: {clash}")
    opened = _opened(events).where(F.col("__reason").isNull())
    texts = opened.select(*(f"`{c}`" for c in keep), _texts("__after").alias("__texts"))
    cells = {f.name: F.col("__texts")[f.name].try_cast(f.dataType) for f in row}
    fits = {name: cell.isNotNull() | F.col("__texts")[name].isNull() for name, cell in cells.items()}
    taken = F.array_compact(F.array(*(F.when(fit, F.lit(name)) for name, fit in fits.items()), F.lit(None).cast("string")))
    rest = F.map_filter("__texts", lambda name, _: ~F.array_contains(taken, name))
    return texts.select(*(f"`{c}`" for c in keep), *(cell.alias(name) for name, cell in cells.items()), rest.alias(REST))


def rejected(events: DataFrame) -> DataFrame:
    """The events that hold no row, as they came, with the ``reason``: ``not JSON``, ``no row`` or ``not an object``."""
    opened = _opened(events)
    return opened.where(F.col("__reason").isNotNull()).drop("__after").withColumnRenamed("__reason", "reason")
