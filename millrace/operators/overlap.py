"""Overlap join: pairs of rows whose spans of time or numbers have a point in common."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ByteType, DataType, DateType, IntegerType, LongType, ShortType, TimestampNTZType, TimestampType

# Each level's cells are as wide as this many of the level below.
FACTOR = 8
ROWS_A_CELL = 20_000


def _name(c: str) -> Column:
    return F.col(f"`{c}`")


def _position(c: str, kind: DataType) -> Column:
    """A bound as a long that ascends with it, whatever the session's time zone."""
    if isinstance(kind, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', `{c}`)")
    if isinstance(kind, TimestampType):
        return F.unix_micros(_name(c))
    if isinstance(kind, DateType):
        return F.unix_date(_name(c)).cast("long")
    if isinstance(kind, (ByteType, ShortType, IntegerType, LongType)):
        return _name(c).cast("long")
    raise ValueError(f"{c} is {kind.simpleString()}: a bound is a timestamp, a date or an integer")


def _spans(rows: DataFrame, keys: Sequence[str], span: tuple[str, str], side: str) -> DataFrame:
    """The rows that can match, as keys, first and last point, and the row itself."""
    start, end = (_position(c, rows.schema[c].dataType) for c in span)
    row = F.struct(*map(_name, rows.columns)).alias(f"__{side}")
    found = rows.select(*(_name(c).alias(f"__k{i}") for i, c in enumerate(keys)), start.alias("__from"), (end - 1).alias("__to"), row)
    return found.where(" AND ".join(["__from <= __to", *(f"__k{i} IS NOT NULL" for i in range(len(keys)))]))


def _size(spans: DataFrame) -> tuple[int, int]:
    """Mean and greatest length of the spans, from one aggregation."""
    length = F.col("__to") - F.col("__from") + 1
    mean, longest = spans.agg(F.avg(length), F.max(length)).first()
    return int(mean or 1), longest or 1


def _cells(spans: DataFrame, widths: list[int], side: str) -> DataFrame:
    """Each row once or twice at each level from its own on, its own being the first whose cells are as wide as its span."""
    own = F.lit(len(widths) - 1)
    for level in reversed(range(len(widths) - 1)):
        own = F.when(F.col("__to") - F.col("__from") < widths[level], F.lit(level)).otherwise(own)

    def reach(level: int) -> Column:
        first, last = (F.shiftright(c, widths[level].bit_length() - 1) for c in ("__from", "__to"))
        cells = F.transform(F.sequence(first, last), lambda cell: F.struct(F.lit(level).alias("level"), cell.alias("cell"), first.alias("first")))
        return F.when(F.col("__own") <= level, cells).otherwise(F.array().cast("array<struct<level:int,cell:bigint,first:bigint>>"))

    places = [reach(level) for level in range(len(widths))]
    rows = spans.withColumn("__own", own).withColumn("__at", F.explode(F.concat(*places)))
    # Of a pair at least one row is at its own level: meeting 0 takes the left row there, meeting 1 the right row alone.
    at_own = F.col("__own") == F.col("__at.level")
    at, beyond = ([0], [1]) if side == "left" else ([0, 1], [0])
    meetings = F.when(at_own, F.array(*map(F.lit, at))).otherwise(F.array(*map(F.lit, beyond)))
    rows = rows.withColumn("__meeting", F.explode(meetings))
    return rows.select(*spans.columns, "__meeting", F.col("__at.level").alias("__level"), F.col("__at.cell").alias("__cell"), F.col("__at.first").alias(f"__first_{side}"))


def _dealt(cells: DataFrame, crowded: DataFrame, place: list[str], side: str) -> DataFrame:
    """Rows of crowded cells dealt to one part of their own side, and copied to all parts of the other."""
    other = "right" if side == "left" else "left"
    rows = cells.join(crowded, place, "left").fillna(1, ["__n_left", "__n_right"])
    part = F.pmod(F.xxhash64(f"__{side}"), F.col(f"__n_{side}")).cast("int").alias(f"__p_{side}")
    copies = F.explode(F.sequence(F.lit(0), F.col(f"__n_{other}") - 1)).alias(f"__p_{other}")
    return rows.select(*cells.columns, part, copies)


def overlap_join(
    left: DataFrame,
    right: DataFrame,
    span: tuple[str, str],
    right_span: tuple[str, str],
    keys: Sequence[str] = (),
    rows_a_cell: int = ROWS_A_CELL,
) -> DataFrame:
    """All pairs of rows with equal ``keys`` whose spans overlap: each pair once, repeated rows as often as they occur.

    A span holds its start and not its end. One whose start or end is NULL, or
    whose end is not after its start, overlaps nothing, and a NULL key equals
    none. Bounds are timestamps, dates or integers, of one kind in both tables. The
    result has the columns of ``left`` and those of ``right`` but the keys; no
    other column may be in both.

    No range condition is joined alone. Points are cut into cells, on levels whose
    cells grow by ``FACTOR``. A row lies at its own level, whose cells are as wide
    as its span, in at most two cells, and is repeated at coarser levels, so a long
    span costs no more copies than a short one. Rows meet where one of them is at
    its own level, by an equality of keys, level and cell, and the first cell that
    both have is the one that gives the pair. A cell with more than ``rows_a_cell`` rows
    of a side, as a hot key makes, is cut into as many parts by a hash, each
    joined with each part of the other side, in tasks of their own.
    """
    clash = sorted((set(left.columns) & set(right.columns)) - set(keys))
    if clash:
        raise ValueError(f"columns in both tables: {clash}")
    kinds = [[type(t.schema[c].dataType) for c in s] for t, s in ((left, span), (right, right_span))]
    if any(k in (DateType, TimestampType, TimestampNTZType) for k in sum(kinds, [])) and len(set(sum(kinds, []))) > 1:
        raise ValueError("bounds of different kinds")
    lefts, rights = _spans(left, keys, span, "left"), _spans(right, keys, right_span, "right")
    sizes = [_size(lefts), _size(rights)]
    # Powers of two, from the lesser mean length to the greatest length.
    widths = [1 << min((min(mean for mean, _ in sizes) - 1).bit_length(), 62)]
    while widths[-1] < min(max(longest for _, longest in sizes), 1 << 62):
        widths.append(min(widths[-1] * FACTOR, 1 << 62))
    place = [*(f"__k{i}" for i in range(len(keys))), "__meeting", "__level", "__cell"]
    cells = {"left": _cells(lefts, widths, "left"), "right": _cells(rights, widths, "right")}
    # One row a cell that is crowded, which are at most the copies of rows by rows_a_cell.
    counts = [c.groupBy(*place).agg(F.count("*").alias(f"__rows_{side}")) for side, c in cells.items()]
    crowded = counts[0].join(counts[1], place).where((F.col("__rows_left") > rows_a_cell) | (F.col("__rows_right") > rows_a_cell))
    crowded = crowded.select(*place, *(F.ceil(F.col(f"__rows_{s}") / rows_a_cell).cast("int").alias(f"__n_{s}") for s in cells))
    a, b = (_dealt(c, crowded, place, side) for side, c in cells.items())
    b = b.withColumnsRenamed({"__from": "__right_from", "__to": "__right_to"})
    pairs = a.join(b, [*place, "__p_left", "__p_right"]).where(
        (F.col("__from") <= F.col("__right_to"))
        & (F.col("__right_from") <= F.col("__to"))
        & (F.col("__cell") == F.greatest("__first_left", "__first_right"))
    )
    return pairs.select("__left.*", *(F.col(f"__right.`{c}`") for c in right.columns if c not in keys))
