"""Shards that all hold the mixture of the whole: proportional stratified interleaving.

Within each source the rows are shuffled by a seeded hash and ranked; a row's
fractional rank is its rank less an offset of the source, over the size of the
source. The offset is a hash of the source, so that sources of few rows lie
anywhere and not all in the middle. All rows sorted by it have each source
evenly spread, and equal cuts of that order are the shards: row counts at most
one apart, and of each source about its share of rows in each.

Both orders are global. No source and no shard is ever one task: a rank is the
count in the buckets of the order before it, which a small table holds, plus
the place within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import seeded, stored

# Buckets a source is ranked in, and buckets the interleaved order is cut in. More
# buckets mean smaller groups and a longer table of counts.
BUCKETS = 1 << 10
_HASHES = 1 << 60


def _ranked(rows: DataFrame, group: list[str], bucket: str, order: list[Column], rank: str) -> DataFrame:
    """The place from 0 of each row in its group, which is ordered by ``bucket`` and then ``order``."""
    counts = rows.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    within = Window.partitionBy(*group, bucket).orderBy(*order)
    placed = rows.withColumn("_place", F.row_number().over(within) - 1)
    return placed.join(counts, [*group, bucket]).withColumn(rank, F.col("_before") + F.col("_place")).drop("_before", "_place")


def interleaved_shards(
    docs: DataFrame,
    shards: int,
    seed: int = 0,
    source: str = "source",
    keep: dict[str, Column] | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``doc_id``, the columns of ``keep``, ``shard`` and ``slot`` (gapless from 0 in a shard).

    A null source is a source of its own, the one of the empty name. A null id
    is shuffled as an empty one. Repeated rows are rows each; rows that are
    equal in id, source and what is kept are interchangeable. With fewer rows
    than shards some shards are empty; an empty table gives an empty result.
    Other columns of ``docs`` are left out, so their names cannot clash.
    """
    keep = keep or {}
    names = list(keep)
    # Equal ids, which may be many, are dealt apart by what else the row holds.
    shuffled = seeded(seed, F.col("doc_id"), *keep.values())
    rows = stored(
        docs.select(
            "doc_id",
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
            shuffled.alias("_hash"),
            *(c.alias(name) for name, c in keep.items()),
        ).withColumn("_bucket", F.floor(F.col("_hash") / (_HASHES // buckets)))
    )
    ranked = _ranked(rows, ["_source"], "_bucket", [F.col("_hash"), F.col("doc_id")], "_rank")
    sizes = rows.groupBy("_source").agg(F.count("*").alias("_size"))
    offset = (seeded(seed, F.lit("offset"), F.col("_source")) + 0.5) / _HASHES
    ranked = stored(
        ranked.join(sizes, "_source")
        .withColumn("_at", (F.col("_rank") + offset) / F.col("_size"))
        .withColumn("_all", F.lit(0))
        .withColumn("_cut", F.floor(F.col("_at") * buckets))
        .select("doc_id", *names, "_source", "_all", "_cut", "_at")
    )
    ordered = _ranked(ranked, ["_all"], "_cut", [F.col("_at"), F.col("_source")], "_row")
    total = ranked.groupBy("_all").agg(F.count("*").alias("_total"))
    row, n = F.col("_row"), F.col("_total")
    # Row r of n lies in shard floor(r * shards / n); that shard begins at row ceil(shard * n / shards).
    ordered = ordered.join(F.broadcast(total), "_all").withColumn("shard", F.expr(f"_row * {shards} div _total").cast("int"))
    first = F.expr(f"(shard * _total + {shards - 1}) div {shards}")
    return ordered.select("doc_id", *names, "shard", (row - first).alias("slot"))
