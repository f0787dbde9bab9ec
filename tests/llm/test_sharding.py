"""Shards by interleaving: equal counts, gapless slots and the mixture of the whole."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from llm.fixtures import none, odd
from pyspark.sql import functions as F

from millrace.llm.queries import op4_sharding
from millrace.llm.sharding import interleaved_shards


def _check(found: list, sources: dict, shards: int) -> None:
    slots, mix, totals = defaultdict(list), Counter(), Counter(sources.values())
    for r in found:
        slots[r.shard].append(r.slot)
        mix[(sources[r.doc_id], r.shard)] += 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(slots[i]) for i in range(shards)]
    assert sum(sizes) == len(sources) and max(sizes) - min(sizes) <= 1 and set(slots) <= set(range(shards))
    for source, n in totals.items():
        assert all(abs(mix[(source, i)] - n / shards) <= 3 for i in range(shards))


@pytest.mark.parametrize("n, buckets", [(3, 1024), (500, 1024), (2000, 8)])
def test_every_shard_has_the_mixture(spark, n, buckets):
    # A third of the rows in one source, and sources of a single row.
    sources = {i: "hot" if i % 3 == 0 else f"one{i}" if i % 11 == 0 else f"s{i % 5}" for i in range(n)}
    frame = spark.createDataFrame(list(sources.items()), "doc_id long, source string")
    first = interleaved_shards(frame, 16, seed=3, buckets=buckets).collect()
    _check(first, sources, 16)
    again = interleaved_shards(frame.repartition(5), 16, seed=3, buckets=buckets).collect()
    assert sorted(first) == sorted(again)
    if n > 3:
        assert sorted(first) != sorted(interleaved_shards(frame, 16, seed=4, buckets=buckets).collect())


def _seeded(seed, *parts) -> int:
    return int(hashlib.md5(":".join([str(seed), *map(str, parts)]).encode()).hexdigest()[:15], 16)


def _interleaved(sources: dict, shards: int, seed: int) -> dict:
    """Shard and slot of each row, by sorting: once each source, once all rows."""
    placed = []
    for source in set(sources.values()):
        ids = sorted((i for i, s in sources.items() if s == source), key=lambda i: (_seeded(seed, i), i))
        offset = (_seeded(seed, "offset", source) + 0.5) / (1 << 60)
        placed += [((rank + offset) / len(ids), source, i) for rank, i in enumerate(ids)]
    found, filled = {}, Counter()
    for row, (_, _, i) in enumerate(sorted(placed)):
        shard = row * shards // len(placed)
        found[i] = (shard, filled[shard])
        filled[shard] += 1
    return found


@pytest.mark.parametrize("n, buckets, shards", [(5, 1024, 16), (700, 4, 16), (700, 1024, 7)])
def test_against_sorting(spark, n, buckets, shards):
    """Every row where sorting puts it, a third of them of one source, and sources of a single row."""
    sources = {i: "hot" if i % 3 == 0 else f"one{i}" if i % 11 == 0 else f"s{i % 5}" for i in range(n)}
    frame = spark.createDataFrame(list(sources.items()), "doc_id long, source string").repartition(3)
    found = {r.doc_id: (r.shard, r.slot) for r in interleaved_shards(frame, shards, seed=5, buckets=buckets).collect()}
    assert found == _interleaved(sources, shards, 5)


def test_odd_rows(spark):
    docs = odd(spark)
    n = docs.count()
    found = interleaved_shards(docs, 4, keep={"_text": F.col("text")}).collect()
    assert sorted((r.shard, r.slot) for r in found) == sorted((i, s) for i in range(4) for s in range(len([r for r in found if r.shard == i])))
    assert Counter(str(r._text) for r in found) == Counter(str(r.text) for r in docs.collect())
    sizes = Counter(r.shard for r in found)
    assert len(found) == n and max(sizes.values()) - min(sizes.values()) <= 1
    assert interleaved_shards(none(spark), 4).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op4_sharding(spark, sf).collect()
    _check(found, {i: r.source for i, r in docs.items()}, 16)
    for r in found:
        raw = (docs[r.doc_id].text or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
