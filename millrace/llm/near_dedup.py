"""Near-duplicate documents by b-bit MinHash, and their components.

1. A text's word shingles are hashed, and their minima under ``PERMUTATIONS``
   permutations taken. Bands of minima give bucket keys; of each minimum the
   ``BITS`` bits of a hash of minimum and permutation are packed into the signature.
2. Documents with the same set are one class, whose smallest id stands for it.
3. Candidates come from buckets, without all pairs of one. First every member is
   compared with two hubs of its bucket. Buckets with the same first hub are a
   family. Only where a family then still holds several components are the
   members outside its largest one compared with the others, in tiles, so that no
   link between different texts is lost; a tile gives its links and no other
   pairs. Bits counted in signatures, corrected for chance agreement, drop what
   cannot be similar, except among sets of fewer than ``SHORT``, and so do exact distances to the hub that differ by more
   than the threshold allows: the distance of sets obeys the triangle inequality.
4. Links are confirmed on the full sets, read again for candidates only.
5. Components spread the smallest id along the links, in rounds, on Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import once_a_worker, stored

PERMUTATIONS = 256
# Buckets take the first minima, BANDS times _ROWS of them; estimates take all.
BANDS = 32
BITS = 2
# Standard deviations below the threshold at which an estimate is still confirmed.
MARGIN = 4.0
# Sets of fewer shingles are confirmed without an estimate.
SHORT = 64
# Members that are confirmed against one hub in one task.
BLOCK = 256
# Members on either side of a tile, about.
TILE = 256
_KNOWN_WORDS = 400_000

_ROWS = 4
_LONGS = PERMUTATIONS * BITS // 64
_random = np.random.default_rng(20)
_MULTIPLY = _random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_ADD = _random.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


class _Words(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; all words as one where they are fewer."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    known = once_a_worker("shingle words", _Words)
    if len(known) > _KNOWN_WORDS:
        known.clear()
    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(hashes))
    mixed = np.zeros(len(hashes) - n + 1, np.uint64)
    for i in range(n):
        mixed = _mixed(mixed + hashes[i : len(hashes) - n + 1 + i])
    # A short text as one shingle is unlike every full shingle.
    return np.unique(mixed if n == size else _mixed(mixed + np.uint64(n)))


def _signature(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys of the bands, and the packed low bits of all minima."""
    low = (shingles >> np.uint64(16)).astype(np.uint32)
    minima = np.full(PERMUTATIONS, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(minima, (low[None, at : at + 512] * _MULTIPLY[:, None] + _ADD[:, None]).min(axis=1), out=minima)
    rows = minima[: BANDS * _ROWS].reshape(BANDS, _ROWS).astype(np.uint64)
    keys = np.arange(BANDS, dtype=np.uint64)
    for i in range(_ROWS):
        keys = _mixed(keys + rows[:, i])
    # The low bits of a minimum itself depend on those of its shingle alone, the same way in all permutations.
    own = _mixed(minima.astype(np.uint64) + (np.arange(PERMUTATIONS, dtype=np.uint64) << np.uint64(32))).astype(np.uint32)
    bits = ((own[:, None] >> np.arange(BITS, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits.ravel(), bitorder="little").view(np.int64)


def _set_hash(shingles: np.ndarray) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(shingles.tobytes())
    return tuple(np.array([whole >> 64, whole & ((1 << 64) - 1)], np.uint64).view(np.int64).tolist())


_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bits array<long>, keys array<long>"
_SIGNED_TYPES = [pa.int64()] * 4 + [pa.list_(pa.int64())] * 2


def _sign(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                shingles = shingle_hashes(text, size)
                if len(shingles):
                    keys, bits = _signature(shingles)
                    rows.append((len(shingles), *_set_hash(shingles), bits, keys))
                else:
                    rows.append((0, None, None, None, None))
            if not rows:
                continue
            columns = [batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _SIGNED_TYPES[1:], strict=True))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_shingles", "set_a", "set_b", "bits", "keys"])

    return run


def _texts(size: int):
    """Texts whose set is the one that stands for their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [_set_hash(shingle_hashes(t, size)) for t in batch.column(1).to_pylist()]
            wanted = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            keep = pa.array([own == w for own, w in zip(sets, wanted, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(batch.columns[:2], names=["id", "text"]).filter(keep)

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_hashes(t, size).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["id", "shingles"])

    return run


def _similar(a: str, b: str, threshold: float) -> Column:
    """Whether sizes and signatures leave a similarity of ``threshold`` possible."""
    chance = 0.5**BITS
    n, m = F.col(f"{a}_n"), F.col(f"{b}_n")
    differ = F.lit(0)
    for i in range(_LONGS):
        x = F.get(f"{a}_bits", F.lit(i)).bitwiseXOR(F.get(f"{b}_bits", F.lit(i)))
        # Each pair of bits becomes one bit that is set where the minima's bits differ.
        either = x.bitwiseOR(F.shiftright(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        differ = differ + F.bit_count(either)
    estimate = ((1 - differ / PERMUTATIONS) - chance) / (1 - chance)
    likely = (F.least(n, m) < SHORT) | (estimate >= _least_estimate(threshold))
    return (F.least(n, m) >= threshold * F.greatest(n, m)) & likely


_MEASURED = "a long, b long, linked boolean, distance double"


def _measured(pairs: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs ``a``, ``b`` with the exact ``distance`` of their sets, and whether they are ``linked``.

    The pairs of one ``a`` are dealt out in blocks, each with a copy of its
    set; a set reaches a block once, and a task holds one block at a time.
    """
    place = Window.partitionBy("a", "_salt").orderBy("b")
    blocks = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(64)))
    blocks = stored(blocks.withColumn("_block", F.floor((F.row_number().over(place) - 1) / BLOCK)))
    hubs = blocks.select("a", "_salt", "_block").distinct()
    wanted = blocks.select(F.col("a").alias("id")).union(blocks.select(F.col("b").alias("id"))).distinct()
    sets = texts.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(_sets(size), "id long, shingles array<long>")
    mine = hubs.join(sets, hubs["a"] == sets["id"]).select("a", "_salt", "_block", F.lit(None).cast("long").alias("b"), "shingles")
    theirs = blocks.join(sets, blocks["b"] == sets["id"]).select("a", "_salt", "_block", "b", "shingles")
    block = ["a", "_salt", "_block"]
    dealt = mine.unionByName(theirs).repartition(*block).sortWithinPartitions(*block, F.col("b").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            shingles = batch.column("shingles")
            values, ends = shingles.values.to_numpy(), shingles.offsets.to_numpy()
            for i, (a, b) in enumerate(zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True)):
                other = values[ends[i] : ends[i + 1]].view(np.uint64)
                if b is None:
                    hub, own = a, other.copy()
                elif a == hub:
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    common = int((own[at] == other).sum())
                    union = len(own) + len(other) - common
                    found.append((a, b, 100 * common >= percent * union, 1 - common / union))
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.float64()]
            columns = zip(*found, strict=True) if found else [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["a", "b", "linked", "distance"]
            )

    return stored(dealt.mapInArrow(run, _MEASURED))


def _least_estimate(threshold: float) -> float:
    """The estimate below which a pair is not confirmed."""
    chance = 0.5**BITS
    expected = threshold + (1 - threshold) * chance
    deviation = (expected * (1 - expected) / PERMUTATIONS) ** 0.5 / (1 - chance)
    return threshold - MARGIN * deviation


def _tile_links(percent: int):
    """Links between the two sides of each tile, whose first side comes before the second."""
    threshold, chance = percent / 100, 0.5**BITS
    most_differ = PERMUTATIONS * (1 - chance) * (1 - _least_estimate(threshold))
    slack = 1 - threshold + 1e-9
    pairs_of_bits = np.uint64(0x5555555555555555)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, ready = None, [], None
        for batch in batches:
            found = ([], [])
            names = ("hub", "o", "m", "second", "id", "component", "outside", "distance", "bits")
            columns = zip(*(batch.column(n).to_pylist() for n in names), strict=True)
            sets = batch.column("shingles")
            values, ends = sets.values.to_numpy().view(np.uint64), sets.offsets.to_numpy()
            for i, (*key, second, b, component, outside, distance, bits) in enumerate(columns):
                own = values[ends[i] : ends[i + 1]]
                packed = np.array(bits, np.int64).view(np.uint64)
                if key != tile:
                    tile, held, ready = key, [], None
                if not second:
                    held.append((b, component, np.nan if distance is None else distance, len(own), packed, own.copy()))
                    continue
                if not held:
                    continue
                if ready is None:
                    ids, parts, far, sizes, signatures, _ = zip(*held, strict=True)
                    ready = (*map(np.array, (ids, parts, far, sizes)), np.vstack(signatures))
                ids, parts, far, sizes, signatures = ready
                differ = signatures ^ packed
                differ = np.bitwise_count((differ | (differ >> np.uint64(1))) & pairs_of_bits).sum(axis=1)
                near = (parts != component) & ((differ <= most_differ) | (np.minimum(sizes, len(own)) < SHORT))
                near &= np.minimum(sizes, len(own)) >= threshold * np.maximum(sizes, len(own))
                # A pair of two members outside is compared once.
                near &= (ids < b) | (not outside)
                if distance is not None:
                    near &= ~(np.abs(far - distance) > slack)
                for j in np.flatnonzero(near).tolist():
                    other = held[j][5]
                    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                    common = int((own[at] == other).sum())
                    if 100 * common >= percent * (len(own) + len(other) - common):
                        found[0].append(min(held[j][0], b))
                        found[1].append(max(held[j][0], b))
            yield pa.RecordBatch.from_arrays([pa.array(f, pa.int64()) for f in found], names=["a", "b"])

    return run


def _links_across(families: DataFrame, one: DataFrame, texts: DataFrame, size: int, percent: int) -> DataFrame:
    """Links between members of different components of a family.

    ``families`` has ``hub``, ``id``, ``component`` and ``distance`` to the hub,
    if that is known. Each tile holds about ``TILE`` members outside the largest
    component and as many of all, by hash, however large the family is.
    """
    parts = families.groupBy("hub", "component").agg(F.count("*").alias("n"))
    parts = parts.groupBy("hub").agg(
        F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("most"), F.sum("n").alias("all")
    )
    parts = stored(parts.where("all > most"))
    rows = families.join(parts, "hub").withColumn("outside", F.col("component") != F.col("main"))
    tiles = {"o": F.ceil((F.col("all") - F.col("most")) / TILE), "m": F.ceil(F.col("all") / TILE)}
    rows = stored(rows.withColumns({f"{name}_tiles": n.cast("long") for name, n in tiles.items()}))
    hashed = F.xxhash64("id", F.lit(1))

    def dealt(side: str, other: str, second: bool) -> DataFrame:
        """Rows with their own tile of one side, once for each tile of the other."""
        own = rows.withColumn(side, F.pmod(hashed, F.col(f"{side}_tiles")))
        own = own.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_tiles") - 1)))
        return own.select("hub", "o", "m", F.lit(second).alias("second"), "id", "component", "outside", "distance")

    both = dealt("o", "m", False).where("outside").unionByName(dealt("m", "o", True))
    wanted = rows.select("id").distinct()
    sets = texts.join(wanted, "id", "left_semi").select("id", "text").mapInArrow(_sets(size), "id long, shingles array<long>")
    both = both.join(sets.join(one.select("id", "bits"), "id"), "id")
    tile = ["hub", "o", "m"]
    ordered = both.repartition(*tile).sortWithinPartitions(*tile, "second")
    return stored(ordered.mapInArrow(_tile_links(percent), "a long, b long").distinct())


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """``id`` and ``component``, the smallest id that links reach, of each node.

    Each round every node takes the smallest label of its links' ends, and then
    the label of its label; the number of rounds grows with the logarithm of a
    chain. No node's links meet in one task: minima are combined before the shuffle.
    """
    both = stored(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = stored(nodes.select("id", F.col("id").alias("component")))
    if both.isEmpty():
        return labels
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("component").alias("near"))
        joined = labels.join(near, labels["id"] == near["a"], "left")
        lower = joined.select("id", F.col("component").alias("was"), F.least("component", F.coalesce("near", "component")).alias("low"))
        # The old label's node also takes what its members have found.
        told = lower.where("low < was").groupBy(F.col("was").alias("root")).agg(F.min("low").alias("told"))
        merged = lower.join(told, lower["id"] == told["root"], "left").select("id", "was", F.least("low", F.coalesce("told", "low")).alias("low"))
        merged = stored(merged)
        roots = merged.select(F.col("id").alias("root"), F.col("low").alias("above"))
        labels = stored(
            merged.join(roots, merged["low"] == roots["root"]).select("id", F.col("above").alias("component"), (F.col("above") < F.col("was")).alias("moved"))
        )
        if labels.where("moved").isEmpty():
            return labels.select("id", "component")
        labels = labels.select("id", "component")


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of each document.

    Documents are linked where 100 times what their sets of ``size``-word
    shingles have in common is at least ``percent`` times their union. The
    smallest id of a component is kept. A text of fewer words is one shingle;
    a null or empty one has none, is linked with nothing and kept. Rows of the
    same id count as one document, whose text is the largest; a null id is left
    out, as it names no document. An empty table gives an empty result.
    """
    threshold = percent / 100
    docs = docs.select(F.col("doc_id").cast("long"), "text").where("doc_id IS NOT NULL")
    signed = stored(docs.mapInArrow(_sign(size), _SIGNED))
    # Repeated ids: one row each.
    signed = signed.groupBy("doc_id").agg(
        F.max_by(F.struct("n_shingles", "set_a", "set_b", "bits", "keys"), F.struct("n_shingles", "set_a", "set_b")).alias("s")
    ).select("doc_id", "s.*")
    signed = stored(signed)
    classes = stored(signed.where("n_shingles > 0").groupBy("set_a", "set_b").agg(F.min("doc_id").alias("class")))
    members = signed.join(classes, ["set_a", "set_b"], "left").select("doc_id", "n_shingles", F.coalesce("class", "doc_id").alias("id"))
    one = signed.join(classes.select(F.col("class").alias("doc_id")), "doc_id", "left_semi").withColumnRenamed("doc_id", "id")
    one = one.withColumnRenamed("n_shingles", "n")
    buckets = one.select("id", F.explode("keys").alias("key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("low"), F.max("id").alias("high"))
    shared = stored(shared.where("size > 1").drop("size"))
    buckets = stored(buckets.join(shared.select("key"), "key", "left_semi"))
    nodes = stored(buckets.select("id").distinct())
    one = stored(one.join(nodes, "id", "left_semi").select("id", "n", "set_a", "set_b", "bits"))
    named = docs.withColumnRenamed("doc_id", "id").join(one.select("id", "set_a", "set_b"), "id")
    texts = named.select("id", "text", "set_a", "set_b").mapInArrow(_texts(size), "id long, text string")
    texts = stored(texts.dropDuplicates(["id"]))

    def measure(ends: DataFrame, before: DataFrame | None) -> DataFrame:
        """All pairs measured so far, with those of ``ends`` that are new and may be similar."""
        if before is not None:
            ends = ends.join(before, ["a", "b"], "left_anti")
        for end in ("a", "b"):
            ends = ends.join(one.select(F.col("id").alias(end), F.col("n").alias(f"{end}_n"), F.col("bits").alias(f"{end}_bits")), end)
        pairs = stored(ends.where(_similar("a", "b", threshold)).select("a", "b"))
        found = _measured(pairs, texts, size, percent)
        return found if before is None else stored(before.union(found))

    # The smallest id of each bucket is its first hub, the largest its second.
    tested = labels = None
    for hub in ("low", "high"):
        pairs = buckets.join(shared.select("key", F.col(hub).alias("hub")), "key").where("id != hub")
        if labels is not None:
            pairs = pairs.join(labels.withColumnRenamed("component", "own"), "id")
            pairs = pairs.join(labels.toDF("hub", "theirs"), "hub").where("own != theirs")
        ends = pairs.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
        tested = measure(ends, tested)
        labels = components(nodes, tested.where("linked"))
    # Every two members of a bucket are in the family of its first hub.
    families = buckets.join(shared.select("key", F.col("low").alias("hub")), "key").select("hub", "id").distinct()
    far = tested.select(F.col("a").alias("hub"), F.col("b").alias("id"), "distance")
    families = stored(families.join(labels, "id").join(far, ["hub", "id"], "left"))
    links = _links_across(families, one, texts, size, percent)
    labels = components(nodes, tested.where("linked").select("a", "b").union(links))
    found = members.join(labels, "id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "id").alias("component_id")
    )
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def without_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` with one row of each component, the one of the smallest id, and all its columns.

    Rows are compared by their texts alone: rows that share an id, or have none,
    are documents each, numbered for the purpose where there are such. A null
    id is the largest; of rows with equal ids one of a component stays. Texts
    without words stay, all of them. An empty table gives an empty result.
    """
    ids = docs.groupBy("doc_id").agg(F.count("*").alias("n"))
    if ids.where("n > 1 OR doc_id IS NULL").isEmpty():
        gone = near_duplicates(docs, size, percent).where("NOT kept").select("doc_id")
        return docs.join(stored(gone), "doc_id", "left_anti").select(*docs.columns)
    numbered = stored(docs.select(F.monotonically_increasing_id().alias("_row"), F.struct(*docs.columns).alias("_doc")))
    found = near_duplicates(numbered.select(F.col("_row").alias("doc_id"), F.col("_doc.text").alias("text")), size, percent)
    found = found.select(F.col("doc_id").alias("_row"), F.col("component_id").alias("_component"))
    order = F.struct(F.col("_doc.doc_id").isNull().alias("none"), F.col("_doc.doc_id").alias("id"), F.col("_row").alias("row"))
    named = numbered.select("_row", order.alias("order")).join(found, "_row")
    first = stored(named.groupBy("_component").agg(F.min("order").alias("first")).select(F.col("first.row").alias("_row")))
    return numbered.join(first, "_row", "left_semi").select("_doc.*")
