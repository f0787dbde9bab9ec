"""Similarity join of documents on word n-grams: a grouped prefix join.

1. *Sieve.* Partners share at least t of their n shingles, so the first n - t + k
   shingles of both, in the order of hashes, have k in common, where k is
   ``SIEVE`` percent of the smaller one. A set of which fewer are taken elsewhere
   too has no partner. Tasks combine what they have seen before they post it, so that a
   shingle of very many documents is posted once a chunk.
2. What is left is collapsed to one class for each set, and its shingles are
   ordered by the number of classes that hold them, rarest first. A prefix is the
   first n - t + 1 shingles; partners share one of them. Those that no other
   class has need no posting, and a class with only such ones has no partner.
3. *Groups.* Classes with identical prefixes and sizes are one group, which is
   posted once. A shingle's first group is the hub of the others.
4. Group pairs are filtered by size, then expanded: every member of a group is
   verified against the hub. Members that are in one component by then need no
   other pair of the two; those of different components meet in tiles, where
   sizes and bitmaps bound what they can have in common: two sets differ in at
   least as many shingles as the bitmaps of their parities differ in bits. The
   bound is exact, so that no link is lost.
5. What passes is verified on the full sets: first a forest, of which each tile
   gives fewer pairs than it has components, then all pairs that are left between
   the components that the forest has not joined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm.common import stored
from millrace.llm.near_dedup import _measured as measured
from millrace.llm.near_dedup import _set_hash as set_hash
from millrace.llm.near_dedup import components, shingle_hashes

# Shingles that the sieve takes beyond a prefix, in percent of a set; partners share as many.
SIEVE = 10
# Shingles that a task combines before it posts them.
CHUNK = 1 << 21
# Holders of a shingle that are told apart: a task keeps so many of its rows until their number is known.
MOST_HOLDERS = 1 << 17
BITMAP = 1024
# Members on either side of a tile, about.
TILE = 2048


def _least_common(n: int, percent: int) -> int:
    """Shingles that a set of ``n`` shares with any partner, at least."""
    return -(-percent * n // 100)


def _beyond(n: int, percent: int) -> int:
    """Shingles of a set of ``n`` that the sieve takes beyond those that partners may lack."""
    return min(_least_common(n, percent), -(-SIEVE * n // 100))


_DOCUMENT = pa.struct([(name, pa.int64()) for name in ("key", "n", "set_a", "set_b")])
_SIEVED = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("doc", _DOCUMENT)])
_SIEVED_TYPE = "kind int, a long, b long, doc struct<key: long, n: long, set_a: long, set_b: long>"
# Rows of the sieve: a document (row, id), shingles known as shared (row, how many), a posting (shingle, row or null).
DOCUMENT, CREDIT, POSTING = range(3)


def _rows(kind: int, a, b, doc: pa.Array | None = None) -> pa.RecordBatch:
    columns = [np.full(len(a), kind, np.int32), a, b, pa.nulls(len(a), _DOCUMENT) if doc is None else doc]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SIEVED.types, strict=True)], schema=_SIEVED)


def _sieve(size: int, percent: int):
    """Documents with their sets' hashes, and the shingles of the sieve combined by chunk."""

    def combined(rows: list[int], taken: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        hashes = np.concatenate(taken)
        owner = np.repeat(np.arange(len(rows)), [len(t) for t in taken])
        order = np.argsort(hashes, kind="stable")
        hashes, owner = hashes[order], owner[order]
        same = hashes[1:] == hashes[:-1]
        shared = np.zeros(len(hashes), bool)
        shared[1:] |= same
        shared[:-1] |= same
        credit = np.bincount(owner[shared], minlength=len(rows))
        some = np.flatnonzero(credit)
        ids = np.array(rows, np.int64)
        yield _rows(CREDIT, ids[some], credit[some])
        first = np.ones(len(hashes), bool)
        first[1:] = ~same
        known = shared[first]
        yield _rows(POSTING, hashes[first].view(np.int64), pa.array(ids[owner[first]], mask=known))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, taken, held = [], [], 0
        for batch in batches:
            found = []
            for doc, key, text, row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                own = shingle_hashes(text, size)
                n = len(own)
                found.append((row, doc, key, n, *(set_hash(own) if n else (None, None))))
                if n:
                    rows.append(row)
                    taken.append(own[: n - _least_common(n, percent) + _beyond(n, percent)])
                    held += len(taken[-1])
                if held >= CHUNK:
                    yield from combined(rows, taken)
                    rows, taken, held = [], [], 0
            if found:
                row, doc, *facts = zip(*found, strict=True)
                facts = [pa.array(fact, pa.int64()) for fact in facts]
                yield _rows(DOCUMENT, row, doc, pa.StructArray.from_arrays(facts, fields=list(_DOCUMENT)))
        if rows:
            yield from combined(rows, taken)

    return run


def _credited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted postings, the keys of shingles that are posted twice, and how often each."""
    carried: tuple[np.ndarray, np.ndarray, np.ndarray] = (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool))

    def found(hashes, keys, named, before) -> pa.RecordBatch:
        same = hashes[1:] == hashes[:-1]
        shared = np.zeros(len(hashes), bool)
        shared[1:] |= same
        shared[:-1] |= same
        if before is not None and len(hashes):
            shared[0] |= hashes[0] == before
        keys, counts = np.unique(keys[shared & named], return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], names=["key", "n"])

    before = None
    for batch in batches:
        column = batch.column(1)
        new = (batch.column(0).to_numpy(), column.fill_null(0).to_numpy(), column.is_valid().to_numpy(zero_copy_only=False))
        hashes, keys, named = (np.concatenate(pair) for pair in zip(carried, new, strict=True))
        # The last row waits for the next batch, where its shingle may go on.
        carried = hashes[-1:], keys[-1:], named[-1:]
        if len(hashes) > 1:
            # It has been seen by the row ahead of it.
            whole = found(hashes, np.append(keys[:-1], 0), np.append(named[:-1], False), before)
            before = hashes[-2]
            yield whole
    if len(carried[0]):
        yield found(*carried, before)


def _resolved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted rows of the sieve, credits in place of the postings; the others as they are."""
    others: list[pa.RecordBatch] = []

    def postings() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            posted = pc.equal(batch.column("kind"), POSTING)
            others.append(batch.filter(pc.invert(posted)))
            yield pa.RecordBatch.from_arrays(batch.columns[1:3], names=["shingle", "key"]).filter(posted)

    for credits in _credited(postings()):
        yield _rows(CREDIT, *credits.columns)
        yield from others
        others.clear()
    yield from others


def _survivors(docs: DataFrame, size: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """All documents (``doc_id``, ``key``, ``n``, ``set_a``, ``set_b``), and the classes that may have a partner.

    Postings are a third of the input, so they are dealt out once and not stored.
    """
    # Only within this job; the number of a row is shorter in a posting than its key.
    numbered = docs.withColumn("row", F.monotonically_increasing_id())
    dealt = numbered.mapInArrow(_sieve(size, percent), _SIEVED_TYPE).repartition("a").sortWithinPartitions("a")
    sieved = stored(dealt.mapInArrow(_resolved, _SIEVED_TYPE))
    signed = sieved.where(F.col("kind") == DOCUMENT).select(F.col("a").alias("row"), F.col("b").alias("doc_id"), "doc.*")
    credits = sieved.where(F.col("kind") == CREDIT).groupBy(F.col("a").alias("row")).agg(F.sum("b").alias("shared"))
    # What _beyond is for the smallest partner.
    smallest = -F.floor(-percent * F.col("n") / 100)
    least = F.least(-F.floor(-percent * smallest / 100), -F.floor(-SIEVE * smallest / 100))
    left = signed.join(credits, "row").where(F.col("shared") >= least)
    classes = left.groupBy("set_a", "set_b", "n").agg(F.min("doc_id").alias("doc_id"), F.min("key").alias("key"))
    return signed.drop("row"), stored(classes.withColumn("id", F.monotonically_increasing_id()))


def _class_texts(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``id``, ``text``, ``set_a`` and ``set_b`` of each class, once; repeated rows are dropped where the join by key has dealt them."""
    texts = docs.select("key", "text").join(classes.select("key", "id", "set_a", "set_b"), "key")
    return texts.dropDuplicates(["key", "id", "set_a", "set_b"]).select("id", "text", "set_a", "set_b")


def _shingles(size: int):
    """The full sets of the classes; rows of equal keys whose set is another one give none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sets, ends = [], [], []
            for i, text, *wanted in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                own = shingle_hashes(text, size)
                if len(own) and set_hash(own) == tuple(wanted):
                    ids.append(i)
                    sets.append(own.view(np.int64))
                    ends.append(len(own))
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            columns = [pa.array(np.repeat(np.array(ids, np.int64), ends)), pa.array(flat)]
            for at in range(0, max(len(flat), 1), 1 << 16):
                yield pa.RecordBatch.from_arrays([c.slice(at, 1 << 16) for c in columns], names=["id", "shingle"])

    return run


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by shingle, those whose shingle more than one class has, and how many do, up to ``MOST_HOLDERS``."""

    def found(ids: np.ndarray, shingles: np.ndarray, over: int | None) -> pa.RecordBatch:
        starts = np.flatnonzero(np.append(np.ones(min(len(shingles), 1), bool), shingles[1:] != shingles[:-1]))
        counts = np.diff(np.append(starts, len(shingles)))
        holders = np.repeat(np.minimum(counts, MOST_HOLDERS), counts)
        if over is not None:
            holders[shingles == over] = MOST_HOLDERS
        more = holders > 1
        return pa.RecordBatch.from_arrays([pa.array(c[more], pa.int64()) for c in (ids, shingles, holders)], names=["id", "shingle", "holders"])

    ids = shingles = np.empty(0, np.int64)
    over = None
    for batch in batches:
        ids, shingles = (np.concatenate([old, batch.column(i).to_numpy()]) for i, old in enumerate((ids, shingles)))
        if not len(ids):
            continue
        # The last shingle waits for the next batch, where it may go on.
        last = int(np.searchsorted(shingles, shingles[-1]))
        before = over
        if shingles[-1] == over or len(shingles) - last >= MOST_HOLDERS:
            last, over = len(shingles), int(shingles[-1])
        yield found(ids[:last], shingles[:last], before)
        ids, shingles = ids[last:], shingles[last:]
    if len(ids):
        yield found(ids, shingles, over)


def _bitmaps(size: int):
    """The parities of a set's shingles over ``BITMAP`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = []
            for text in batch.column(1).to_pylist():
                places = (shingle_hashes(text, size) >> np.uint64(20)) % np.uint64(BITMAP)
                odd = (np.bincount(places.astype(np.int64), minlength=BITMAP) & 1).astype(np.uint8)
                maps.append(np.packbits(odd, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(maps, pa.binary())], names=["id", "bitmap"])

    return run


def _prefixes(shingles: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``id``, ``n``, ``single`` (shingles that it alone has) and the shared ``prefix`` of each class with one.

    Equal numbers of holders are ordered by shingle, the same way everywhere.
    """
    held = shingles.repartition("shingle").sortWithinPartitions("shingle").mapInArrow(_held, "id long, shingle long, holders long")
    shared = held.join(classes.select("id", "n"), "id")
    own = Window.partitionBy("id")
    ranked = shared.withColumns({"place": F.row_number().over(own.orderBy("holders", "shingle")), "single": F.col("n") - F.count("*").over(own)})
    # The prefix has n - t + 1 shingles; the ones that no other class has are its first.
    longest = F.col("n") + F.floor(-percent * F.col("n") / 100) + 1
    prefix = ranked.where(F.col("place") + F.col("single") <= longest)
    return prefix.groupBy("id", "n", "single").agg(F.sort_array(F.collect_list("shingle")).alias("prefix"))


def _groups(prefixes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (``group``, ``k``, ``prefix``), each named by its smallest class, and their members (``group``, ``id``)."""
    # A shingle that no other class has makes a prefix its own.
    alone = F.when(F.col("single") > 0, F.col("id"))
    keyed = prefixes.withColumn("named", F.md5(F.concat_ws(",", F.concat_ws(":", "n", alone), F.col("prefix").cast("array<string>"))))
    groups = stored(keyed.groupBy("named").agg(F.min("id").alias("group"), F.count("*").alias("k"), F.first("prefix").alias("prefix")))
    members = keyed.select("id", "named").join(groups.select("named", "group"), "named").select("group", "id")
    return groups.drop("named"), members


def _expanded(groups: DataFrame, members: DataFrame) -> DataFrame:
    """Families (``hub``, ``id``): each group's members, with the first group of each of its shingles and its own."""
    postings = groups.select("group", F.explode("prefix").alias("shingle"))
    lists = postings.groupBy("shingle").agg(F.min("group").alias("hub"), F.max("group").alias("last")).where("hub < last")
    pairs = postings.join(lists.select("shingle", "hub"), "shingle").select("hub", "group")
    pairs = pairs.union(groups.where("k > 1").select(F.col("group").alias("hub"), "group")).distinct()
    return pairs.join(members, "group").select("hub", "id").distinct()


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _tile_pairs(percent: int, forest: bool):
    """Pairs of the two sides of each tile, first side first, that may be linked and are of different components.

    A ``forest`` has no pair that would join what those before it would have joined:
    fewer than there are components, nearest partners first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, ready, above = None, [], None, {}

        def top(component: int) -> int:
            while component in above:
                component = above[component]
            return component

        for batch in batches:
            a, b = [], []
            names = ("hub", "o", "m", "second", "id", "component", "outside", "n", "bitmap")
            for *key, second, own, component, outside, n, bitmap in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if key != tile:
                    tile, held, ready, above = key, [], None, {}
                bits = np.frombuffer(bitmap, np.uint64)
                if not second:
                    held.append((own, component, n, bits))
                    continue
                if not held:
                    continue
                if ready is None:
                    ids, parts, sizes, maps = zip(*held, strict=True)
                    ready = (*map(np.array, (ids, parts, sizes)), np.vstack(maps))
                ids, parts, sizes, maps = ready
                differ = np.bitwise_count(maps ^ bits).sum(axis=1, dtype=np.int64)
                # Twice the most that they have in common.
                common = sizes + n - differ
                mine = top(component)
                near = (parts != mine) & (100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
                near &= 100 * common >= percent * (2 * (sizes + n) - common)
                # A pair of two members outside is compared once.
                near &= (ids < own) | (not outside)
                found = np.flatnonzero(near)
                if forest and len(found):
                    found = found[np.argsort(differ[found], kind="stable")]
                    found = found[np.sort(np.unique(parts[found], return_index=True)[1])]
                    for other in parts[found].tolist():
                        above[other] = mine
                        parts[parts == other] = mine
                a += np.minimum(ids[found], own).tolist()
                b += np.maximum(ids[found], own).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return run


def _across(families: DataFrame, labels: DataFrame, facts: DataFrame, percent: int, forest: bool) -> DataFrame:
    """Pairs of members of a family that are in different components and may be linked.

    Each tile holds about ``TILE`` members outside the family's largest component and as many of
    all, by hash; it gets their bitmaps, and gives pairs only where the bound on what they have
    in common allows a link.
    """
    named = families.join(labels, "id")
    parts = named.groupBy("hub", "component").agg(F.count("*").alias("k"))
    parts = parts.groupBy("hub").agg(F.max_by("component", F.struct("k", "component")).alias("main"), F.max("k").alias("most"), F.sum("k").alias("all"))
    parts = parts.where("all > most")
    rows = named.join(parts, "hub").withColumns(
        {
            "outside": F.col("component") != F.col("main"),
            "o_tiles": F.ceil((F.col("all") - F.col("most")) / TILE).cast("long"),
            "m_tiles": F.ceil(F.col("all") / TILE).cast("long"),
        }
    )
    rows = stored(rows.join(facts, "id"))
    hashed = F.xxhash64("id", F.lit(2))

    def dealt(side: str, other: str, second: bool) -> DataFrame:
        own = rows.withColumn(side, F.pmod(hashed, F.col(f"{side}_tiles")))
        own = own.withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{other}_tiles") - 1)))
        return own.select("hub", "o", "m", F.lit(second).alias("second"), "id", "component", "outside", "n", "bitmap")

    both = dealt("o", "m", False).where("outside").unionByName(dealt("m", "o", True))
    tile = ["hub", "o", "m"]
    ordered = both.repartition(*tile).sortWithinPartitions(*tile, "second")
    return ordered.mapInArrow(_tile_pairs(percent, forest), "a long, b long").distinct()


def ngram_join(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of each row of ``docs``.

    Rows are linked where 100 times what their sets of ``size``-word shingles
    have in common is at least ``percent`` times their union; ``component_id`` is
    the smallest id that links reach. A text of fewer words is one shingle; a
    null or empty one has none and is linked with nothing. Rows that share an id
    are documents of their own, which may be in different components; a row
    without an id links others like any row, and is its own component's id only
    if no id is reached (null then). Repeated rows are one class. An empty table
    gives an empty result. Other columns are left out.
    """
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("key"), "text")
    signed, classes = _survivors(docs, size, percent)
    texts = stored(_class_texts(docs, classes))
    shingles = texts.mapInArrow(_shingles(size), "id long, shingle long")
    prefixes = stored(_prefixes(shingles, classes, percent))
    groups, members = _groups(prefixes)
    families = stored(_expanded(groups, members))
    nodes = stored(families.select("id").distinct())
    texts = stored(texts.join(nodes, "id", "left_semi").select("id", "text"))
    maps = texts.mapInArrow(_bitmaps(size), "id long, bitmap binary")
    facts = stored(maps.join(classes.select("id", "n"), "id"))
    sizes = classes.select("id", "n")
    hubs = families.where("id != hub").join(sizes, "id").join(sizes.toDF("hub", "hub_n"), "hub")
    pairs = hubs.where(_sizes_fit(F.col("n"), F.col("hub_n"), percent)).select(F.least("hub", "id").alias("a"), F.greatest("hub", "id").alias("b")).distinct()
    tested = measured(pairs, texts, size, percent)
    labels = components(nodes, tested.where("linked"))
    # A forest first, so that few components are left to be compared in all pairs.
    for forest in (True, False):
        pairs = _across(families, labels, facts, percent, forest).join(tested.select("a", "b"), ["a", "b"], "left_anti")
        tested = stored(tested.union(measured(stored(pairs), texts, size, percent)))
        labels = components(nodes, tested.where("linked"))
    least = labels.join(classes.select("id", "doc_id"), "id").groupBy("component").agg(F.min("doc_id").alias("low"))
    found = labels.join(least, "component").select("id", "low")
    named = classes.join(found, "id", "left").select("set_a", "set_b", F.coalesce("low", "doc_id").alias("low"))
    rows = signed.where("n > 0").join(stored(named), ["set_a", "set_b"], "left").unionByName(signed.where("n = 0"), allowMissingColumns=True)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))
