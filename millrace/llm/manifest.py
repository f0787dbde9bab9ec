"""Merkle manifest of a dataset: digests of all rows, a root, and a proof for each row.

Time-forward processing. Nodes are labelled by tree, level and place. A node's
digest is a message to its parent, and messages lie in an external priority
queue ordered by label: Spark's shuffle and sort hold it, and deal it out in
bundles of 8 to the power of ``LEVELS`` neighbours, so that a task holds one bundle. Within a
bundle a heap delivers the messages of ``LEVELS`` levels in the order of their
labels; the digest of the bundle's last node is a message of the next round.
Then a sweep in the reverse order delivers to each node the suffix of its proof,
which its parent knows: the siblings of all nodes above. A bundle gets the
suffix of its top from the round above as one more message, ahead of its nodes.

A round reduces the rows 4,096 times; two rounds hold 16 million rows a tree.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

# Fixed values of the contract: nodes that have one parent, and the fields of a leaf.
FAN = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")

# Levels that a round processes.
LEVELS = 4

_STEP = pa.struct([("left", pa.string()), ("right", pa.string())])
_STEPS = "array<struct<left: string, right: string>>"


def _digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_digest(fields: list[Column]) -> Column:
    """The digest of a row: each field as ``-`` if null, else its UTF-8 byte count, ``:`` and its value."""
    texts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*texts).cast("binary"), 256)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their partition, with the partition and the place in the run of their tree."""
    part, tree, at = TaskContext.get().partitionId(), (), 0
    for batch in batches:
        places = []
        for own in batch.column("tree").to_pylist():
            if own != tree:
                tree, at = own, 0
            places.append(at)
            at += 1
        names = [*batch.schema.names, "part", "place"]
        columns = [*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=names)


def _placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows``, stored, with the ``place`` of each in its ``tree`` by ``order`` and the size ``n`` of the tree.

    One shuffle, by ranges of tree and order, so that a tree of any share of the rows is dealt
    to as many tasks; the rows of a tree before a range are summed over one row a range and tree.
    """
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order)]
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    numbered = stored(ordered.mapInArrow(_numbered, f"{fields}, part int, place long"))
    runs = numbered.groupBy("tree", "part").agg(F.count("*").alias("rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(
        F.col("tree").alias("_tree"),
        F.col("part").alias("_part"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("before"),
        F.sum("rows").over(tree).alias("n"),
    )
    same = numbered["tree"].eqNullSafe(runs["_tree"]) & (numbered["part"] == runs["_part"])
    found = numbered.join(runs, same).withColumn("place", F.col("place") + F.col("before"))
    return found.drop("_tree", "_part", "part", "before")


def _levels(n: int, most: int) -> int:
    """Levels above ``n`` nodes that this round processes."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // FAN), levels + 1
    return levels


def _forward(digests: list[str], levels: int) -> list[list[str]]:
    """The digests of a bundle's nodes by level, each message delivered in the order of its label."""
    queue = [(0, i, d) for i, d in enumerate(digests)]
    nodes: list[list[str]] = [[] for _ in range(levels + 1)]
    heapq.heapify(queue)
    inbox: list[str] = []
    while queue:
        level, i, digest = heapq.heappop(queue)
        nodes[level].append(digest)
        if level == levels:
            continue
        inbox.append(digest)
        # The parent's inbox is whole when the next label is not of its children.
        if i % FAN == FAN - 1 or not (queue and queue[0][0] == level):
            heapq.heappush(queue, (level + 1, i // FAN, _digest("".join(inbox))))
            inbox = []
    return nodes


def _backward(nodes: list[list[str]], suffix: tuple) -> Iterator[tuple]:
    """The proof of each node of the lowest level: the siblings left and right of it, then its parent's proof."""
    above = [suffix]
    for level in reversed(nodes[:-1]):
        proofs = []
        for i in range(len(level)):
            first = i - i % FAN
            step = ("".join(level[first:i]), "".join(level[i + 1 : first + FAN]))
            proofs.append((step, *above[i // FAN]))
        above = proofs
    yield from above


def _bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[dict]]]:
    """The first row's fields and all rows of each bundle, in sorted input."""
    key, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            own = (row["tree"], row["bundle"])
            if own != key and rows:
                yield rows[0], rows
                rows = []
            key = own
            rows.append(row)
    if rows:
        yield rows[0], rows


def _up(levels: int):
    schema = pa.schema([("tree", pa.string()), ("place", pa.int64()), ("n", pa.int64()), ("digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(schema.names, f, strict=True)) for f in found], schema=schema)

        for first, rows in _bundles(batches):
            top = _forward([r["digest"] for r in rows], _levels(first["n"], levels))[-1][0]
            found.append((first["tree"], first["bundle"], -(-first["n"] // FAN**levels), top))
            if len(found) >= 4096:
                yield batch()
                found.clear()
        if found:
            yield batch()

    return run


def _ordered(rows: DataFrame) -> DataFrame:
    """The queue's messages by bundle and place; a bundle's suffix, of place -1, comes first."""
    return rows.repartition("tree", "bundle").sortWithinPartitions("tree", "bundle", "place")


def _rounds(rows: DataFrame, levels: int) -> tuple[list[DataFrame], DataFrame]:
    """The messages of each round, lowest first, and the last digest of each tree."""
    bundle = F.floor(F.col("place") / FAN**levels).cast("long")
    rounds = [rows.withColumn("bundle", bundle)]
    while True:
        narrow = rounds[-1].select("tree", "bundle", "place", "n", "digest")
        top = stored(_ordered(narrow).mapInArrow(_up(levels), "tree string, place long, n long, digest string"))
        if top.where("n > 1").isEmpty():
            return rounds, top
        rounds.append(top.withColumn("bundle", bundle))


def _proofs_of(rows: list[dict], levels: int) -> Iterator[tuple[dict, tuple]]:
    """The nodes of a bundle, whose suffix comes first, with their proofs."""
    suffix, *nodes = rows
    found = _forward([r["digest"] for r in nodes], _levels(nodes[0]["n"], levels))
    yield from zip(nodes, _backward(found, tuple((s["left"], s["right"]) for s in suffix["steps"])), strict=True)


def _down(levels: int):
    """The proofs of a round's nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _bundles(batches):
            trees, places, proofs = [], [], []
            for row, steps in _proofs_of(rows, levels):
                trees.append(row["tree"])
                places.append(row["place"])
                proofs.append([{"left": a, "right": b} for a, b in steps])
            columns = [pa.array(trees, pa.string()), pa.array(places, pa.int64()), pa.array(proofs, pa.list_(_STEP))]
            yield pa.RecordBatch.from_arrays(columns, names=["tree", "place", "steps"])

    return run


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
_PROVED_NAMES = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root")


def _folded(digest: str, steps: tuple) -> str:
    for left, right in steps:
        digest = _digest(left + digest + right)
    return digest


def _proved(levels: int):
    """The results of the leaves: each proof's digest, and the root that the given leaf folds to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for suffix, rows in _bundles(batches):
            found = []
            for row, steps in _proofs_of(rows, levels):
                proof = _digest("".join(left + right for left, right in steps))
                found.append((row["doc_id"], row["digest"], suffix["subroot"], suffix["root"], proof, _folded(row["given"], steps)))
            columns = [pa.array(c, pa.int64() if i == 0 else pa.string()) for i, c in enumerate(zip(*found, strict=True))]
            columns.append(pa.array([f[5] == suffix["root"] for f in found], pa.bool_()))
            yield pa.RecordBatch.from_arrays(columns, names=[*_PROVED_NAMES, "verified"])

    return run


def _suffixed(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    """``rows`` and, ahead of each bundle, its suffix."""
    return _ordered(suffixes.withColumn("place", F.lit(-1).cast("long")).unionByName(rows, allowMissingColumns=True))


def _proofs(rounds: list[DataFrame], suffixes: DataFrame, levels: int) -> DataFrame:
    """The proofs of the lowest round's bundles, from those of the trees' last nodes (``bundle`` 0)."""
    for messages in reversed(rounds[1:]):
        rows = messages.select("tree", "bundle", "place", "n", "digest")
        suffixes = _suffixed(rows, suffixes.select("tree", "bundle", "steps"))
        found = stored(suffixes.mapInArrow(_down(levels), f"tree string, place long, steps {_STEPS}"))
        suffixes = found.withColumnRenamed("place", "bundle")
    return suffixes


def manifest(docs: DataFrame, given: Column, levels: int = LEVELS) -> DataFrame:
    """``doc_id``, ``leaf``, ``subroot``, ``root``, ``proof_sha256``, ``folded_root`` and ``verified`` of each row.

    The rows of each ``lang`` are the leaves of a tree, by ``doc_id`` (null
    first); its last node is the subroot. The subroots by ``lang`` (null first,
    by bytes) are the leaves of the tree of the root. ``given`` is the text that
    is verified: the root is folded from its leaf and the siblings of ``text``.

    Rows of one id are ordered by their digests; equal rows are leaves of their
    own, in no particular order, which their digests do not show. Null fields
    count as ``-``; a null language is a tree of its own, not that of the empty
    one. An empty table gives an empty result. Other columns are left out, also
    those that are named like the results.
    """
    fields = [F.col(f) for f in FIELDS]
    changed = [given if f == "text" else F.col(f) for f in FIELDS]
    leaves = docs.select(
        F.col("lang").cast("string").alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        leaf_digest(fields).alias("digest"),
        F.when(~given.eqNullSafe(F.col("text")), leaf_digest(changed)).alias("given"),
        # Deals equal rows out, too; fixed by being stored.
        F.monotonically_increasing_id().alias("tie"),
    )
    leaves = stored(_placed(stored(leaves), ["doc_id", "digest", "tie"]).drop("tie"))
    rounds, subroots = _rounds(leaves.withColumn("given", F.coalesce("given", "digest")), levels)
    # The trees' last nodes are the leaves of the tree of the root, which is one value.
    named = subroots.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "digest")
    named = stored(_placed(named, ["lang"]))
    upper, last = _rounds(named, levels)
    top = last.select("tree", F.lit(0).cast("long").alias("bundle"), F.array().cast(_STEPS).alias("steps"))
    lowest = upper[0].select("tree", "bundle", "place", "n", "digest")
    proofs = _suffixed(lowest, _proofs(upper, top, levels)).mapInArrow(_down(levels), f"tree string, place long, steps {_STEPS}")
    named = named.select(F.col("lang").alias("tree"), "place", F.col("digest").alias("subroot"))
    tops = stored(named.join(proofs.select("place", "steps"), "place").withColumn("bundle", F.lit(0).cast("long")))
    suffixes = _proofs(rounds, tops.select("tree", "bundle", "steps"), levels)
    suffixes = suffixes.join(tops.select(F.col("tree").alias("_tree"), "subroot"), F.col("tree").eqNullSafe(F.col("_tree"))).drop("_tree")
    root = last.first()
    suffixes = suffixes.withColumn("root", F.lit(root["digest"] if root else None).cast("string"))
    rows = rounds[0].select("tree", "bundle", "place", "n", "digest", "doc_id", "given")
    return _suffixed(rows, suffixes).mapInArrow(_proved(levels), _PROVED)
