"""Chat formatting of reply trees: root-to-leaf paths, the best of each tree, one conversation each.

Paths are found by self-joins that double the distance each round: the ancestor
at distance 2^j of every message is a table, joined with itself for the next
one. So a chain of n replies takes log2(n) rounds, and no conversation, however
long, is collected in one task. The same tables first sum the scores from the
root, by which branches are ranked, and then list the messages of the chosen
branches only.

The template: ``<turn ROLE>TEXT</turn>`` and a newline for each turn. In roles
and texts a backslash is put before ``\\``, ``<`` and ``>``, so no text can hold
a control string and taking the backslashes away gives the text back. The loss
mask is a list of spans of code points that cover the texts of the assistant.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import stored

# Turns of one row of the output; a longer conversation has several, in order.
PIECE_TURNS = 1000
# Turn numbers that are chained in one group.
CHAIN_TURNS = 1024
ASSISTANT = "assistant"
_CLOSE = "</turn>\n"


def chain(rows: DataFrame, tree: str = "conv_id", turn: str = "turn") -> DataFrame:
    """``tree``, ``node``, ``parent``, ``role``, ``text`` and ``score`` of rows that follow each other by ``turn``.

    Each row answers the one before it; ties are ordered by role and text, a
    null turn comes first. Nodes ascend in that order. A null tree is a tree of
    its own. Conversations are chained in groups of turn numbers, and the
    groups by the last node of each.
    """
    rows = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col(tree).cast("string")), F.lit("null")).alias("tree"),
        F.coalesce(F.floor(F.col(turn) / CHAIN_TURNS), F.lit(-(1 << 30))).cast("long").alias("_group"),
        F.col(turn).alias("_turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    order = Window.partitionBy("tree", "_group").orderBy(F.col("_turn").asc_nulls_first(), "role", "text")
    rows = rows.withColumn("node", F.col("_group") * F.lit(1 << 32) + F.row_number().over(order))
    rows = stored(rows.withColumn("_before", F.lag("node").over(order)))
    ends = rows.groupBy("tree", "_group").agg(F.max("node").alias("_end"))
    last = F.lag("_end").over(Window.partitionBy("tree").orderBy("_group"))
    ends = ends.withColumn("_last", last).drop("_end")
    return rows.join(ends, ["tree", "_group"]).select(
        "tree", "node", F.coalesce("_before", "_last").alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


def best_paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """``tree``, ``leaf``, ``rank``, ``position`` and ``node`` of the ``branches`` best root-to-leaf paths of each tree.

    Branches are ranked by the mean score of their messages, then the longer
    one, then the smaller leaf. ``(tree, node)`` is unique and not null; a null
    score is 0. A message whose parent is null or missing is a root. Messages
    that answer each other in a circle hang from no root and are on no path.
    """
    keys = ["tree", "node"]
    links = stored(messages.select("tree", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("sum")))
    there = links.select("tree", F.col("node").alias("up"), F.lit(True).alias("there"))
    jump = links.join(there, ["tree", "up"], "left").withColumn("up", F.when(F.col("there"), F.col("up")))
    jump = stored(jump.select("tree", "node", "up", "sum", F.lit(1).cast("long").alias("n")))
    # Messages whose path to the root is known, and those that still go on.
    finished, live = jump.where("up IS NULL"), jump.where("up IS NOT NULL")
    jumps = [live]
    most = links.count()
    while 1 << len(jumps) <= 2 * most and not live.isEmpty():
        above = live.unionByName(finished)
        above = above.select("tree", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("sum").alias("sum2"), F.col("n").alias("n2"))
        far = live.join(above, ["tree", "up"])
        jump = stored(far.select("tree", "node", F.col("up2").alias("up"), (F.col("sum") + F.col("sum2")).alias("sum"), (F.col("n") + F.col("n2")).alias("n")))
        finished, live = finished.unionByName(jump.where("up IS NULL")), jump.where("up IS NOT NULL")
        jumps.append(live)
    parents = jumps[0].select("tree", F.col("up").alias("node")).distinct()
    leaves = finished.join(parents, keys, "left_anti")
    order = Window.partitionBy("tree").orderBy(F.desc(F.col("sum") / F.col("n")), F.desc("n"), "node")
    leaves = leaves.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= branches)
    paths = stored(leaves.select("tree", F.col("node").alias("leaf"), "rank", F.col("n").alias("position"), "node"))
    for j, jump in enumerate(jumps[:-1]):
        far = paths.join(jump.select("tree", "node", "up"), keys)
        far = far.select("tree", "leaf", "rank", (F.col("position") - (1 << j)).alias("position"), F.col("up").alias("node"))
        paths = stored(paths.unionByName(far))
    return paths


def escaped(text: Column) -> Column:
    for char in "\\<>":
        text = F.replace(text, F.lit(char), F.lit(f"\\{char}"))
    return text


def formatted(messages: DataFrame, branches: int = 1, piece_turns: int = PIECE_TURNS) -> DataFrame:
    """``tree``, ``leaf``, ``rank``, ``piece``, ``formatted`` and ``loss`` of the best paths.

    Each path is one conversation: its pieces in order, of ``piece_turns`` turns
    at most. ``loss`` has the spans of the assistant's texts within the piece.
    """
    paths = best_paths(messages, branches)
    rows = paths.join(messages.select("tree", "node", "role", "text"), ["tree", "node"])
    text = escaped(F.coalesce("text", F.lit("")))
    opening = F.concat(F.lit("<turn "), escaped(F.coalesce("role", F.lit(""))), F.lit(">"))
    rows = rows.select(
        "tree",
        "leaf",
        "rank",
        F.floor((F.col("position") - 1) / piece_turns).alias("piece"),
        "position",
        F.concat(opening, text, F.lit(_CLOSE)).alias("_segment"),
        F.length(opening).alias("_from"),
        F.length(text).alias("_size"),
        (F.col("role") == ASSISTANT).alias("_learnt"),
    )
    piece = ["tree", "leaf", "rank", "piece"]
    before = Window.partitionBy(*piece).orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("_segment")).over(before), F.lit(0)) + F.col("_from")
    rows = rows.withColumn("_start", start.cast("long"))
    span = F.struct(F.col("_start").alias("start"), (F.col("_start") + F.col("_size")).alias("end"))
    turns = F.sort_array(F.collect_list(F.struct("position", "_segment")))
    return rows.groupBy(*piece).agg(
        F.array_join(F.transform(turns, lambda t: t["_segment"]), "").alias("formatted"),
        F.sort_array(F.collect_list(F.when(F.col("_learnt"), span))).alias("loss"),
    )


_TURN = re.compile(r"<turn ((?:[^\\<>]|\\.)*)>((?:[^\\<>]|\\.)*)</turn>\n", re.S)
_ESCAPE = re.compile(r"\\(.)", re.S)


def unescaped(text: str) -> str:
    return _ESCAPE.sub(r"\1", text) if "\\" in text else text


def parsed(text: str) -> list[tuple[str, str]]:
    """Role and text of each turn of a formatted text; raises on anything else in it."""
    turns, at = [], 0
    while at < len(text):
        turn = _TURN.match(text, at)
        if not turn:
            raise ValueError(f"not a turn at {at}")
        turns.append((unescaped(turn[1]), unescaped(turn[2])))
        at = turn.end()
    return turns


DIGEST = "tree string, leaf long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_DIGEST = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of conversations whose pieces come one after another; one piece is held at a time."""
    names = [part.split()[0] for part in DIGEST.split(", ")]
    key, state, done = None, None, []

    def closed() -> tuple:
        n, turns, chars, loss, size = state
        return (*key, n, turns.hexdigest(), chars, loss.hexdigest(), size)

    for batch in batches:
        for row in batch.to_pylist():
            if (row["tree"], row["leaf"]) != key:
                if key:
                    done.append(closed())
                key, state = (row["tree"], row["leaf"]), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            for role, text in parsed(row["formatted"]):
                state[0] += 1
                state[1].update(f"{role}\n{text}\n".encode())
            for span in row["loss"]:
                text = unescaped(row["formatted"][span["start"] : span["end"]])
                state[2] += len(text)
                state[3].update(text.encode())
            state[4] += len(row["formatted"])
        if len(done) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _DIGEST, strict=True)], names=names)
            done = []
    if key:
        done.append(closed())
    if done:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), _DIGEST, strict=True)], names=names)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """What the formatted conversations written to ``path`` hold, turn by turn and under the loss mask."""
    rows = spark.read.parquet(path).select("tree", "leaf", "piece", "formatted", "loss")
    ordered = rows.repartition("tree", "leaf").sortWithinPartitions("tree", "leaf", "piece")
    return ordered.mapInArrow(_digests, DIGEST)
