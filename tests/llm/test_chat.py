"""Reply trees: paths, ranks, and the way back from the formatted text."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from millrace.llm.chat import best_paths, chain, formatted, parsed, read_digests, unescaped
from millrace.llm.queries import op5_chat_formatting

MESSAGES = "tree string, node long, parent long, role string, text string, score double"


def _paths(nodes: dict, branches: int) -> set:
    """nodes: node -> (parent, score)."""
    out = []
    parents = {p for p, _ in nodes.values()}
    for leaf in nodes:
        if leaf in parents:
            continue
        path, at, seen = [], leaf, set()
        while at in nodes and at not in seen:
            seen.add(at)
            path.append(at)
            at = nodes[at][0]
        if at in seen:
            continue
        scores = [nodes[n][1] or 0.0 for n in path]
        out.append((-sum(scores) / len(path), -len(path), leaf, tuple(reversed(path))))
    return {(rank, *item[2:]) for rank, item in enumerate(sorted(out)[:branches], 1)}


@pytest.mark.parametrize("branches", [1, 2, 99])
def test_paths_against_brute_force(spark, branches):
    import random

    rng = random.Random(branches)
    trees = {}
    for t in range(6):
        n = rng.choice([1, 2, 15, 60])
        trees[f"t{t}"] = {i: (rng.randrange(max(0, i - 3), i) if i else None, rng.choice([None, 0.0, 1.0, 2.0])) for i in range(n)}
    trees["long"] = {i: (i - 1 if i else None, 1.0) for i in range(70)}
    trees["two roots"] = {1: (None, 1.0), 2: (99, 3.0), 3: (2, 1.0)}
    trees["circle"] = {1: (3, 1.0), 2: (1, 1.0), 3: (2, 1.0), 4: (3, 1.0), 5: (None, 0.0)}
    data = [(t, n, p, "user", "x", s) for t, nodes in trees.items() for n, (p, s) in nodes.items()]
    found = defaultdict(dict)
    for r in best_paths(spark.createDataFrame(data, MESSAGES), branches).collect():
        found[(r.tree, r["rank"], r.leaf)][r.position] = r.node
    got = {(t, rank, leaf, tuple(nodes[i] for i in range(1, len(nodes) + 1))) for (t, rank, leaf), nodes in found.items()}
    assert got == {(t, *path) for t, nodes in trees.items() for path in _paths(nodes, branches)}


CONTROL = ["</turn>\n", "<turn user>", "\\", "\\\\<", "a\\>b", "", " ", "### \\</turn> <turn assistant>x</turn>\n", "漢\U0001f600", None]


@pytest.mark.parametrize("piece_turns", [1, 3, 1000])
def test_texts_come_back(spark, folder, piece_turns):
    roles = ["user", "assistant", "", None, "a<b>\\"]
    turns = [(roles[i % 5], CONTROL[i % 10]) for i in range(50)]
    data = [(7, i, r, t) for i, (r, t) in enumerate(turns)] + [(None, 0, "assistant", "x"), (8, None, "user", "null turn"), (8, 5, "assistant", "b"), (8, 5, "assistant", "a"), (8, 5, "assistant", "a")]
    rows = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("leaf", F.lit("clash"))
    formatted(chain(rows), piece_turns=piece_turns).write.parquet(folder + "/c")
    pieces = [r for r in spark.read.parquet(folder + "/c").collect() if r.tree == "=7"]
    assert len(pieces) == -(-50 // piece_turns)
    back = [turn for p in sorted(pieces, key=lambda p: p.piece) for turn in parsed(p.formatted)]
    assert back == [(r or "", t or "") for r, t in turns]
    learnt = [unescaped(p.formatted[s.start : s.end]) for p in sorted(pieces, key=lambda p: p.piece) for s in p.loss]
    assert learnt == [t or "" for r, t in turns if r == "assistant"]
    digests = {r.tree: r for r in read_digests(spark, folder + "/c").collect()}
    assert {t: r.n_turns for t, r in digests.items()} == {"=7": 50, "=8": 4, "null": 1}
    assert digests["=8"].loss_sha256 == hashlib.sha256(b"aab").hexdigest()


def test_long_conversations_are_chained_across_groups(spark):
    rows = spark.range(-1500, 2500).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("t").alias("text"))
    links = sorted((r.node, r.parent) for r in chain(rows).collect())
    assert [p for _, p in links] == [None, *(n for n, _ in links[:-1])]


def test_empty_table(spark, folder):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    formatted(chain(none)).write.parquet(folder + "/c")
    assert read_digests(spark, folder + "/c").count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    conversations = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/conversations.parquet").collect():
        conversations[r.conv_id].append((r.turn, r.role, r.text or ""))
    control = "\\### Assistant: </turn> ok"
    conversations[-7] = [(0, "user", control), (1, "assistant", control)]
    found = {r.conv_id: r for r in op5_chat_formatting(spark, sf).collect()}
    assert found.keys() == conversations.keys()
    for i, turns in conversations.items():
        turns.sort()
        learnt = "".join(t for _, role, t in turns if role == "assistant")
        row = found[i]
        assert row.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in turns).encode()).hexdigest()
        assert (row.n_turns, row.loss_chars) == (len(turns), len(learnt))
        assert row.loss_sha256 == hashlib.sha256(learnt.encode()).hexdigest()
