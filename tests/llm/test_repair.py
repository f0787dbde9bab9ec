"""Conversation repair against every way to edit, and against a plain programme."""

from __future__ import annotations

import hashlib
import itertools
import random
import re

import pytest
from conftest import DATA
from oracle import duck_rows, spark_rows

from millrace.llm import ORACLES, QUERIES
from millrace.llm.repair import (
    SYMBOLS,
    _before,
    _ended,
    _flat,
    _through,
    matrices,
    repaired,
    replaced,
)

SCHEMA = "conv_id long, turn long, role string, text string, cost string, audit string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal"]
NEXT = {"s": {"": "s"}, "u": {"": "u", "s": "u", "a": "u"}, "a": {"u": "a"}}
ROLES = {"u": "user", "a": "assistant"}


def _every_way(rows):
    """All repairs of ``rows`` (initial, must go, truncated) with up to two insertions in each gap."""
    pattern = re.compile(r"(s?(ua)+)?")
    for edits in itertools.product(*(("D",) if gone else ("K", "Ru", "Ra", "D") for _, gone, _ in rows)):
        for gaps in itertools.product(("", "u", "a", "ua", "au"), repeat=len(rows) + 1):
            said, audit, cost = gaps[0], "I" * len(gaps[0]), 2 * len(gaps[0])
            for (initial, _, truncated), edit, gap in zip(rows, edits, gaps[1:], strict=True):
                said += ("" if edit == "D" else initial if edit == "K" else edit[1]) + gap
                audit += edit[0] + "I" * len(gap)
                cost += {"K": 0, "R": 2, "D": 3}[edit[0]] + (truncated and edit != "D") + 2 * len(gap)
            if pattern.fullmatch(said):
                yield cost, audit


def _symbol(row) -> int:
    initial, gone, truncated = row
    return SYMBOLS - 1 if gone else 2 * "sua?".index(initial) + truncated


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_matrices_give_the_least_of_all_ways(n):
    kinds = [("s", False, False), ("u", False, False), ("a", False, False), ("?", False, True), ("u", False, True), ("a", True, False)]
    rng = random.Random(n)
    some = list(itertools.product(kinds, repeat=n))
    for rows in rng.sample(some, min(len(some), 20)):
        own = matrices([])
        state = [(0, ""), None, None, None]
        for row in rows:
            state = _through(state, own[_symbol(row)])
        assert _ended(state) == min(_every_way(rows))


def _plain(rows) -> tuple[int, str, list]:
    """The least cost, audit and edits by a programme over whole strings, row by row."""
    best = {"": (0, "", ())}

    def inserted(best):
        out = dict(best)
        for _ in range(2):
            for state, (cost, audit, said) in list(out.items()):
                role = "a" if state == "u" else "u"
                new = (cost + 2, audit + "I", (*said, (ROLES[role], "")))
                to = NEXT[role][state]
                out[to] = min(out.get(to, new), new)
        return out

    for role, text, fault in rows:
        after: dict = {}
        for state, (cost, audit, said) in inserted(best).items():
            ways = [(state, 3, "D", ())]
            if fault not in ("blank", "duplicate"):
                more = fault == "truncated"
                if state in NEXT.get(role[:1], {}):
                    ways.append((NEXT[role[0]][state], more, "K", ((role, text),)))
                ways += [(NEXT[r][state], 2 + more, "R", ((ROLES[r], text),)) for r in ROLES if state in NEXT[r]]
            for to, price, edit, says in ways:
                new = (cost + price, audit + edit, said + says)
                after[to] = min(after.get(to, new), new)
        best = after
    ends = inserted(best)
    return min(ends[s] for s in ("", "a") if s in ends)


def _brute(rows, names) -> list[tuple]:
    out = []
    for conv in set(names):
        own = [(r[1], " " if r[2] is None else r[2], " " if r[3] is None else r[3]) for r in rows if r[0] == conv]
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.sha256(f"{len(r[1].encode())}:{r[1]}{r[2]}".encode()).digest()))
        seen, faulty = set(), []
        for _, role, text in own:
            marks = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not marks else "duplicate" if (role, text) in seen else "" if marks[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in own if t is not None]
        initials = [role[:1] for role, _, _ in faulty]
        illegal = sum(f"{a}/{b}" not in ("s/u", "u/a", "a/u") for a, b in itertools.pairwise(initials))
        cost, audit, said = _plain(faulty)
        counts = [sum(f == name for _, _, f in faulty) for name in COUNTS[1:4]]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        text = "\n".join(f"{role}:{text}" for role, text in said)
        out.append((conv, gaps, *counts, illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return out


def _agrees(spark, rows: list[tuple], names: list | None = None) -> None:
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    names = [r[0] for r in rows] if names is None else names
    wanted = spark.createDataFrame([(n,) for n in names], "conv_id long")
    found = repaired(docs, wanted)
    assert found.columns == ["conv_id", *COUNTS, "cost", "audit", "repaired_sha256"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, _brute(rows, names)))


def _conversation(rng: random.Random, conv: int | None, n: int) -> list[tuple]:
    out = []
    for turn in range(n):
        role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
        text = rng.choice(["Yes.", "Why? ", "no end", "", " \n", "Été !", f"n{rng.randrange(99)}.", None])
        out += [(conv, rng.choice([turn, turn, turn * 2, None]), role, text)] * rng.choice([1, 1, 1, 2])
    return out


def test_odd_conversations(spark):
    rng = random.Random(3)
    rows = [r for conv in (None, *range(40)) for r in _conversation(rng, conv, rng.randrange(1, 14))]
    _agrees(spark, rows, [None, *range(45), 7])


def test_one_conversation_over_many_tasks(spark):
    """A conversation of most rows, with contents repeated far apart, in many chunks."""
    rng = random.Random(5)
    rows = _conversation(rng, 1, 6000) + [(1, 9000 + i, ("user", "assistant")[i % 2], f"a{i % 3000}.") for i in range(6000)]
    rows += [r for conv in range(2, 20) for r in _conversation(rng, conv, 4)]
    _agrees(spark, rows)


def test_equal_conversations(spark):
    """All of one shape: a few symbols after compression, and one chunk for all."""
    rows = [(c, t, ("user", "assistant")[t % 2], f"{c} {t}.") for c in range(60) for t in range(32)]
    _agrees(spark, rows)


def test_no_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repaired(none, none).collect() == []
    _agrees(spark, [], [1, None])


def test_rules_keep_the_meaning():
    """Any rules give the matrices of the symbols that they stand for."""
    rng = random.Random(1)
    for _ in range(20):
        symbols = [rng.randrange(SYMBOLS) for _ in range(40)]
        rules, packed = [], symbols
        for _ in range(6):
            pair = rng.choice(list(itertools.pairwise(packed)))
            packed = replaced(packed, {pair: SYMBOLS + len(rules)})
            rules.append(pair)
        own = matrices(rules)
        plain = whole = [(0, ""), None, None, None]
        for s in symbols:
            plain = _through(plain, own[s])
        for s in packed:
            whole = _through(whole, own[s])
        assert len(packed) < len(symbols) and _ended(plain) == _ended(whole)


def test_ropes_are_ordered_like_their_texts():
    rng = random.Random(2)

    def rope(depth: int):
        return (rope(depth - 1), rope(depth - 1)) if depth and rng.random() < 0.7 else rng.choice(["", "a", "ab", "b"])

    ropes = [rope(4) for _ in range(60)]
    assert all(_before(a, b) == (_flat(a) < _flat(b)) for a in ropes for b in ropes)


def test_query_agrees_with_sql(spark):
    sf_dir = DATA / "sf0.01"
    expected_columns, expected = duck_rows(sf_dir, ORACLES["op12_conversation_repair"])
    columns, rows = spark_rows(QUERIES["op12_conversation_repair"](spark, str(sf_dir)))
    assert columns == expected_columns and rows == expected and sum(rows.values()) == 100
