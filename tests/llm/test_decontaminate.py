"""Matches of the suffix automaton against windows counted one by one."""

from __future__ import annotations

import random
import re
from pathlib import Path

import pytest
from llm.fixtures import none, odd, rows
from oracle import duck_rows, spark_rows
from pyspark.sql import functions as F

from millrace.llm.decontaminate import SuffixAutomaton, decontaminated, matched
from millrace.llm.queries import OP8_SQL, op8_decontamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _words(text: str | None) -> list[str]:
    return WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def _brute(text: str | None, items: list[tuple], window: int):
    words, hit, found = _words(text), set(), set()
    for name, item in items:
        own = _words(item)
        size = min(window, len(own))
        windows = {tuple(own[i : i + size]) for i in range(len(own) - size + 1)} if own and name is not None else set()
        for i in range(len(words) - size + 1):
            if tuple(words[i : i + size]) in windows:
                hit |= set(range(i, i + size))
                found.add(str(name))
    return len(words), len(hit), sorted(found)


def _random_cases(seed: int):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choice("ab" if seed % 2 else "abcd") for _ in range(rng.choice([0, 1, 2, 3, 4, 9])))) for i in range(12)]
    texts = [(" " if i % 2 else ". ").join(rng.choice("abcdE") for _ in range(rng.randrange(0, 40))) for i in range(60)]
    return items, texts


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_brute_force(seed):
    items, texts = _random_cases(seed)
    for window in (1, 2, 3, 5):
        automaton = SuffixAutomaton([(str(n), [w.encode() for w in _words(t)]) for n, t in items], window)
        for text in texts:
            words = [w.encode() for w in _words(text)]
            spans, owners, longest = automaton.match(words)
            got = (len(words), len({p for a, b in spans for p in range(a, b)}), sorted(automaton.names[i] for i in owners))
            assert got == _brute(text, items, window)
            assert longest <= max(len(_words(t)) for _, t in items)


@pytest.mark.parametrize("max_words", [1000, 5])
def test_items_in_parts_find_the_same(spark, max_words):
    items, texts = _random_cases(2)
    items += [(None, "a b"), (50, None), (51, ""), (52, "a b c d"), (52, "a b c d")]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("spans", F.lit(1))
    for r in matched(docs, bench, 3, max_words).collect():
        assert (r.n_words, r.n_hit, list(r["items"])) == _brute([*texts, None][r.doc_id], items, 3)


def test_spans_are_cut_and_covered_documents_go(spark):
    item = "one two three four five six seven eight nine ten eleven"
    clean = "Alpha, beta; gamma delta " * 10
    texts = [clean, f"{clean}ONE two, three-four five six seven eight nine ten eleven. Omega é", item, None, "", "one two three"]
    docs = spark.createDataFrame([(i, t, -1, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_chars long, items string")
    found = {r.doc_id: r for r in decontaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found.keys() == {0, 1, 3, 4, 5}
    assert found[1].text == f"{clean}. Omega é" and found[1].n_chars == len(found[1].text)
    assert all((found[i].text, found[i].n_chars, found[i]["items"]) == (texts[i], -1, "x") for i in (0, 3, 4, 5))


def test_odd_rows(spark):
    docs, items = odd(spark), spark.createDataFrame([("q", rows()[0][1])], "item_id string, text string")
    found = {r.doc_id: r.n_hit for r in matched(docs, items).collect()}
    assert {i for i, n in found.items() if n} == {0}
    assert decontaminated(docs, items).columns == docs.columns
    assert decontaminated(docs, items).count() == docs.count() - 1
    assert decontaminated(docs, items.limit(0)).count() == docs.count()
    assert decontaminated(none(spark), items).count() == matched(none(spark), items).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    assert spark_rows(op8_decontamination(spark, sf)) == duck_rows(Path(sf), OP8_SQL)
