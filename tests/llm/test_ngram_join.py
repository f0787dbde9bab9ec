"""The n-gram join against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from conftest import DATA
from llm.fixtures import none, odd, prose
from oracle import duck_rows, spark_rows

from millrace.llm import ORACLES, QUERIES
from millrace.llm.ngram_join import CREDIT, DOCUMENT, POSTING, _class_texts, _credited, _held, _resolved, _rows, ngram_join


def _set(text: str | None, size: int) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def _brute(rows: list[tuple], size: int, percent: int) -> list[tuple]:
    """Each row's id, size of its set and the smallest id that it reaches."""
    sets = [_set(text, size) for _, text in rows]
    near: list[set[int]] = [{i} for i in range(len(rows))]
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                near[i].add(j)
                near[j].add(i)
    out, label = [], [-1] * len(rows)
    for i in range(len(rows)):
        if label[i] < 0:
            found, todo = {i}, [i]
            while todo:
                new = near[todo.pop()] - found
                found |= new
                todo += new
            for j in found:
                label[j] = i
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.append((doc, len(sets[i]), min(ids, default=None)))
    return out


def _agrees(spark, rows: list[tuple], size: int = 5, percent: int = 80) -> list[tuple]:
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    found = [tuple(r) for r in ngram_join(docs, size, percent).collect()]
    expected = _brute(rows, size, percent)
    assert sorted(map(str, found)) == sorted(map(str, expected))
    return expected


def _edited(rng: random.Random, text: str, n: int) -> str:
    words = text.split()
    for _ in range(n):
        i = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[i : i + 1] = [] if kind == 0 else [f"new{rng.randrange(10**6)}"] if kind == 1 else [words[i], "more"]
    return " ".join(words)


def test_families(spark):
    """Chains of edits, copies, and boilerplate in unlike texts."""
    rng = random.Random(4)
    texts = []
    for family in range(12):
        text = prose(family, rng.choice([6, 12, 60, 200]))
        for _ in range(14):
            text = _edited(rng, text, rng.choice([0, 1, 1, 2, 3]))
            texts.append(text)
    shared = prose(50, 60)
    texts += [f"{shared} {prose(100 + i, 30)}" for i in range(40)]
    texts += [prose(300 + i, 40).upper() for i in range(20)]
    rng.shuffle(texts)
    expected = _agrees(spark, list(enumerate(texts)))
    assert 30 < len({c for _, _, c in expected}) < len(texts) - 60


def test_a_crowd_around_the_threshold(spark):
    """Several hundred edits of one text: some linked, some not, and none by way of the first alone."""
    rng = random.Random(9)
    text = prose(1, 104)
    texts = [_edited(rng, text, rng.choice([1, 2, 2, 3, 4])) for _ in range(300)]
    expected = _agrees(spark, list(enumerate(texts)))
    assert len({c for _, _, c in expected}) > 20


def test_short_texts(spark):
    rng = random.Random(2)
    words = "a b c d e f".split()
    _agrees(spark, [(i, " ".join(rng.choices(words, k=rng.randrange(0, 9)))) for i in range(150)])


@pytest.mark.parametrize(("size", "percent"), [(2, 60)])
def test_other_parameters(spark, size, percent):
    rng = random.Random(size)
    texts = [_edited(rng, prose(i % 9, 30), rng.randrange(4)) for i in range(80)]
    _agrees(spark, list(enumerate(texts)), size, percent)


def test_odd_rows(spark):
    docs = odd(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    found = ngram_join(docs)
    assert found.columns == ["doc_id", "n_shingles", "component_id"]
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, _brute(rows, 5, 80)))


def test_no_rows(spark):
    assert ngram_join(none(spark)).collect() == []


def test_ids_and_nulls(spark):
    text = prose(1, 40)
    rows = [(None, text), (None, text), (5, text + " end"), (5, "unlike the others in all its words"), (7, prose(2, 50)), (None, prose(2, 50) + " x"), (None, None)]
    _agrees(spark, rows)


@pytest.mark.parametrize("at", [1, 2, 3, 7, 100])
def test_shared_postings_across_batches(at):
    rng = random.Random(at)
    rows = sorted((rng.randrange(30), i) for i in range(60))
    keys = [None if rng.random() < 0.2 else i for _, i in rows]
    whole = pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array(keys, pa.int64())], names=["shingle", "key"])
    found = [tuple(r.values()) for b in _credited(iter([whole.slice(i, at) for i in range(0, 60, at)])) for r in b.to_pylist()]
    often = np.bincount([s for s, _ in rows], minlength=30)
    assert sorted(found) == sorted((k, 1) for (s, _), k in zip(rows, keys, strict=True) if k is not None and often[s] > 1)


@pytest.mark.parametrize("at", [1, 2, 7, 100])
def test_postings_become_credits(at):
    rng = random.Random(at)
    rows = [(rng.choice([DOCUMENT, CREDIT, POSTING, POSTING]), rng.randrange(20), i) for i in range(60)]
    rows.sort(key=lambda row: row[1])
    batches = [b for kind, a, i in rows for b in [_rows(kind, [a], [i])]]
    whole = pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
    found = [tuple(r.values())[:3] for b in _resolved(iter([whole.slice(i, at) for i in range(0, 60, at)])) for r in b.to_pylist()]
    often = np.bincount([a for kind, a, _ in rows if kind == POSTING], minlength=20)
    assert sorted(found) == sorted((CREDIT, i, 1) if kind == POSTING else (kind, a, i) for kind, a, i in rows if kind != POSTING or often[a] > 1)


@pytest.mark.parametrize("at", [1, 2, 3, 7, 100])
def test_holders_across_batches(at, monkeypatch):
    """One number for all rows of a shingle, however many it has; rows of one holder are left out."""
    monkeypatch.setattr("millrace.llm.ngram_join.MOST_HOLDERS", 5)
    rng = random.Random(at)
    rows = sorted((rng.choice([-3, 0, 4, *range(9, 30)]), i) for i in range(60))
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((i, s) for s, i in rows), strict=True)], names=["id", "shingle"])
    found = [tuple(r.values()) for b in _held(iter([whole.slice(0, 0), *(whole.slice(i, at) for i in range(0, 60, at))])) for r in b.to_pylist()]
    often = {s: sum(other == s for other, _ in rows) for s, _ in rows}
    assert sorted(found) == sorted((i, s, min(often[s], 5)) for s, i in rows if often[s] > 1)
    assert list(_held(iter([]))) == []


def test_shingles_are_not_stored(spark, folder, monkeypatch):
    """What is stored follows the documents, not their shingles."""
    folders = (f"{folder}/run-{i}" for i in range(1000))
    monkeypatch.setattr("millrace.llm.common.new_folder", lambda spark: next(folders))
    texts = [text for i in range(30) for text in (prose(i, 300), prose(i, 300) + " end")]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {tuple(r) for r in ngram_join(docs).select("doc_id", "component_id").collect()} == {(i, i // 2 * 2) for i in range(60)}
    counts = [pq.read_table(path).num_rows for path in (DATA.__class__(folder)).glob("run-*/rows")]
    assert len(counts) > 10 and max(counts) < 10 * len(texts) < len(texts) * 290


def test_texts_of_classes_are_dealt_out_once(spark):
    """Whole texts go through one shuffle, by key, and each class gets one of its repeated rows."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs = spark.createDataFrame([(k % 4, f"text {k % 4}") for k in range(12)], "key long, text string").repartition(3)
        classes = spark.createDataFrame([(0, 70, 1, 2, 9), (3, 71, 3, 4, 9)], "key long, id long, set_a long, set_b long, n long")
        texts = _class_texts(docs, classes)
        assert texts._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 2
        assert sorted(map(tuple, texts.collect())) == [(70, "text 0", 1, 2), (71, "text 3", 3, 4)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_query_agrees_with_sql(spark):
    sf_dir = DATA / "sf0.01"
    expected_columns, expected = duck_rows(sf_dir, ORACLES["op11_ngram_join"])
    columns, rows = spark_rows(QUERIES["op11_ngram_join"](spark, str(sf_dir)))
    assert columns == expected_columns and rows == expected and sum(rows.values()) == 1000
