"""Exact base scores, and model scores close to those of exact counts."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from llm.fixtures import none, odd, prose, rows
from pyspark.sql import functions as F

from millrace.llm import common
from millrace.llm import language_model as lm
from millrace.llm.queries import op3_lm_scoring


def _tokens(text: str | None) -> list[str]:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", lower), " "]


def _counts(texts):
    words, pairs = Counter(), Counter()
    for text in texts:
        tokens = _tokens(text)
        words.update(tokens)
        pairs.update(zip([None, *tokens], tokens))
    return words, pairs


def _agrees(row, text, words, pairs, error: float) -> None:
    n, v, tokens = sum(words.values()), len(words), _tokens(text)
    base = sum(math.log10((words[t] + 1) / (n + v + 1)) for t in tokens)
    assert (row.n_tokens, row.n_known, row.train_tokens) == (len(tokens), sum(words[t] > 0 for t in tokens), n)
    assert row.base_score == pytest.approx(base, abs=1e-6)
    exact = 0.0
    for before, t in zip([None, *tokens], tokens):
        seen = words[" "] if before is None else words[before]
        exact += math.log10((pairs[(before, t)] + lm.SMOOTHING * (words[t] + 1) / (n + v + 1)) / (seen + lm.SMOOTHING))
    assert abs(row.score - exact) / len(tokens) < error


@pytest.mark.parametrize("head", [lm.HEAD_WORDS, 10, 1])
def test_scores_against_exact_counts(spark, monkeypatch, head):
    # The head may be any part of the words: the rest is joined.
    monkeypatch.setattr(lm, "HEAD_WORDS", head)
    train, other = [prose(i, 150) for i in range(60)], [prose(i, 60) for i in range(100, 110)] + ["", None, "UNSEEN words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(train + other)], "doc_id long, text string").withColumn("held_out", F.col("doc_id") >= 60)
    model = lm.train(docs.where("NOT held_out"))
    words, pairs = _counts(train)
    assert 0 < model.load < 0.6
    for row in lm.scores(docs, model).collect():
        _agrees(row, (train + other)[row.doc_id], words, pairs, 0.35)


def test_a_filter_beyond_the_broadcast_gives_the_same_scores(spark, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 500)
    texts = [prose(i, 150) for i in range(60)] + ["", None, "UNSEEN words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("held_out", F.col("doc_id") % 7 == 0)
    docs = docs.union(docs.where("doc_id < 3"))
    whole, parts = lm.train(docs.where("NOT held_out")), lm.train(docs.where("NOT held_out"), filter_bytes=1 << 10)
    # The bits do not stop at filter_bytes.
    assert parts.load == whole.load and parts.filter is None
    expected, found = (sorted(map(tuple, lm.scores(docs, m).collect())) for m in (whole, parts))
    assert len(found) == len(expected) == 66
    for e, f in zip(expected, found, strict=True):
        assert e[:5] == f[:5] and e[5:] == pytest.approx(f[5:], abs=1e-9)


def test_blocks_hold_the_same_tokens():
    texts = [prose(3, 80), None, "", " ", "\t\x0bA  b\x0c\r\n", "Ünï\u00a0cÖde\x85 \x1cX\x00Y", " A", "A "]
    block = lm._read(lm.pa.array(["left out", *texts]).slice(1))
    found = np.split([block.words[c] for c in block.codes], block.starts[1:])
    assert [t.tolist() for t in found] == [np.array(lm.tokens_of(t)).tolist() for t in texts]
    assert block.words[-1] == lm.END and len(set(block.words)) == len(block.words)


def test_gaps_round_trip():
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 48, 90_000, dtype=np.uint64))
    for regions in (1, 7, 70_000):
        order, edges = lm._by_region(keys, regions)
        for r in (0, regions - 1):
            own = keys[order][edges[r] : edges[r + 1]]
            packed = lm._pack_gaps(own, regions) if len(own) else b"\4"
            assert (lm._unpack_gaps(packed, r, regions) == own).all() and (own % np.uint64(regions) == r).all()
    dense = np.arange(5, 5000, 5, dtype=np.uint64)
    assert len(lm._pack_gaps(dense, 5)) < 4 * len(dense) + 2


def test_what_is_stored(spark, monkeypatch):
    """Answers hold no keys, and texts are not stored."""
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 2000)
    written = []
    monkeypatch.setattr(lm, "stored", lambda df: written.append(common.stored(df)) or written[-1])
    docs = spark.createDataFrame([(i, prose(i, 100)) for i in range(50)] * 2, "doc_id long, text string").withColumn("held_out", F.lit(False))
    model = lm.train(docs, filter_bytes=0)
    found = lm.scores(docs, model)
    assert [set(d.columns) & {"keys", "text"} for d in written[2:]] == [set(), set()]
    assert found.count() == 100


def test_no_known_ngram_is_missed():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 48, 5000, dtype=np.uint64))
    counts = np.arange(1, len(keys) + 1).astype(np.uint64)
    regions, bits = 4, 1 << 17
    whole = np.zeros(regions * bits // 8, np.uint8)
    for r in range(regions):
        own = keys % np.uint64(regions) == r
        batch = lm.pa.RecordBatch.from_pylist(
            [{"region": r, "singles": 0, "keys": lm._pack(keys[own]), "counts": counts[own].tobytes()}]
        )
        (built,) = lm._set_bits(bits)([batch])
        whole[r * bits // 8 : (r + 1) * bits // 8] = np.frombuffer(built.column("bits")[0].as_py(), np.uint8)
    found = lm.Filter(whole, regions, bits).counts(keys)
    exact = lm._value(lm._levels(counts))
    assert (found >= exact).all() and (found == exact).mean() > 0.9
    absent = np.random.default_rng(1).integers(0, 1 << 48, 5000, dtype=np.uint64)
    assert (lm.Filter(whole, regions, bits).counts(absent) > 0).mean() < 0.1


def test_packed_keys_round_trip():
    keys = np.array([0, 1, (1 << 48) - 1, 123456789012345], np.uint64)
    assert (lm._unpack(lm._pack(keys)) == keys).all()


def test_odd_rows(spark):
    docs = odd(spark).withColumn("held_out", F.lit(False))
    words, pairs = _counts([r[1] for r in rows()])
    model = lm.train(docs)
    texts = Counter((r[0], len(_tokens(r[1]))) for r in rows())
    found = lm.scores(docs, model).collect()
    assert Counter((r.doc_id, r.n_tokens) for r in found) == texts
    assert all(r.n_known == r.n_tokens and r.score <= 0 for r in found)
    empty = lm.train(none(spark))
    assert lm.scores(none(spark).withColumn("held_out", F.lit(True)), model).count() == 0
    assert all(r.n_known == 0 and r.base_score == 0 for r in lm.scores(docs, empty).collect())


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in docs}
    words, pairs = _counts(t for i, t in docs.items() if not held[i])
    found = op3_lm_scoring(spark, sf).collect()
    assert len(found) == len(docs)
    for row in found:
        assert row.held_out == held[row.doc_id]
        _agrees(row, docs[row.doc_id], words, pairs, 0.6)
