"""Statistics against brute force, estimates against numpy, and planted outliers."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm.fixtures import none, odd, prose, rows
from pyspark.sql import functions as F

from millrace.llm import quality
from millrace.llm.queries import op7_quality_rules

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _counts(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = list(zip(words, words[1:], words[2:]))
    times, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if times[w] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " ", "x", "a b a b a b c", "a b c a b c", "a a a a", "a b c d a b c", "\n\na\na\n \na", "é é é é\té", "1 2 3 4 1 2 3 4 2 3 4", "漢 # | <> \x0b\x0c\r x"]


@pytest.mark.parametrize("packed_words", [1 << 24, 1])
def test_statistics_against_brute_force(spark, monkeypatch, packed_words):
    monkeypatch.setattr(quality._repeat_words, "__defaults__", (3, packed_words))
    texts = TEXTS + [r[1] for r in rows()] + [prose(i, 30) + " " + prose(i, 9) for i in range(20)]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for r in quality.with_statistics(frame).collect():
        assert tuple(r[c] for c in COUNTS) == _counts(texts[r.i])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def _vectors(text: str) -> np.ndarray:
    words, chars, symbols, dup, repeat = _counts(text)
    lines, capitals = text.count("\n") + 1, len(re.findall("[A-Z]", text))
    shares = [np.sqrt(min(1.0, a / b)) for a, b in ((symbols, chars), (dup, lines), (repeat, words), (capitals, chars))]
    return np.floor(np.array([np.log(max(1.0, chars / words)), *shares]) * quality.SCALE + 0.5)


def _distances(x: np.ndarray) -> np.ndarray:
    """The concentration steps with plain numpy."""
    least = np.diag((np.array(list(quality.STATISTICS.values())) * quality.SCALE) ** 2)
    low, centre, high = np.quantile(x, [0.16, 0.5, 0.84], axis=0)
    cover = np.diag(((high - low) / 2) ** 2) + least

    def distance():
        off = x - centre
        return np.einsum("ij,jk,ik->i", off, np.linalg.inv(cover), off)

    for _ in range(quality.STEPS):
        bins = np.floor(quality.BINS_AN_OCTAVE * np.log2(distance() + 1))
        need, taken, core = np.ceil(quality.CORE * len(x)), 0, np.zeros(len(x), bool)
        for b in np.unique(bins):
            if taken < need:
                core |= bins == b
                taken += (bins == b).sum()
        own = x[core]
        centre = own.mean(axis=0)
        cover = quality.CONSISTENCY * (own.T @ own / len(own) - np.outer(centre, centre)) + least
    return distance()


def test_estimates_against_numpy_and_planted_outliers(spark):
    texts = [prose(i, 60 + i % 50) for i in range(120)]
    planted = [" ".join(w + "###" for w in prose(i, 70).split()) for i in range(4)] + [prose(i, 70).upper() for i in range(4)]
    data = [(i, t, "en" if i % 3 else "de", "s") for i, t in enumerate(texts + planted)]
    verdicts = {r.doc_id: r for r in quality.quality_verdicts(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    groups = defaultdict(list)
    for i, t, lang, _ in data:
        assert not verdicts[i].base_failed
        groups[lang].append((i, _vectors(t)))
    for group in groups.values():
        expected = _distances(np.array([x for _, x in group]))
        assert [verdicts[i].distance for i, _ in group] == pytest.approx(expected, rel=1e-6)
    assert {i for i, r in verdicts.items() if not r.kept} == set(range(120, 128))


@pytest.mark.parametrize("copies", [33])
def test_a_third_of_a_group_is_copies_of_one_junk_text(spark, copies):
    junk = " ".join(w + "###" for w in prose(0, 70).split())
    data = [(i, prose(i, 60 + i % 50) if i >= copies else junk, "en", "s") for i in range(100)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality.good_documents(docs).collect()} == set(range(copies, 100))


def test_texts_of_partly_duplicate_lines_are_rejected(spark):
    def lined(seed: int) -> str:
        lines = [prose(1000 * seed + i, 12) for i in range(12)]
        return "\n".join(lines + lines[:1] * 8)

    # Eight of twenty lines repeat the first one.
    texts = [prose(i, 60 + i % 50) for i in range(60)] + [lined(i) for i in range(60, 64)]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    verdicts = {r.doc_id: r for r in quality.quality_verdicts(docs).collect()}
    assert not any(r.base_failed for r in verdicts.values())
    assert {i for i, r in verdicts.items() if not r.kept} == set(range(60, len(texts)))


def test_odd_rows(spark):
    docs = odd(spark)
    verdicts = quality.quality_verdicts(docs).collect()
    assert Counter((r.doc_id, *(r[c] for c in COUNTS)) for r in verdicts) == Counter((r[0], *_counts(r[1])) for r in rows())
    good = quality.good_documents(docs)
    assert good.columns == docs.columns
    assert Counter(r.doc_id for r in good.collect()) == Counter(r.doc_id for r in verdicts if r.kept)
    assert quality.quality_verdicts(none(spark)).count() == 0 and quality.good_documents(none(spark)).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    found = op7_quality_rules(spark, sf)
    for r in found.collect():
        assert tuple(r[c] for c in COUNTS) == _counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.kept and r.base_failed)
    judged = found.where("NOT base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    # At this scale many groups have some ten texts only.
    assert share[1] == 1.0 and share[0] < 0.15
