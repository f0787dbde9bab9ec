"""Near-duplicates against all pairs."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from llm.fixtures import none, odd, prose, rows

from millrace.llm import near_dedup
from millrace.llm.near_dedup import components, near_duplicates, shingle_hashes, without_near_duplicates


def _set(text: str | None, size: int) -> frozenset:
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def _brute(texts: dict, size: int, percent: int) -> dict:
    sets, label = {i: _set(t, size) for i, t in texts.items()}, {i: i for i in texts}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in texts:
        for j in texts:
            if i < j and sets[i] and sets[j]:
                common = len(sets[i] & sets[j])
                if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                    a, b = top(i), top(j)
                    label[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), top(i)) for i in texts}


def _found(df) -> dict:
    out = {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}
    assert all(r.kept == (r.doc_id == r.component_id) for r in df.collect())
    return out


def _edited(rng: random.Random, words: list[str], n: int) -> list[str]:
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randrange(10**6)}"
    return words


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_components_against_all_pairs(spark, size, percent):
    rng = random.Random(size)
    texts = {}

    def add(words):
        texts[len(texts)] = " ".join(words)

    # A chain of edits, of which far ends are not alike, and a star of edits about the threshold.
    words = prose(1, 150).split()
    for _ in range(25):
        add(words)
        words = _edited(rng, words, 2)
    star = prose(2, 200).split()
    for _ in range(40):
        add(_edited(rng, star, rng.randrange(1, 7)))
    # Exact copies, copies in another case and spacing, unrelated and short texts.
    for i in range(30):
        add(star if i % 3 else [w.upper() for w in star])
    for i in range(30):
        add(prose(100 + i, 60).split())
    for text in ("a", "a", "a b", "A  b", "", " ", "x y z w v"):
        texts[len(texts)] = text
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    assert _found(near_duplicates(frame, size, percent)) == _brute(texts, size, percent)


def test_a_large_group_of_near_copies_keeps_its_links(spark):
    rng = random.Random(5)
    base = prose(9, 120).split()
    texts = {i: " ".join(_edited(rng, base, rng.randrange(0, 5))) for i in range(300)}
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert _found(near_duplicates(frame, 3, 85)) == _brute(texts, 3, 85)


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(3)
    common = rng.integers(0, 1 << 63, 800, dtype=np.uint64)
    for share in (0, 200, 600):
        a, b = (np.unique(np.concatenate([common, rng.integers(0, 1 << 63, share, dtype=np.uint64)])) for _ in range(2))
        x, y = near_dedup._signature(a)[1].view(np.uint8), near_dedup._signature(b)[1].view(np.uint8)
        bits = np.unpackbits(x ^ y, bitorder="little").reshape(-1, near_dedup.BITS)
        chance = 0.5**near_dedup.BITS
        estimate = ((~bits.any(axis=1)).mean() - chance) / (1 - chance)
        assert abs(estimate - 800 / (800 + 2 * share)) < 0.2


def test_short_texts_are_unlike_full_shingles():
    assert len(shingle_hashes("a b", 3)) == 1
    assert shingle_hashes("a b", 3)[0] not in shingle_hashes("a b c d", 3)
    assert len(shingle_hashes("a b a b a b", 2)) == 2


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200)
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 150)] + [(180, 199)], "a long, b long")
    found = {r.id: r.component for r in components(nodes, links).collect()}
    assert found == {i: 0 if i <= 150 else 180 if i == 199 else i for i in range(200)}
    assert components(nodes, links.limit(0)).where("id != component").count() == 0


def test_odd_rows(spark):
    docs = odd(spark)
    found = _found(near_duplicates(docs))
    assert found.keys() == {r[0] for r in rows() if r[0] is not None}
    assert found[24] == (0, 24) and found[25] == (0, 25)
    assert found[32][1] == found[33][1] == found[34][1] == 3
    kept = without_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    # The other text of the id 2 stays as well.
    assert sorted(i for i in ids if i is not None) == sorted([2, *(i for i, (_, c) in found.items() if i == c)]) and ids.count(None) == 1
    assert near_duplicates(none(spark)).count() == 0 and without_near_duplicates(none(spark)).count() == 0


def test_no_link_between_short_texts_is_lost(spark):
    # Four of five shingles in common are 80 percent.
    data = [(2 * i + j, " ".join(f"{i}x{k}" for k in range(9 - j))) for i in range(1000) for j in (0, 1)]
    found = near_dedup.near_duplicates(spark.createDataFrame(data, "doc_id long, text string")).collect()
    assert [r.doc_id for r in found if r.component_id != r.doc_id // 2 * 2] == []


def test_signature_bits_are_independent_by_permutation():
    rng = np.random.default_rng(5)
    lost = 0
    for _ in range(1500):
        shingles = np.sort(rng.integers(0, 1 << 63, 5, dtype=np.uint64))
        a, b = (near_dedup._signature(s)[1].view(np.uint64) for s in (shingles, shingles[1:]))
        x = a ^ b
        differ = int(np.bitwise_count((x | (x >> np.uint64(1))) & np.uint64(0x5555555555555555)).sum())
        chance = 0.5**near_dedup.BITS
        lost += ((1 - differ / near_dedup.PERMUTATIONS) - chance) / (1 - chance) < near_dedup._least_estimate(0.8)
    assert lost <= 1


def test_rows_are_compared_by_text_whatever_their_ids(spark):
    """Different texts of one id all stay; copies go, also those without an id or of the same id."""
    rows = [(1, prose(i, 70)) for i in range(12)] + [(None, prose(i, 70) + " end") for i in range(3)]
    rows += [(None, prose(50, 60)), (None, prose(50, 60)), (2, prose(50, 60)), (3, None), (None, ""), (None, None), (9, prose(60, 90)), (9, prose(60, 90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(map(tuple, without_near_duplicates(docs).collect()), key=str)
    expected = [(1, prose(i, 70)) for i in range(12)] + [(2, prose(50, 60)), (3, None), (None, ""), (None, None), (9, prose(60, 90))]
    assert kept == sorted(expected, key=str)
