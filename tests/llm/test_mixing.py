"""Budgets down the tree and prefixes of seeded epochs, against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from llm.fixtures import none, odd, rows
from pyspark.sql import functions as F

from millrace.llm.mixing import leaf_budgets, mixture
from millrace.llm.queries import op2_mixing


def _split(budget: int, children: dict) -> dict:
    """Children are name -> (weight, capacity)."""
    left, out = dict(children), {}
    while left:
        rest, weights = budget - sum(out.values()), sum(w for w, _ in left.values())
        full = [k for k, (w, c) in left.items() if c * weights <= w * rest]
        if not full:
            upto = 0
            for k in sorted(left):
                w = left[k][0]
                out[k] = rest * (upto + w) // weights - rest * upto // weights
                upto += w
            break
        for k in full:
            out[k] = left.pop(k)[1]
    return out


def test_shortage_goes_to_siblings_first(spark):
    leaves = [("a", "x", 10), ("a", "y", 1000), ("b", "x", 100), ("b", "y", 1000)]
    frame = spark.createDataFrame(leaves, "_domain string, _lang string, available long")
    weights = {"domain": F.lit(1), "lang": F.lit(1)}

    def budgets(total: int) -> dict:
        return {(r["_domain"], r["_lang"]): r.budget for r in leaf_budgets(frame, weights, F.lit(total), 1).collect()}

    # The want of a/x is met by a/y; b is not touched.
    assert budgets(1000) == {("a", "x"): 10, ("a", "y"): 490, ("b", "x"): 100, ("b", "y"): 400}
    # Only when all of a is short does b get more.
    assert budgets(2050) == {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 100, ("b", "y"): 940}
    assert sum(budgets(9999).values()) == 2110
    assert sum(budgets(7).values()) == 7


def _brute(data, weights, total, epochs, seed):
    leaves = defaultdict(Counter)
    for doc, source, lang, n in data:
        leaves[(source or "", lang or "")][doc] += n
    available = {leaf: sum(docs.values()) for leaf, docs in leaves.items()}
    budgets = {}
    tops = {s for s, _ in leaves}
    top = _split(min(total, epochs * sum(available.values())), {s: (weights.get(s, 1), epochs * sum(a for l, a in available.items() if l[0] == s)) for s in tops})
    for s, b in top.items():
        for l, c in _split(b, {l[1]: (1, epochs * a) for l, a in available.items() if l[0] == s}).items():
            budgets[(s, l)] = c
    want = Counter()
    for leaf, budget in budgets.items():
        if not budget:
            continue
        whole, rest = divmod(budget, available[leaf])
        for doc in leaves[leaf]:
            for e in range(whole):
                want[(doc, e)] += leaves[leaf][doc]
        at = 0
        order = sorted((int(hashlib.md5(f"{seed}:{whole}:{doc}".encode()).hexdigest()[:15], 16), doc) for doc in leaves[leaf])
        for _, doc in order:
            if at < rest:
                want[(doc, whole)] += min(leaves[leaf][doc], rest - at)
            at += leaves[leaf][doc]
    return want


@pytest.mark.parametrize("percent, epochs, buckets", [(50, 1, 4096), (150, 3, 4096), (90, 1, 4)])
def test_mixture_against_brute_force(spark, percent, epochs, buckets):
    data = [(i, "abc"[(i % 9) // 4] if i % 9 else None, "xy"[i % 2], (i * 37) % 50) for i in range(400)]
    # A third of all rows in one leaf.
    data += [(1000 + i, "a", "x", 11) for i in range(200)]
    frame = spark.createDataFrame(data, "doc_id long, source string, lang string, n long")
    weights = {"a": 3, "b": 2}
    path = {"source": F.col("source"), "lang": F.col("lang")}
    weight = F.when(F.col("_source") == "a", 3).when(F.col("_source") == "b", 2).otherwise(1)
    total = sum(r[3] for r in data) * percent // 100
    got = mixture(frame, path, {"source": weight, "lang": F.lit(1)}, F.lit(total), epochs, 5, F.col("n"), buckets)
    found = Counter()
    for r in got.collect():
        found[(r.doc_id, r.epoch)] += r.take_tokens
    expected = _brute(data, weights, total, epochs, 5)
    assert +found == +expected and sum(found.values()) == min(total, epochs * sum(r[3] for r in data))


def _mixed(docs, percent):
    path = {"lang": F.col("lang"), "source": F.col("source")}
    return mixture(docs, path, {"lang": F.lit(1), "source": F.lit(1)}, F.expr(f"available * {percent} div 100"), 2, 1)


def test_odd_rows(spark):
    docs = odd(spark)
    everything = _mixed(docs, 100)
    assert everything.columns == [*docs.drop("epoch").columns, "epoch", "take_tokens"]
    n = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows())
    # Rows of one id are one document to the cut: at most their repeats come on top.
    total = everything.agg(F.sum("take_tokens")).first()[0]
    assert n <= total <= n + 200
    some = _mixed(docs, 40)
    assert 0 < some.agg(F.sum("take_tokens")).first()[0] < total
    assert _mixed(none(spark), 50).count() == 0


def test_query_reaches_its_budget(spark):
    sf = "/root/testdata/sf0.001"
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    n = sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in texts)
    assert op2_mixing(spark, sf).agg(F.sum("take_tokens")).first()[0] == n * 80 // 100
