"""Mixing sources to target weights: budgets down a tree of domains, languages and sources.

A budget of tokens is divided at each node among its children by weight. A
child that has too little, all its epochs together, gets what it has, and the
rest is divided among its siblings again; only what no sibling can take is
missing at the parent and goes to the parent's siblings. With capacities summed
upwards first, one division a level from the root down does exactly this.

Each leaf then takes a prefix of the tokens of its seeded epochs: each epoch is
a shuffle of its own, all but the last are whole, and the last is cut at the
token where the budget is reached. The place of the cut is found in two steps,
over counts in buckets of the shuffle and then within the one bucket of the cut,
so that no leaf is ever sorted in one task. Everything is built-in expressions
over whole numbers.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import WORD, seeded, stored

LEVELS = ("domain", "lang", "source")
BUCKETS = 1 << 12
_HASHES = 1 << 60


def n_words(text: Column) -> Column:
    """Words of a text as its tokens; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _path(levels: Sequence[str]) -> list[str]:
    return [f"_{level}" for level in levels]


def _exact(column: str) -> Column:
    """A column for products beyond 64 bits."""
    return F.col(column).cast("decimal(19,0)")


def _divided(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``budget`` of each node from ``parent_budget``, its ``weight`` and its ``capacity``.

    In the order of capacity to weight a node is full if its share of what the
    ones before it left is at least its capacity; the rest is dealt to the
    others by weight, cut at whole tokens so that nothing is lost.
    """
    group = Window.partitionBy(*parent)
    order = group.orderBy((F.col("capacity") / F.col("weight")), name)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    nodes = nodes.withColumns(
        {
            "_left": F.col("parent_budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0)),
            "_weights": F.sum("weight").over(group) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
        }
    )
    full = _exact("capacity") * _exact("_weights") <= _exact("weight") * _exact("_left")
    nodes = nodes.withColumn("_full", full)
    taken = F.sum(F.when(F.col("_full"), F.col("capacity")).otherwise(0)).over(group)
    nodes = nodes.withColumns(
        {
            "_rest": F.col("parent_budget") - taken,
            "_open": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(group),
            "_upto": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("weight"))).over(
                group.orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
            ),
        }
    ).withColumn("_from", F.col("_upto") - F.col("weight"))
    # A share may not pass the capacity: shares are cut down to whole tokens, at either end of the node's part.
    part = F.expr(
        "CAST((CAST(_rest AS DECIMAL(19,0)) * CAST(_upto AS DECIMAL(19,0))) DIV _open AS BIGINT)"
        " - CAST((CAST(_rest AS DECIMAL(19,0)) * CAST(_from AS DECIMAL(19,0))) DIV _open AS BIGINT)"
    )
    budget = F.when(F.col("_full"), F.col("capacity")).otherwise(part)
    return nodes.withColumn("budget", budget).drop("_left", "_weights", "_full", "_rest", "_open", "_upto", "_from")


def leaf_budgets(leaves: DataFrame, weights: dict[str, Column], budget: Column, epochs: int) -> DataFrame:
    """The ``budget`` of each leaf of ``leaves``, which holds the path columns and ``available`` tokens.

    ``weights`` gives the weight of a node of each level, a positive whole
    number, by the columns of its path. The root's budget is ``budget`` (of the
    column ``available``, summed over all leaves), or all capacity if that is less.
    """
    levels = list(weights)
    leaves = leaves.withColumn("capacity", F.col("available") * epochs).withColumn("_root", F.lit(0))
    root = leaves.groupBy("_root").agg(F.sum("available").alias("available"), F.sum("capacity").alias("_most"))
    parents = root.select("_root", F.least(budget.cast("long"), "_most").alias("parent_budget"))
    for depth, level in enumerate(levels):
        up = ["_root", *_path(levels[:depth])]
        path = [*up, f"_{level}"]
        nodes = leaves.groupBy(*path).agg(F.sum("capacity").alias("capacity"))
        nodes = nodes.withColumn("weight", weights[level].cast("long")).join(parents, up)
        nodes = _divided(nodes, up, path[-1])
        parents = nodes.select(*path, F.col("budget").alias("parent_budget"))
    return leaves.join(parents.withColumnRenamed("parent_budget", "budget"), ["_root", *_path(levels)]).drop("_root")


def mixture(
    docs: DataFrame,
    path: dict[str, Column],
    weights: dict[str, Column],
    budget: Column,
    epochs: int = 1,
    seed: int = 0,
    tokens: Column | None = None,
    buckets: int = BUCKETS,
) -> DataFrame:
    """``docs`` with ``epoch`` and ``take_tokens``: a row for each epoch in which a document is taken.

    ``path`` gives a row's node at each level, the last one its leaf; a null is
    the node of the empty name. ``take_tokens`` is ``tokens`` (words, by
    default) but for the document that a leaf's budget ends in. A document
    without tokens is in each whole epoch and, in the last, if it lies before
    the cut. Rows of the same leaf and id stand and fall together; of those at
    the cut, each takes its tokens while the budget lasts, as if they were one
    document, and so may pass it by their repeats. Columns of ``docs`` stay;
    ``epoch`` and ``take_tokens`` replace theirs. An empty table gives an empty result.
    """
    levels = list(path)
    leaf = _path(levels)
    tokens = n_words(F.col("text")) if tokens is None else tokens
    named = docs.drop("epoch", "take_tokens").withColumns(
        {f"_{level}": F.coalesce(c.cast("string"), F.lit("")) for level, c in path.items()}
    )
    # The same row again in the narrow table and in the documents: nothing wide is stored or shuffled.
    narrow = stored(named.select("doc_id", *leaf, tokens.alias("_tokens")))
    available = stored(narrow.groupBy(*leaf).agg(F.sum("_tokens").alias("available")))
    plan = stored(
        leaf_budgets(available, weights, budget, epochs)
        .where("budget > 0")
        .withColumn("_whole", F.expr("budget div available"))
        .withColumn("_rest", F.expr("budget % available"))
        .select(*leaf, "_whole", "_rest")
    )

    def shuffled(epoch: Column) -> Column:
        return seeded(seed, epoch, F.col("doc_id"))

    place = {"_hash": shuffled(F.col("_whole"))}
    last = narrow.join(plan, leaf).withColumns(place).withColumn("_bucket", F.floor(F.col("_hash") / (_HASHES // buckets)))
    counts = last.groupBy(*leaf, "_bucket").agg(F.sum("_tokens").alias("_n"))
    before = Window.partitionBy(*leaf).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cut = counts.join(plan.drop("_whole"), leaf).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    cut = stored(cut.where("_before < _rest AND _rest <= _before + _n").select(*leaf, "_bucket", "_before"))
    within = last.join(cut, [*leaf, "_bucket"]).groupBy(*leaf, "_rest", "_before", "_hash", "doc_id").agg(F.sum("_tokens").alias("_n"))
    order = Window.partitionBy(*leaf).orderBy("_hash", F.col("doc_id").asc_nulls_first())
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    within = within.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    edge = within.where("_before < _rest AND _rest <= _before + _n").select(
        *leaf, F.col("_hash").alias("_cut_hash"), F.col("doc_id").alias("_cut_id"), (F.col("_rest") - F.col("_before")).alias("_cut_tokens")
    )
    # One row a leaf: stored, so that it is broadcast only if its files are small.
    plan = stored(plan.join(edge, leaf, "left"))
    rows = named.join(plan, leaf).withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_whole"))))
    here = shuffled(F.col("_whole"))
    same = (here == F.col("_cut_hash")) & F.col("doc_id").eqNullSafe(F.col("_cut_id"))
    earlier = (here < F.col("_cut_hash")) | (
        (here == F.col("_cut_hash")) & F.coalesce(F.col("doc_id") < F.col("_cut_id"), F.col("doc_id").isNull() & F.col("_cut_id").isNotNull())
    )
    taken = (F.col("epoch") < F.col("_whole")) | F.coalesce(earlier | same, F.lit(False))
    cut_short = (F.col("epoch") == F.col("_whole")) & F.coalesce(same, F.lit(False))
    take = F.when(cut_short, F.least(tokens, F.col("_cut_tokens"))).otherwise(tokens)
    return rows.where(taken).select(*docs.drop("epoch", "take_tokens").columns, "epoch", take.alias("take_tokens"))
