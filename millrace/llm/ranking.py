"""Quality scores by Bradley-Terry ranking of documents in pairs.

From labelled texts come pairs of which one is preferred. A text's worth is a
weighted sum of its features, and the weights minimise the logistic loss of
the preferred text's worth less the other's. Features are counts and shares of
the text, each cut into bins at quantiles of the labelled texts, so that worth
may rise and fall along each. The threshold is a quantile of worth: the share of
the labelled texts that are not preferred lies below it.

``train`` fits on all labelled texts and on all pairs of two of them. Tasks count
and add whole numbers, so that the order of rows changes nothing; sums of a
size that does not depend on the rows reach the driver.

1. Cuts, medians and the threshold are exact order statistics, found digit by
   digit from counts.
2. In a pair, each text counts by the chance that the pair goes against its label.
   The mean chance over all partners is a smooth function of a text's worth, and
   comes from a histogram of the partners' worths with two moments in each cell.
3. The second derivatives of the loss take the same pairs by coarser cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import shuffles_dropped, stored

# Pairs that ``fit`` draws; ``train`` takes all.
PAIRS = 60_000
QUANTILES = 12
PENALTY = 1e-3
ROUNDS = 25
# The score of a text at the threshold.
AT_THRESHOLD = 0.7
# Worth is counted in whole numbers, UNIT of them for 1, and means in SHARE of them.
UNIT = 1 << 20
SHARE = 1 << 28
# Widths in worth of the cells of a histogram, of the steps of a mean chance, and of the cells of second derivatives.
CELL, STEP, COARSE = UNIT >> 4, UNIT >> 3, UNIT >> 2
# Change of a weight below which the fit has ended.
SETTLED = 1e-5
# Bits that a pass over the rows adds to an order statistic.
DIGIT = 8
# Numbers in a row of a sum, and tasks that add them up.
SLICE, ADDERS = 512, 8

FEATURES = (
    "words", "word_length", "capitals", "digits", "stops", "calls", "bars", "symbols", "other_marks",
    "line_words", "distinct_words", "distinct_growth", "same_as_last", "most_frequent", "distinct_lines", "not_ascii",
)


def _table(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode(), np.uint8)


_CAPITALS, _DIGITS = np.arange(65, 91), np.arange(48, 58)
_STOPS, _CALLS, _BARS, _SYMBOLS, _OTHER = map(_table, (".,;:", "!?", "|", "#*$%&<>=~^_{}[]\\/", "'\"()+-@`"))


def features(text: str | None) -> list[float]:
    """The features of a text, all 0 without words."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n, chars = len(words), sum(map(len, words))
    times: dict[bytes, int] = {}
    for word in words:
        times[word] = times.get(word, 0) + 1
    lines = [line for line in raw.split(b"\n") if line.strip()]

    def share(of: np.ndarray) -> float:
        return float(counts[of].sum()) / chars

    return [
        np.log(n),
        chars / n,
        share(_CAPITALS),
        share(_DIGITS),
        share(_STOPS),
        share(_CALLS),
        share(_BARS),
        share(_SYMBOLS),
        share(_OTHER),
        np.log(n / len(lines)),
        len(times) / n,
        np.log(len(times)) / np.log(n + 1),
        sum(map(bytes.__eq__, words, words[1:])) / n,
        max(times.values()) / n,
        len(set(lines)) / len(lines),
        float(counts[128:].sum()) / chars,
    ]


@dataclass(frozen=True)
class Ranking:
    """Cuts of each feature into bins, the weight of each bin, the threshold of worth and its scale."""

    cuts: list[np.ndarray]
    weights: np.ndarray
    threshold: float
    scale: float

    def worth(self, values: np.ndarray) -> np.ndarray:
        return _binned(values, self.cuts) @ self.weights

    def score(self, values: np.ndarray) -> np.ndarray:
        """Between 0 and 1; ``AT_THRESHOLD`` at the threshold."""
        at = np.log(AT_THRESHOLD / (1 - AT_THRESHOLD))
        return 1 / (1 + np.exp(-np.clip((self.worth(values) - self.threshold) / self.scale, -30, 30) - at))


def _binned(values: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    columns = []
    for i, own in enumerate(cuts):
        columns.append(np.eye(len(own) + 1)[np.searchsorted(own, values[:, i], side="left")])
    return np.hstack(columns)


def _undecided() -> Ranking:
    return Ranking([np.empty(0)] * len(FEATURES), np.zeros(len(FEATURES)), np.log(AT_THRESHOLD / (1 - AT_THRESHOLD)), 1.0)


def fit(values: np.ndarray, preferred: np.ndarray, share: float, seed: int = 0) -> Ranking:
    """Weights for rows in memory, from ``PAIRS`` seeded pairs of one preferred and one other; ``share`` of all texts is not preferred.

    With rows of one label only there is no pair, and all texts score 0.5.
    """
    good, bad = values[preferred], values[~preferred]
    if not len(good) or not len(bad):
        return _undecided()
    points = np.linspace(0, 1, QUANTILES + 1)[1:-1]
    # Of each label, so that a rare one has cuts too; a cut lies at a value, and bins hold their upper end.
    cuts = [np.unique(np.concatenate([np.quantile(side[:, i], points, method="lower") for side in (good, bad)])) for i in range(values.shape[1])]
    rng = np.random.default_rng(seed)
    better, worse = _binned(good, cuts), _binned(bad, cuts)
    differences = better[rng.integers(0, len(better), PAIRS)] - worse[rng.integers(0, len(worse), PAIRS)]
    weights = np.zeros(differences.shape[1])
    for _ in range(ROUNDS):
        chance = 1 / (1 + np.exp(-differences @ weights))
        slope = differences.T @ (chance - 1) / PAIRS + PENALTY * weights
        curve = (differences * (chance * (1 - chance))[:, None]).T @ differences / PAIRS
        step = np.linalg.solve(curve + PENALTY * np.eye(len(weights)), slope)
        weights = weights - step
        if np.abs(step).max() < 1e-6:
            break
    worths = np.concatenate([better @ weights, worse @ weights])
    mass = np.concatenate([np.full(len(better), (1 - share) / len(better)), np.full(len(worse), share / len(worse))])
    order = np.argsort(worths, kind="stable")
    worths, below = worths[order], np.cumsum(mass[order])
    at = min(max(int(np.searchsorted(below, share - 1e-9)), 0), len(worths) - 2)
    # The quantile lies between two texts: in the middle.
    threshold = (worths[at] + worths[at + 1]) / 2
    scale = max(float(np.median(better @ weights) - np.median(worse @ weights)) / 8, 1e-9)
    return Ranking(cuts, weights, float(threshold), scale)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [features(t) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["doc_id", "x"])


def _matrix(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, -1)


def _labels(batch: pa.RecordBatch) -> np.ndarray:
    """1 for a preferred row, else 0."""
    return batch.column("good").to_numpy(zero_copy_only=False).astype(np.int64)


def _summed(rows: DataFrame, count: Callable[[pa.RecordBatch], np.ndarray]) -> np.ndarray:
    """The sum over all batches of the whole numbers that ``count`` gives, flat; tasks add them up by slices."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = count(batch).ravel()
                total = own if total is None else total + own
        if total is not None:
            parts = [total[at : at + SLICE].tobytes() for at in range(0, len(total), SLICE)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["place", "part"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = np.frombuffer(part, np.int64)
                totals[place] = totals[place] + own if place in totals else own
        parts = [total.tobytes() for total in totals.values()]
        yield pa.RecordBatch.from_arrays([pa.array(totals, pa.int32()), pa.array(parts, pa.binary())], names=["place", "part"])

    schema = "place int, part binary"
    sums = rows.mapInArrow(counted, schema).repartition(ADDERS, "place").mapInArrow(added, schema)
    with shuffles_dropped(rows.sparkSession):
        found = sorted(sums.collect())
    return np.concatenate([np.frombuffer(row["part"], np.int64) for row in found])


def _select(
    rows: DataFrame, keys: Callable[[pa.RecordBatch], np.ndarray], bits: int, searches: list[tuple[int, float, float, float]]
) -> tuple[list[int], np.ndarray]:
    """Of each search the least key of its column up to which the rows have its mass, and the rows below that key by label.

    A search is a column of ``keys``, whose values have ``bits`` bits, the mass of a
    row that is not preferred and of one that is, and the mass asked for.
    """
    found = [0] * len(searches)
    below = np.zeros((len(searches), 2), np.int64)
    masses, wanted = np.array([s[1:3] for s in searches]), np.array([s[3] for s in searches])
    for shift in range((bits - 1) // DIGIT * DIGIT, -1, -DIGIT):
        groups = sorted({(search[0], start) for search, start in zip(searches, found, strict=True)})
        columns = {c: np.array([start for own, start in groups if own == c], np.uint64) for c, _ in groups}

        def count(batch: pa.RecordBatch, shift=shift, groups=groups, columns=columns) -> np.ndarray:
            all_keys, labels, at = keys(batch), _labels(batch), 0
            counts = np.zeros((len(groups), 2 << DIGIT), np.int64)
            for column, starts in columns.items():
                own = all_keys[:, column].astype(np.uint64)
                high = own >> np.uint64(shift + DIGIT) if shift + DIGIT < 64 else np.zeros_like(own)
                group = np.minimum(np.searchsorted(starts, high), len(starts) - 1)
                digit = (own >> np.uint64(shift)).astype(np.int64) & ((1 << DIGIT) - 1)
                place = ((group * 2 + labels << DIGIT) + digit)[starts[group] == high]
                counts[at : at + len(starts)] += np.bincount(place, minlength=len(starts) * 2 << DIGIT).reshape(len(starts), -1)
                at += len(starts)
            return counts

        counts = _summed(rows, count).reshape(len(groups), 2, -1).cumsum(axis=2)
        places = {group: i for i, group in enumerate(groups)}
        for i, search in enumerate(searches):
            reached = below[i][:, None] + counts[places[search[0], found[i]]]
            digit = int(np.argmax(masses[i] @ reached >= wanted[i]))
            if digit:
                below[i] = reached[:, digit - 1]
            found[i] = found[i] << DIGIT | digit
    return found, below


def _cuts(rows: DataFrame, sizes: tuple[int, int]) -> list[np.ndarray]:
    """Cuts of each feature at quantiles of all rows, of each label, so that a rare one has cuts too."""
    points = np.linspace(0, 1, QUANTILES + 1)[1:-1]
    searches = [
        (i, 1 - label, label, int(rank) + 1)
        for i in range(len(FEATURES))
        for label, size in enumerate(sizes)
        for rank in np.floor((size - 1) * points)
    ]
    # Features are not negative, so that their bits are in the order of their values.
    found, _ = _select(rows, lambda batch: _matrix(batch, "x").view(np.uint64), 64, searches)
    values = np.array(found, np.uint64).view(np.float64).reshape(len(FEATURES), -1)
    # A cut lies at a value, and bins hold their upper end.
    return [np.unique(own) for own in values]


def _coded(cuts: list[np.ndarray]):
    """The places of a row's bins among all weights."""
    starts = np.cumsum([0] + [len(own) + 1 for own in cuts[:-1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = _matrix(batch, "x")
            codes = [start + np.searchsorted(own, values[:, i], side="left") for i, (start, own) in enumerate(zip(starts, cuts, strict=True))]
            codes = np.stack(codes, axis=1).astype(np.int16)
            ends = np.arange(0, codes.size + 1, len(cuts), dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("good"), pa.ListArray.from_arrays(ends, codes.ravel())], names=["good", "codes"])

    return run


def _worths(weights: np.ndarray, cuts: list[np.ndarray]) -> tuple[Callable[[pa.RecordBatch], np.ndarray], int, int]:
    """Worths of a batch's rows above the least that is possible, that least one, and the most above it."""
    bins = np.split(weights, np.cumsum([len(own) + 1 for own in cuts[:-1]]))
    low, high = (int(sum(end(own) for own in bins)) for end in (np.min, np.max))
    return lambda batch: weights[_matrix(batch, "codes")].sum(axis=1) - low, low, high - low


def _mean_chance(moments: np.ndarray, size: int, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The mean chance that a row of the histogram beats one whose worth is at a point, and its slope."""
    some = np.flatnonzero(moments[0])
    n, first, second = (m[some] / size / UNIT**k for k, m in enumerate(moments))
    chance = 1 / (1 + np.exp(points[:, None] - (some + 0.5)[None, :] * (CELL / UNIT)))
    curve = chance * (1 - chance)
    bend = curve * (1 - 2 * chance)
    mean = chance @ n + curve @ first + bend @ second / 2
    return mean, -(curve @ n + bend @ first + (curve * (1 - 6 * curve)) @ second / 2)


def _between(worths: np.ndarray, values: np.ndarray, slopes: np.ndarray) -> np.ndarray:
    """The cubic through values and slopes that are ``STEP`` apart."""
    at, t = worths // STEP, worths % STEP / STEP
    rise = slopes * (STEP / UNIT)
    left = values[at] * (1 + 2 * t) + rise[at] * t
    right = values[at + 1] * (3 - 2 * t) + rise[at + 1] * (t - 1)
    return left * (1 - t) ** 2 + right * t**2


def _step(codes: DataFrame, cuts: list[np.ndarray], weights: np.ndarray, sizes: tuple[int, int]) -> np.ndarray:
    """Newton's step of the mean loss over all pairs of one row of each label."""
    worths, _, most = _worths(weights, cuts)
    cells, width = most // CELL + 1, len(weights)

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        own = worths(batch)
        place, off = _labels(batch) * cells + own // CELL, own % CELL - CELL // 2
        return np.stack([np.bincount(place, off**k, 2 * cells) for k in range(3)]).astype(np.int64)

    found = _summed(codes, moments).reshape(3, 2, cells).swapaxes(0, 1)
    points = np.arange(most // STEP + 2) * (STEP / UNIT)
    # A preferred row's pair goes against it where the other one beats it; another row's, where a preferred one does not beat it.
    mean, slope = _mean_chance(found[0], sizes[0], points)
    beaten, fall = _mean_chance(found[1], sizes[1], points)
    against = ((1 - beaten, -fall), (mean, slope))

    coarse = most // COARSE + 1
    counts = [np.add.reduceat(own[0], np.arange(0, cells, COARSE // CELL)) for own in found]
    apart = (np.arange(coarse)[:, None] - np.arange(coarse)[None, :]) * (COARSE / UNIT)
    curve = 1 / (2 + 2 * np.cosh(np.minimum(np.abs(apart), 500)))
    # Of each label by cell, in proportion to one row of the rarer label.
    shares = [np.rint(curve @ counts[1 - k] / sizes[1 - k] * (min(sizes) / sizes[k]) * SHARE) for k in range(2)]

    def slopes(batch: pa.RecordBatch) -> np.ndarray:
        labels, places, own = _labels(batch), _matrix(batch, "codes").astype(np.int64), worths(batch)
        cell = own // COARSE
        chance = np.rint(SHARE * np.where(labels == 1, _between(own, *against[1]), _between(own, *against[0])))
        spread = (labels * width)[:, None] + places
        first = np.bincount(spread.ravel(), np.repeat(chance, len(cuts)), 2 * width)
        held = ((labels * coarse + cell) * width)[:, None] + places
        bins = np.zeros((len(own), width))
        np.put_along_axis(bins, places, 1.0, axis=1)
        # Whole numbers below 2^53 are added without rounding.
        square = (bins * np.where(labels == 1, shares[1][cell], shares[0][cell])[:, None]).T @ bins
        return np.concatenate([first, np.bincount(held.ravel(), minlength=2 * coarse * width), square.ravel()]).astype(np.int64)

    sums = _summed(codes, slopes)
    first, held, square = np.split(sums, [2 * width, 2 * width * (coarse + 1)])
    worse, better = first.reshape(2, width) / SHARE
    slope = worse / sizes[0] - better / sizes[1] + PENALTY * weights / UNIT
    bad, good = held.reshape(2, coarse, width).astype(float)
    cross = (good / sizes[1]).T @ curve @ (bad / sizes[0])
    square = square.reshape(width, width) / SHARE / min(sizes) - cross - cross.T
    return np.linalg.solve(square + PENALTY * np.eye(width), slope)


def _equal(codes: DataFrame, worths: Callable[[pa.RecordBatch], np.ndarray], worth: int) -> np.ndarray:
    """Rows of that worth by label."""
    return _summed(codes, lambda batch: np.bincount(_labels(batch)[worths(batch) == worth], minlength=2))


def train(docs: DataFrame, labels: DataFrame) -> Ranking:
    """A ranking from all ``labels``, whose column ``good`` says whether a document is preferred.

    Labels without an id or a verdict are left out; a document with both
    verdicts gives a text to each side. Documents without a row are no part of it.
    With texts of one label only there is no pair, and all texts score 0.5.
    """
    labels = labels.where("doc_id IS NOT NULL AND good IS NOT NULL").select("doc_id", "good").distinct()
    given = {row["good"]: row["count"] for row in labels.groupBy("good").count().collect()}
    # Features are joined, not texts.
    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows = rows.mapInArrow(_features, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, x array<double>")
    rows = stored(rows.join(labels, "doc_id").select("good", "x"))
    known = {row["good"]: row["count"] for row in rows.groupBy("good").count().collect()}
    if len(known) < 2:
        return _undecided()
    sizes = known[False], known[True]
    cuts = _cuts(rows, sizes)
    codes = stored(rows.mapInArrow(_coded(cuts), "good boolean, codes array<short>"))
    weights = np.zeros(sum(len(own) + 1 for own in cuts), np.int64)
    for _ in range(ROUNDS):
        step = _step(codes, cuts, weights, sizes)
        weights = weights - np.rint(step * UNIT).astype(np.int64)
        if np.abs(step).max() < SETTLED:
            break
    worths, low, most = _worths(weights, cuts)

    def select(*searches: tuple[float, float, float]) -> tuple[list[int], np.ndarray]:
        return _select(codes, lambda batch: worths(batch)[:, None], max(most.bit_length(), 1), [(0, *s) for s in searches])

    share = given[False] / (given[False] + given[True])
    # Of rows of equal worth the preferred come first.
    bad, good = share / sizes[0], (1 - share) / sizes[1]
    middles = [(1 - k, k, rank) for k in range(2) for rank in ((sizes[k] + 1) // 2, sizes[k] // 2 + 1)]
    (at, *halves), below = select((bad, good, share - 1e-9), *middles)
    equal = _equal(codes, worths, at)
    missing = share - 1e-9 - below[0] @ (bad, good)
    ahead = np.ceil(missing / good)
    if ahead > equal[1]:
        ahead = equal[1] + np.ceil((missing - equal[1] * good) / bad)
    rank = int(min(below[0].sum() + min(max(ahead, 1), equal.sum()), sum(sizes) - 1))
    # The quantile lies between two texts: in the middle.
    between, _ = select((1, 1, rank), (1, 1, rank + 1))
    scale = (sum(halves[2:]) - sum(halves[:2])) / 2 / UNIT / 8
    return Ranking(cuts, weights / UNIT, (low + sum(between) / 2) / UNIT, max(scale, 1e-9))


def scored(docs: DataFrame, ranking: Ranking) -> DataFrame:
    """``docs`` without ``text`` and with ``score``, from the text alone.

    A null or empty text has the features of no words and the score these get.
    Repeated rows are scored each; a column ``score`` is replaced.
    """
    docs = docs.drop("score")
    others = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([features(t) for t in batch.column(len(others)).to_pylist()]).reshape(-1, len(FEATURES))
            scores = pa.array(ranking.score(values), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], names=[*others, "score"])

    rows = docs.select(*others, "text")
    return rows.mapInArrow(run, rows.drop("text").withColumn("score", F.lit(0.0)).schema)
