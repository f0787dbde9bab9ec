"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Each text gets a vector of transformed statistics. For each language and source
the minimum-covariance-determinant estimate of centre and spread comes from
concentration steps: distances by the last estimate, the half with the smallest
ones, the moments of that half. A text is rejected when its Mahalanobis
distance by the last estimate is beyond the limit.

Everything is built-in expressions. A step is one aggregation of moments by
group and bin of distance, pre-aggregated in each task, so that a group of any
size is a few rows of sums. Vectors are fixed-point integers, whose sums do not
depend on the order of rows: the same rows give the same verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import SPACES, let, stored

# Fixed values of the contract: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANK = " \t\n\x0b\x0c\r"

SCALE = 256
# Least standard deviation of each statistic: a smaller spread is no evidence. Texts of which
# a third are duplicate lines and a quarter repeated words at once are labelled good.
STATISTICS = {
    "word_length": 0.05,
    "symbols": 0.025,
    "duplicate_lines": 0.18,
    "repeats": 0.18,
    "capitals": 0.05,
}
# Squared distance beyond which a text is rejected, the 0.999 quantile of chi-square in five
# dimensions, and the share of a group that is its core: the half, so that junk of up to some 40 percent of a group stays outside.
LIMIT = 20.515
CORE = 0.5
# The covariance of the core times this is that of a normal population in five dimensions.
CONSISTENCY = 1.91
STEPS = 4
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Texts of more words sort pairs in place of packed integers to find repeated windows.
PACKED_WORDS = 1 << 24
BINS_AN_OCTAVE = 8


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def _duplicate_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(rf"[^{SPACES}]"))
    hashes = F.transform(lines, lambda line: F.xxhash64(line))
    return let(hashes, lambda h: F.size(h) - F.size(F.array_distinct(h)))


def _covered(places: Column, size: int) -> Column:
    """Words in windows of ``size`` that begin at the ascending ``places``."""
    spans = F.transform(places, lambda p, k: F.least(F.lit(size), F.coalesce(F.get(places, k + 1) - p, F.lit(size))))
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s)


def _repeat_words(words: Column, size: int = 3, packed_words: int = PACKED_WORDS) -> Column:
    """Words in windows of ``size`` words that the text holds at least twice."""

    def count(w: Column) -> Column:
        windows = F.transform(
            F.sequence(F.lit(0), F.size(w) - size), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(size)))
        )
        return let(windows, lambda h: F.when(F.size(w) < packed_words, packed(h)).otherwise(paired(h)))

    def packed(h: Column) -> Column:
        # The upper bits of a window's hash above its place: equal windows are neighbours when sorted.
        low = (1 << 24) - 1
        keys = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long"))))

        def place(x: Column) -> Column:
            return x.bitwiseAND(F.lit(low)).cast("int")

        def same(x: Column, y: Column) -> Column:
            near = x.bitwiseXOR(y).bitwiseAND(F.lit(~low)) == 0
            return F.coalesce(near & (F.get(h, place(x)) == F.get(h, place(y))), F.lit(False))

        def repeated(k: Column) -> Column:
            twice = F.filter(k, lambda x, i: same(x, F.get(k, i - 1)) | same(x, F.get(k, i + 1)))
            return let(F.sort_array(F.transform(twice, lambda x: place(x).cast("long"))), lambda p: _covered(p, size))

        return let(keys, repeated)

    def paired(h: Column) -> Column:
        keys = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.cast("long").alias("i"))))

        def repeated(k: Column) -> Column:
            def hash_at(i: Column) -> Column:
                return F.get(k, i)["h"]

            twice = F.filter(
                k, lambda x, i: F.coalesce(x["h"] == hash_at(i - 1), F.lit(False)) | F.coalesce(x["h"] == hash_at(i + 1), F.lit(False))
            )
            return let(F.sort_array(F.transform(twice, lambda x: x["i"])), lambda p: _covered(p, size))

        return let(keys, repeated)

    return let(words, lambda w: F.when(F.size(w) < size, F.lit(0).cast("long")).otherwise(count(w)))


def text_statistics(text: Column) -> dict[str, Column]:
    """Counts of a text; a null text counts as an empty one, all of whose counts are 0."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, f"[{SPACES}]+"), "")
    counted = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    return {
        "_words": counted,
        "word_chars": _without(text, _BLANK).cast("long"),
        "n_symbols": (F.length(text) - _without(text, SYMBOLS)).cast("long"),
        "n_dup_lines": _duplicate_lines(text).cast("long"),
        "_lines": (F.length(text) - _without(text, "\n") + 1).cast("long"),
        "_capitals": (F.length(text) - _without(text, _UPPER)).cast("long"),
    }


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words`` and ``base_failed``."""
    rows = docs.withColumns(text_statistics(F.col(text)))
    rows = rows.withColumns({"n_words": F.col("_words")["n_words"], "n_repeat_words": F.col("_words")["n_repeat_words"]})
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed).drop("_words")


def _vector() -> list[Column]:
    """The transformed statistics as fixed-point longs, 0 for texts without words."""

    def share(part: str, whole: str) -> Column:
        return F.sqrt(F.least(F.lit(1.0), F.coalesce(F.try_divide(F.col(part), F.col(whole)), F.lit(0.0))))

    values = {
        "word_length": F.log(F.greatest(F.lit(1.0), F.coalesce(F.try_divide("word_chars", "n_words"), F.lit(1.0)))),
        "symbols": share("n_symbols", "word_chars"),
        "duplicate_lines": share("n_dup_lines", "_lines"),
        "repeats": share("n_repeat_words", "n_words"),
        "capitals": share("_capitals", "word_chars"),
    }
    return [F.round(values[name] * SCALE).cast("long").alias(f"_x{i}") for i, name in enumerate(STATISTICS)]


_N = len(STATISTICS)
_GROUP = ["_lang", "_source"]
_ESTIMATE = [*(f"_m{i}" for i in range(_N)), *(f"_w{i}_{j}" for i in range(_N) for j in range(i + 1))]


def _whitened(groups: DataFrame, mean: list[Column], covariance: dict[tuple[int, int], Column]) -> DataFrame:
    """Centre and inverse Cholesky factor of each group's covariance, with the least spread added to its diagonal."""
    out = groups.select(
        *_GROUP,
        *(c.alias(f"_m{i}") for i, c in enumerate(mean)),
        *((c + (least * SCALE) ** 2 * (i == j)).alias(f"_c{i}_{j}") for (i, j), c in covariance.items() for least in [list(STATISTICS.values())[i]]),
    )
    col = F.col
    for i in range(_N):
        for j in range(i + 1):
            rest = col(f"_c{i}_{j}")
            for k in range(j):
                rest = rest - col(f"_l{i}_{k}") * col(f"_l{j}_{k}")
            out = out.withColumn(f"_l{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-6))) if i == j else rest / col(f"_l{j}_{j}"))
    for i in range(_N):
        for j in range(i + 1):
            if i == j:
                value = 1 / col(f"_l{i}_{i}")
            else:
                value = F.lit(0.0)
                for k in range(j, i):
                    value = value - col(f"_l{i}_{k}") * col(f"_w{k}_{j}")
                value = value / col(f"_l{i}_{i}")
            out = out.withColumn(f"_w{i}_{j}", value)
    return stored(out.select(*_GROUP, *_ESTIMATE))


def _start(rows: DataFrame) -> DataFrame:
    """Medians, and half the distance of the outer sixths as the spread, without correlation."""
    points = [F.percentile(f"_x{i}", [0.16, 0.5, 0.84]).alias(f"_p{i}") for i in range(_N)]
    groups = rows.groupBy(*_GROUP).agg(*points)
    mean = [F.col(f"_p{i}")[1] for i in range(_N)]
    spread = {
        (i, j): F.pow((F.col(f"_p{i}")[2] - F.col(f"_p{i}")[0]) / 2, F.lit(2)) if i == j else F.lit(0.0)
        for i in range(_N)
        for j in range(i + 1)
    }
    return _whitened(groups, mean, spread)


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with the squared distance ``_d`` by their group's estimate.

    The estimate is a stored table of one row a group: it is broadcast only if
    its files are small, and joined by key otherwise.
    """
    total = F.lit(0.0)
    for i in range(_N):
        y = F.lit(0.0)
        for j in range(i + 1):
            y = y + F.col(f"_w{i}_{j}") * (F.col(f"_x{j}") - F.col(f"_m{j}"))
        total = total + y * y
    return rows.join(estimate, _GROUP).withColumn("_d", total).drop(*_ESTIMATE)


def _concentrated(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """The estimate of the core: the bins of smallest distance that hold ``CORE`` of each group."""
    binned = _distance(rows, estimate).withColumn("_bin", F.floor(BINS_AN_OCTAVE * F.log2(F.col("_d") + 1)))
    pairs = [(i, j) for i in range(_N) for j in range(i + 1)]
    sums = [F.sum(f"_x{i}").alias(f"_s{i}") for i in range(_N)]
    sums += [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_s{i}_{j}") for i, j in pairs]
    bins = binned.groupBy(*_GROUP, "_bin").agg(F.count("*").alias("_n"), *sums)
    group = Window.partitionBy(*_GROUP)
    before = group.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns(
        {"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)), "_core": F.ceil(CORE * F.sum("_n").over(group))}
    )
    names = ["_n", *(f"_s{i}" for i in range(_N)), *(f"_s{i}_{j}" for i, j in pairs)]
    core = bins.where("_before < _core").groupBy(*_GROUP).agg(*(F.sum(n).alias(n) for n in names))
    mean = [F.col(f"_s{i}") / F.col("_n") for i in range(_N)]
    spread = {(i, j): CONSISTENCY * (F.col(f"_s{i}_{j}") / F.col("_n") - mean[i] * mean[j]) for i, j in pairs}
    return _whitened(core, mean, spread)


def _prepared(docs: DataFrame, lang: str, source: str, *keep: Column) -> DataFrame:
    return with_statistics(
        docs.select(
            *keep,
            F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("_lang"),
            F.coalesce(F.col(source).cast("string"), F.lit("")).alias("_source"),
            F.col("text").alias("_text"),
        ),
        "_text",
    )


def _estimated(rows: DataFrame) -> DataFrame:
    """The estimate of each group, from rows that pass the fixed limits."""
    judged = rows.where("NOT base_failed")
    estimate = _start(judged)
    for _ in range(STEPS):
        estimate = _concentrated(judged, estimate)
    return estimate


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality_verdicts(docs: DataFrame, lang: str = "lang", source: str = "source", limit: float = LIMIT) -> DataFrame:
    """``doc_id``, the statistics, ``base_failed``, ``distance`` and ``kept`` of each row of ``docs``.

    A text that fails a fixed limit is not part of its group's estimate; its
    distance is null. A null language or source counts as the empty one. A
    group of few or equal texts has the least spread, so none of them is an
    outlier by itself. A null or empty text fails by its number of words.
    Repeated rows are judged alike, each one; an empty table gives an empty
    result. Other columns are left out.
    """
    rows = _prepared(docs, lang, source, F.col("doc_id"))
    rows = stored(rows.select("doc_id", *_GROUP, *_COUNTS, "base_failed", *_vector()))
    passed = _distance(rows.where("NOT base_failed"), _estimated(rows)).withColumn("kept", F.col("_d") <= limit)
    failed = rows.where("base_failed").withColumns({"_d": F.lit(None).cast("double"), "kept": F.lit(False)})
    return passed.unionByName(failed).select("doc_id", *_COUNTS, "base_failed", F.col("_d").alias("distance"), "kept")


def good_documents(docs: DataFrame, lang: str = "lang", source: str = "source", limit: float = LIMIT) -> DataFrame:
    """The rows of ``docs`` that ``quality_verdicts`` keeps, with all their columns.

    The rows are stored once with their statistics, which nothing after that
    computes again, and never shuffled or joined by id, so ids may repeat or be null.
    """
    rows = _prepared(docs, lang, source, F.struct(*docs.columns).alias("_row"))
    rows = stored(rows.select("_row", *_GROUP, "base_failed", *_vector()))
    judged = _distance(rows.where("NOT base_failed"), _estimated(rows.drop("_row")))
    return judged.where(F.col("_d") <= limit).select("_row.*")
