"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

Training counts words, and pairs of a word and the one before it, over all
texts. Pairs and words enter a Bloom filter once for each level of their
quantised count, level l standing for counts from 2^(l-1) on; a count is read
back by testing level after level until one is missing. The filter's size
follows the number of tokens without a bound. Up to ``FILTER_BYTES`` it is
broadcast; a larger one stays in its regions, to which the n-grams of the texts
are sent. Texts are dealt to chunks by hash, and a chunk sends each region its
distinct keys there in order; the region's task answers with their levels alone.
Where texts and answers meet, a chunk's keys are made again from its texts, in the
same order. ``Model.load`` is the share of bits set.

The filter is built in regions: each n-gram belongs to one, tasks send each
region a packed list of keys and counts, and one task sets the bits of a
region. The probability of a word after another is its count there, smoothed
towards the word's own frequency with the weight ``SMOOTHING``.

Exact counts for the base score come from the table of words: the
``HEAD_WORDS`` most frequent are broadcast, all others are joined.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import stored

FILTER_BYTES = 96 << 20
BITS_A_TOKEN = 8
HASHES = 3
REGION_TOKENS = 2_000_000
FLUSH_TOKENS = 4_000_000
# Tokens of texts, about, that are scored together where the filter is not broadcast, and bytes of a token, about.
CHUNK_TOKENS = 1_000_000
TOKEN_BYTES = 6
# Texts that are read at once.
BLOCK = 200
HEAD_WORDS = 1 << 17
SMOOTHING = 16.0
LEVELS = 40

# The token after the last word; no word holds a space.
END = b" "
_KEY = np.uint64((1 << 48) - 1)
_START = np.uint64(0x5851F42D4C957F2D)
_UNIGRAM = np.uint64(0x14057B7EF767814F)


def tokens_of(text: str | None) -> list[bytes]:
    """Words, A-Z lower, and the end; a null text has the end alone."""
    tokens = (text or "").encode().lower().split()
    tokens.append(END)
    return tokens


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


@dataclass(frozen=True)
class Block:
    """Texts as numbers of ``words``, ``sizes`` of each with its end; the end is the last of ``words``."""

    words: list[bytes]
    codes: np.ndarray
    sizes: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes


def _read(texts: pa.Array) -> Block:
    """The tokens of each text, as ``tokens_of`` has them."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    ends -= ends[0]
    # White space at either end of a text leaves an empty word there.
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    sizes = np.diff(before[ends]) + 1
    coded = flat.filter(real).cast(pa.binary()).dictionary_encode()
    words = coded.dictionary.to_pylist()
    codes = np.full(int(sizes.sum()), len(words), np.int64)
    inside = np.ones(len(codes), bool)
    inside[np.cumsum(sizes) - 1] = False
    codes[inside] = coded.indices.to_numpy()
    return Block([*words, END], codes, sizes)


def _unigrams(hashes: np.ndarray) -> np.ndarray:
    return _mixed(hashes + _UNIGRAM) & _KEY


def _bigrams(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Keys of each token with the one before it, or the start of its text."""
    before = np.empty_like(hashes)
    before[1:] = hashes[:-1]
    before[starts] = _START
    return _mixed(_mixed(before) + hashes) & _KEY


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted, each once; ``np.unique`` takes far longer for so many."""
    keys = np.sort(keys)
    return keys[np.concatenate([np.ones(min(len(keys), 1), bool), keys[1:] != keys[:-1]])]


def _ngrams(block: Block) -> np.ndarray:
    """Keys of the pairs and, once each, of the words."""
    hashes = _word_hashes(block.words)
    return np.concatenate([_bigrams(hashes[block.codes], block.starts), _unigrams(hashes)])


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(counts.astype(np.float64))[1], LEVELS)


def _value(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level, 0 for none."""
    return np.where(levels > 0, (3 * np.exp2(levels - 1.0) - 1) / 2, 0.0)


def _places(keys: np.ndarray, level: int, i: int, bits: int) -> np.ndarray:
    """The bit of each key in its region for a level and a hash function."""
    step = (level * 0xA0761D6478BD642F + (2 * i + 1) * 0xD1342543DE82EF95) & ((1 << 64) - 1)
    return _mixed(keys + np.uint64(step)) % np.uint64(bits)


@dataclass(frozen=True)
class Filter:
    """``regions`` of ``bits`` bits each, in one array of bytes."""

    bytes: np.ndarray
    regions: int
    bits: int

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """The quantised count of each key."""
        return _value(self.levels(keys))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """The level of each key, by probes of one after another."""
        base = (keys % np.uint64(self.regions)) * np.uint64(self.bits)
        found = np.zeros(len(keys), np.int8)
        live = np.arange(len(keys))
        for level in range(1, LEVELS + 1):
            own, at = keys[live], base[live]
            for i in range(HASHES):
                place = at + _places(own, level, i, self.bits)
                held = (self.bytes[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8)) & 1
                kept = held.astype(bool)
                live, own, at = live[kept], own[kept], at[kept]
            if not len(live):
                break
            found[live] = level
        return found


@dataclass(frozen=True)
class Answers:
    """Levels of the sorted ``keys`` that a chunk of texts holds."""

    keys: np.ndarray
    found: np.ndarray

    def counts(self, keys: np.ndarray) -> np.ndarray:
        return _value(self.found[np.searchsorted(self.keys, keys)])


@dataclass(frozen=True)
class Model:
    """``filter`` is None where it is too large for a broadcast; its ``regions`` of ``bits`` bits each are stored in ``built``."""

    words: DataFrame
    tokens: int
    distinct: int
    filter: Broadcast | None
    load: float
    built: DataFrame
    regions: int
    bits: int


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(counts, pa.binary()), pa.array(counts.values(), pa.int64())], names=["word", "n"])

    counts: Counter = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            counts.update(tokens_of(text))
            if len(counts) > 300_000:
                yield rows()
                counts = Counter()
    if counts:
        yield rows()


_PACKED = "region int, singles long, keys binary, counts binary"
_PACKED_TYPES = [pa.int32(), pa.int64(), pa.binary(), pa.binary()]


def _pack(keys: np.ndarray) -> bytes:
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    wide = np.zeros((len(packed) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8).reshape(-1, 6)
    return wide.view("<u8").ravel()


def _by_region(keys: np.ndarray, regions: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of sorted keys by region, and where each region's begin in it."""
    region = (keys % np.uint64(regions)).astype(np.uint16 if regions <= 1 << 16 else np.int64)
    order = np.argsort(region, kind="stable")
    return order, np.searchsorted(region[order], np.arange(regions + 1))


def _pack_gaps(keys: np.ndarray, regions: int) -> bytes:
    """Sorted keys of one region as the gaps between them, of 4 bytes if the widest fits and else of 6."""
    gaps = np.diff(keys // np.uint64(regions), prepend=np.uint64(0))
    return b"\4" + gaps.astype("<u4").tobytes() if gaps.max() < 1 << 32 else b"\6" + _pack(gaps)


def _unpack_gaps(packed: bytes, region: int, regions: int) -> np.ndarray:
    gaps = np.frombuffer(packed, "<u4", offset=1).astype(np.uint64) if packed[0] == 4 else _unpack(packed[1:])
    return np.cumsum(gaps, dtype=np.uint64) * np.uint64(regions) + np.uint64(region)


def _count_ngrams(regions: int):
    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        keys, counts = np.unique(np.concatenate(parts), return_counts=True)
        # By region, single ones first; two bytes are sorted by their digits.
        place = ((keys % np.uint64(regions)) * np.uint64(2) + (counts > 1)).astype(np.uint16 if regions <= 1 << 15 else np.int64)
        order = np.argsort(place, kind="stable")
        keys, counts = keys[order], counts[order]
        rows = []
        edges = np.searchsorted(place[order], 2 * np.arange(regions + 1))
        for r in np.flatnonzero(np.diff(edges)).tolist():
            own, n = keys[edges[r] : edges[r + 1]], counts[edges[r] : edges[r + 1]]
            single = int((n == 1).sum())
            rows.append((r, single, _pack(own), n[single:].astype("<u8").tobytes()))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _PACKED_TYPES, strict=True)], names=["region", "singles", "keys", "counts"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[np.ndarray] = []
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                block = _read(batch.column(0).slice(at, BLOCK))
                hashes = _word_hashes(block.words)[block.codes]
                parts += [_bigrams(hashes, block.starts), _unigrams(hashes)]
                held += len(hashes)
                if held >= FLUSH_TOKENS:
                    yield packed(parts)
                    parts, held = [], 0
        if parts:
            yield packed(parts)

    return run


def _set_bits(bits: int):
    """Each region's bits from its packed lists, which come one after another."""

    def region_bits(lists: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, int, int]:
        keys, inverse = np.unique(np.concatenate([k for k, _ in lists]), return_inverse=True)
        counts = np.bincount(inverse, weights=np.concatenate([n for _, n in lists]).astype(np.float64), minlength=len(keys))
        levels = _levels(counts)
        held = np.zeros(bits, np.uint8)
        for level in range(1, int(levels.max()) + 1):
            own = keys[levels >= level]
            for i in range(HASHES):
                held[_places(own, level, i, bits).astype(np.int64)] = 1
        return np.packbits(held, bitorder="little").tobytes(), len(keys), int(held.sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, lists = None, []

        def done() -> pa.RecordBatch:
            packed, n, ones = region_bits(lists)
            return pa.RecordBatch.from_arrays(
                [pa.array([region], pa.int32()), pa.array([packed], pa.binary()), pa.array([n], pa.int64()), pa.array([ones], pa.int64())],
                names=["region", "bits", "n", "ones"],
            )

        for batch in batches:
            for row in batch.to_pylist():
                if region is not None and row["region"] != region:
                    yield done()
                    lists = []
                region = row["region"]
                keys, many = _unpack(row["keys"]), np.frombuffer(row["counts"], "<u8")
                lists.append((keys, np.concatenate([np.ones(row["singles"], np.uint64), many])))
        if lists:
            yield done()

    return run


def train(docs: DataFrame, filter_bytes: int = FILTER_BYTES) -> Model:
    """A model of the column ``text`` of all rows; repeated rows count as often as they occur.

    A null text is an empty one. Without rows every word is unknown. A filter of
    more than ``filter_bytes`` is not broadcast.
    """
    spark = docs.sparkSession
    texts = docs.select("text")
    words = stored(texts.mapInArrow(_count_words, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    regions = max(16, math.ceil(total["n"] / REGION_TOKENS))
    size = max(1 << 10, total["n"] * BITS_A_TOKEN // 8)
    bits = -(-size // regions // 8) * 64
    lists = texts.mapInArrow(_count_ngrams(regions), _PACKED).repartition("region").sortWithinPartitions("region")
    built = stored(lists.mapInArrow(_set_bits(bits), "region int, bits binary, n long, ones long"))
    load = built.agg(F.coalesce(F.sum("ones"), F.lit(0)).alias("ones")).first()["ones"] / (regions * bits)
    filled = None
    if size <= filter_bytes:
        # The whole filter is at most filter_bytes, and a word a region.
        whole = np.zeros(regions * bits // 8, np.uint8)
        for row in built.select("region", "bits").toLocalIterator():
            at = row["region"] * bits // 8
            whole[at : at + bits // 8] = np.frombuffer(row["bits"], np.uint8)
        filled = spark.sparkContext.broadcast(Filter(whole, regions, bits))
    return Model(words, total["n"], total["v"], filled, load, built, regions, bits)


_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, tail array<binary>, times array<long>"
_SCORED_TYPES = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 2, *[pa.float64()] * 2, pa.list_(pa.binary()), pa.list_(pa.int64())]
_SCORED_NAMES = [part.split()[0] for part in _SCORED.split(", ")]


def _runs(*columns: np.ndarray) -> list[tuple[int, int]]:
    """From where to where all ``columns`` stay the same."""
    changes = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns])) + 1
    edges = [0, *changes.tolist(), len(columns[0])]
    return [(at, end) for at, end in zip(edges, edges[1:]) if at < end]


def _pieces(filled: Broadcast):
    """Blocks of texts, the rows of each (``doc_id``, ``held_out``), and where counts are looked up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                doc_id, held_out, texts = batch.slice(at, BLOCK).columns
                yield _read(texts), [[own] for own in zip(doc_id.to_pylist(), held_out.to_pylist())], filled.value

    return run


def _pieces_of_chunks(regions: int):
    """As ``_pieces``, of chunks whose answers, by region, come before their texts; equal texts of a chunk are one."""

    def pieces(levels: list[np.ndarray], held: dict[str | None, list]) -> Iterator[tuple]:
        if not held:
            return
        texts = pa.array(held, pa.string())
        blocks = [_read(texts.slice(at, BLOCK)) for at in range(0, len(texts), BLOCK)]
        keys = _distinct(np.concatenate([_ngrams(block) for block in blocks]))
        found = np.empty(len(keys), np.int8)
        found[_by_region(keys, regions)[0]] = np.concatenate(levels)
        owners = list(held.values())
        for i, block in enumerate(blocks):
            yield block, owners[i * BLOCK : (i + 1) * BLOCK], Answers(keys, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        chunk, levels, held = None, [], {}
        for batch in batches:
            number, answer = batch.column("chunk").to_numpy(), batch.column("levels").is_valid().to_numpy(zero_copy_only=False)
            for at, end in _runs(number, answer):
                if number[at] != chunk:
                    yield from pieces(levels, held)
                    chunk, levels, held = number[at], [], {}
                some = batch.slice(at, end - at)
                if answer[at]:
                    levels += [np.frombuffer(found, np.int8) for found in some.column("levels").to_pylist()]
                    continue
                for doc_id, held_out, text in zip(*(some.column(c).to_pylist() for c in ("doc_id", "held_out", "text")), strict=True):
                    held.setdefault(text, []).append((doc_id, held_out))
        yield from pieces(levels, held)

    return run


def _score(model: Model, head: Broadcast):
    """Scores of texts, by the broadcast filter or, without one, by their chunk's answers."""
    total, distinct = model.tokens, model.distinct
    pieces = _pieces_of_chunks(model.regions) if model.filter is None else _pieces(model.filter)

    def tails(block: Block, missed: np.ndarray) -> tuple[list, list]:
        """The words of each text that ``missed`` names, and how often each is there."""
        at = np.flatnonzero(missed[block.codes])
        text = np.repeat(np.arange(len(block.sizes)), block.sizes)[at]
        each, times = np.unique(text * len(missed) + block.codes[at], return_counts=True)
        edges = np.searchsorted(each, np.arange(len(block.sizes) + 1) * len(missed)).tolist()
        words, times = [block.words[c] for c in (each % len(missed)).tolist()], times.tolist()
        return ([of[a:b] for a, b in zip(edges, edges[1:])] for of in (words, times))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _SCORED_TYPES, strict=True)], names=_SCORED_NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted = head.value
        norm = math.log10(total + distinct + 1)
        logs = {w: math.log10(n + 1) - norm for w, n in counted.items()}
        row = TaskContext.get().partitionId() << 40
        for block, owners, table in pieces(batches):
            codes, starts, hashes = block.codes, block.starts, _word_hashes(block.words)
            each = table.counts(_unigrams(hashes))
            single = each[codes]
            before = np.empty_like(single)
            before[1:] = single[:-1]
            # A text begins as often as there are texts, which is how often one ends.
            before[starts] = each[-1]
            own = (single + 1) / (total + distinct + 1)
            keys, place = np.unique(_bigrams(hashes[codes], starts), return_inverse=True)
            chance = (table.counts(keys)[place] + SMOOTHING * own) / (before + SMOOTHING)
            scores = np.add.reduceat(np.log10(np.minimum(chance, 1.0)), starts)
            log = np.fromiter((logs.get(w, np.nan) for w in block.words), np.float64, len(block.words))
            missed = np.isnan(log)
            known = np.add.reduceat(~missed[codes], starts, dtype=np.int64)
            base = np.add.reduceat(np.where(missed, 0.0, log)[codes], starts)
            columns = (c.tolist() for c in (block.sizes, known, base, scores))
            rows = []
            for same, *found in zip(owners, *columns, *tails(block, missed), strict=True):
                for doc_id, held_out in same:
                    rows.append((row, doc_id, held_out, *found))
                    row += 1
                    if len(rows) == 10 * BLOCK:
                        yield batch_of(rows)
                        rows = []
            if rows:
                yield batch_of(rows)

    return run


def _probe(regions: int):
    """Each chunk's distinct keys by region, of texts in the order of chunks."""

    def asked(chunk: int, parts: list[np.ndarray]) -> pa.RecordBatch:
        keys = _distinct(np.concatenate(parts))
        order, edges = _by_region(keys, regions)
        keys, some = keys[order], np.flatnonzero(np.diff(edges)).tolist()
        packed = [_pack_gaps(keys[edges[r] : edges[r + 1]], regions) for r in some]
        columns = [pa.array([chunk] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(packed, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["chunk", "region", "keys"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, parts, held = None, [], 0
        for batch in batches:
            number = batch.column("chunk").to_numpy()
            for at, end in _runs(number):
                if number[at] != chunk:
                    if parts:
                        yield asked(chunk, parts)
                    chunk, parts, held = int(number[at]), [], 0
                for first in range(at, end, BLOCK):
                    block = _read(batch.column("text").slice(first, min(BLOCK, end - first)))
                    parts.append(_ngrams(block))
                    held += len(block.codes)
                    if held >= FLUSH_TOKENS:
                        # A chunk of many repeated rows.
                        parts, held = [_distinct(np.concatenate(parts))], 0
        if parts:
            yield asked(chunk, parts)

    return run


def _answer(regions: int, bits: int):
    """Levels of each chunk's keys in a region, whose bits come before the keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        region, table = None, None
        for batch in batches:
            rows = []
            columns = (batch.column(n).to_pylist() for n in ("region", "chunk", "keys"))
            for own, chunk, keys in zip(*columns, strict=True):
                if own != region:
                    region, table = own, None
                if chunk is None:
                    table = Filter(np.frombuffer(keys, np.uint8), 1, bits)
                    continue
                keys = _unpack_gaps(keys, region, regions)
                # A region without bits holds no n-gram.
                found = np.zeros(len(keys), np.int8) if table is None else table.levels(keys)
                rows.append((chunk, region, found.tobytes()))
            chunks, own, found = zip(*rows, strict=True) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [pa.array(chunks, pa.int64()), pa.array(own, pa.int32()), pa.array(found, pa.binary())], names=["chunk", "region", "levels"]
            )

    return run


def _answered(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` in chunks, each after the levels of its n-grams from the stored regions."""
    size = rows.agg(F.sum(F.octet_length("text") + 1).alias("n")).first()["n"] or 0
    chunks = max(1, math.ceil(size / TOKEN_BYTES / CHUNK_TOKENS))
    # By what a row holds, so that it is in the same chunk both times.
    texts = rows.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)))
    dealt = texts.select("chunk", "text").repartition("chunk").sortWithinPartitions("chunk")
    asked = dealt.mapInArrow(_probe(model.regions), "chunk long, region int, keys binary")
    both = model.built.select("region", F.lit(None).cast("long").alias("chunk"), F.col("bits").alias("keys")).unionByName(asked)
    both = both.repartition("region").sortWithinPartitions("region", F.col("chunk").asc_nulls_first())
    answers = stored(both.mapInArrow(_answer(model.regions, model.bits), "chunk long, region int, levels binary"))
    met = answers.unionByName(texts, allowMissingColumns=True)
    return met.repartition("chunk").sortWithinPartitions("chunk", F.col("levels").isNull(), "region")


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and ``score`` of each row.

    ``docs`` has ``doc_id``, ``held_out`` and ``text``; its other columns are
    left out. A null text is an empty one, of one token. Repeated rows are
    scored each.
    """
    spark = docs.sparkSession
    first = model.words.orderBy(F.desc("n"), "word").limit(HEAD_WORDS)
    head = {bytes(r["word"]): r["n"] for r in first.toLocalIterator()}
    rows = docs.select(F.col("doc_id").cast("long"), "held_out", "text")
    if model.filter is None:
        rows = _answered(rows, model)
    rows = stored(rows.mapInArrow(_score(model, spark.sparkContext.broadcast(head)), _SCORED))
    tail = rows.where("size(tail) > 0").select("row", F.explode(F.arrays_zip("tail", "times")).alias("t"))
    tail = tail.select("row", F.col("t.tail").alias("word"), F.col("t.times").alias("times"))
    # Words of the tail are rare by definition, so none of them is a hot key.
    least = min(head.values(), default=0)
    counts = model.words.where(F.col("n") <= least)
    joined = tail.join(counts.hint("shuffle_hash"), "word", "left")
    n = F.coalesce("n", F.lit(0))
    norm = math.log10(model.tokens + model.distinct + 1)
    sums = joined.groupBy("row").agg(
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("known"),
        F.sum(F.col("times") * (F.log10(n + 1) - norm)).alias("more"),
    )
    return rows.drop("tail", "times").join(sums, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        "score",
    )
