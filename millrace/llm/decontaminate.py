"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of words of every item. A document's words are
streamed through it; the longest match that ends at each word shows where
windows of items occur. It is broadcast, so it is built of ``MAX_ITEM_WORDS``
words at most; more items make several automata, one after another, each with a
pass over the documents, and neither the driver nor a worker ever holds two.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.llm.common import stored

# Words of one automaton; about 400 bytes a word in each Python worker.
MAX_ITEM_WORDS = 200_000
WINDOW = 10

# A word is digits, letters and all that is not ASCII; A-Z count as a-z.
_NORMAL = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_NORMAL).split()


class SuffixAutomaton:
    """All runs of words of some items, with the items whose windows end in each state."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int):
        self.window = window
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.owners: list[set[int]] = [set()]
        self.names = [name for name, _ in items]
        self.short: dict[int, set[int]] = {}
        self.whole: dict[int, int] = {}
        self.shortest = window
        for item, (_, words) in enumerate(items):
            codes = [self.ids.setdefault(w, len(self.ids)) for w in words]
            last = 0
            for code in codes:
                last = self._extend(last, code)
        pairs = set()
        for item, (_, words) in enumerate(items):
            codes = [self.ids[w] for w in words]
            pairs.update(zip(codes, codes[1:], strict=False))
            self._own(item, codes)
        self.pairs = np.sort(np.array([a << 32 | b for a, b in pairs], dtype=np.int64))

    def _state(self, length: int, link: int, following: dict[int, int]) -> int:
        self.next.append(following)
        self.length.append(length)
        self.link.append(link)
        self.owners.append(set())
        return len(self.next) - 1

    def _extend(self, last: int, code: int) -> int:
        """Add one word after the run that ends in ``last``; the state of the longer run."""
        known = self.next[last].get(code)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, code, known)
        state = self._state(self.length[last] + 1, 0, {})
        at = last
        while at >= 0 and code not in self.next[at]:
            self.next[at][code] = state
            at = self.link[at]
        if at >= 0:
            target = self.next[at][code]
            exact = self.length[target] == self.length[at] + 1
            self.link[state] = target if exact else self._split(at, code, target)
        return state

    def _split(self, at: int, code: int, target: int) -> int:
        """Part the shorter runs of ``target`` off into a state of their own."""
        copy = self._state(self.length[at] + 1, self.link[target], dict(self.next[target]))
        while at >= 0 and self.next[at].get(code) == target:
            self.next[at][code] = copy
            at = self.link[at]
        self.link[target] = copy
        return copy

    def _own(self, item: int, codes: list[int]) -> None:
        """Note the item at the state of each of its windows."""
        if not codes:
            return
        size = min(self.window, len(codes))
        self.shortest = min(self.shortest, size)
        for _, state, length in self.ends(codes):
            if length >= size:
                at = self._window(state, size)
                if size == self.window:
                    self.owners[at].add(item)
                elif size == len(codes):
                    self.short.setdefault(at, set()).add(item)
                    self.whole[at] = size

    def _window(self, state: int, size: int) -> int:
        """The state of the last ``size`` words of a run of at least so many that ends in ``state``."""
        while self.length[self.link[state]] >= size:
            state = self.link[state]
        return state

    def ends(self, codes: list[int]) -> Iterator[tuple[int, int, int]]:
        """For each word: its place, the state and the length of the longest match that ends there."""
        state, length = 0, 0
        for place, code in enumerate(codes):
            while state and code not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if code in self.next[state]:
                state = self.next[state][code]
                length += 1
            else:
                length = 0
            yield place, state, length

    def runs(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Where matches as long as the shortest window can lie: runs of words that items have, each pair in some item."""
        get = self.ids.get
        codes = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        if not len(codes) or codes.max() < 0:
            return
        known = codes >= 0
        joined = np.zeros(len(codes), dtype=bool)
        if len(self.pairs):
            pair = codes[:-1] << 32 | codes[1:]
            at = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
            joined[1:] = known[:-1] & known[1:] & (self.pairs[at] == pair)
        starts = np.flatnonzero(known & ~joined)
        breaks = np.flatnonzero(~joined)
        ends = np.append(breaks, len(codes))[np.searchsorted(breaks, starts, side="right")]
        for start, end in zip(starts.tolist(), ends.tolist(), strict=True):
            if end - start >= self.shortest:
                yield start, codes[start:end].tolist()

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int], int]:
        """Spans of words that windows of items cover, those items, and the length of the longest match.

        The longest match is 0 where it is shorter than the shortest window.
        """
        spans: list[list[int]] = []
        items: set[int] = set()
        longest = 0

        def cover(start: int, end: int) -> None:
            # A later window may begin before earlier short ones.
            while spans and start <= spans[-1][1]:
                start = min(start, spans.pop()[0])
            spans.append([start, end])

        for first, codes in self.runs(words):
            for place, state, length in self.ends(codes):
                longest = max(longest, length)
                end = first + place + 1
                if length >= self.window:
                    at = self._window(state, self.window)
                    if self.owners[at]:
                        items |= self.owners[at]
                        cover(end - self.window, end)
                if self.short:
                    at = state
                    while at > 0:
                        # A match may end inside a state's range: only runs within it occur here.
                        if at in self.short and self.whole[at] <= length:
                            items |= self.short[at]
                            cover(end - self.whole[at], end)
                        at = self.link[at]
        return [(a, b) for a, b in spans], items, longest


def _part(items: DataFrame, window: int, part: int, parts: int) -> SuffixAutomaton:
    own = items.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == part)
    return SuffixAutomaton([(item, words_of(text)) for item, text in own.toLocalIterator()], window)


# What is known of a document so far: spans of words hit, items found, longest match, words.
_FOUND = "_spans array<array<long>>, _items array<string>, _longest long, _words long"
_FOUND_TYPES = [pa.list_(pa.list_(pa.int64())), pa.list_(pa.string()), pa.int64(), pa.int64()]


def _merged(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def _searched(docs: DataFrame, items: DataFrame, window: int, max_words: int) -> DataFrame:
    """``docs`` with what was found in ``text``; one pass over it for each part of the items."""
    named = items.select(F.col("item_id").cast("string"), "text").where("text IS NOT NULL AND item_id IS NOT NULL")
    size = named.agg(F.sum(F.octet_length("text") / 2)).first()[0] or 0
    # Words are at least half of the bytes; parts by hash are not quite equal.
    parts = max(1, math.ceil(1.5 * size / max_words)) if size > max_words else 1
    schema = StructType.fromDDL(_FOUND)
    rows = docs.withColumns({f.name: F.lit(None).cast(f.dataType) for f in schema})
    for part in range(parts):
        rows = rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(_part(named, window, part, parts))), rows.schema)
        if part < parts - 1:
            rows = stored(rows)
    return rows


def _search(automaton):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = automaton.value
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            before = [columns[n].to_pylist() for n in ("_spans", "_items", "_longest")]
            after: list[list] = [[], [], [], []]
            for text, spans, items, longest in zip(columns["text"].to_pylist(), *before, strict=True):
                words = words_of(text)
                found, owners, most = part.match(words)
                after[0].append(_merged((spans or []) + [list(x) for x in found]))
                after[1].append(sorted({*(items or []), *(part.names[i] for i in owners)}))
                after[2].append(max(longest or 0, most))
                after[3].append(len(words))
            new = [pa.array(v, t) for v, t in zip(after, _FOUND_TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *new], names=batch.schema.names)

    return run


def matched(docs: DataFrame, items: DataFrame, window: int = WINDOW, max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """For each document: words hit, the items that occur (sorted), the longest match and the spans of words hit.

    A window is ``window`` consecutive words of an item, or all words of a
    shorter one; items without words, text or id have none. Repeated items each
    count by their id. A null or empty text has no words. Without items nothing
    is hit. Other columns are left out. A repeated document gives a row each.
    ``longest`` is 0 where no match is as long as the shortest window.
    """
    hit = F.aggregate("_spans", F.lit(0).cast("long"), lambda n, s: n + s[1] - s[0])
    return _searched(docs.select("doc_id", "text"), items, window, max_words).select(
        "doc_id",
        F.col("_words").alias("n_words"),
        hit.alias("n_hit"),
        F.col("_items").alias("items"),
        F.col("_longest").alias("longest"),
        F.col("_spans").alias("spans"),
    )


def _byte_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Places in the text of spans of words."""
    plain = raw.translate(_NORMAL)
    starts = np.frombuffer(plain, np.uint8) != 32
    edges = np.flatnonzero(np.diff(np.concatenate(([False], starts, [False])).astype(np.int8)))
    return [(int(edges[2 * a]), int(edges[2 * b - 1])) for a, b in spans]


def clean_text(raw: bytes, spans: list[tuple[int, int]]) -> str:
    """The text without the spans, each with the marks and white space up to the next word."""
    kept, at = [], 0
    for a, b in _byte_spans(raw, spans):
        kept.append(raw[at:a])
        at = b
    return b"".join([*kept, raw[at:]]).decode()


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_coverage: float = 0.5,
    max_words: int = MAX_ITEM_WORDS,
) -> DataFrame:
    """Documents with the words of item windows cut out of ``text``.

    A document of which more than ``max_coverage`` is hit is left out whole.
    All its columns stay; ``n_chars``, if it is one of them, is counted anew for
    cut texts. Null and empty texts, and all texts without hits, stay as they are.
    """
    searched = _searched(docs, items, window, max_words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts, spans, words = (columns[n].to_pylist() for n in ("text", "_spans", "_words"))
            n_chars = columns["n_chars"].to_pylist() if "n_chars" in columns else None
            keep = []
            for i, (text, found) in enumerate(zip(texts, spans, strict=True)):
                keep.append(not found or sum(b - a for a, b in found) <= max_coverage * words[i])
                if found:
                    texts[i] = clean_text(text.encode(), found)
                    if n_chars:
                        n_chars[i] = len(texts[i])
            columns["text"] = pa.array(texts, columns["text"].type)
            if n_chars:
                columns["n_chars"] = pa.array(n_chars, columns["n_chars"].type)
            out = pa.RecordBatch.from_arrays(list(columns.values())[:-4], names=batch.schema.names[:-4])
            yield out.filter(pa.array(keep, pa.bool_()))

    return searched.mapInArrow(run, docs.schema)
