"""Token ids of documents as binary files in Simple-8b, and back.

A file is one sorted range of documents. Its rows are segments of whole
documents: their ids and lengths, the words of ``simple8b``, the word at which
each block begins, and the escapes. Parquet is only the container, so that
Spark's committer makes each file whole or absent when executors are lost, on
any storage. Files and the segments in them ascend by document id.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import simple8b
from millrace.llm.common import once_a_worker

SEGMENT_IDS = 1 << 18
# Pieces that a worker remembers of late, and as many from before: some 200 bytes each, as those
# of more characters than these are not kept.
CACHE_ENTRIES = 200_000
LONGEST_KEPT = 64
TEXTS_A_BATCH = 256

SEGMENT = (
    "part int, start long, n_ids long, doc_ids array<long>, lengths array<long>,"
    " words binary, offsets array<int>, escapes binary"
)
_SEGMENT = pa.schema(
    [
        ("part", pa.int32()),
        ("start", pa.int64()),
        ("n_ids", pa.int64()),
        ("doc_ids", pa.list_(pa.int64())),
        ("lengths", pa.list_(pa.int64())),
        ("words", pa.binary()),
        ("offsets", pa.list_(pa.int32())),
        ("escapes", pa.binary()),
    ]
)
_DOCUMENT = pa.schema(
    [
        ("part", pa.int32()),
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
    ]
)

# The byte-level pattern never matches across a place where white space begins
# or ends, but for one space before a word, nor between a letter and one of
# these marks, the apostrophe being none of them. So these pieces encode one by
# one to the ids of the whole text.
_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
_MARK = r'!"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~'
_PIECE = re.compile(
    rf" ?[{_LETTER}]+(?![^{_WHITE}{_MARK}])| ?[{_MARK}]+(?![^{_WHITE}{_LETTER}])"
    rf"|[{_WHITE}]+(?![^{_WHITE}])| ?[^{_WHITE}]+|[{_WHITE}]"
)
# Of these pieces the byte-level pattern makes one each.
_WHOLE = re.compile(rf" ?(?:[{_LETTER}]+|[{_MARK}]+|[0-9]+)")
# Byte-level characters: a printable character of Latin-1 stands for its byte, those from 256 for the other bytes.
_SHOWN = [b for b in range(256) if b != ord(" ") and chr(b).isprintable()]
_BYTE_LEVEL = {b: 256 + n for n, b in enumerate(sorted(set(range(256)).difference(_SHOWN)))}
_SPACE = chr(_BYTE_LEVEL[ord(" ")])

# Of UTF-8 bytes: white space but the space, the space, letters, marks, digits, and all others.
_BLANK, _BLANK_SPACE, _OTHER, _LETTERS, _MARKS, _DIGITS = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
for _kind, _pattern in ((_BLANK, r"[\t-\r]"), (_BLANK_SPACE, " "), (_LETTERS, "[A-Za-z]"), (_MARKS, f"[{_MARK}]"), (_DIGITS, "[0-9]")):
    _KIND[[b for b in range(128) if re.match(_pattern, chr(b))]] = _kind
_ODD_WHITE = re.compile(r"[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
# Bytes of a piece that stand in two words, beside the length.
_SHORT = 15
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SLOTS = 1 << 20
PIECES_AT_ONCE = 1 << 16
BYTES_AT_ONCE = 1 << 22


def _cuts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Where pieces begin that encode one by one, in the UTF-8 of texts that have no white space beyond ASCII."""
    kind = _KIND[data]
    lead = np.flatnonzero(data == 0xC3)
    if len(lead):
        # The letters of Latin-1; its signs of multiplication and division are none.
        lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
        kind[lead] = kind[lead + 1] = _LETTERS
    white = kind <= _BLANK_SPACE
    cut = np.zeros(len(data), bool)
    a, b = kind[:-1], kind[1:]
    cut[1:] = (a != b) & (np.minimum(a, b) > _OTHER)
    cut[1:] |= white[1:] & ~white[:-1]
    cut[1:] |= ~white[1:] & (a == _BLANK)
    # The last of several is a piece of its own or goes with what follows.
    follows = ~white
    follows[begins] = False
    cut[1:-1] |= white[:-2] & white[1:-1] & follows[2:]
    cut[begins] = True
    return np.flatnonzero(cut)


def _taken(pool: np.ndarray, first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """``count`` values of ``pool`` from each ``first`` on."""
    ends = np.cumsum(count)
    return pool[np.repeat(first - (ends - count), count) + np.arange(ends[-1] if len(ends) else 0)]


class _Table:
    """Ids of pieces, those of ``_SHORT`` bytes at most remembered by their bytes in a hash table.

    When there are more than ``2 * CACHE_ENTRIES``, those stay that were met again.
    """

    def __init__(self, make: Callable[[str], bytes], make_long: Callable[[str], bytes]):
        self.make, self.make_long = make, make_long
        # Entry 0 is none.
        self._fill(np.zeros((2, 1), np.uint64), np.zeros(1, np.int64), np.zeros(1, np.int64), np.empty(0, np.uint32))

    def _fill(self, keys: np.ndarray, first: np.ndarray, count: np.ndarray, pool: np.ndarray) -> None:
        self.keys, self.first, self.count, self.pool = keys, first, count, pool
        self.n, self.held = len(first), len(pool)
        self.used = np.zeros(self.n, bool)
        self.slots = np.zeros(_SLOTS, np.int32)
        self._insert(np.arange(1, self.n))

    def _slot(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        mixed = (lo ^ (hi * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((mixed ^ (mixed >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(44)).astype(np.int64)

    def _insert(self, entries: np.ndarray) -> None:
        slot = self._slot(*self.keys[:, entries])
        while len(entries):
            free = self.slots[slot] == 0
            self.slots[slot[free]] = entries[free]
            left = self.slots[slot] != entries
            entries, slot = entries[left], (slot[left] + 1) % _SLOTS

    def _find(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        found = np.zeros(len(lo), np.int64)
        slot, left = self._slot(lo, hi), np.arange(len(lo))
        while len(left):
            entry = self.slots[slot]
            same = (self.keys[0][entry] == lo) & (self.keys[1][entry] == hi)
            found[left[same]] = entry[same]
            on = ~same & (entry != 0)
            lo, hi, slot, left = lo[on], hi[on], (slot[on] + 1) % _SLOTS, left[on]
        return found

    def _put(self, lo: np.ndarray, hi: np.ndarray, made: list[bytes]) -> None:
        """New entries from ``n`` on, in place of any that are there."""
        count = np.array([len(ids) // 4 for ids in made], np.int64)
        ids = np.frombuffer(b"".join(made), "<u4")
        if self.n + len(made) > len(self.first):
            more = self.n + len(made)
            self.keys = np.concatenate([self.keys, np.zeros((2, more), np.uint64)], axis=1)
            self.first, self.count = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (self.first, self.count))
            self.used = np.concatenate([self.used, np.zeros(more, bool)])
        if self.held + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(self.held + len(ids), np.uint32)])
        to = slice(self.n, self.n + len(made))
        self.keys[:, to], self.count[to], self.used[to] = (lo, hi), count, False
        self.first[to] = self.held + np.cumsum(count) - count
        self.pool[self.held : self.held + len(ids)] = ids

    def _add(self, pieces: list[bytes], lo: np.ndarray, hi: np.ndarray, make: Callable[[str], bytes]) -> np.ndarray:
        """Entries of pieces that are not in the table, equal ones once."""
        places: dict[bytes, int] = {}
        number = np.array([places.setdefault(piece, len(places)) for piece in pieces], np.int64)
        any_of = np.zeros(len(places), np.int64)
        any_of[number] = np.arange(len(pieces))
        self._put(lo[any_of], hi[any_of], [make(piece.decode()) for piece in places])
        return self.n + number

    def ids(self, data: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the pieces of ``data``, one after another, and how many each has; 16 bytes follow the last."""
        if self.n > 2 * CACHE_ENTRIES:
            keep = np.flatnonzero(self.used[: self.n])
            keep = np.append(0, keep if len(keep) <= CACHE_ENTRIES else keep[:0])
            count = self.count[keep]
            pool = _taken(self.pool, self.first[keep], count)
            self._fill(self.keys[:, keep], np.cumsum(count) - count, count, pool)
        lengths = ends - starts
        words = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))
        lo = words[starts] & _MASKS[np.minimum(lengths, 8)]
        hi = words[starts + 8] & _MASKS[np.clip(lengths - 8, 0, 7)]
        hi |= np.minimum(lengths, 255).astype(np.uint64) << np.uint64(56)
        entry = self._find(lo, hi)
        self.used[entry[entry > 0]] = True
        new = entry == 0
        short = lengths <= _SHORT
        # Long ones are put where the next entries come, for this call only.
        for long in (False, True):
            some = np.flatnonzero(new & (short != long))
            if len(some):
                pieces = [data[a:b] for a, b in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                entry[some] = self._add(pieces, lo[some], hi[some], self.make_long if long else self.make)
                if not long:
                    n, self.n = self.n, int(entry[some].max()) + 1
                    self.held += int(self.count[n : self.n].sum())
                    self._insert(np.arange(n, self.n))
        count = self.count[entry]
        return _taken(self.pool, self.first[entry], count), count


class _Remembered(dict):
    """What ``make`` gives for a piece: that of late, and as much from before."""

    def __init__(self, make: Callable[[str], bytes]):
        self.make = make
        self.before: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        found = self.before.get(piece)
        if found is None:
            found = self.make(piece)
        if len(piece) <= LONGEST_KEPT:
            if len(self) >= CACHE_ENTRIES:
                self.before = dict(self)
                self.clear()
            self[piece] = found
        return found


class Encoder:
    """Texts to ids as little-endian 32-bit bytes.

    A text is cut into pieces that encode one by one, and their ids are remembered:
    of many texts at once, by their bytes, in a table. A piece of which the tokenizer's
    pattern makes one goes to its model at once. A text with white space beyond ASCII is
    cut by a pattern, and its pieces are remembered in two generations of ``CACHE_ENTRIES``.
    One that holds the string of a special token goes to the tokenizer whole, as do all
    texts of tokenizers of another kind.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        parts = (self.tokenizer.normalizer, self.tokenizer.post_processor, self.tokenizer.truncation, self.tokenizer.padding)
        split = self.tokenizer.pre_tokenizer
        split = json.loads(split.__getstate__()) if split else {}
        self.by_piece = (
            all(p is None for p in parts)
            and isinstance(self.model, BPE)
            and not self.model.dropout
            and split.get("type") == "ByteLevel"
            and split.get("use_regex", True)
            and not split.get("add_prefix_space")
        )
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known = _Remembered(self._piece)
        self.table = _Table(self._piece, self.known.__getitem__)

    def _ids(self, text: str) -> bytes:
        (done,) = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)
        return np.array(done.ids, dtype="<u4").tobytes()

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.lstrip(" ").isalpha():
            shown = piece.replace(" ", _SPACE)
        elif _WHOLE.fullmatch(piece):
            shown = piece.encode().decode("latin-1").translate(_BYTE_LEVEL)
        else:
            return self._ids(piece)
        tokens = self.model.tokenize(shown)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def _text(self, text: str) -> bytes:
        if not self.by_piece or any(special in text for special in self.added):
            return self._ids(text)
        return b"".join(map(self.known.__getitem__, _PIECE.findall(text)))

    def _together(self, texts: list[bytes]) -> list[bytes]:
        data = b"".join(texts)
        if not data:
            return [b""] * len(texts)
        begins = np.cumsum([0, *map(len, texts)])
        starts = _cuts(np.frombuffer(data, np.uint8), begins[begins < len(data)])
        ends = np.append(starts[1:], len(data))
        data += bytes(16)
        found = [self.table.ids(data, starts[at : at + PIECES_AT_ONCE], ends[at : at + PIECES_AT_ONCE]) for at in range(0, len(starts), PIECES_AT_ONCE)]
        ids, counts = (np.concatenate(x) for x in zip(*found, strict=True))
        bounds = 4 * np.append(0, np.cumsum(counts))[np.searchsorted(starts, begins)]
        raw = ids.astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]

    def encode(self, texts: list[str]) -> list[bytes]:
        done: list[bytes] = [b""] * len(texts)
        places, raws, held = [], [], 0

        def flush() -> None:
            nonlocal held
            for place, ids in zip(places, self._together(raws), strict=True):
                done[place] = ids
            places.clear()
            raws.clear()
            held = 0

        for place, text in enumerate(texts):
            odd = not text.isascii() and _ODD_WHITE.search(text)
            if odd or not self.by_piece or any(special in text for special in self.added):
                done[place] = self._text(text)
                continue
            raw = text.encode()
            if held + len(raw) > BYTES_AT_ONCE:
                flush()
            places.append(place)
            raws.append(raw)
            held += len(raw)
        flush()
        return done


def _segments(path: str, end_id: int | None, segment_ids: int):
    end = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, start = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        parts: list[bytes] = []
        held = 0

        def segment() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), dtype="<u4")
            words, offsets, escapes = simple8b.encode(ids)
            row = [part, start, len(ids), docs, [len(p) // 4 for p in parts]]
            row += [words.astype("<u8").tobytes(), offsets, escapes.astype("<u8").tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(row, _SEGMENT, strict=True)], schema=_SEGMENT)

        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS_A_BATCH):
                some = batch.slice(at, TEXTS_A_BATCH)
                encoder = once_a_worker(("encoder", path), lambda: Encoder(path))
                encoded = encoder.encode(some.column(1).to_pylist())
                for doc, ids in zip(some.column(0).to_pylist(), encoded, strict=True):
                    docs.append(doc)
                    parts.append(ids + end)
                    held += len(parts[-1]) // 4
                    if held >= segment_ids:
                        yield segment()
                        start, held, docs, parts = start + held, 0, [], []
        if docs:
            yield segment()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int | None = None,
    segment_ids: int = SEGMENT_IDS,
) -> None:
    """Encode ``text`` and write it by ascending ``doc_id`` (null first, ties by text).

    A null text is an empty one; repeated rows are written as often as they
    occur; other columns are left out. An empty table writes no segment. The
    tokenizer file must be at ``tokenizer`` on every executor. One shuffle,
    of the texts by ranges; equal ids are cut apart by their texts.
    """
    key = [F.col("doc_id"), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange(*key).sortWithinPartitions("doc_id", "text")
    segments = ordered.mapInArrow(_segments(tokenizer, end_id, segment_ids), SEGMENT)
    segments.write.option("compression", "zstd").parquet(path)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = _segment_ids(row).astype("<u4")
            ends = np.cumsum(row["lengths"])
            starts = ends - row["lengths"]
            crcs = [zlib.crc32(ids[a:b]) for a, b in zip(starts, ends, strict=True)]
            columns = [[row["part"]] * len(ends), row["doc_ids"], starts + row["start"], row["lengths"], crcs]
            yield pa.RecordBatch.from_arrays([pa.array(v, t.type) for v, t in zip(columns, _DOCUMENT, strict=True)], schema=_DOCUMENT)


def _segment_ids(row: dict) -> np.ndarray:
    return simple8b.decode(np.frombuffer(row["words"], "<u8"), np.frombuffer(row["escapes"], "<u8"))


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            ids = _segment_ids(row).astype(np.int64)
            cut = np.split(ids, np.cumsum(row["lengths"])[:-1])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(row["doc_ids"], pa.int64()), "ids": pa.array(cut, pa.list_(pa.int64()))})


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id`` and ``ids`` of each document written to ``path``."""
    return _read(spark, path).select("doc_ids", "lengths", "words", "escapes").mapInArrow(_ids, "doc_id long, ids array<long>")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Each document as the files have it: ``doc_id``, ``start`` among all ids, ``n_tokens``, ``ids_crc32``.

    The ids before a file are summed over one row a file.
    """
    segments = _read(spark, path)
    files = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    rows = segments.mapInArrow(_documents, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(files), "part").select(
        "doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids_crc32"
    )


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SEGMENT).parquet(path)
