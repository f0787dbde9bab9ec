"""Simple-8b: ids packed into 64-bit words, in numpy for whole segments at once.

The high four bits of a word select how many ids it holds and how wide they
are; the rest holds the ids, first id lowest. Every word is full, so decoding
needs no count. An id of 60 bits or more stands in a list of escapes, and its
word holds the place in that list. Ids are cut into blocks of ``BLOCK``; the
word at which each block begins is kept, so any block decodes by itself.
"""

from __future__ import annotations

import numpy as np

# Fixed values of the format: ids a word, by selector; 0 and 15 hold none or an escape.
COUNTS = (0, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = tuple(60 // n if n else 0 for n in COUNTS)
ESCAPE = 15
BLOCK = 1024

_COUNT = np.array([*COUNTS, 1], dtype=np.int64)
_POWERS = np.array([1 << b for b in range(63)], dtype=np.uint64)
_SMALL = np.searchsorted(_POWERS, np.arange(1 << 17, dtype=np.uint64), side="right").astype(np.uint8)


def _widths(ids: np.ndarray) -> np.ndarray:
    if ids.max() < len(_SMALL):
        return _SMALL[ids]
    return np.searchsorted(_POWERS, ids, side="right").astype(np.uint8)


def _choices(widths: np.ndarray) -> np.ndarray:
    """For each place of each block, the selector that packs most ids from there."""
    n = widths.shape[1] - 60
    best = np.full((len(widths), n), ESCAPE, dtype=np.uint8)
    widest = {1: widths}
    for half in (1, 2, 4, 8, 16):
        w = widest[half]
        widest[2 * half] = np.maximum(w[:, :-half], w[:, half:])
    for selector in range(14, 0, -1):
        count, bits = COUNTS[selector], BITS[selector]
        power = 1 << (count.bit_length() - 1)
        w, shift = widest[power], count - power
        fits = np.maximum(w[:, :n], w[:, shift : shift + n]) <= bits
        if not fits.any():
            break
        # What fits here has fitted the selectors of fewer and wider ids.
        best -= fits
    return best


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, the word at which each block begins, and the escaped ids."""
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.uint64)
    ids = ids.astype(np.uint64)
    blocks = -(-n // BLOCK)
    # A width of 255 fits nothing: no word reaches past its block.
    widths = np.full((blocks, BLOCK + 60), 255, dtype=np.uint8)
    flat = np.full(blocks * BLOCK, 255, dtype=np.uint8)
    flat[:n] = _widths(ids)
    widths[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    choice = _choices(widths)
    # All blocks walk their chains of words at the same time.
    ends = np.full(blocks, BLOCK, dtype=np.int64)
    ends[-1] = n - (blocks - 1) * BLOCK
    row, at = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    begins = np.zeros((blocks, BLOCK), dtype=bool)
    while len(row):
        begins[row, at] = True
        at = at + _COUNT[choice[row, at]]
        going = at < ends[row]
        row, at = row[going], at[going]
    starts = np.flatnonzero(begins)
    rows, selectors = starts // BLOCK, choice[begins]
    words = selectors.astype(np.uint64) << np.uint64(60)
    for selector in range(1, 15):
        chosen = np.flatnonzero(selectors == selector)
        if len(chosen):
            first, packed = starts[chosen], words[chosen]
            for j in range(COUNTS[selector]):
                packed |= ids[first + j] << np.uint64(j * BITS[selector])
            words[chosen] = packed
    escaped = np.flatnonzero(selectors == ESCAPE)
    words[escaped] |= np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(rows, np.arange(blocks)).astype(np.int32)
    return words, offsets, ids[starts[escaped]]


def decode(words: np.ndarray, escapes: np.ndarray) -> np.ndarray:
    """The ids of whole words: of a segment, or of one block by its offset."""
    selectors = (words >> np.uint64(60)).astype(np.int64)
    counts = _COUNT[selectors]
    starts = np.cumsum(counts) - counts
    payload = words & np.uint64((1 << 60) - 1)
    ids = np.empty(int(counts.sum()), dtype=np.uint64)
    for selector in range(1, 15):
        chosen = np.flatnonzero(selectors == selector)
        if len(chosen):
            bits, first, packed = BITS[selector], starts[chosen], payload[chosen]
            mask = np.uint64((1 << bits) - 1)
            for j in range(COUNTS[selector]):
                ids[first + j] = (packed >> np.uint64(j * bits)) & mask
    escaped = np.flatnonzero(selectors == ESCAPE)
    if len(escaped):
        ids[starts[escaped]] = escapes[payload[escaped].astype(np.int64)]
    return ids
