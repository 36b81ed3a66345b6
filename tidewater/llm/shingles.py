"""Words and word shingles of a batch of texts as NumPy arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BACK = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def times(m: int) -> np.uint64:
    """The m-th step of a sequence of odd spacing, modulo 2 ** 64."""
    return np.uint64(m * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes (UTF-8) of a string or binary column without nulls, and the n + 1 places where texts begin."""
    column = column.cast(pa.large_binary())
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    data = column.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each word; a word is a run of anything but ASCII white space."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    inner = ~_SPACE[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inner[:-1]
    heads = offsets[:-1][offsets[:-1] < n]
    before[heads] = False
    start = np.flatnonzero(inner & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inner[1:]
    after[heads[heads > 0] - 1] = False
    end = np.flatnonzero(inner & ~after) + 1
    # sums of byte * base ** place, taken back to the word's own place: equal words, equal hashes
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=sums[1:])
    hashes = mix((sums[end] - sums[start]) * _powers(_BACK, n)[start])
    return hashes, np.searchsorted(offsets, start, side="right") - 1


def shingle_hashes(words: np.ndarray, text: np.ndarray, width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of each run of ``width`` words; a text of fewer words, but not none, is one shingle."""
    n = len(words)
    at = np.flatnonzero(text[: n - width + 1] == text[width - 1 :]) if n >= width else np.zeros(0, np.int64)
    total = np.zeros(len(at), np.uint64)
    for j in range(width):
        total += words[at + j] * _STEP[j % len(_STEP)]
    hashes, owner = mix(total), text[at]
    if n:
        first = np.flatnonzero(np.r_[True, text[1:] != text[:-1]])
        count = np.diff(np.r_[first, n])
        short = count < width
        first, count = first[short], count[short]
        few = count.astype(np.uint64)
        for j in range(width - 1):
            has = count > j
            few[has] += words[first[has] + j] * _STEP[j % len(_STEP)]
        hashes, owner = np.r_[hashes, mix(few)], np.r_[owner, text[first]]
    return hashes, owner


def unit_regions(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One region for each unit of a shingle's weight (its count in the text), sorted by text.

    The k-th copy of a shingle in a text is a region of its own, so the weighted Jaccard
    similarity of two texts is the plain one of their regions.
    """
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    n = len(h)
    if not n:
        return h, o
    new = np.r_[True, (h[1:] != h[:-1]) | (o[1:] != o[:-1])]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    copy = (np.arange(n) - start).astype(np.uint64)
    return mix(h + copy * np.uint64(0x9E3779B97F4A7C15)), o
