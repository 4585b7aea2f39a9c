"""Word shingle sets and fast similarity sketches of a batch of texts, in numpy over UTF-8 bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; some ten arrays of 8 bytes for each live meanwhile.
CHUNK = 1 << 18
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_MULT = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, offsets of rows) of runs of rows of about `limit` bytes; a longer text stands alone."""
    arr = texts.cast(pa.large_binary())
    off = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(arr):
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def word_hashes(data: np.ndarray, off: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of consecutive texts, and the index of each text's first word (one more at the end).

    A single text of more than CHUNK bytes is hashed in pieces that end at blanks.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    if len(off) == 2 and len(data) > CHUNK:
        found, lo = [], 0
        while lo < len(data):
            blank = np.flatnonzero(_BLANK[data[lo + CHUNK : lo + 2 * CHUNK]])
            step = CHUNK
            while not len(blank) and lo + step < len(data):  # one word of more than CHUNK bytes
                step += CHUNK
                blank = np.flatnonzero(_BLANK[data[lo + step : lo + step + CHUNK]])
            hi = lo + step + int(blank[0]) if len(blank) else len(data)
            found.append(_word_hashes(data[lo:hi], np.array([0, hi - lo]), lower)[0])
            lo = hi
        h = np.concatenate(found)
        return h, np.array([0, len(h)])
    return _word_hashes(data, off, lower)


def _word_hashes(data: np.ndarray, off: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    if lower:
        data = _LOWER[data]
    inside = ~_BLANK[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[off] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | cut[1:-1]
    end[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(start), np.flatnonzero(end) + 1
    sizes = np.diff(np.concatenate(([0], start, [len(data)])))
    place = np.arange(len(data), dtype=np.uint64) - np.repeat(np.concatenate(([0], start)), sizes).astype(np.uint64)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(mix(place << np.uint64(8) | data), out=total[1:])  # every letter is mixed with its place before the sum, so no choice of letters makes sums meet
    h = mix(total[end] - total[start] + (end - start).astype(np.uint64))
    return h, np.searchsorted(start, off)


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """For each text the sorted distinct 64-bit hashes of its n-word shingles, in row order.

    Fewer words than n: one hash of the whole sequence; none: empty. Memory is bounded by a chunk or one text.
    """
    for _, _, data, off in chunks(texts):
        h, first = word_hashes(data, off)
        if len(h) >= n:
            acc = np.zeros(len(h) - n + 1, np.uint64)
            for k in range(n):
                acc += h[k : len(h) - n + 1 + k] * _MULT[k]
            acc = mix(acc)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= n:
                s = np.sort(acc[a : b - n + 1])
                yield s[np.concatenate(([True], s[1:] != s[:-1]))]
            elif b > a:
                yield mix(np.array([np.sum(h[a:b] * _MULT[: b - a])], np.uint64) + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketches of t coordinates (a power of two), one row per set; empty sets give the largest value.

    Round i < t throws each element into a hashed bin with a value in [i, i + 1); round i >= t gives bin
    i - t the smallest value of all elements, so every coordinate of a set with an element is filled after 2t rounds
    at most. A set leaves as soon as its bins are full: one round for |A| >> t log t.
    """
    out = np.full((len(sets), t), np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    row = np.repeat(np.arange(len(sets)), sizes)
    x = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    flat = out.reshape(-1)
    for i in range(2 * t):
        if not len(x):
            break
        h = mix(x + np.uint64((i * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % (1 << 64)))
        at = h & np.uint64(t - 1) if i < t else np.uint64(i - t)
        np.minimum.at(flat, row * t + np.asarray(at).astype(np.int64), (h >> np.uint64(12)) | np.uint64(i << 52))
        busy = (out == np.iinfo(np.uint64).max).any(axis=1)
        if not busy[row].all():
            stay = busy[row]
            x, row = x[stay], row[stay]
    return out


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int(np.count_nonzero(b[np.minimum(at, len(b) - 1)] == a)) if len(a) else 0
