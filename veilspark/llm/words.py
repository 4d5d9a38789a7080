"""Words of UTF-8 texts and their 64-bit fingerprints, for whole batches at a time."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

_ODD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A well-mixing bijection of 64-bit numbers."""
    x = x + _ODD
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def letters() -> np.ndarray:
    """Byte table: ASCII letters and every byte of a non-ASCII character."""
    table = np.zeros(256, bool)
    table[65:91] = table[97:123] = table[128:] = True
    return table


def alphanumerics() -> np.ndarray:
    """Byte table of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after A-Z became lower case."""
    table = letters()
    table[48:58] = True
    return table


def printables() -> np.ndarray:
    """Byte table of ``[^\\x20\\x09-\\x0D]``."""
    table = np.ones(256, bool)
    table[32] = False
    table[9:14] = False
    return table


def lower_bytes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


class Words(NamedTuple):
    starts: np.ndarray  # byte positions
    ends: np.ndarray
    first: np.ndarray  # of each text the index of its first word, and the number of words at the end
    prints: np.ndarray  # 64-bit fingerprints of the lower-cased words


def _powers(n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n - 1, _M1))])


def find_words(data: np.ndarray, borders: np.ndarray, table: np.ndarray, window: int = 1 << 20) -> Words:
    """All words of the texts between ``borders``; temporary memory is bounded by ``window``."""
    lower, of_byte = lower_bytes(), mix(np.arange(256, dtype=np.uint64))
    powers = _powers(64)
    starts, ends, prints = [], [], []
    lo, n = 0, len(data)
    while lo < n:
        hi = min(lo + window, n)
        is_word = table[data[lo:hi]]
        while hi < n:  # end behind a byte that is no word, or at a text's border
            gaps = np.flatnonzero(~is_word[-4096:])
            border = borders[np.searchsorted(borders, hi, "right") - 1]
            if len(gaps):
                hi = hi - len(is_word[-4096:]) + int(gaps[-1]) + 1
                break
            if border > lo:
                hi = int(border)
                break
            hi = min(hi + window, n)
            is_word = table[data[lo:hi]]
        is_word = is_word[: hi - lo]
        begins, stops = is_word.copy(), is_word.copy()
        begins[1:] &= ~is_word[:-1]
        stops[:-1] &= ~is_word[1:]
        inside = borders[np.searchsorted(borders, lo, "left") : np.searchsorted(borders, hi, "right")] - lo
        heads, tails = inside[inside < hi - lo], inside[inside > 0] - 1
        begins[heads] = is_word[heads]
        stops[tails] = is_word[tails]
        a, b = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        if len(a):
            lengths = b - a
            segments = np.cumsum(lengths) - lengths
            place = np.arange(int(lengths.sum())) - np.repeat(segments, lengths)
            if lengths.max() > len(powers):
                powers = _powers(int(lengths.max()))
            values = of_byte[lower[data[lo:hi][is_word]]] * powers[place]
            prints.append(mix(np.add.reduceat(values, segments) ^ (lengths.astype(np.uint64) * _M2)))
            starts.append(a + lo)
            ends.append(b + lo)
        lo = hi
    empty = np.empty(0, np.int64)
    starts = np.concatenate(starts) if starts else empty
    return Words(
        starts,
        np.concatenate(ends) if ends else empty,
        np.searchsorted(starts, borders),
        np.concatenate(prints) if prints else np.empty(0, np.uint64),
    )


def shingle_prints(prints: np.ndarray, width: int) -> np.ndarray:
    """Fingerprints of every ``width`` consecutive words, borders of texts ignored."""
    n = len(prints) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(n, np.uint64)
    factor = _ODD
    for i in range(width):
        total += prints[i : i + n] * factor
        factor = np.uint64((int(factor) * int(_M1)) & 0xFFFFFFFFFFFFFFFF)
    return mix(total ^ np.uint64(width))
