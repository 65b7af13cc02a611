"""Content-defined anchors: places chosen by the bytes around them, so that equal strings have equal anchors.

A string of ``span`` bytes holds span - gram + 1 grams of ``gram`` bytes. Its anchor is the gram with the least hash
(the first of equal ones); equal strings have it at the same distance. Consecutive strings mostly share their anchor, so
a text has one anchor in about (span - gram) / 2 bytes, and every start of a string belongs to exactly one anchor.
"""

from __future__ import annotations

import functools

import numpy as np

BASE = 0x9E3779B97F4A7C15 | 1


@functools.cache
def _tables(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A random number for each byte, powers of the base and of its inverse modulo 2**64."""
    inverse = pow(BASE, -1, 1 << 64)
    up, down = np.full(n + 1, BASE, dtype=np.uint64), np.full(n + 1, inverse, dtype=np.uint64)
    up[0] = down[0] = 1
    byte = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return byte, np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


class Hashes:
    """Hashes of any slices of some bytes."""

    def __init__(self, data: np.ndarray):
        size = 1 << max(16, int(len(data)).bit_length())
        byte, self.up, self.down = _tables(size)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(byte[data] * self.up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[: len(self.sums) - n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    step = 1
    while step * 2 <= width:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    rest = width - step
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def anchors(data: np.ndarray, ends: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """Anchors of texts laid end to end: gram hash, context hash, first start, number of starts, and the starts' text.

    The context of an anchor is the bytes that its strings cover; its hash also tells where in it the anchor lies.
    ``data`` must be shorter than 2**24 bytes.
    """
    none = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), *[np.zeros(0, np.int64)] * 3)
    if len(data) < span:
        return none
    hashes = Hashes(data)
    grams = hashes.grams(gram)
    place = np.uint64((1 << 24) - 1)
    keyed = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    least = sliding_min(keyed, span - gram + 1) & place  # by start of a string
    starts = np.concatenate([[0], ends[:-1]])
    lengths = ends - starts
    whole = lengths >= span
    text = np.repeat(np.flatnonzero(whole), (lengths - span + 1)[whole])
    if not len(text):
        return none
    first = np.repeat(starts[whole] - np.concatenate([[0], np.cumsum((lengths - span + 1)[whole])[:-1]]), (lengths - span + 1)[whole])
    at = first + np.arange(len(text))
    own = least[at].astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (text[1:] != text[:-1])]))
    count = np.diff(np.concatenate([new, [len(at)]]))
    low, anchor = at[new], own[new]
    context = hashes.of(low, low + count - 1 + span) ^ mix((count * 4096 + anchor - low).astype(np.uint64))
    return grams[anchor], context, low, count, text[new]
