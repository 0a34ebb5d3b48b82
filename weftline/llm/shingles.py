"""Word shingles of whole texts as sorted arrays of 64-bit hashes, without a Python step per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 5
#: Bytes of text that are hashed at a time.
BLOCK = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_VALUES = np.random.default_rng(20240601).integers(1 << 62, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    size, step = 1, base & (2**64 - 1)
    while size < n:
        take = min(size, n - size)
        out[size : size + take] = out[:take] * np.uint64(step)
        size, step = size + take, step * step & (2**64 - 1)
    return out


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of ``data`` (bytes), and where each begins."""
    space = _SPACE[data]
    before = np.concatenate(([True], space[:-1])) if len(data) else space
    starts = np.flatnonzero(before & ~space)
    after = np.concatenate((space[1:], [True])) if len(data) else space
    ends = np.flatnonzero(after & ~space) + 1
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[_LOWER[data]] * _powers(_BASE, len(data)), out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * _powers(_INVERSE, len(data) + 1)[starts]
    return mix(hashes + (ends - starts).astype(np.uint64)), starts


_WEIGHTS = np.random.default_rng(7).integers(1 << 62, 1 << 63, WORDS, dtype=np.uint64) | np.uint64(1)


def _of_words(words: np.ndarray, k: int) -> np.ndarray:
    if not len(words):
        return np.zeros(0, dtype=np.uint64)
    width = min(k, len(words))
    weights = _WEIGHTS if k == WORDS else np.random.default_rng(k).integers(1 << 62, 1 << 63, k, dtype=np.uint64) | np.uint64(1)
    total = np.zeros(len(words) - width + 1, dtype=np.uint64)
    for i in range(width):
        total += words[i : len(words) - width + 1 + i] * weights[i]
    return mix(total + np.uint64(width))


def shingle_sets(texts: list[bytes | None], k: int = WORDS) -> Iterator[np.ndarray]:
    """For each text (UTF-8) its distinct shingles of ``k`` words, as sorted hashes.

    Words are runs of anything but ASCII white space, with A-Z lower-cased. A text of fewer words has one
    shingle, all of them in order; a text without words, or none at all, has no shingle.
    """
    at = 0
    while at < len(texts):
        group, size = [], 0
        while at < len(texts) and (not group or size + len(texts[at] or b"") <= BLOCK):
            group.append(texts[at] or b"")
            size += len(group[-1]) + 1
            at += 1
        words, starts = word_hashes(np.frombuffer(b"\n".join(group) + b"\n", dtype=np.uint8))
        bounds = np.searchsorted(starts, np.cumsum([0, *(len(x) + 1 for x in group)]))
        for a, b in zip(bounds, bounds[1:]):
            yield np.unique(_of_words(words[a:b], k))
