r"""Word shingles of texts in numpy: words ``[^\x20\x09-\x0D]+`` with A-Z lower-cased, five at a time."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np

WORDS = 5
#: Bytes of text that are hashed together, about.
BLOCK_BYTES = 1 << 18

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Value of each byte (A-Z as a-z); which bytes part words."""
    low = np.arange(256)
    low[65:91] += 32
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    return mixed(low.astype(_U) + _U(1)), space


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * BLOCK_BYTES)
        _powers[:] = [np.concatenate([np.ones(1, _U), np.full(size - 1, b, _U)]).cumprod(dtype=_U) for b in (_U(_BASE), _U(_INVERSE))]
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word in data (UTF-8 bytes)."""
    values, space = _tables()
    gap = space[data]
    edge = np.diff(np.concatenate([[True], gap, [True]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum(values[data] * up[: len(data)], out=sums[1:])
    return mixed((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(_U)), begin


def shingle_hashes(words: np.ndarray) -> np.ndarray:
    """Hash of every run of five words; of the whole sequence if it is shorter; nothing without words."""
    k = min(WORDS, len(words))
    if not k:
        return words
    n = len(words) - k + 1
    h = np.full(n, k, _U)
    for i in range(k):
        h = mixed(h * _U(_BASE) + words[i : i + n])
    return h


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (stop == at or size + len(texts[stop]) < BLOCK_BYTES):
            size += len(texts[stop]) + 1
            stop += 1
        data = np.frombuffer(b" ".join(texts[at:stop]), np.uint8)
        words, begin = word_hashes(data)
        ends = np.cumsum([len(x) + 1 for x in texts[at:stop]])
        cuts = np.searchsorted(begin, np.concatenate([[0], ends]))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            yield np.unique(shingle_hashes(words[a:b]))
        at = stop
