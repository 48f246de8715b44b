"""Vectorised text primitives used inside tasks: byte buffers, words, rolling hashes.

Texts of a batch are laid end to end in one byte buffer, so that one NumPy call
works on all of them. ``spans`` keeps such buffers small whatever the batch.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np

#: Bytes of text laid out at once. One longer text is laid out alone.
SPAN_BYTES = 1_000_000

_ODD = np.uint64(0x9E3779B97F4A7C15)


def encoded(texts: Sequence[str | None]) -> list[bytes]:
    """UTF-8 of every text, a missing one as the empty text."""
    return [b"" if t is None or t != t else t.encode("utf-8", "surrogatepass") for t in texts]


def spans(sizes: Sequence[int], limit: int = SPAN_BYTES) -> Iterator[slice]:
    """Slices of consecutive rows whose sizes add up to at most ``limit`` or hold one row."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield slice(start, i)
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield slice(start, len(sizes))


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble unsigned 64-bit values so that every bit depends on all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


@lru_cache(maxsize=8)
def random_table(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 2**63, size, dtype=np.uint64) | np.uint64(1)


_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = np.uint64(pow(int(_ODD), -1, 2**64))
        for k, base in enumerate((_ODD, inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[k] = np.cumprod(steps)
    return _powers[0], _powers[1]


class Words:
    """Words of several texts: byte positions, owning text and hash of each.

    Words are maximal runs of bytes outside space and 0x09-0x0D.
    """

    SPACE = np.zeros(256, bool)
    SPACE[[0x20, *range(0x09, 0x0E)]] = True

    def __init__(self, texts: Sequence[bytes]):
        self.buffer = np.frombuffer(b"\n".join(texts) + b"\n" if texts else b"", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.text_start = np.concatenate([[0], np.cumsum(lengths + 1)])[:-1] if len(texts) else np.zeros(0, np.int64)
        space = self.SPACE[self.buffer]
        edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
        self.start, self.end = edge[0::2], edge[1::2]
        self.text = np.searchsorted(self.text_start, self.start, "right") - 1
        self.count = np.bincount(self.text, minlength=len(texts))
        self.first = np.concatenate([[0], np.cumsum(self.count)]).astype(np.int64)

    @classmethod
    def slices(cls, raw: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of every piece ``raw[start[i]:end[i]]``."""
        bare = cls.__new__(cls)
        bare.buffer = np.frombuffer(raw, np.uint8)
        return bare.hash_of(start, end)

    def prefix(self) -> np.ndarray:
        if not hasattr(self, "_prefix"):
            table = random_table(256, 11)
            up, _ = _power_tables(len(self.buffer) + 1)
            self._prefix = np.concatenate([[np.uint64(0)], np.cumsum(table[self.buffer] * up[: len(self.buffer)], dtype=np.uint64)])
        return self._prefix

    def hash_of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the bytes between two positions, wherever they stand."""
        prefix = self.prefix()
        _, down = _power_tables(len(self.buffer) + 1)
        return mix((prefix[end] - prefix[start]) * down[start] + (end - start).astype(np.uint64))

    def hashes(self) -> np.ndarray:
        return self.hash_of(self.start, self.end)


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n neighbouring entries; entry i covers i to i+n-1."""
    size = len(hashes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    keys = random_table(max(n, 8), 23)
    total = np.zeros(size, np.uint64)
    for k in range(n):
        total += hashes[k : k + size] * keys[k]
    return mix(total)


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of ``values[first[i]:first[i+1]]`` for every i; empty ranges give 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.float64)])
    return total[first[1:]] - total[first[:-1]]
