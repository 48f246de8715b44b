"""Public byte-level BPE inside tasks.

The tokenizer never joins what stands on the two sides of a lone space or a
lone line feed, so a text can be cut before each of them and the parts encoded
one by one. Words repeat, so the distinct parts of many texts are looked up
once, a worker keeps the ids of short parts it has met, the tokenizers library
encodes those it has not, and NumPy lays the ids out in the order of the texts.
"""

from __future__ import annotations

import os
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from worklens.llm.arrays import Words, encoded, spans

#: Bytes that the parts kept by a worker may take, and the longest part that is kept.
CACHE_BYTES = 32_000_000
KEEP_BYTES = 64
#: Bytes of text cut and laid out at once, and bytes of unknown parts encoded in one call.
SPAN_BYTES = 2_000_000
CALL_BYTES = 50_000

_BLANK = np.zeros(256, bool)
_BLANK[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
#: Unicode blanks beyond ASCII, in UTF-8.
_WIDE = [chr(c).encode() for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]


def _blank(buffer: np.ndarray) -> np.ndarray:
    """Which bytes belong to a blank character."""
    out = _BLANK[buffer]
    lead = np.flatnonzero((buffer == 0xC2) | ((buffer >= 0xE1) & (buffer <= 0xE3)))
    if len(lead):
        padded = np.concatenate([buffer, np.zeros(2, np.uint8)]).astype(np.uint32)
        two = padded[lead] << 8 | padded[lead + 1]
        three = two << 8 | padded[lead + 2]
        for code, n in ((two, 2), (three, 3)):
            known = [int.from_bytes(w, "big") for w in _WIDE if len(w) == n]
            at = lead[np.isin(code, known)]
            for k in range(n):
                out[at + k] = True
    return out


def _gather(pool: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """``pool[start[i] : start[i] + size[i]]`` for every i, end to end."""
    before = np.cumsum(size) - size
    return pool[np.repeat(start - before, size) + np.arange(int(size.sum()))]


class Kept:
    """Ids of parts by the parts' hashes, in sorted arrays; ``check`` tells apart parts that share a hash."""

    def __init__(self):
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def find(self, key: np.ndarray, check: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of every key, and whether it is there."""
        if not len(self.key):
            return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return place, (self.key[place] == key) & (self.check[place] == check)

    def add(self, key: np.ndarray, check: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Takes in parts with sorted keys; over ``CACHE_BYTES`` the earlier ones go."""
        if 32 * (len(self.key) + len(key)) + 4 * (len(self.pool) + len(ids)) > CACHE_BYTES:
            self.__init__()
        at = len(self.pool) + np.cumsum(size) - size
        joined = [np.concatenate(x) for x in ((self.key, key), (self.check, check), (self.at, at), (self.size, size))]
        order = np.argsort(joined[0], kind="stable")
        self.key, self.check, self.at, self.size = (x[order] for x in joined)
        self.pool = np.concatenate([self.pool, ids])


class PartEncoder:
    """Ids of whole texts; equal to encoding the text in one call.

    A part starts at a lone space or line feed, or at the start of its text.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The strings of special tokens in a text are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.kept = Kept()
        # A byte-level token is written with one character per byte.
        names = self.tokenizer.get_vocab()
        self.widths = np.zeros(max(names.values()) + 1, np.int64)
        self.widths[list(names.values())] = [len(name) for name in names]

    def _ids(self, text: bytes) -> np.ndarray:
        (call,) = self.tokenizer.encode_batch_fast([text.decode("utf-8", "surrogatepass")], add_special_tokens=False)
        return np.array(call.ids, "<u4")

    def _learn(self, buffer: np.ndarray, start: np.ndarray, end: np.ndarray, led: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each part has, and all ids. Parts that begin and end at a cut go through the tokenizer together."""
        size = np.zeros(len(start), np.int64)
        runs = []
        for i in np.flatnonzero(~led).tolist():
            ids = self._ids(buffer[start[i] : end[i]].tobytes())
            size[i] = len(ids)
            runs.append((np.array([i]), ids))
        joined = np.flatnonzero(led)
        length = (end - start)[joined]
        for some in spans(length.tolist(), CALL_BYTES):
            ids = self._ids(_gather(buffer, start[joined[some]], length[some]).tobytes())
            last = np.searchsorted(np.cumsum(self.widths[ids]), np.cumsum(length[some])) + 1
            size[joined[some]] = np.diff(last, prepend=0)
            runs.append((joined[some], ids))
        if not runs:
            return size, np.zeros(0, "<u4")
        # The ids stand in order of the calls: back to the order of the parts.
        order = np.concatenate([r[0] for r in runs])
        at = np.zeros(len(start), np.int64)
        at[order] = np.cumsum(size[order]) - size[order]
        return size, _gather(np.concatenate([r[1] for r in runs]), at, size)

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; a missing text is empty."""
        return self.encode_many([text])[0]

    def encode_many(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        raw = encoded(list(texts))
        out = []
        for some in spans([len(t) for t in raw], SPAN_BYTES):
            out += self._encode(raw[some])
        return out

    def _encode(self, texts: list[bytes]) -> list[np.ndarray]:
        whole = b"".join(texts)
        if not whole:
            return [np.zeros(0, "<u4") for _ in texts]
        buffer = np.frombuffer(whole, np.uint8)
        first = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        blank = _blank(buffer)
        cut = np.zeros(len(buffer) + 1, bool)
        cut[1:-2] = ((buffer[1:-1] == 0x20) | (buffer[1:-1] == 0x0A)) & ~(blank[:-2] | blank[2:])
        # A blank at the end of a text has no neighbour after it.
        cut[np.maximum(first[1:] - 1, 0)] = False
        opens = np.zeros(len(buffer) + 1, bool)
        opens[first] = True
        edge = np.flatnonzero(cut | opens)
        start, end = edge[:-1], edge[1:]
        key, place, inverse = np.unique(Words.slices(whole, start, end), return_index=True, return_inverse=True)
        a, b = start[place], end[place]
        check = (b - a).astype(np.uint64)
        for k in (0, 1, 2):
            check = check << np.uint64(16) | buffer[np.minimum(a + k, b - 1)].astype(np.uint64) << np.uint64(8) | buffer[np.maximum(b - 1 - k, a)]
        old, hit = self.kept.find(key, check)
        size, at = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64)
        size[hit], at[hit] = self.kept.size[old[hit]], self.kept.at[old[hit]]
        pool = self.kept.pool
        if not hit.all():
            new = np.flatnonzero(~hit)
            # Cut on both sides: a lone blank before it, no blank at its own end.
            led = ~opens[a[new]] & ~blank[b[new] - 1]
            size[new], ids = self._learn(buffer, a[new], b[new], led)
            at[new] = len(pool) + np.cumsum(size[new]) - size[new]
            pool = np.concatenate([pool, ids])
            keep = ((b - a)[new] <= KEEP_BYTES) & (self.kept.key[old[new]] != key[new] if len(self.kept.key) else True)
            kept = new[keep]
            self.kept.add(key[kept], check[kept], size[kept], _gather(pool, at[kept], size[kept]))
        ids = _gather(pool, at[inverse], size[inverse])
        before = np.concatenate([[0], np.cumsum(size[inverse])])
        edges = before[np.searchsorted(start, first)]
        return [ids[i:j] for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def encoder(path: str) -> PartEncoder:
    """The worker's encoder of a vocabulary file."""
    return PartEncoder(path)


def forget() -> None:
    """Give back what this worker keeps for encoding; other work in the same worker calls this first."""
    encoder.cache_clear()


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
