"""Words, word hashes and shingle hashes of whole Arrow batches, without a Python loop over words.

Words are maximal runs of bytes other than U+0020 and U+0009 to U+000D; those
bytes never occur inside a multi-byte UTF-8 character. The distinct words of a
chunk are told apart byte for byte (a dictionary encoding) and get two hashes
of 64 bits: those of up to 16 bytes by a permutation of 128 bits, so no two
have the same pair, longer ones by keyed BLAKE2b. A shingle's hash mixes those
of its words, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from hashlib import blake2b

import numpy as np
import pyarrow as pa

_KEY = b"word hashes"
_ROUNDS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89)
#: By number of bytes, those of a word that are kept of eight.
_KEPT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)

#: Bytes of text that are worked on at once; one longer document is a chunk of its own.
CHUNK = 1 << 20


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x + np.uint64(salt)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k values in a row: runs of 1, 2, 4 ... values are made of two halves, and those that k's bits name are joined."""
    n = max(len(values) - k + 1, 0)
    out, done, length, part = np.full(n, k, np.uint64), 0, 1, values
    while done < k and n:
        if k & length:
            out = mix(out * _ODD + part[done : done + n])
            done += length
        if done < k:
            part = mix(part[:-length] * _ODD + part[length:])
            length *= 2
    return out


def keys(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each word of a large binary array, and which words are at most 16 bytes (without a zero byte): those share no pair."""
    _, offs, data = words.buffers()
    cuts = np.frombuffer(offs, np.int64)[words.offset : words.offset + len(words) + 1]
    size = np.diff(cuts)
    padded = np.concatenate([np.frombuffer(data, np.uint8)[: cuts[-1]] if data is not None else np.zeros(0, np.uint8), np.zeros(16, np.uint8)])
    eight = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    x = eight[cuts[:-1]] & _KEPT[np.minimum(size, 8)]
    y = eight[cuts[:-1] + np.minimum(size, 8)] & _KEPT[np.clip(size - 8, 0, 8)]
    for salt in _ROUNDS:
        x, y = y, x ^ mix(y, salt)
    exact = size <= 16
    zeros = np.flatnonzero(padded[: cuts[-1]] == 0)
    exact[np.searchsorted(cuts, zeros, "right") - 1] = False
    out = np.stack([x, y], axis=1)
    for i in np.flatnonzero(~exact):
        out[i] = np.frombuffer(blake2b(padded[cuts[i] : cuts[i + 1]].tobytes(), digest_size=16, key=_KEY).digest(), np.uint64)
    return out, exact


def dictionary(data: np.ndarray | bytes, cuts: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct words of data[cuts[i]:cuts[i + 1]], byte for byte, and the number of each word among them."""
    found = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(data)]).dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


class Words:
    """The words of several documents: word i is buf[starts[i]:ends[i]], document d has words ptr[d] to ptr[d+1]."""

    def __init__(self, buf: np.ndarray, offsets: np.ndarray, lower: bool = False):
        self.raw, self.buf, self.offsets = buf, _LOWER[buf] if lower else buf, offsets
        full = ~_SPACE[buf]
        first, last = full.copy(), full.copy()
        first[1:] &= ~full[:-1]
        last[:-1] &= ~full[1:]
        inner = offsets[(offsets > 0) & (offsets < len(buf))]
        first[inner] = full[inner]
        last[inner - 1] = full[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.starts, offsets)
        self._full = full

    @cached_property
    def distinct(self) -> tuple[pa.Array, np.ndarray]:
        """The distinct words, byte for byte, and the number of each word among them."""
        cuts = np.zeros(len(self.starts) + 1, np.int64)
        np.cumsum(self.ends - self.starts, out=cuts[1:])
        return dictionary(np.ascontiguousarray(self.buf[self._full]), cuts)

    @cached_property
    def _keys(self) -> np.ndarray:
        return keys(self.distinct[0])[0]

    def hashes(self, which: int = 0) -> np.ndarray:
        """One of each word's two hashes."""
        return self._keys[:, which][self.distinct[1]]

    def shingles(self, k: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of every run of k words in one document: hash, document, number of its first word."""
        n = np.maximum(np.diff(self.ptr) - k + 1, 0)
        doc = np.repeat(np.arange(len(n)), n)
        start = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return runs(hashes, k)[self.ptr[doc] + start], doc, start

    def numbered(self, k: int) -> list[np.ndarray]:
        """The set of runs of k words of each document as sorted numbers, the same number only for the same words.

        Fewer than k words: the whole sequence as one; none: empty. Numbers hold among these documents only.
        """
        one = self.distinct[1].astype(np.int64)
        kinds, run, out, taken = int(one.max(initial=0)) + 1, one, [], 0
        whole = {}
        for length in range(1, k):
            short = np.flatnonzero(np.diff(self.ptr) == length)
            for d in short:
                whole[d] = tuple(one[self.ptr[d] : self.ptr[d + 1]])
            run = np.unique(run[:-1] * kinds + one[length:], return_inverse=True)[1] if len(run) > 1 else run[:0]
        few = {x: -1 - i for i, x in enumerate(dict.fromkeys(whole.values()))}
        for d, n in enumerate(np.diff(self.ptr)):
            taken = self.ptr[d]
            out.append(np.unique(run[taken : taken + n - k + 1]) if n >= k else np.array([few[whole[d]]] if n else [], np.int64))
        return out


def flat(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a text column, and where each text begins, from 0. Null is empty."""
    text = (text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text).cast(pa.large_binary()).fill_null(b"")
    if isinstance(text, pa.ChunkedArray):
        text = text.combine_chunks()
    if not len(text):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = text.buffers()
    offsets = np.frombuffer(offs, np.int64)[text.offset : text.offset + len(text) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(text: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into chunks: first row, row after the last, bytes, offsets from 0."""
    whole, offsets = flat(text)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + CHUNK, "right")) - 1)
        j = min(j, n)
        yield i, j, whole[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


def documents(text: pa.Array, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    for i, j, buf, offsets in chunks(text):
        yield i, j, Words(buf, offsets, lower)


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)
