"""Token ids of a public byte-level vocabulary, by merging each distinct word once.

Texts are cut into pre-tokens with NumPy, distinct ones are told apart byte
for byte, and each is encoded once: with ranks where the vocabulary numbers
its merges in order, else with the vocabulary's own library. Only texts that
hold one of the vocabulary's added tokens go to that library whole.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa

from .shingle import CHUNK, dictionary, keys

#: Place of the vocabulary that tokens are counted with.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
_LETTER, _NUMBER, _OTHER, _WHITE = 0, 1, 2, 3
_POINTS = 0x110000
_KINDS: list[np.ndarray] = []
#: The white space of the vocabulary's splitting pattern, and what its contractions have after the apostrophe.
_SPACES = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Distinct words of up to 16 bytes whose ids a worker keeps.
_KEEP = 1 << 19


def _kinds() -> np.ndarray:
    if not _KINDS:
        first = np.array([unicodedata.category(chr(c))[0] for c in range(_POINTS)])
        kind = np.full(_POINTS, _OTHER, np.uint8)
        kind[first == "L"], kind[first == "N"] = _LETTER, _NUMBER
        kind[_SPACES] = _WHITE
        _KINDS.append(kind)
    return _KINDS[0]


def boundaries(code: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where pre-tokens begin in texts given as code points, text i from offsets[i].

    Runs of one kind; a run takes the one space before it, other white space
    is on its own; a contraction ends the run that its letters begin.
    """
    kind, n = _kinds()[code], len(code)
    new = np.ones(n, bool)
    new[1:] = kind[1:] != kind[:-1]
    inner = offsets[:-1][offsets[:-1] < n]
    new[inner] = True
    white = kind == _WHITE
    last = np.zeros(n, bool)  # white space right before a run of another kind, in the same text
    last[:-1] = white[:-1] & ~white[1:]
    last[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < n)] - 1] = False
    new |= last
    joined = np.flatnonzero(last & (code == 32)) + 1
    new[joined] = False
    quote = np.flatnonzero(new & (code == 39))
    if len(quote):
        ends = offsets[np.searchsorted(offsets, quote, "right")]
        padded = np.concatenate([code, np.zeros(2, code.dtype)])
        for letters in _CONTRACTIONS:
            stop = quote + 1 + len(letters)
            hit = stop <= ends
            for k, letter in enumerate(letters, 1):
                hit &= padded[quote + k] == ord(letter)
            at, stop = quote[hit], stop[hit]
            new[at + 1] = False
            after = stop[stop < ends[hit]]
            new[after[kind[after] == _LETTER]] = True
    return np.flatnonzero(new)


def _byte_of() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself, or from U+0100 on in order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _word_encoder(name: str, library) -> Callable[[list[bytes]], list[list[int]]]:
    with open(name, encoding="utf-8") as f:
        model = json.load(f)["model"]
    vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    numbers = [vocab.get("".join(m)) for m in merges]
    if None in numbers or numbers != sorted(numbers):
        return lambda words: [x.ids for x in library.encode_batch([w.decode() for w in words], add_special_tokens=False)]
    import tiktoken

    of = _byte_of()
    ranks = {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token) and i <= numbers[-1]}
    core = tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})._core_bpe
    return lambda words: [core.encode_single_piece(w) for w in words]


def encoder(name: str) -> Callable[[pa.Array], Iterator[np.ndarray]]:
    """A function from a text column to the ids of each text, equal to the library's without special tokens added."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(name)
    added = [t.content for t in library.get_added_tokens_decoder().values()]
    odd = re.compile("|".join(map(re.escape, added)) or r"(?!)")
    merge = _word_encoder(name, library)
    # The ids of kept words: sorted first keys, second keys, where each word's ids begin, and the ids.
    first, second, ptr, held = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32)

    def ids_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each distinct word where its ids begin and how many there are, and ids that hold them."""
        nonlocal first, second, ptr, held
        key, exact = keys(words)
        at = np.searchsorted(first, key[:, 0])
        known = exact & (at < len(first))
        known[known] = (first[at[known]] == key[known, 0]) & (second[at[known]] == key[known, 1])
        fresh = np.flatnonzero(~known)
        got = merge(words.take(pa.array(fresh)).to_pylist())
        size, begin = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size[fresh] = list(map(len, got))
        new = np.fromiter(chain.from_iterable(got), np.uint32, int(size.sum()))
        begin[fresh] = len(held) + np.cumsum(size[fresh]) - size[fresh]
        begin[known], size[known] = ptr[at[known]], ptr[at[known] + 1] - ptr[at[known]]
        every = np.concatenate([held, new])
        keep = np.flatnonzero(~known & exact)
        if len(keep):
            old = len(first) if len(first) + len(keep) <= _KEEP else 0
            key = np.concatenate([np.stack([first, second], axis=1)[:old], key[keep]])
            start, n = np.concatenate([ptr[:-1][:old], begin[keep]]), np.concatenate([np.diff(ptr)[:old], size[keep]])
            order = np.argsort(key[:, 0], kind="stable")[:_KEEP]
            n = n[order]
            first, second, ptr = key[order, 0], key[order, 1], np.concatenate([[0], np.cumsum(n)])
            held = every[np.repeat(start[order] - ptr[:-1], n) + np.arange(ptr[-1])]
        return begin, size, every

    def look_up(texts: list[str]) -> list[np.ndarray]:
        offsets = np.cumsum([0, *map(len, texts)])
        whole = "".join(texts)
        code = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
        if not len(code):
            return [np.zeros(0, np.uint32) for _ in texts]
        starts = boundaries(code, offsets)
        cuts = np.append(starts, len(code))
        if not whole.isascii():
            more = (code >= 0x80).astype(np.uint8) + (code >= 0x800) + (code >= 0x10000)
            cuts = cuts + np.concatenate([[0], np.cumsum(more, dtype=np.int64)])[cuts]
        words, back = dictionary(whole.encode(), cuts)
        begin, size, every = ids_of(words)
        n = size[back]
        sums = np.concatenate([[0], np.cumsum(n)])
        out = every[np.repeat(begin[back] - sums[:-1], n) + np.arange(sums[-1])]
        cut = sums[np.searchsorted(starts, offsets)]
        return [out[i:j] for i, j in zip(cut[:-1], cut[1:], strict=True)]

    def encode(column: pa.Array) -> Iterator[np.ndarray]:
        texts = [x or "" for x in column.to_pylist()]
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) <= CHUNK):
                size += len(texts[j])
                j += 1
            plain = [k for k in range(i, j) if not odd.search(texts[k])]
            found = dict(zip(plain, look_up([texts[k] for k in plain]), strict=True))
            for k in range(i, j):
                yield found[k] if k in found else np.array(library.encode(texts[k], add_special_tokens=False).ids, np.uint32)
            i = j

    return encode
