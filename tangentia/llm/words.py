"""Vectorised word splitting and hashing over Arrow string columns.

A batch of texts is one byte array; a word is a maximal run of bytes other than
the space and 0x09-0x0D, which in UTF-8 equals the pattern `[^\\x20\\x09-\\x0D]+`.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Longer words are hashed one by one.
LONG_WORD = 256
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets of n + 1) of a string column; null counts as empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def lowered(raw: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes as they are."""
    return np.where((raw >= 65) & (raw <= 90), raw + np.uint8(32), raw)


@dataclass
class Words:
    raw: np.ndarray  #: all texts' bytes
    begin: np.ndarray  #: byte offset of each word
    end: np.ndarray
    doc: np.ndarray  #: row of each word
    first: np.ndarray  #: n_docs + 1: index of each row's first word

    def __len__(self) -> int:
        return len(self.begin)

    def hashes(self, seed: int = 0) -> np.ndarray:
        return span_hashes(self.raw, self.begin, self.end, seed)


def split_words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    n_docs = len(offsets) - 1
    word = ~_SPACE[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = word[:-1], word[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    before[inner] = False
    after[inner - 1] = False
    begin, end = np.flatnonzero(word & ~before), np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(begin, offsets)
    return Words(raw, begin, end, np.repeat(np.arange(n_docs), np.diff(first)), first)


def span_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each byte span."""
    size = end - begin
    out = mix(size.astype(U64) + U64((seed * 0x9E3779B97F4A7C15 + 1) % 2**64))
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    live = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(live):
        left = np.minimum(size[live] - at, 8)
        chunk = eight[begin[live] + at] & (~U64(0) >> ((8 - left) * 8).astype(U64))
        out[live] = mix((out[live] ^ chunk) * U64(0x9E3779B97F4A7C15))
        at += 8
        live = live[size[live] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        out[i] = int.from_bytes(hashlib.blake2b(raw[begin[i] : end[i]].tobytes(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return out


def windows_of(words: Words, hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word's index, hash) of all windows of k words that lie in one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, U64)
    at = np.flatnonzero(words.doc[:n] == words.doc[k - 1 :])
    out = np.zeros(n, U64)
    for j in range(k):
        out = mix(out * U64(3) + hashes[j : j + n])
    return at, out[at]


def covered(n: int, begin: np.ndarray, k: np.ndarray | int) -> np.ndarray:
    """Which of n positions lie in a span [begin, begin + k)."""
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, begin, 1)
    np.add.at(step, np.minimum(begin + k, n), -1)
    return np.cumsum(step[:-1]) > 0


def as_long(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
