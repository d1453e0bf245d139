"""Reading SentencePiece model files, and their view of a text as distinct chunks."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np

from tangentia.llm.words import U64, mix

#: Fixed values of the public model format: piece kinds.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SPACE = 0x2581  #: the format's mark for a space


def _number(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        value |= (x & 127) << shift
        i, shift = i + 1, shift + 7
        if x < 128:
            return value, i


def _fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    i = 0
    while i < len(b):
        key, i = _number(b, i)
        wire = key & 7
        if wire == 0:
            value, i = _number(b, i)
        else:
            n, i = _number(b, i) if wire == 2 else ({1: 8, 5: 4}[wire], i)
            value, i = b[i : i + n], i + n
        yield key >> 3, value


@dataclass
class Pieces:
    """A model's pieces. Only the identity normaliser is supported: others raise."""

    texts: list[str]
    scores: np.ndarray
    kinds: np.ndarray

    @classmethod
    def load(cls, path: str) -> Pieces:
        texts, scores, kinds = [], [], []
        with open(path, "rb") as f:
            blob = f.read()
        for field, value in _fields(blob):
            if field == 1:
                d = dict(_fields(value))
                texts.append(d[1].decode())
                scores.append(struct.unpack("<f", d[2])[0] if 2 in d else 0.0)
                kinds.append(d.get(3, NORMAL))
            elif field == 3:
                d = dict(_fields(value))
                if d.get(2) or d.get(4, 1):
                    raise ValueError("only models with the identity normaliser that keep all white space are supported")
        kinds = np.array(kinds)
        if (kinds == USER_DEFINED).any() or any("▁" in t.lstrip("▁") for t, k in zip(texts, kinds) if k == NORMAL):
            raise ValueError("user-defined pieces and pieces over a word's end are not supported")
        return cls(texts, np.array(scores), kinds)

    @cached_property
    def byte_ids(self) -> np.ndarray:
        """The id of each byte's fallback piece."""
        out = np.zeros(256, np.int32)
        for i in np.flatnonzero(self.kinds == BYTE):
            out[int(self.texts[i][3:-1], 16)] = i
        return out

    @cached_property
    def plain(self) -> np.ndarray:
        """Ids of the pieces that texts can contain."""
        return np.flatnonzero(self.kinds == NORMAL)


def spaced(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) with one space before each text that isn't empty."""
    full = np.flatnonzero(np.diff(offsets))
    out = np.insert(raw, offsets[full], 0x20)
    more = np.zeros(len(offsets), np.int64)
    more[full + 1] = 1
    return out, offsets + np.cumsum(more)


def chunks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, first) of the chunks of spaced() texts: spaces and what follows up to the next space.

    No piece crosses such a border, so that chunks can be encoded one by one.
    """
    gap = raw == 0x20
    start = gap.copy()
    start[1:] &= ~gap[:-1]
    start[offsets[:-1][np.diff(offsets) > 0]] = True
    begin = np.flatnonzero(start)
    return begin, np.append(begin[1:], len(raw)), np.searchsorted(begin, offsets)


def code_points(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code points, offsets) of the spans, spaces as SPACE."""
    size = end - begin
    at = np.repeat(begin - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    data = raw[at]
    codes = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).copy()
    codes[codes == 0x20] = SPACE
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return codes, heads[np.concatenate([[0], np.cumsum(size)])]


def byte_length(codes: np.ndarray) -> np.ndarray:
    return 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)


def text_key(codes: np.ndarray, base: np.uint64 = U64(0x9E3779B97F4A7C15)) -> np.uint64:
    """The polynomial hash that the encoder's prefix sums give for a whole string."""
    h = U64(0)
    with np.errstate(over="ignore"):
        for x in mix(codes.astype(U64) + U64(1)):
            h = h * base + x
    return h
