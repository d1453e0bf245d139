"""SentencePiece encoding and decoding by a batched numpy Viterbi search.

For a BPE model the library's encoding of a prefix ends in the one piece that is
compatible with the last piece of what stands before it: the two, merged by rank from
their characters, stay two. So a Viterbi search over (position, last piece), whose
transitions score 0 where compatible and minus infinity elsewhere, finds the library's
ids. (Maximal sums of piece scores, the rule of unigram models, are not these ids.)
A batch's distinct chunks are grouped by their number of code points, and the chunks
of a group advance together: hashes of the substrings that end at a position probe the
sorted piece keys, and the maxima over their scores store the backpointers. A character
without a piece becomes its UTF-8 bytes' pieces, and is compatible with everything; any
path through pieces scores above it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame

from tangentia.llm.pieces import Pieces, chunks, code_points, spaced, text_key
from tangentia.llm.runtime import prepared, text_slices
from tangentia.llm.token_counts import Merges, merged_counts, plain_spaces
from tangentia.llm.words import U64, mix, span_hashes, text_bytes

BASE = U64(0x9E3779B97F4A7C15)
#: Cells of a group of chunks that advance together.
CELLS = 1 << 18
#: Text bytes that are encoded at once; about 60 times as much memory is used.
ENCODE_SLICE = 2 << 20
#: Score of a character without a piece.
UNKNOWN_SCORE = np.float32(-1)
#: Slots of the table of pairs whose compatibility is known; a full slot is overwritten.
SLOTS = 1 << 20
SIEVE = 1 << 20


@dataclass
class Codec:
    keys: np.ndarray  #: sorted hashes of the pieces that BPE can end in
    symbols: np.ndarray  #: their symbols in merges
    sieve: np.ndarray  #: by a hash's low bits: a key may have them
    lengths: np.ndarray  #: code points of pieces that exist, ascending
    merges: Merges
    spelling: np.ndarray  #: all symbols' characters, as symbols
    spelling_at: np.ndarray
    piece_of: np.ndarray  #: by symbol: the id
    byte_ids: np.ndarray
    blob: np.ndarray  #: all pieces' bytes, spaces as spaces
    blob_at: np.ndarray
    seen: np.ndarray
    fits: np.ndarray

    @classmethod
    def of(cls, pieces: Pieces) -> Codec:
        merges = Merges.of(pieces)
        codes = [np.frombuffer(pieces.texts[i].encode("utf-32-le"), np.uint32) for i in pieces.plain]
        spelling_at = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
        spelling = merges.char_ids[np.searchsorted(merges.chars, np.concatenate(codes))]
        own = np.flatnonzero(merged_counts(merges, spelling, spelling_at) == 1)
        keys = np.array([text_key(codes[k]) for k in own], U64)
        order = np.argsort(keys)
        keys = keys[order]
        if (keys[1:] == keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        sieve = np.zeros(SIEVE, bool)
        sieve[(keys & U64(SIEVE - 1)).astype(np.int64)] = True
        parts = [t.replace("▁", " ").encode() if k == 1 else (bytes([int(t[3:-1], 16)]) if k == 6 else b"") for t, k in zip(pieces.texts, pieces.kinds)]
        return cls(
            keys, own[order], sieve, np.unique([len(c) for c in codes]), merges, spelling, spelling_at, pieces.plain.astype(np.int32), pieces.byte_ids,
            np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]), np.full(SLOTS, -1), np.zeros(SLOTS, bool),
        )

    def probe(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, symbol) of the keys that are pieces."""
        row = np.flatnonzero(self.sieve[(key & U64(SIEVE - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, key[row]), len(self.keys) - 1)
        hit = self.keys[at] == key[row]
        return row[hit], self.symbols[at[hit]]

    def compatible(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether the two pieces, merged from their characters, stay these two; negative symbols always do."""
        out = (left < 0) | (right < 0)
        ask = np.flatnonzero(~out)
        key = left[ask].astype(np.int64) << 32 | right[ask]
        slot = (mix(key) >> U64(44)).astype(np.int64)
        known = self.seen[slot] == key
        out[ask[known]] = self.fits[slot[known]]
        if not known.all():
            fresh, inverse = np.unique(key[~known], return_inverse=True)
            a, b = fresh >> 32, fresh & 0xFFFFFFFF
            both = np.stack([a, b], 1).ravel()
            size = np.diff(self.spelling_at)[both]
            ends = np.concatenate([[0], np.cumsum(size)])
            chars = self.spelling[np.repeat(self.spelling_at[both] - ends[:-1], size) + np.arange(ends[-1])]
            heads = np.full(len(fresh), -1)
            fit = (merged_counts(self.merges, chars, ends[::2], heads) == 2) & (heads == a)
            slot = (mix(fresh) >> U64(44)).astype(np.int64)
            self.seen[slot] = fresh
            good = np.flatnonzero(self.seen[slot] == fresh)
            self.fits[slot[good]] = fit[good]
            out[ask[~known]] = fit[inverse]
        return out

    def advance(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(back, last) for chunks of equal length, one a row: by end, the last piece's length and its symbol or -1."""
        m, n = codes.shape
        symbol = mix((codes.T.astype(U64) + U64(1)).ravel()).reshape(n, m)
        prefix = np.zeros((n + 1, m), U64)
        power = np.ones(n + 1, U64)
        for j in range(n):
            prefix[j + 1] = prefix[j] * BASE + symbol[j]
            power[j + 1 : j + 2] = power[j : j + 1] * BASE
        back, last = np.ones((n + 1, m), np.int32), np.full((n + 1, m), -1, np.int32)
        best = np.zeros((n + 1, m), np.float32)
        for j in range(1, n + 1):
            ks = self.lengths[self.lengths <= j]
            hit, piece = self.probe((prefix[j] - prefix[j - ks] * power[ks][:, None]).ravel())
            of, row = hit // m, hit % m
            size = ks[of]
            fit = (size == j) | self.compatible(last[j - size, row], piece)
            score = np.full((len(ks), m), -np.inf, np.float32)
            ids = np.zeros((len(ks), m), np.int32)
            score[of[fit], row[fit]] = best[j - size[fit], row[fit]]
            ids[of, row] = piece
            which, every = score.argmax(0), np.arange(m)
            most = score[which, every]
            known = most > -np.inf
            best[j] = np.where(known, most, best[j - 1] + UNKNOWN_SCORE)
            back[j], last[j] = np.where(known, ks[which], 1), np.where(known, ids[which, every], -1)
        return back.T, last.T

    def trace(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(chunk, piece or -1, code point's place) of all pieces of equally long chunks, in order."""
        back, piece = self.advance(codes)
        at = np.full(len(codes), codes.shape[1])
        live, out = np.arange(len(codes)), []
        while len(live):
            j = at[live]
            out.append((live, piece[live, j], j - 1))
            at[live] = j - back[live, j]
            live = live[at[live] > 0]
        rows, ids, place = (np.concatenate([x[i] for x in out[::-1]]) for i in range(3))
        order = np.lexsort((place, rows))
        return rows[order], ids[order], place[order]

    def encode_chunks(self, codes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of n + 1) of the chunks."""
        size = np.diff(first)
        got = []
        for n in np.unique(size[size > 0]):
            which = np.flatnonzero(size == n)
            step = max(1, CELLS // int(n))
            for i in range(0, len(which), step):
                own = which[i : i + step]
                grid = codes[first[own][:, None] + np.arange(n)]
                rows, ids, place = self.trace(grid)
                odd = np.flatnonzero(ids < 0)
                if len(odd):
                    count = np.ones(len(ids), np.int64)
                    spelt = [chr(c).encode() for c in grid[rows[odd], place[odd]]]
                    count[odd] = [len(b) for b in spelt]
                    rows = np.repeat(rows, count)
                    ids = np.repeat(ids, count)
                unknown = ids < 0
                ids = self.piece_of[ids]
                if len(odd):
                    ids[unknown] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
                got.append((own[rows], ids))
        if not got:
            return np.empty(0, np.int32), np.zeros(len(size) + 1, np.int64)
        chunk, ids = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
        order = np.argsort(chunk, kind="stable")
        return ids[order], np.concatenate([[0], np.cumsum(np.bincount(chunk, minlength=len(size)))])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets of n + 1) of the texts."""
        raw, offsets = spaced(*text_bytes(column))
        begin, end, first = chunks(raw, offsets)
        if not len(begin):
            return np.empty(0, np.int32), np.zeros(len(offsets), np.int64)
        _, example, which = np.unique(span_hashes(raw, begin, end), return_index=True, return_inverse=True)
        ids, at = self.encode_chunks(*code_points(raw, begin[example], end[example]))
        size = np.diff(at)[which]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(at[which] - ends[:-1], size) + np.arange(ends[-1])
        return ids[place], ends[first]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        """The texts; bytes that aren't UTF-8 become U+FFFD."""
        size = np.diff(self.blob_at)[ids]
        ends = np.concatenate([[0], np.cumsum(size)])
        place = np.repeat(self.blob_at[ids] - ends[:-1], size) + np.arange(ends[-1])
        raw, cuts = self.blob[place], ends[offsets]
        full = np.diff(cuts) > 0
        lead = np.zeros(len(cuts) - 1, bool)
        lead[full] = raw[cuts[:-1][full]] == 0x20
        drop = cuts[:-1][lead]
        raw = np.delete(raw, drop)
        cuts = cuts - np.concatenate([[0], np.cumsum(lead)])
        out = pa.Array.from_buffers(pa.large_binary(), len(cuts) - 1, [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])
        try:
            return out.cast(pa.large_string())
        except pa.ArrowInvalid:
            return pa.array([b.decode("utf-8", "replace") for b in out.to_pylist()], pa.large_string())


@lru_cache(maxsize=2)
def codec_of(model_path: str) -> Codec:
    """One codec for each model and worker process, which serves all tasks of the worker."""
    return Codec.of(Pieces.load(model_path))


def encode_pieces(docs: DataFrame, model_path: str, text_col: str = "text", out_col: str = "piece_ids", verify: bool = False) -> DataFrame:
    """The rows of docs with a column `out_col`: array of the text's piece ids, without begin and end marks.

    The ids are those of the model's library. Null and empty texts give an empty array. A column of that name is replaced; all others
    stay. Texts are never cut; a U+2581 in a text is a space to the format. With verify,
    `round_trip` tells whether decoding the ids gives the text again (null: true).
    A narrow pass without a shuffle.
    """
    return _mapped(docs, model_path, text_col, out_col, "array<int>", verify)


def _mapped(docs: DataFrame, model_path: str, col: str, out_col: str, kind: str, verify: bool = False) -> DataFrame:
    prepared(docs.sparkSession)
    rest = docs.drop(out_col, *(["round_trip"] if verify else []))
    base = rest if col in rest.columns else rest.withColumn(col, docs[col])
    schema = f"{base._jdf.schema().toDDL()}, `{out_col}` {kind}" + ", round_trip boolean" * verify

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in text_slices(batches, col, ENCODE_SLICE):
            texts = plain_spaces(batch.column(col))
            ids, at = codec.encode(texts)
            more = [pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))]
            if verify:
                again = codec.decode(ids, at)
                more.append(pa.compute.equal(again, pa.compute.fill_null(batch.column(col).cast(pa.large_string()), "")))
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], [*batch.schema.names, out_col, *["round_trip"] * verify])

    return base.mapInArrow(run, schema)


def decode_pieces(rows: DataFrame, model_path: str, ids_col: str = "piece_ids", out_col: str = "decoded") -> DataFrame:
    """The rows with a column `out_col`: the text of their piece ids.

    Null gives the empty text; null ids and ids outside the model raise.
    """
    prepared(rows.sparkSession)
    base = rows.drop(out_col)
    schema = f"{base._jdf.schema().toDDL()}, `{out_col}` string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(model_path)
        for batch in batches:
            lists = batch.column(ids_col)
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = lists.flatten()
            if flat.null_count:
                raise ValueError("a null piece id")
            ids = flat.to_numpy(zero_copy_only=False)
            if len(ids) and not 0 <= ids.min() <= ids.max() < len(codec.blob_at) - 1:
                raise ValueError("a piece id outside the model")
            texts = codec.decode(ids, np.concatenate([[0], np.cumsum(size)]))
            yield pa.RecordBatch.from_arrays([*batch.columns, texts.cast(pa.string())], [*batch.schema.names, out_col])

    return base.mapInArrow(run, schema)
