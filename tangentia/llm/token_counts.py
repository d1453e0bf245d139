"""Token counts by rank-synchronous array merging.

A batch's distinct chunks are held as one ragged array of symbols. In each step
every sequence merges its pair of the lowest rank, the leftmost of equal ones;
sequences without a pair leave with their number of symbols. This is what the
library's queue does, one sequence at a time, with the same result. Characters
that the model doesn't have count as their UTF-8 bytes (byte fallback).
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import DataFrame

from tangentia.llm.pieces import SPACE, Pieces, byte_length, chunks, code_points, spaced
from tangentia.llm.runtime import prepared, text_slices
from tangentia.llm.words import span_hashes, text_bytes

#: Sequences of more symbols are merged by a queue, as they would hold up the rest.
LONG = 2048
NONE = np.iinfo(np.int32).max
COUNT_SLICE = 4 << 20


@dataclass
class Merges:
    """Symbols are the single characters of pieces and the pieces."""

    chars: np.ndarray  #: sorted code points
    char_ids: np.ndarray
    known: np.ndarray  #: by symbol: it is a piece, else it falls back to bytes
    char_bytes: np.ndarray  #: by symbol: bytes of a single character
    pairs: np.ndarray  #: sorted left << 32 | right
    rank: np.ndarray
    merged: np.ndarray
    inner: np.ndarray  #: sorted first << 32 | second code point, of neighbours within pieces

    @classmethod
    def of(cls, pieces: Pieces) -> Merges:
        ids = {pieces.texts[i]: k for k, i in enumerate(pieces.plain)}
        n = len(ids)
        for c in sorted({c for t in ids for c in t}):
            ids.setdefault(c, len(ids))
        order = {s: k for k, s in enumerate(sorted({-pieces.scores[i] for i in pieces.plain}))}
        rows, inner = [], set()
        for i in pieces.plain:
            t, r = pieces.texts[i], order[-pieces.scores[i]]
            rows += [(ids[t[:k]] << 32 | ids[t[k:]], r, ids[t]) for k in range(1, len(t)) if t[:k] in ids and t[k:] in ids]
            inner.update(ord(a) << 32 | ord(b) for a, b in zip(t, t[1:]))
        rows.sort()
        pairs, rank, merged = (np.array(x) for x in zip(*rows))
        single = sorted(c for c in ids if len(c) == 1)
        size = np.ones(len(ids), np.int64)
        size[[ids[c] for c in single]] = [len(c.encode()) for c in single]
        return cls(np.array([ord(c) for c in single], np.uint32), np.array([ids[c] for c in single]), np.arange(len(ids)) < n, size, pairs, rank.astype(np.int32), merged, np.array(sorted(inner)))

    def of_pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank or NONE, index into merged) of neighbours; negative symbols merge with nothing."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        found = (self.pairs[at] == key) & (left >= 0) & (right >= 0)
        return np.where(found, self.rank[at], NONE), at


def _long_count(m: Merges, symbols: np.ndarray) -> int:
    """Tokens of one long sequence: the same merges by a queue over a linked list."""
    n = len(symbols)
    sym, after, before = symbols.tolist(), [*range(1, n), -1], [*range(-1, n - 1)]
    table = {}

    def look(a: int, b: int) -> tuple[int, int]:
        if (a, b) not in table:
            rank, at = m.of_pairs(np.array([a]), np.array([b]))
            table[a, b] = (int(rank[0]), int(m.merged[at[0]]))
        return table[a, b]

    queue = []

    def offer(i: int) -> None:
        if i >= 0 and after[i] >= 0 and (r := look(sym[i], sym[after[i]]))[0] != NONE:
            queue.append((r[0], i, sym[i], sym[after[i]]))

    for i in range(n):
        offer(i)
    heapq.heapify(queue)
    fresh: list = []
    while queue:
        _, i, a, b = heapq.heappop(queue)
        j = after[i] if sym[i] == a else -1
        if j < 0 or sym[j] != b:
            continue
        sym[i], sym[j] = look(a, b)[1], -2
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        fresh, queue_before = [], len(queue)
        for k in (before[i], i):
            if k >= 0 and after[k] >= 0 and (r := look(sym[k], sym[after[k]]))[0] != NONE:
                fresh.append((r[0], k, sym[k], sym[after[k]]))
        for x in fresh:
            heapq.heappush(queue, x)
    return sum(1 if m.known[s] else int(m.char_bytes[s]) for s in sym if s >= 0)


def merged_counts(m: Merges, symbols: np.ndarray, first: np.ndarray, heads: np.ndarray | None = None) -> np.ndarray:
    """Tokens of each sequence; first: offsets of n + 1; unknown characters are negative and count nothing.

    heads, if given, gets the first symbol of each result of sequences up to LONG.
    """
    size = np.diff(first)
    out = np.zeros(len(size), np.int64)
    for i in np.flatnonzero(size > LONG):
        out[i] = _long_count(m, symbols[first[i] : first[i + 1]])
    live = np.flatnonzero((size > 0) & (size <= LONG))
    keep = np.repeat((size > 0) & (size <= LONG), size)
    sym, size = symbols[keep], size[live]
    begin = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
    rank, at = np.full(len(sym), NONE, np.int32), np.zeros(len(sym), np.int64)
    if len(sym) > 1:
        rank[:-1], at[:-1] = m.of_pairs(sym[:-1], sym[1:])
        rank[begin[1:] - 1] = NONE
    weight = np.where(m.known, 1, m.char_bytes)
    while len(live):
        best = np.minimum.reduceat(rank, begin)
        over = best == NONE
        if over.any():
            worth = np.where(sym >= 0, weight[sym], 0)
            out[live[over]] = np.add.reduceat(worth, begin)[over]
            if heads is not None:
                heads[live[over]] = sym[begin[over]]
            stay = np.repeat(~over, size)
            sym, rank, at, live, size, best = sym[stay], rank[stay], at[stay], live[~over], size[~over], best[~over]
            begin = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
            if not len(live):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        seq = np.searchsorted(begin, hit, "right") - 1
        hit = hit[np.concatenate([[True], seq[1:] != seq[:-1]])]
        sym[hit] = m.merged[at[hit]]
        gone = np.ones(len(sym), bool)
        gone[hit + 1] = False
        last = hit + 1 == begin + size - 1
        now = hit - np.arange(len(hit))
        sym, rank, at, size = sym[gone], rank[gone], at[gone], size - 1
        begin = np.concatenate([[0], np.cumsum(size)])[:-1].astype(np.int64)
        rank[now] = NONE
        right = now[~last]
        rank[right], at[right] = m.of_pairs(sym[right], sym[right + 1])
        left = now[now > begin] - 1
        rank[left], at[left] = m.of_pairs(sym[left], sym[left + 1])
    return out


def count_tokens(m: Merges, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, tokens) of each text."""
    raw, offsets = text_bytes(column)
    n_bytes = np.diff(offsets)
    raw, offsets = spaced(raw, offsets)
    begin, end, first = chunks(raw, offsets)
    if not len(begin):
        return n_bytes, np.zeros(len(n_bytes), np.int64)
    key = span_hashes(raw, begin, end)
    _, example, which = np.unique(key, return_index=True, return_inverse=True)
    codes, at = code_points(raw, begin[example], end[example])
    place = np.minimum(np.searchsorted(m.chars, codes), len(m.chars) - 1)
    known = m.chars[place] == codes
    symbols = np.where(known, m.char_ids[place], -1)
    edge = np.zeros(len(codes) + 1, bool)
    edge[at] = True
    pair = codes[:-1].astype(np.int64) << 32 | codes[1:]
    spot = np.minimum(np.searchsorted(m.inner, pair), len(m.inner) - 1)
    edge[1:-1] |= m.inner[spot] != pair
    part = np.flatnonzero(edge)
    per_part = merged_counts(m, symbols, part)
    extra = np.concatenate([[0], np.cumsum(np.where(known, 0, byte_length(codes)))])
    total = np.concatenate([[0], np.cumsum(per_part)])
    per_chunk = np.diff(total[np.searchsorted(part, at)]) + np.diff(extra[at])
    sums = np.concatenate([[0], np.cumsum(per_chunk[which])])
    return n_bytes, np.diff(sums[first])


@lru_cache(maxsize=2)
def merges_of(model_path: str) -> Merges:
    """One table of merges for each model and worker process."""
    return Merges.of(Pieces.load(model_path))


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id, `n_bytes` (UTF-8) and `n_tokens`, as the model's library counts them.

    Null and empty texts have no bytes and no tokens. Rows stay as they are: repeated
    ids give repeated rows, a null id stays null; other columns are not read. Texts are
    never cut. One narrow pass without a shuffle; memory follows the longest text.
    """
    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = merges_of(model_path)
        for batch in text_slices(batches, "text", COUNT_SLICE):
            n_bytes, n_tokens = count_tokens(merges, plain_spaces(batch.column("text")))
            sizes = pa.compute.fill_null(pa.compute.binary_length(batch.column("text")), 0).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("id"), sizes, pa.array(n_tokens)], ["id", "n_bytes", "n_tokens"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long").withColumnRenamed("id", id_col)


def plain_spaces(column: pa.Array) -> pa.Array:
    """The format can't tell its space mark from a space."""
    return pa.compute.replace_substring(column, chr(SPACE), " ")
