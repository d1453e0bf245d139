"""Benchmark decontamination by SimHash windows and multi-index Hamming search.

A benchmark item of L words is compared with every window of L consecutive words of every
text, and with the whole of a text that has fewer words, but enough to reach the threshold:
both are multisets of shingles of consecutive words, and their similarity is the weighted
Jaccard, sum of least over sum of largest multiplicities. Fingerprints of 128
bits, the signs of the shingles' summed +-1 vectors, choose the candidates: each is cut
into 8 blocks of 16 bits, and two fingerprints within the radius of 31 have a block that
differs in at most 31 // 8 = 3 bits. An index holds, by block, the items under all values
within 3 bits of theirs, so that looking up a window's 8 values gives all items within the radius;
of items that are not like the window 8 in 100 meet it, and their distances are counted. Similar texts of
0.8 are 19 bits apart on average, with a deviation of 4, so that the radius holds all but 2 in 1,000 of
those right at the threshold. Candidates are then verified exactly. A window that shares no shingle
with an item of its length has similarity 0, and no fingerprint is made for it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401  pa.ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.llm.runtime import prepared, saved, text_slices
from tangentia.llm.words import U64, Words, lowered, mix, split_words, text_bytes, windows_of

BLOCKS, BLOCK_BITS = 8, 16
RADIUS = 31
SHINGLE = 5
THRESHOLD = 0.8
#: Items that one pass holds; more are taken in further passes over the texts.
ITEMS_A_PASS = 1024
SIEVE = 1 << 22
#: Windows whose fingerprints are made at once.
PART = 1 << 14
#: Shingles of windows that are compared with an item at once.
CELLS = 1 << 20
_ONES = np.array([bin(x).count("1") for x in range(1 << BLOCK_BITS)], np.uint8)
_FLIPS = np.flatnonzero(_ONES <= RADIUS // BLOCKS).astype(np.uint16)


def split_lower(column: pa.Array) -> tuple[Words, np.ndarray]:
    raw, offsets = text_bytes(column)
    words = split_words(lowered(raw), offsets)
    return words, words.hashes()


def signs(hashes: np.ndarray) -> np.ndarray:
    """+-1 by bit of each hash and of its scrambled self."""
    both = np.stack([hashes, mix(hashes ^ U64(0x5851F42D4C957F2D))], 1)
    bits = np.unpackbits(both.view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


def fingerprints(sums: np.ndarray) -> np.ndarray:
    """Eight blocks a row: whether each of 128 sums is above 0."""
    return np.packbits(sums > 0, axis=1).view(np.uint16)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _ONES[a ^ b].sum(-1)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place) of all places of the ranges [low, high)."""
    n = high - low
    return np.repeat(np.arange(len(n)), n), np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())


@dataclass
class Index:
    """The items of one length in words, with their shingles (sorted, with multiplicities) and, by block, the sorted values that lead to them."""

    width: int
    k: int
    items: np.ndarray
    shingles: list[tuple[np.ndarray, np.ndarray]]
    prints: np.ndarray
    values: list[np.ndarray]
    owners: list[np.ndarray]

    @classmethod
    def of(cls, width: int, k: int, items: list[int], shingles: list[np.ndarray]) -> Index:
        prints = fingerprints(np.stack([signs(s).sum(0, dtype=np.int32) for s in shingles]))
        values, owners = [], []
        for b in range(BLOCKS):
            near = (prints[:, b, None] ^ _FLIPS).ravel()
            order = np.argsort(near, kind="stable")
            values.append(near[order])
            owners.append((order // len(_FLIPS)).astype(np.int32))
        return cls(width, k, np.array(items), [np.unique(s, return_counts=True) for s in shingles], prints, values, owners)

    def met(self, prints: np.ndarray) -> np.ndarray:
        """row * items + item of all pairs that the index leads to, sorted."""
        pairs = []
        for b in range(BLOCKS):
            row, place = spread(np.searchsorted(self.values[b], prints[:, b], "left"), np.searchsorted(self.values[b], prints[:, b], "right"))
            pairs.append(row * len(self.items) + self.owners[b][place])
        return np.unique(np.concatenate(pairs))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of all pairs within the radius."""
        row, item = np.divmod(self.met(prints), len(self.items))
        close = distance(prints[row], self.prints[item]) <= RADIUS
        return row[close], item[close]

    def similarities(self, keys: np.ndarray, start: np.ndarray, span: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Weighted Jaccard of each window, the shingles keys[start : start + span], with the item."""
        out = np.zeros(len(start))
        order = np.argsort(item, kind="stable")
        for own in np.split(order, np.flatnonzero(np.diff(item[order])) + 1) if len(order) else []:
            held, times = self.shingles[item[own[0]]]
            step = max(1, CELLS // int(span[own].max()))
            for i in range(0, len(own), step):
                some = own[i : i + step]
                row, place = spread(start[some], start[some] + span[some])
                key = keys[place]
                at = np.minimum(np.searchsorted(held, key), len(held) - 1)
                hit = held[at] == key
                n = np.bincount(row[hit] * len(held) + at[hit], minlength=len(some) * len(held)).reshape(len(some), -1)
                both = np.minimum(n, times).sum(1)
                out[some] = both / (span[some] + times.sum() - both)
        return out


def indexes(column: pa.Array, k: int) -> tuple[list[Index], np.ndarray]:
    """(indexes of a column's texts by length, sorted distinct shingles). Texts without words match nothing."""
    words, hashes = split_lower(column)
    by_width = defaultdict(lambda: ([], []))
    for i in range(len(column)):
        a, b = words.first[i], words.first[i + 1]
        if b > a:
            own = Words(words.raw, words.begin[a:b], words.end[a:b], np.zeros(b - a, np.int64), np.array([0, b - a]))
            size = min(k, int(b - a))
            by_width[int(b - a), size][0].append(i)
            by_width[int(b - a), size][1].append(windows_of(own, hashes[a:b], size)[1])
    found = [Index.of(w, size, *both) for (w, size), both in sorted(by_width.items())]
    return found, np.unique(np.concatenate([s for x in found for s, _ in x.shingles])) if found else np.empty(0, U64)


def window_starts(near: np.ndarray, first: np.ndarray, doc: np.ndarray, size: np.ndarray, width: int, k: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(first words, shingles) of the windows of `width` words that hold a shingle at one of `near`.

    A text of fewer words is one window if its shingles are enough for the threshold.
    """
    span = width - k + 1
    own = doc[near]
    short = np.unique(own[(size[own] < width) & ((size[own] - k + 1) / span >= threshold)])
    low = np.maximum(near - span + 1, first[doc[near]])
    high = np.minimum(near, first[doc[near]] + size[doc[near]] - width)
    step = np.zeros(len(doc) + 1, np.int64)
    ok = high >= low
    np.add.at(step, low[ok], 1)
    np.add.at(step, high[ok] + 1, -1)
    full = np.flatnonzero(np.cumsum(step[:-1]) > 0)
    starts = np.concatenate([full, first[short]])
    spans = np.concatenate([np.full(len(full), span), size[short] - k + 1])
    order = np.argsort(starts)
    return starts[order], spans[order]


def leaks(column: pa.Array, found: list[Index], known: np.ndarray, sieve: np.ndarray, threshold: float) -> list[np.ndarray]:
    """Columns row, item, first word, words, similarity: of the best window of each text and item, of equal ones the first."""
    words, hashes = split_lower(column)
    size = np.diff(words.first)
    at_of, got = {}, [(np.empty(0, np.int64),) * 4 + (np.empty(0),)]
    for index in found:
        if index.k not in at_of:
            at, key = windows_of(words, hashes, index.k)
            hit = sieve[(key & U64(SIEVE - 1)).astype(np.int64)]
            place = np.minimum(np.searchsorted(known, key[hit]), len(known) - 1)
            all_keys = np.zeros(len(words), U64)
            all_keys[at] = key
            good = known[place] == key[hit]
            at_of[index.k] = (at[hit][good], key[hit][good], all_keys)
        at, key, all_keys = at_of[index.k]
        near = at[np.isin(key, np.concatenate([s for s, _ in index.shingles]))] if len(at) else at
        if not len(near):
            continue
        starts, spans = window_starts(near, words.first, words.doc, size, index.width, index.k, threshold)
        for i in range(0, len(starts), PART):
            own, span = starts[i : i + PART], spans[i : i + PART]
            # Sums over windows from running sums over the words that they touch.
            touched = np.zeros((own + span).max() + 1 - own[0], bool)
            edge = np.zeros(len(touched) + 1, np.int64)
            np.add.at(edge, own - own[0], 1)
            np.add.at(edge, own - own[0] + span, -1)
            touched = np.cumsum(edge[:-1]) > 0
            row_of = np.cumsum(touched) - 1
            total = np.zeros((touched.sum() + 1, BLOCKS * BLOCK_BITS), np.int32)
            np.cumsum(signs(all_keys[own[0] + np.flatnonzero(touched)]), axis=0, out=total[1:])
            a = row_of[own - own[0]]
            row, item = index.candidates(fingerprints(total[a + span] - total[a]))
            s = index.similarities(all_keys, own[row], span[row], item)
            row, item, s = row[s >= threshold], item[s >= threshold], s[s >= threshold]
            doc = words.doc[own[row]]
            got.append((doc, index.items[item], own[row] - words.first[doc], span[row] + index.k - 1, s))
    doc, item, start, n, s = (np.concatenate(x) for x in zip(*got))
    order = np.lexsort((start, -s, item, doc))
    doc, item, start, n, s = (x[order] for x in (doc, item, start, n, s))
    first = np.ones(len(doc), bool)
    first[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])
    return [x[first] for x in (doc, item, start, n, s)]


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(id, item_id, first_word, n_words, similarity): per text and item its best window at or above the threshold.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased; items of fewer than `shingle` words are
    one shingle. Null and empty texts and items match nothing; repeated rows give repeated
    rows. Distinct rows of the benchmark are items of their own, whatever their ids, null ones
    included; rows that are alike are one. Other columns are not read. The items
    of one pass are ITEMS_A_PASS at most, which bounds their number, not their texts' lengths, in what executors get; a larger
    benchmark takes further passes over the texts. No shuffle.
    """
    spark = prepared(docs.sparkSession)
    kind, item_field = docs.schema[id_col].dataType.simpleString(), benchmark.schema[item_col]
    items = saved(benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text")).filter(F.length("text") > 0).distinct())
    n_parts = max(1, -(-items.count() // ITEMS_A_PASS))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.length("text") > 0)
    schema = f"id {kind}, item {item_field.dataType.simpleString()}, first_word long, n_words long, similarity double"
    out = None
    for part in range(n_parts):
        own = items.orderBy("item", "text").offset(part * ITEMS_A_PASS).limit(ITEMS_A_PASS).toArrow().combine_chunks()
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, own.schema) as writer:
            writer.write_table(own)
        sent = spark.sparkContext.broadcast(sink.getvalue().to_pybytes())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own = pa.ipc.open_stream(sent.value).read_all().combine_chunks()
            if not own.num_rows:
                return
            names, texts = (own.column(x).chunk(0) for x in ("item", "text"))
            found, known = indexes(texts, shingle)
            sieve = np.zeros(SIEVE, bool)
            sieve[(known & U64(SIEVE - 1)).astype(np.int64)] = True
            if not found:
                return
            for batch in text_slices(batches):
                row, item, *rest = leaks(batch.column("text"), found, known, sieve, threshold)
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(row)), names.take(pa.array(item)), *map(pa.array, rest)], ["id", "item", "first_word", "n_words", "similarity"])

        one = rows.mapInArrow(run, schema)
        out = one if out is None else out.unionAll(one)
    return out.withColumnsRenamed({"id": id_col, "item": item_col})
