"""Substring deduplication by recompression.

Every text is recompressed in rounds: runs of one symbol, and then pairs of neighbours
of which the first falls on one side and the second on the other side of a coin that
depends on the symbol alone, become new symbols. A new symbol's name is a hash of what it
stands for, which makes names global: equal word sequences get equal names in every text
and task, without a dictionary that grows with the corpus. Only symbols near a sequence's
ends depend on what surrounds it (at most MARGIN words on each side, see below), so that
two equal windows have the same interior symbols. The window's foremost interior symbol
(the longest, of equal ones the least hash, then the leftmost) is its anchor.

Consecutive windows with one anchor are a region. Spark groups regions by the anchor's
surroundings, which lie in all of its windows: anchors that only one document has are
done. For the others, the regions that the smallest document shares are settled as a
whole, and only what remains is compared window by window, one document per different
region. Windows are compared by two 64-bit hashes of their words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.llm.runtime import prepared, saved, sieve, text_slices
from tangentia.llm.words import U64, Words, as_long, covered, mix, split_words, text_bytes

#: Words of a new symbol at most, by round. A round moves the border of what depends on
#: the surroundings by the cap for runs and the cap less one for pairs, on each side.
CAPS = (2, 3)
MARGIN = sum(2 * c - 1 for c in CAPS)
_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def recompressed(names: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words) of the symbols after all rounds; names: the words' hashes."""
    begin, size = np.arange(len(names)), np.ones(len(names), np.int64)
    owner = doc
    for k, cap in enumerate(CAPS):
        # Runs of one symbol, as one symbol where that is short enough.
        head = np.ones(len(names), bool)
        head[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(head)
        times = np.diff(np.append(first, len(names)))
        joined = (times > 1) & (times * size[first] <= cap)
        if joined.any():
            keep = head | ~np.repeat(joined, times)
            at = first[joined]
            names, size = names.copy(), size.copy()
            names[at] = mix(names[at] ^ mix(times[joined].astype(U64) + U64(1000 * (k + 1))))
            size[at] *= times[joined]
            names, begin, size, owner = names[keep], begin[keep], size[keep], owner[keep]
        # Pairs over the coin's two sides; they can't overlap.
        coin = (mix(names + U64(k + 1)) & U64(1)).astype(bool)
        pair = ~coin[:-1] & coin[1:] & (size[:-1] + size[1:] <= cap) & (owner[:-1] == owner[1:])
        at = np.flatnonzero(pair)
        names, size = names.copy(), size.copy()
        names[at] = mix(names[at] * U64(3) + mix(names[at + 1] + U64(k)))
        size[at] += size[at + 1]
        keep = np.ones(len(names), bool)
        keep[at + 1] = False
        names, begin, size, owner = names[keep], begin[keep], size[keep], owner[keep]
    return names, begin, size


class Sequence:
    """Hashes of any stretch of words of a batch, from two running sums."""

    def __init__(self, hashes: np.ndarray):
        self.sums, self.inverse = [], []
        for base in _BASES:
            power = np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(len(hashes), base, U64)]))
            self.sums.append(np.concatenate([np.zeros(1, U64), np.cumsum(hashes * power[:-1])]))
            self.inverse.append(np.multiply.accumulate(np.concatenate([np.ones(1, U64), np.full(len(hashes), pow(base, -1, 2**64), U64)])))

    def lane(self, which: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[which][end] - self.sums[which][begin]) * self.inverse[which][begin])

    def both(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix(self.lane(0, begin, end) + mix(self.lane(1, begin, end) + U64(1)))


def regions(words: Words, hashes: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window's first word, number of windows, anchor's word) of all runs of windows with one anchor."""
    n = len(hashes) - window + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none
    names, begin, size = recompressed(hashes, words.doc)
    # Interior starts of a window at i: [i + MARGIN, i + window - MARGIN - longest].
    reach = window - 2 * MARGIN - CAPS[-1] + 1
    if reach < CAPS[-1]:
        raise ValueError(f"windows need {2 * MARGIN + 2 * CAPS[-1] - 1} words at least")
    value = np.full(len(hashes), ~U64(0))
    value[begin] = (names >> U64(2)) | ((CAPS[-1] - size).astype(U64) << U64(62))
    best, at = value, np.arange(len(hashes))
    done = 1
    while done < reach:
        step = min(done, reach - done)
        later = best[step:] < best[:-step]
        best, at = np.where(later, best[step:], best[:-step]), np.where(later, at[step:], at[:-step])
        done += step
    at = at[MARGIN : MARGIN + n]
    ok = np.flatnonzero(words.doc[:n] == words.doc[window - 1 :])
    anchor = at[ok]
    head = np.ones(len(ok), bool)
    head[1:] = (anchor[1:] != anchor[:-1]) | (ok[1:] != ok[:-1] + 1)
    first = np.flatnonzero(head)
    return ok[first], np.diff(np.append(first, len(ok))), anchor[first]


def _anchors(docs: DataFrame, window: int) -> DataFrame:
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = split_words(*text_bytes(batch.column("text")))
            hashes = words.hashes()
            begin, n, anchor = regions(words, hashes, window)
            if not len(begin):
                continue
            stretch = Sequence(hashes)
            key = stretch.lane(0, anchor - MARGIN, anchor + CAPS[-1] + MARGIN)
            region = stretch.both(begin, begin + n + window - 1)
            doc = words.doc[begin]
            rows = pa.array(doc)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(rows), batch.column("rid").take(rows), pa.array(as_long(key)), pa.array(as_long(region)), pa.array((begin - words.first[doc]).astype(np.int32)), pa.array(n.astype(np.int32))],
                ["id", "rid", "key", "region", "start", "n"],
            )

    return docs.mapInArrow(run, f"id {kind}, rid long, key long, region long, start int, n int")


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """(key, region, place, w1, w2, id) of all windows of the regions `parts` of each text."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            words = split_words(*text_bytes(batch.column("text")))
            stretch = Sequence(words.hashes())
            parts = batch.column("parts")
            size = pa.compute.list_value_length(parts).to_numpy(zero_copy_only=False)
            flat = parts.flatten()
            key, region, start, n = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("key", "region", "start", "n"))
            row = np.repeat(np.repeat(np.arange(len(size)), size), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            begin = words.first[row] + np.repeat(start, n) + place
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(key, n)), pa.array(np.repeat(region, n)), pa.array(place.astype(np.int32)), *(pa.array(as_long(stretch.lane(i, begin, begin + window))) for i in (0, 1)), batch.column("id").take(pa.array(row))],
                ["key", "region", "place", "w1", "w2", "id"],
            )

    return rows.mapInArrow(run, f"key long, region long, place int, w1 long, w2 long, id {kind}")


def repeated_spans(docs: DataFrame, window: int) -> DataFrame:
    """(rid, spans): the stretches [begin, end) of words of each text that a smaller id has; docs: id, rid, text."""
    known = docs.filter(F.col("id").isNotNull() & (F.length("text") >= 2 * window - 1))
    anchors = _anchors(known, window)
    keys = saved(anchors.groupBy("key").agg(F.min("id").alias("kmin"), F.max("id").alias("kmax")).filter("kmin < kmax").drop("kmax"))
    shared = saved(anchors.filter(sieve(keys, "key")(F.col("key"))).join(keys, "key"))
    by_region = saved(shared.groupBy("key", "region").agg(F.min(F.struct("id", "rid", "start")).alias("rep"), F.first("n").alias("n"), F.first("kmin").alias("kmin")))
    open_keys = by_region.filter("rep.id <> kmin").select("key").distinct()
    parts = saved(by_region.join(open_keys, "key", "left_semi").groupBy(F.col("rep.rid").alias("rid")).agg(F.collect_list(F.struct("key", "region", F.col("rep.start").alias("start"), "n")).alias("parts")))

    windows = saved(_windows(known.filter(sieve(parts, "rid")(F.col("rid"))).join(parts, "rid").select("id", "text", "parts"), window))
    owners = windows.groupBy("w1", "w2").agg(F.min("id").alias("owner"))
    own = windows.select("key", "region", "place", "w1", "w2").distinct().join(owners, ["w1", "w2"]).groupBy("key", "region").agg(F.collect_list(F.struct("place", "owner")).alias("owned"))
    settled = by_region.filter("rep.id = kmin").select("key", "region", F.lit(None).cast(own.schema["owned"].dataType).alias("owned"), "kmin", "n")
    rest = by_region.filter("rep.id <> kmin").select("key", "region", "kmin", "n").join(own, ["key", "region"]).select("key", "region", "owned", "kmin", "n")
    found = shared.select("id", "rid", "key", "region", "start").join(settled.unionByName(rest), ["key", "region"])
    span = lambda a, b: F.struct(a.cast("int").alias("begin"), b.cast("int").alias("end"))
    whole = F.when(F.col("kmin") < F.col("id"), F.array(span(F.col("start"), F.col("start") + F.col("n") + window - 1)))
    some = F.transform(F.filter("owned", lambda o: o["owner"] < F.col("id")), lambda o: span(F.col("start") + o["place"], F.col("start") + o["place"] + window))
    spans = found.select("rid", F.coalesce(F.when(F.col("owned").isNull(), whole).otherwise(some), F.array().cast("array<struct<begin:int,end:int>>")).alias("spans")).filter(F.size("spans") > 0)
    return spans.groupBy("rid").agg(F.flatten(F.collect_list("spans")).alias("spans"))


def kept_bytes(words: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets): the kept words of each text, joined by one space."""
    begin, end, doc = words.begin[keep], words.end[keep], words.doc[keep]
    n_docs = len(words.first) - 1
    if not len(begin):
        return np.empty(0, np.uint8), np.zeros(n_docs + 1, np.int64)
    size = end - begin + 1
    ends = np.cumsum(size)
    place = np.repeat(begin - (ends - size), size) + np.arange(ends[-1])
    out = np.append(words.raw, np.uint8(0x20))[place]
    out[ends - 1] = 0x20
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    out = np.delete(out, ends[last] - 1)
    held = np.bincount(doc, size, n_docs).astype(np.int64)
    return out, np.concatenate([[0], np.cumsum(np.maximum(held - 1, 0))])


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs with n_words, n_removed and kept_text; columns of these names are replaced.

    A window is `window` consecutive words (`[^\\x20\\x09-\\x0D]+`, unchanged) of one text. A word
    goes if a window that covers it also starts in a text with a smaller id; windows are
    judged on the input. kept_text: the other words joined by one space. Null and empty
    texts have no words; a row with a null id keeps its text and takes none away from others; rows
    of one id don't take words from each other. Shuffles: the anchors of all texts
    (about one in 16 words), and the texts that share something, to meet what was found.
    """
    prepared(docs.sparkSession)
    row = docs.select(docs[id_col].alias("id"), F.xxhash64(docs[id_col], docs[text_col]).alias("rid"), docs[text_col].alias("text"))
    spans = saved(repeated_spans(row, window))
    met = sieve(spans, "rid")(F.col("rid"))
    base = docs.drop("n_words", "n_removed", "kept_text", "spans", "rid")
    names = base.columns
    told = base.withColumn("rid", F.xxhash64(docs[id_col], docs[text_col]))
    # Only texts of which something may go are shuffled.
    joined = told.filter(met).join(spans, "rid", "left").drop("rid")
    others = told.filter(~met).drop("rid").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType))
    schema = f"{base._jdf.schema().toDDL()}, n_words long, n_removed long, kept_text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, text_col):
            words = split_words(*text_bytes(batch.column(text_col)))
            lists = batch.column("spans")
            size = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            flat, first = lists.flatten(), np.repeat(words.first[:-1], size)
            begin, end = (flat.field(x).to_numpy(zero_copy_only=False) + first for x in ("begin", "end"))
            gone = covered(len(words), begin, end - begin) if len(begin) else np.zeros(len(words), bool)
            raw, offsets = kept_bytes(words, ~gone)
            kept = pa.Array.from_buffers(pa.large_string(), batch.num_rows, [None, pa.py_buffer(offsets), pa.py_buffer(raw)]).cast(pa.string())
            removed = np.bincount(words.doc, gone, batch.num_rows).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(np.diff(words.first)), pa.array(removed), kept], [*names, "n_words", "n_removed", "kept_text"])

    return joined.mapInArrow(run, schema).unionAll(others.mapInArrow(run, schema))
