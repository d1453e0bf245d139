"""N-gram Jaccard self-join with a token-group matrix.

A document's set is its distinct shingles. Documents with equal sets are one class. Two
different sets that link differ in at most D shingles, D from the larger size and the
threshold; so of more than D parts, into which a hash deals all shingles, one is equal in
both. Where the threshold is so low that parts would hold few shingles, sets are told by
their first shingles in the order of their hashes instead: by so many that two sets that
link share several of them, and a set that doesn't share so many with others can't link.
What is equal gathers classes that may link into partitions of similar sets of similar
size, cut by number of shingles where a partition is large. A pair is decided in the
partitions of the larger set's size; nothing outside a partition can link.

Within a partition the token-group matrix decides: similar sets form groups, each with
the union of its shingles (a row of the matrix, with a column for each shingle that two
sets share). The overlap of a query set with a group's union bounds its overlap with every
member; only groups whose bound qualifies are opened, and their members' overlaps are
counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.llm.components import components
from tangentia.llm.runtime import SIEVE_BITS, prepared, saved, sieve, sieve_table, sifted, text_slices, unpacked
from tangentia.llm.words import U64, Words, as_long, lowered, mix, split_words, text_bytes, windows_of

#: Sets of a group of the matrix at most.
GROUP = 32
#: Shingles of one block of a partition; two blocks meet in one task.
BLOCK = 1_000_000
#: Sizes of a level of signatures, and of a level of partitions, grow by these factors.
GROWTH, SPREAD = 1.25, 1.4
#: Shingles that linked sets share at least among their first ones, as a part of their
#: size; a round each, over what the one before left. In the last all shingles count.
ROUNDS = (0.06, 0.3, 1.0)
#: From this similarity on, in percent, parts hold enough shingles.
PARTS_FROM = 88


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingles of each text, offsets of n + 1); texts of fewer than k words are one shingle."""
    raw, offsets = text_bytes(column)
    words = split_words(lowered(raw), offsets)
    hashes = words.hashes()
    at, key = windows_of(words, hashes, k)
    doc = words.doc[at]
    size = np.diff(words.first)
    for n in range(1, k):
        short = np.flatnonzero(size == n)
        if len(short):
            out = np.full(len(short), n, U64)
            for j in range(n):
                out = mix(out * U64(5) + hashes[words.first[short] + j])
            doc, key = np.concatenate([doc, short]), np.concatenate([key, out])
    order = np.lexsort((key, doc))
    doc, key = doc[order], key[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    doc, key = doc[new], key[new]
    return key, np.searchsorted(doc, np.arange(len(size) + 1))


def set_hashes(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set, whatever its order; 0 for the empty one."""
    total = np.concatenate([np.zeros(1, U64), np.cumsum(mix(key + U64(11)))])
    n = np.diff(first).astype(U64)
    return np.where(n > 0, mix((total[first[1:]] - total[first[:-1]]) ^ mix(n)), U64(0))


def most_apart(size: int, num: int, den: int) -> int:
    """Shingles in which two linked sets can differ, the larger of this size."""
    return 2 * size * (den - num) // (den + num)


@lru_cache
def levels(most: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(least size, parts, empty parts that go without a signature) of the levels up to this size.

    Empty parts are spared (they are alike in too many sets) where there are few: with
    parts > D + spared, two sets of which one has no more than the spared number of empty
    parts still have an equal part with shingles. Sets with more give those parts too.
    """
    low, parts, spared = [1], [], []
    while low[-1] <= most:
        low.append(max(low[-1] + 1, int(low[-1] * GROWTH)))
    for a, b in zip(low, low[1:]):
        apart, least = most_apart(b - 1, num, den), -(-a * num // den)
        e = 0
        for _ in range(30):
            mean = (apart + 1 + e) * math.exp(-least / (apart + 1 + e))
            more = min(1 + apart // 3, math.ceil(mean + 4.5 * math.sqrt(mean)))
            if more <= e:
                break
            e = more
        parts.append(apart + 1 + e if apart else 0)
        spared.append(e)
    return np.array(low[:-1]), np.array(parts), np.array(spared)


def signatures(key: np.ndarray, first: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(signatures, offsets): of the parts of each set, at each level that it can link in as the smaller or larger."""
    size = np.diff(first)
    low, parts, spared = levels(max(64, 1 << int(size.max(initial=1) * den // num + 1).bit_length()), num, den)
    a = np.searchsorted(low, size, "right") - 1
    b = np.searchsorted(low, size * den // num, "right") - 1
    got = []
    for level in range(max(0, int(a[size > 0].min(initial=len(low)))), int(b.max(initial=-1)) + 1):
        k = int(parts[level])
        own = np.flatnonzero((a <= level) & (level <= b) & (size > 0))
        if not k or not len(own):
            continue
        n = size[own]
        place = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        token = key[place]
        cell = np.repeat(np.arange(len(own)) * k, n) + (mix(token ^ U64(0xA5A5 + level)) % U64(k)).astype(np.int64)
        total = np.zeros(len(own) * k, U64)
        np.add.at(total, cell, mix(token + U64(77)))
        held = np.bincount(cell, minlength=len(own) * k)
        empty = (held.reshape(-1, k) == 0).sum(1)
        take = (held > 0) | np.repeat(empty > spared[level], k)
        part = np.tile(np.arange(k), len(own))
        sig = mix(total + mix((part + (level + 1) * (1 << 24)).astype(U64)))
        got.append((np.repeat(own, k)[take], sig[take]))
    if not got:
        return np.empty(0, U64), np.zeros(len(size) + 1, np.int64)
    doc, sig = np.concatenate([x[0] for x in got]), np.concatenate([x[1] for x in got])
    order = np.argsort(doc, kind="stable")
    return sig[order], np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=len(size)))])


def first_shared(size: np.ndarray, num: int, den: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(first shingles of a set, shared ones among them that a set needs to link), by size.

    If two sets link, each lacks at most size - ceil(num / den * size) of its shingles in the
    other; with l more first shingles than these on both sides, l first ones at least are
    common. l grows with the size, and the other set may be the smaller by num / den.
    """
    held = -(-size * num // den)
    if share >= 1:
        return np.where(size * (den - num) >= num, size, 0), held
    more = lambda n: np.maximum(np.ceil(share * n), 1).astype(np.int64)
    return np.where(size * (den - num) >= num, np.minimum(size, size - held + more(size)), 0), more(held)


def firsts(key: np.ndarray, first: np.ndarray, num: int, den: int, share: float) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the first shingles, offsets) of sets whose shingles are in order."""
    size = np.diff(first)
    held, _ = first_shared(size, num, den, share)
    take = np.arange(len(key)) - np.repeat(first[:-1], size) < np.repeat(held, size)
    return mix(key[take] + U64(3)), np.concatenate([[0], np.cumsum(held)])


def links(sets: list[np.ndarray], side: np.ndarray, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of all linked pairs by the token-group matrix, some at a time; side: only pairs of side 0 with side 1, or all if there is one side.

    What is held grows with the sets' shingles, and not with the pairs.
    """
    if len(sets) < 2:
        return
    two_sides = side.any()
    size = np.array([len(s) for s in sets])
    _, token, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    doc = np.repeat(np.arange(len(sets)), size)
    shared = times[token] > 1
    renamed = np.cumsum(times > 1) - 1
    token, doc = renamed[token[shared]], doc[shared]
    common = np.bincount(doc, minlength=len(sets))
    # A set links only if den * common >= num * size; the others leave.
    stay = common * den >= num * size
    keep = stay[doc]
    token, doc = token[keep], doc[keep]
    members = np.flatnonzero(stay)
    if len(members) < 2:
        return
    first = np.searchsorted(doc, np.arange(len(sets) + 1))
    sketch = np.full((len(sets), 2), np.iinfo(np.int64).max)
    full = members[first[members + 1] > first[members]]
    for c in (0, 1):
        sketch[full, c] = np.minimum.reduceat(mix(token.astype(U64) + U64(c)).view(np.int64), first[full])
    order = members[np.lexsort((size[members], sketch[members, 1], sketch[members, 0]))]
    rank = np.full(len(sets), -1)
    rank[order] = np.arange(len(order))
    column = np.full(int(token.max(initial=-1)) + 1, -1, np.int64)
    by_rank = np.argsort(rank[doc], kind="stable")
    token, at = token[by_rank], rank[doc[by_rank]]
    edge = np.searchsorted(at, np.arange(len(order) + 1))
    n = size[order]
    for g in range(0, len(order), GROUP):
        own = slice(edge[g], edge[min(g + GROUP, len(order))])
        union, place = np.unique(token[own], return_inverse=True)
        matrix = np.zeros((min(GROUP, len(order) - g), len(union)), np.float32)
        matrix[at[own] - g, place] = 1
        column[union] = np.arange(len(union))
        # Queries: the sets from this group on. Their overlap with the union bounds that with its members.
        rest = token[edge[g] :]
        spot = column[rest]
        query = at[edge[g] :][spot >= 0] - g
        bound = np.bincount(query, minlength=len(order) - g)
        sizes = n[g : g + GROUP]
        open_ = np.flatnonzero((bound * (num + den) >= num * (n[g:] + sizes.min())) & (n[g:] * num <= sizes.max() * den) & (sizes.min() * num <= n[g:] * den))
        spot = spot[spot >= 0]
        begin = np.searchsorted(query, np.arange(len(order) - g + 1))
        step = max(1, (1 << 22) // max(1, len(union)))
        for i in range(0, len(open_), step):
            some = open_[i : i + step]
            rows = np.zeros((len(some), len(union)), np.float32)
            count = begin[some + 1] - begin[some]
            where = np.repeat(begin[some] - (np.cumsum(count) - count), count) + np.arange(count.sum())
            rows[np.repeat(np.arange(len(some)), count), spot[where]] = 1
            both = np.rint(rows @ matrix.T).astype(np.int64)
            q, m = np.nonzero(den * both >= num * (n[g + some][:, None] + sizes[None, :] - both))
            q = some[q]
            later = q > m
            i, j = order[g + q[later]], order[g + m[later]]
            if two_sides:
                cross = side[i] != side[j]
                i, j = i[cross], j[cross]
            if len(i):
                yield i, j
        column[union] = -1


class Forest:
    """Which of n sets the pairs so far connect."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def added(self, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
        """Those of the pairs that are enough to connect what they connect anew."""
        p, q = self.root[i], self.root[j]
        new = np.flatnonzero(p != q)
        if not len(new):
            return []
        _, first = np.unique(np.minimum(p, q)[new] * len(self.root) + np.maximum(p, q)[new], return_index=True)
        own: dict[int, int] = {}

        def find(x: int) -> int:
            while own.get(x, x) != x:
                own[x] = own.get(own[x], own[x])
                x = own[x]
            return x

        out = []
        for k in new[first].tolist():
            a, b = find(int(p[k])), find(int(q[k]))
            if a != b:
                own[max(a, b)] = min(a, b)
                out.append((int(i[k]), int(j[k])))
        at = np.arange(len(self.root))
        for x in own:
            at[x] = find(x)
        self.root = at[self.root]
        return out


def size_level(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log(np.maximum(size, 1)) / math.log(SPREAD) + 1e-9).astype(np.int32)


def _signed(column: pa.Array, k: int, num: int, den: int, share: float) -> tuple[np.ndarray, ...]:
    """(sets' hashes, sizes, signatures, offsets, shared signatures needed to link) of texts."""
    key, first = shingle_sets(column, k)
    size = np.diff(first)
    if 100 * num < PARTS_FROM * den:
        return (set_hashes(key, first), size, *firsts(key, first, num, den, share), first_shared(size, num, den, share)[1])
    return (set_hashes(key, first), size, *signatures(key, first, num, den), np.ones(len(size), np.int64))


def _only(batch: pa.RecordBatch, table: np.ndarray | None) -> pa.RecordBatch:
    """The rows whose id may be in a sieve's table."""
    return batch if table is None else batch.take(pa.array(np.flatnonzero(sifted(table, batch.column("at").to_numpy()))))


def _shared_signatures(docs: DataFrame, k: int, num: int, den: int, share: float, only: Broadcast | None) -> DataFrame:
    """(sig) of the signatures that two different sets have, of the documents in a sieve."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = unpacked(only) if only else None
        for batch in text_slices(batches):
            s, _, sig, at, _ = _signed(_only(batch, table).column("text"), k, num, den, share)
            own = np.repeat(s, np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(as_long(sig)), pa.array(as_long(own))], ["sig", "s"])

    return docs.select("at", "text").mapInArrow(run, "sig long, s long").groupBy("sig").agg(F.min("s").alias("a"), F.max("s").alias("z")).filter("a < z").select("sig")


def _document_sets(docs: DataFrame, k: int, num: int, den: int, share: float, shared: DataFrame, only: Broadcast | None) -> DataFrame:
    """(id, s, n, own, top, sigs) by row in a sieve.

    own, top: the levels of its size and of the largest set that it can link to; sigs: the
    signatures that other sets may have too, if they are enough to link.
    """
    kind = docs.schema["id"].dataType.simpleString()
    sent = sieve_table(shared, F.col("sig"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, own = unpacked(sent), unpacked(only) if only else None
        for batch in text_slices(batches):
            batch = _only(batch, own)
            s, size, sig, at, need = _signed(batch.column("text"), k, num, den, share)
            held = np.diff(at)
            doc = np.repeat(np.arange(len(size)), held)
            hit = sifted(table, (sig & U64(SIEVE_BITS - 1)).astype(np.int64))
            enough = np.bincount(doc[hit], minlength=len(size)) >= need
            keep = hit & enough[doc]
            ends = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(size)))]).astype(np.int32)
            sigs = pa.ListArray.from_arrays(pa.array(ends), pa.array(as_long(sig[keep])))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(as_long(s)), pa.array(size), pa.array(size_level(size)), pa.array(size_level(size * den // num)), sigs], ["id", "s", "n", "own", "top", "sigs"])

    return docs.mapInArrow(run, f"id {kind}, s long, n long, own int, top int, sigs array<long>")


def _narrowed(docs: DataFrame, own: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(s) of the sets that the later rounds leave."""
    left = own.filter(F.size("sigs") > 0).select("id", "s")
    for share in ROUNDS[1:]:
        only = sieve_table(left, F.xxhash64("id"))
        shared = saved(_shared_signatures(docs, k, num, den, share, only))
        left = saved(_document_sets(docs, k, num, den, share, shared, only).filter(F.size("sigs") > 0).select("id", "s"))
    return left.select("s").distinct()


def _tokens(rows: DataFrame, k: int) -> DataFrame:
    """The rows of (text, s, and more) whose text has the set s, with its shingles as tokens for the text."""
    more = [c for c in rows.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            key, first = shingle_sets(batch.column("text"), k)
            own = np.flatnonzero(as_long(set_hashes(key, first)) == batch.column("s").to_numpy())
            take = pa.array(own)
            tokens = pa.array([key[first[i] : first[i + 1]].tobytes() for i in own], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in more), tokens], [*more, "tokens"])

    return rows.mapInArrow(run, f"{rows.select(more)._jdf.schema().toDDL()}, tokens binary")


def _linked(rows: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b, linked): pairs that span each task's links (a, b), and the documents that a class links to (a, linked)."""

    def task(group: list[tuple]) -> Iterator[tuple]:
        seen = {}
        for s, block, members, tokens, own, level in group:
            seen[s] = (block, members, tokens, own, level)
        s = list(seen)
        block = np.array([seen[x][0] for x in s])
        members = np.array([seen[x][1] for x in s])
        own = np.array([seen[x][3] for x in s])
        forest, degree = Forest(len(s)), np.zeros(len(s))
        for i, j in links([np.frombuffer(seen[x][2], U64) for x in s], (block != block[0]).astype(np.int64) if len(s) else block, num, den):
            here = np.maximum(own[i], own[j]) == seen[s[0]][4]
            i, j = i[here], j[here]
            for a, b in forest.added(i, j):
                yield s[a], s[b], 0
            degree += np.bincount(i, members[j], len(s)) + np.bincount(j, members[i], len(s))
        for a in np.flatnonzero(degree):
            yield s[a], s[a], int(degree[a])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted(found: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], ["a", "b", "linked"])

        last, group, found = None, [], []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("part", "low", "high", "s", "block", "members", "tokens", "own", "level")]
            for part, low, high, *row in zip(*columns):
                if (part, low, high) != last:
                    found += task(group)
                    last, group = (part, low, high), []
                group.append(tuple(row))
            if len(found) > 10_000:
                yield emitted(found)
                found = []
        yield emitted(found + list(task(group)))

    return rows.mapInArrow(run, "a long, b long, linked long")


def jaccard_components(docs: DataFrame, k: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id, n_links.

    Words are `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased. Two documents link where den * intersection
    >= num * union; component_id is the smallest id that links reach, the own one included,
    and n_links the number of documents that a document links to. Null and empty texts have
    no shingles and link with nothing; rows of one id and one set are copies, and rows of one id with
    different sets stay rows of their own; a null id never is a component_id but may be reached through. Other columns
    are not read. Sets are told apart by 64-bit hashes. Shuffles: signatures (up to
    2 (den - num) / den a shingle), and the texts that share enough, to meet their partitions.
    """
    if not 0 < num < den:
        raise ValueError("the threshold is num / den, between 0 and 1")
    prepared(docs.sparkSession)
    rows = docs.select(docs[id_col].alias("id"), F.pmod(F.xxhash64(docs[id_col]), F.lit(SIEVE_BITS)).alias("at"), docs[text_col].alias("text"))
    shared = saved(_shared_signatures(rows, k, num, den, ROUNDS[0], None))
    own = saved(_document_sets(rows, k, num, den, ROUNDS[0], shared, None))
    classes = saved(own.filter("n > 0").groupBy("s").agg(F.min("id").alias("rep"), F.count("*").alias("members"), *[F.first(c).alias(c) for c in ("n", "own", "top", "sigs")]))
    near = classes.filter(F.size("sigs") > 0)
    if 100 * num < PARTS_FROM * den:
        near = near.join(_narrowed(rows, own, k, num, den), "s", "left_semi")
    near = saved(near.withColumn("level", F.explode(F.sequence("own", "top"))).withColumn("node", F.xxhash64("s", "level")))
    sigs = near.select("node", F.explode("sigs").alias("sig"), "level")
    least = sigs.groupBy("sig", "level").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").drop("z")
    edges = sigs.join(least, ["sig", "level"]).filter("a <> node").select("a", F.col("node").alias("b"))
    parts = components(edges).withColumnsRenamed({"root": "part"})
    held = saved(near.drop("sigs", "top").join(parts, "node"))
    blocks = held.groupBy("part").agg(F.ceil(F.sum("n") / BLOCK).cast("int").alias("blocks"))
    held = saved(held.join(blocks, "part").select("rep", "s", "members", "part", "blocks", "own", "level"))
    tokens = _tokens(rows.drop("at").filter(sieve(held, "rep")(F.col("id"))).join(held, rows["id"] == held["rep"]).drop("id", "rep"), k)
    block = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    met = tokens.withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("part", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "s", "block", "members", "tokens", "own", "level")
    found = saved(_linked(met.repartition("part", "low", "high").sortWithinPartitions("part", "low", "high"), num, den))
    roots = components(found.filter("a <> b").select("a", "b")).withColumnsRenamed({"node": "s", "root": "group"})
    grouped = classes.select("s", "rep", "members").join(roots, "s", "left").withColumn("group", F.coalesce("group", "s"))
    least = grouped.groupBy("group").agg(F.min("rep").alias("component_id"))
    degree = found.filter("a = b").groupBy(F.col("a").alias("s")).agg(F.sum("linked").alias("linked"))
    by_set = grouped.join(least, "group").join(degree, "s", "left").select("s", "component_id", (F.col("members") - 1 + F.coalesce("linked", F.lit(0))).alias("n_links"))
    out = own.select("id", "s", "n").join(by_set, "s", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
