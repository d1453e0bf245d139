"""Toxicity by class-conditional Kneser-Ney models of the characters of words.

Two interpolated Kneser-Ney models over the UTF-8 bytes of words, one of toxic and one of
ordinary texts, back off from 8 to 5 to 3 bytes, and then to one bigram model with counts of both classes, so
that what neither class knows well is scored alike. A word's evidence is the difference
of its log-likelihoods. A text's length-normalised log-likelihoods are compared: their
difference is the mean evidence of its words. As one rare expression in a long text hardly moves that
mean, the same difference is taken over the text's most telling parts too: the two words of the
most evidence, and what lies above FLOOR of all words, over the root of their number. A
logistic curve over these and the number's logarithm, fitted on labelled rows that the
models haven't seen, gives the score.

Counts are gathered over all labelled training rows by distributed aggregation. All distinct
8-byte grams with their counts are sent to the executors, so that what is sent grows with
the grams of the training rows; lower orders and contexts follow from them.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tangentia.llm.runtime import prepared, sieve, text_slices
from tangentia.llm.words import Words, lowered, split_words, text_bytes

#: Bytes of the grams of each level, the last 8 at most.
ORDERS = (3, 5, 8)
DISCOUNT = 0.75
#: Evidence of a word that chance gives.
FLOOR = 2.0
#: Features, and the width and the largest absolute value of the bins in which they are counted to fit the curve.
FEATURES = {"mean": (0.125, 3.0), "best": (0.5, 12.0), "second": (0.25, 12.0), "excess": (0.25, 8.0), "size": (0.5, 20.0)}
SLICE = 1 << 20
#: Grams that a worker holds to sum them before they leave.
HELD = 600_000


def word_grams(words: Words, n: int = ORDERS[-1]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(grams, words, offsets): n bytes ending at each byte of each word and at its end, as big-endian numbers.

    The bytes before a word count as spaces, and so does the one after it.
    """
    size = words.end - words.begin + 1
    at = np.concatenate([[0], np.cumsum(size)])
    place = np.arange(at[-1]) - np.repeat(at[:-1], size)
    padded = np.append(words.raw, np.uint8(0x20))
    byte = padded[np.minimum(np.repeat(words.begin, size) + place, len(words.raw))].astype(np.int64)
    byte[at[1:] - 1] = 0x20
    gram = byte.copy()
    for k in range(1, n):
        before = np.full(len(byte), 0x20, np.int64)
        before[k:] = byte[:-k] if k else byte
        before[place < k] = 0x20
        gram |= before << (8 * k)
    return gram, np.repeat(np.arange(len(size)), size), at


def distinct_words(column: pa.Array) -> tuple[Words, np.ndarray, Words]:
    """(distinct lower-cased words, which of them each word is, all words)."""
    raw, offsets = text_bytes(column)
    words = split_words(lowered(raw), offsets)
    _, example, which = np.unique(words.hashes(), return_index=True, return_inverse=True)
    few = Words(words.raw, words.begin[example], words.end[example], words.doc[example], np.array([0, len(example)]))
    return few, which, words


def gram_counts(rows: DataFrame) -> DataFrame:
    """(toxic, gram, n) over rows of (toxic, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {0: [], 1: []}

        def merged(c: int) -> list:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held[c]]), return_inverse=True)
            return [(keys, np.bincount(inverse, np.concatenate([n for _, n in held[c]])).astype(np.int64))]

        def given(c: int) -> pa.RecordBatch:
            (keys, n), held[c] = held[c][0], []
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), c, np.int32)), pa.array(keys), pa.array(n)], ["toxic", "gram", "n"])

        for batch in text_slices(batches, "text", SLICE):
            few, which, words = distinct_words(batch.column("text"))
            label = batch.column("toxic").to_numpy(zero_copy_only=False)[words.doc] if len(words) else np.empty(0, np.int64)
            gram, word, _ = word_grams(few)
            for c in (0, 1):
                times = np.bincount(which[label == c], minlength=len(few))[word]
                used = times > 0
                held[c].append((gram[used], times[used]))
                if sum(len(k) for k, _ in held[c]) > HELD:
                    held[c] = merged(c)
                    if len(held[c][0][0]) > HELD // 2:
                        yield given(c)
        for c in (0, 1):
            if held[c]:
                held[c] = merged(c)
                yield given(c)

    return rows.mapInArrow(run, "toxic int, gram long, n long").groupBy("toxic", "gram").agg(F.sum("n").alias("n"))


def tail(gram: np.ndarray, k: int) -> np.ndarray:
    """The last k bytes."""
    return gram if k == 8 else gram & ((1 << 8 * k) - 1)


def looked_up(keys: np.ndarray, of: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Each of values where the sorted distinct keys hold `of`, and 0 elsewhere."""
    if not len(keys):
        return [np.zeros(len(of)) for _ in values]
    at = np.minimum(np.searchsorted(keys, of), len(keys) - 1)
    found = keys[at] == of
    return [np.where(found, v[at], 0) for v in values]


@dataclass
class Level:
    """The grams of one class and order, sorted, with their counts, and their contexts with the followers' sums and numbers."""

    grams: np.ndarray
    n: np.ndarray
    contexts: np.ndarray
    totals: np.ndarray
    types: np.ndarray

    @classmethod
    def of(cls, grams: np.ndarray, n: np.ndarray) -> Level:
        contexts, first = np.unique(grams >> 8, return_index=True)
        types = np.diff(np.append(first, len(grams)))
        return cls(grams, n, contexts, np.add.reduceat(n, first, dtype=float) if len(first) else np.zeros(0), types.astype(np.float32))


@dataclass
class Model:
    """top: by class, the sorted distinct grams of the highest order and their counts; pairs: shared bigram counts."""

    top: list[tuple[np.ndarray, np.ndarray]]
    pairs: np.ndarray

    @cached_property
    def levels(self) -> list[list[Level]]:
        """By class and order; only those who score build them."""
        out = []
        for grams, n in self.top:
            own = [Level.of(grams, n)]
            for k in ORDERS[-2::-1]:
                # Below the highest order a gram counts once for each string of bytes that it is seen after.
                own.append(Level.of(*np.unique(tail(own[-1].grams, k), return_counts=True)))
            out.append(own[::-1])
        return out

    def packed(self) -> tuple[list, np.ndarray]:
        """Compressed differences of the grams, and counts, as executors keep copies of what they are sent."""
        small = lambda x: zlib.compress(x.tobytes(), 1)
        return [(small(np.diff(grams, prepend=0)), small(n)) for grams, n in self.top], self.pairs

    @classmethod
    def unpacked(cls, blobs: list, pairs: np.ndarray) -> Model:
        whole = lambda x, kind: np.frombuffer(zlib.decompress(x), kind)
        return cls([(np.cumsum(whole(grams, np.int64)), whole(n, np.float32)) for grams, n in blobs], pairs)

    def evidence(self, gram: np.ndarray) -> np.ndarray:
        """log P(byte | toxic) - log P(byte | ordinary) of each gram's last byte."""
        gram, which = np.unique(gram, return_inverse=True)
        last, before = gram & 255, (gram >> 8) & 255
        single = (self.pairs.sum(0) + 0.5) / (self.pairs.sum() + 128)
        total = self.pairs.sum(1)
        shared = (self.pairs[before, last] + 4 * single[last]) / (total[before] + 4)
        logs = []
        for c in (1, 0):
            p = shared
            for level, k in zip(self.levels[c], ORDERS):
                g = tail(gram, k)
                (n,) = looked_up(level.grams, g, level.n)
                rest, types = looked_up(level.contexts, g >> 8, level.totals, level.types)
                known = rest > 0
                rest = np.where(known, rest, 1)
                p = np.where(known, np.maximum(n - DISCOUNT, 0) / rest + np.minimum(DISCOUNT * types / rest, 1) * p, p)
            logs.append(np.log(p))
        return (logs[0] - logs[1])[which]


def fit_model(counts: DataFrame) -> Model:
    """A model from (toxic, gram, n) of distinct grams, which come to the driver: 13 bytes a gram and class."""
    got = counts.select(F.col("toxic").cast("byte").alias("toxic"), "gram", F.col("n").cast("float").alias("n")).toArrow()
    pairs, top = np.zeros(65536), []
    for c in (0, 1):
        own = got.filter(pa.compute.equal(got.column("toxic"), c))
        grams, times = own.column("gram").to_numpy(), own.column("n").to_numpy()
        del own
        pairs += np.bincount(grams & 65535, times, 65536)
        order = np.argsort(grams)
        top.append((grams[order], times[order]))
    return Model(top, pairs.reshape(256, 256))


def text_features(model: Model, column: pa.Array) -> np.ndarray:
    """FEATURES by text, one a column; a word that is missing has no evidence."""
    few, which, words = distinct_words(column)
    size = np.diff(words.first)
    out = np.zeros((len(size), len(FEATURES)))
    out[:, 4] = np.log1p(size)
    if len(words):
        gram, _, at = word_grams(few)
        each = np.add.reduceat(model.evidence(gram), at[:-1])[which]
        full = np.flatnonzero(size)
        first = words.first[:-1][full]
        best = np.maximum.reduceat(each, first)
        out[full, 0] = np.add.reduceat(each, first) / size[full]
        out[full, 1] = np.maximum(best, 0)
        out[full, 3] = np.add.reduceat(np.maximum(each - FLOOR, 0), first) / np.sqrt(size[full])
        top = np.flatnonzero(each == np.repeat(best, size[full]))
        top = top[np.concatenate([[True], words.doc[top][1:] != words.doc[top][:-1]])]
        each[top] = 0
        out[full, 2] = np.maximum(np.maximum.reduceat(each, first), 0)
    most = np.array([m for _, m in FEATURES.values()])
    return np.clip(out, -most, most)


def fit_curve(features: np.ndarray, label: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Weights, the constant first, of a logistic regression over weighted points, with a small ridge."""
    x = np.column_stack([np.ones(len(features)), features])
    w = np.zeros(x.shape[1])
    rate = np.clip((label * n).sum() / max(n.sum(), 1), 1e-6, 1 - 1e-6)
    w[0] = np.log(rate / (1 - rate))
    if not 0 < (label * n).sum() < n.sum():
        return w
    ridge = np.diag([1e-6, *[1e-2] * features.shape[1]])
    cost = lambda w: (n * (np.logaddexp(0, x @ w) - label * (x @ w))).sum() + 0.5 * w @ ridge @ w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (p - label)) + ridge @ w)
        t = 1.0
        while t > 1e-4 and cost(w - t * step) > cost(w):
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-8:
            break
    return w


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; null counts as empty."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


@dataclass
class Scorer:
    """What texts are scored with: a broadcast model and the curve's weights, None without labels."""

    model: Broadcast
    weights: np.ndarray | None


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Scorer:
    """A scorer from labelled rows: labels of (id, 0 or 1); other labels, null labels and null ids teach nothing.

    Ids of folds 0 and 3 teach the models, those of fold 1 the curve, and fold 2 is held
    out. The labelled texts are shuffled, to meet their labels; the others are not.
    """
    spark = prepared(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"), fold(F.col(id_col)).alias("fold"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def labelled(rows: DataFrame) -> DataFrame:
        # One plan at every size: few labels would be broadcast else, and many not.
        return texts.filter(sieve(rows, "id")(F.col("id"))).join(rows.hint("merge"), "id").select("toxic", "text")

    counts = gram_counts(labelled(known.filter(F.col("fold").isin(0, 3))))
    model = spark.sparkContext.broadcast(fit_model(counts).packed())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpacked(*model.value)
        for batch in text_slices(batches, "text", SLICE):
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), *map(pa.array, text_features(own, batch.column("text")).T)], ["toxic", *FEATURES])

    features = labelled(known.filter("fold = 1")).mapInArrow(run, "toxic int, " + ", ".join(f"{x} double" for x in FEATURES))
    bins = [F.round(F.col(x) / step).alias(x) for x, (step, _) in FEATURES.items()]
    got = features.groupBy(*bins, "toxic").agg(F.count("*").alias("n")).toPandas()
    if not len(got):
        return Scorer(model, None)
    return Scorer(model, fit_curve(got[list(FEATURES)].to_numpy() * [step for step, _ in FEATURES.values()], got["toxic"].to_numpy(), got["n"].to_numpy()))


def with_toxicity(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of docs with `score` from 0 to 1 (a column of that name is replaced).

    Null and empty texts score as texts without evidence. Without labels of both classes
    for the curve, the score is the share of toxic ones there, or 0 without any. A narrow pass.
    """
    prepared(docs.sparkSession)
    base = docs.drop("score")
    model, weights = scorer.model, scorer.weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model.unpacked(*model.value)
        for batch in text_slices(batches, text_col, SLICE):
            if weights is None:
                score = np.zeros(batch.num_rows)
            else:
                logit = weights[0] + text_features(own, batch.column(text_col)) @ weights[1:]
                score = 1 / (1 + np.exp(-np.clip(logit, -500, 500)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], [*batch.schema.names, "score"])

    return base.mapInArrow(run, f"{base._jdf.schema().toDDL()}, score double")


def score_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Per row of docs: id, held_out (its fold taught nothing), score, predicted (1 if score >= threshold).

    Rows stay as they are: repeated ids give repeated rows. See fit_toxicity and with_toxicity.
    """
    scorer = fit_toxicity(docs, labels, id_col=id_col, text_col=text_col, label_col=label_col)
    out = with_toxicity(docs.select(id_col, text_col), scorer, text_col)
    return out.select(id_col, (fold(F.col(id_col)) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
