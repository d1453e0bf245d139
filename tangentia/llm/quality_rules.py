"""Quality rules: counts over the whole text, and a line labelling by a linear-chain CRF.

Lines with a word are observations of twelve yes-or-no features. A conditional random
field with the states content and boilerplate is fitted on the lines of labelled documents:
those of good ones are content, and those of poor ones are a mixture, whose labels are found by
turns. They begin with what tells a line of poor documents from one of good ones; then the field is
fitted to the labels, and the lines of poor documents get its likeliest labelling, one line at
least staying boilerplate. Viterbi decoding, in step for all texts of a
batch, labels each line; the share of words in content lines decides retention.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tangentia.llm.runtime import prepared, text_slices
from tangentia.llm.words import Words, covered, mix, span_hashes, split_words, text_bytes, windows_of

#: Fixed values of the contract.
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS = 10
MOST_REPEATED = 20  #: percent of the words
REPEAT = 5
#: A document is kept if so large a share of its words lies in content lines.
CONTENT_SHARE = 0.5
N_FEATURES = 12
#: The field is taught by stretches of so many lines.
STRETCH = 128
#: Turns of fitting and labelling, and steps of the first and of further fits.
TURNS, STEPS = 4, (120, 60)
_KIND = np.zeros((6, 256), np.int64)
_KIND[0, list(SYMBOLS)] = 1
_KIND[1, 65:91] = 1
_KIND[2, 65:91] = _KIND[2, 97:123] = 1
_KIND[3, list(b"!?")] = 1
_KIND[4, 48:58] = 1
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?:;\"')")] = True


@dataclass
class Lines:
    doc: np.ndarray  #: row of each line with a word
    first: np.ndarray  #: n_docs + 1
    n_words: np.ndarray
    code: np.ndarray  #: features as bits
    repeated: np.ndarray  #: an equal line stands before it


def _sums(values: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[end] - total[begin]


def repeated_words(words: Words, hashes: np.ndarray, k: int = REPEAT) -> np.ndarray:
    """Which words lie in a window of k words that the same text has twice or more."""
    at, key = windows_of(words, hashes, k)
    _, inverse, n = np.unique(mix(key ^ mix(words.doc[at])), return_inverse=True, return_counts=True)
    return covered(len(words), at[n[inverse] > 1], k)


def lines_of(words: Words, offsets: np.ndarray, hashes: np.ndarray, again: np.ndarray) -> Lines:
    raw, n_docs = words.raw, len(offsets) - 1
    feed = raw == 0x0A
    begin = np.unique(np.concatenate([offsets[:-1][np.diff(offsets) > 0], np.flatnonzero(feed) + 1]))
    begin = begin[begin < len(raw)]
    end = np.append(begin[1:], len(raw))
    end = end - ((end > begin) & feed[np.maximum(end, 1) - 1]) if len(raw) else end
    a, b = np.searchsorted(words.begin, begin), np.searchsorted(words.begin, end)
    some = b > a
    begin, end, a, b = begin[some], end[some], a[some], b[some]
    doc = words.doc[a] if len(a) else np.empty(0, np.int64)
    key = mix(span_hashes(raw, begin, end, 7) ^ mix(doc))
    _, earliest, inverse = np.unique(key, return_index=True, return_inverse=True)
    repeated = earliest[inverse] != np.arange(len(key))
    n = b - a
    kind = _KIND[:, raw]
    symbols, upper, letters, cries, digits = (_sums(kind[i], begin, end) for i in range(5))
    same = np.zeros(len(words), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (words.doc[1:] == words.doc[:-1])
    size = end - begin
    bits = [
        symbols * 10 > n, symbols * 10 > 4 * n, upper * 2 > letters, cries * 10 > 3 * n, _sums(same, a, b) * 10 > 3 * n, n < 3,
        n < 8, _ENDS[raw[words.end[np.maximum(b, 1) - 1] - 1]] if len(b) else n < 0, digits * 5 > size, repeated, size > 13 * n, _sums(again, a, b) * 10 > 3 * n,
    ]
    code = np.zeros(len(n), np.int64)
    for i, x in enumerate(bits):
        code |= x.astype(np.int64) << i
    return Lines(doc, np.searchsorted(doc, np.arange(n_docs + 1)), n, code, repeated)


def measured(column: pa.Array) -> tuple[dict[str, np.ndarray], Lines]:
    """(counts by text, lines)."""
    raw, offsets = text_bytes(column)
    words = split_words(raw, offsets)
    hashes = words.hashes()
    again = repeated_words(words, hashes)
    lines = lines_of(words, offsets, hashes, again)
    n_docs = len(offsets) - 1
    by_word = lambda x: np.bincount(words.doc, x, n_docs).astype(np.int64)
    head = (raw & 0xC0) != 0x80
    counts = {
        "n_words": np.diff(words.first),
        "word_chars": by_word(_sums(head, words.begin, words.end)),
        "n_symbols": _sums(_KIND[0, raw], offsets[:-1], offsets[1:]),
        "n_dup_lines": np.bincount(lines.doc, lines.repeated, n_docs).astype(np.int64),
        "n_repeat_words": by_word(again),
    }
    return counts, lines


def _bits(code: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones((*code.shape, 1)), (code[..., None] >> np.arange(N_FEATURES)) & 1], -1)


@dataclass
class Field:
    """States: 0 content, 1 boilerplate. weights: (2, features and a constant); moves: (2, 2); start: 2."""

    weights: np.ndarray
    moves: np.ndarray
    start: np.ndarray

    def viterbi(self, lines: Lines) -> np.ndarray:
        """The state of each line in the likeliest labelling of its text; of equal ones the one with content."""
        size = np.diff(lines.first)
        score = (_bits(np.arange(1 << N_FEATURES)) @ self.weights.T)[lines.code]
        back = np.zeros((len(lines.code), 2), np.int8)
        live = np.flatnonzero(size)
        best = np.full((len(size), 2), -np.inf)
        best[live] = self.start + score[lines.first[live]]
        t = 1
        while len(live := live[size[live] > t]):
            at = lines.first[live] + t
            total = best[live][:, :, None] + self.moves
            back[at] = total.argmax(1)
            best[live] = total.max(1) + score[at]
            t += 1
        state = best.argmax(1)
        out = np.zeros(len(lines.code), np.int8)
        while t:
            t -= 1
            live = np.flatnonzero(size > t)
            at = lines.first[live] + t
            out[at] = state[live]
            state[live] = back[at, state[live]]
        return out

    @classmethod
    def neutral(cls) -> Field:
        """All lines are content."""
        return cls(np.zeros((2, N_FEATURES + 1)), np.zeros((2, 2)), np.array([0.0, -1.0]))

    def theta(self) -> np.ndarray:
        return np.concatenate([self.weights.ravel(), self.moves.ravel(), self.start])

    @classmethod
    def of(cls, theta: np.ndarray) -> Field:
        return cls(theta[:-6].reshape(2, -1), theta[-6:-2].reshape(2, 2), theta[-2:])

    @classmethod
    def fit(cls, stretches: Stretches, begin: Field | None = None, rounds: int = STEPS[0], ridge: float = 1e-3) -> Field:
        """Maximum conditional likelihood of the lines' states by Adam."""
        theta = np.zeros(2 * (N_FEATURES + 1) + 6) if begin is None else begin.theta()
        m, v = np.zeros_like(theta), np.zeros_like(theta)
        for k in range(1, rounds + 1):
            g = -stretches.likelihood(cls.of(theta))[1] / len(stretches.size) + ridge * theta
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            theta = theta - 0.2 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
        return cls.of(theta)


class Stretches:
    """Sequences of lines' codes and states, the longest first, held by place."""

    def __init__(self, codes: list[np.ndarray], states: list[np.ndarray]):
        order = np.argsort([-len(c) for c in codes], kind="stable")
        codes, states = [codes[i] for i in order], [states[i] for i in order]
        self.size = np.array([len(c) for c in codes])
        steps = int(self.size.max())
        self.grid = np.zeros((steps, len(codes)), np.int64)
        state = np.zeros((steps, len(codes)), np.int64)
        for i, (c, y) in enumerate(zip(codes, states)):
            self.grid[: len(c), i], state[: len(c), i] = c, y
        self.live = [int((self.size > t).sum()) for t in range(steps)]
        there = np.arange(steps)[:, None] < self.size
        self.seen = np.stack([np.bincount(self.grid[there & (state == s)], minlength=1 << N_FEATURES) for s in (0, 1)])
        self.pairs = np.bincount((2 * state[:-1] + state[1:])[there[1:]], minlength=4).reshape(2, 2)
        self.starts = np.bincount(state[0], minlength=2)

    def likelihood(self, f: Field) -> tuple[float, np.ndarray]:
        """(log-likelihood of the states, its gradient by Field.theta)."""
        bits = _bits(np.arange(1 << N_FEATURES))
        table = bits @ f.weights.T
        score, live = table[self.grid], self.live
        forward = [f.start + score[0]]
        for t in range(1, len(live)):
            a = forward[-1][: live[t], :, None] + f.moves
            forward.append(np.logaddexp(a[:, 0], a[:, 1]) + score[t, : live[t]])
        norm = sum(float(np.logaddexp(x[n:, 0], x[n:, 1]).sum()) for x, n in zip(forward, [*live[1:], 0]))
        expect, moves, starting, later = np.zeros_like(self.seen, float), np.zeros((2, 2)), None, np.zeros((0, 2))
        for t in range(len(live) - 1, -1, -1):
            n, ahead = live[t], len(later)
            beta = np.zeros((n, 2))
            if ahead:
                b = f.moves + (score[t + 1, :ahead] + later)[:, None, :]
                beta[:ahead] = np.logaddexp(b[:, :, 0], b[:, :, 1])
                joint = forward[t][:ahead, :, None] + b
                joint -= joint.max((1, 2), keepdims=True)
                joint = np.exp(joint)
                moves += (joint / joint.sum((1, 2), keepdims=True)).sum(0)
            p = forward[t] + beta
            p = np.exp(p - p.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for s in (0, 1):
                expect[s] += np.bincount(self.grid[t, :n], p[:, s], 1 << N_FEATURES)
            starting, later = p.sum(0), beta
        value = float((self.seen * table.T).sum() + (self.pairs * f.moves).sum() + self.starts @ f.start) - norm
        return value, np.concatenate([((self.seen - expect) @ bits).ravel(), (self.pairs - moves).ravel(), self.starts - starting])


def odds(codes: np.ndarray, poor: np.ndarray) -> np.ndarray:
    """By code of a line: the log of its share in poor documents over that in good ones, codes alike in few lines drawn to 0."""
    held = [np.bincount(codes[poor == s], minlength=1 << N_FEATURES) for s in (0, 1)]
    return np.log((held[1] + 0.5) / (held[1].sum() + 1)) - np.log((held[0] + 0.5) / (held[0].sum() + 1))


def labelled_field(codes: list[np.ndarray], poor: np.ndarray) -> Field:
    """A field from documents' lines and whether each document is poor; see above."""
    flat, size = np.concatenate(codes), np.array([len(c) for c in codes])
    first = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(codes)), size)
    of_poor = np.asarray(poor, bool)[doc]
    bad = odds(flat, of_poor.astype(int))[flat]
    # The line of each poor document that tells most stays boilerplate.
    worst = np.array([first[i] + bad[first[i] : first[i + 1]].argmax() for i in np.flatnonzero(poor)], np.int64)
    state = (of_poor & (bad > 0)).astype(np.int8)
    state[worst] = 1
    cuts = np.unique(np.concatenate([first[:-1], *[np.arange(a, b, STRETCH) for a, b in zip(first, first[1:])]]))
    parts = list(zip(cuts, [*cuts[1:], len(flat)]))
    field = None
    lines = Lines(doc, first, np.ones(len(flat), np.int64), flat, np.zeros(len(flat), bool))
    for turn in range(TURNS):
        field = Field.fit(Stretches([flat[a:b] for a, b in parts], [state[a:b] for a, b in parts]), field, STEPS[min(turn, 1)])
        again = np.where(of_poor, field.viterbi(lines), 0).astype(np.int8)
        again[worst] = 1
        if (again == state).all():
            break
        state = again
    return field


def fit_field(docs: DataFrame, labels: DataFrame, sample_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Field:
    """A field from at most sample_rows labelled documents (1 good, 0 poor), those with the least hash of their id.

    Only their lines' features come to the driver, of all their lines. Of ids that are
    repeated, one row teaches (labels: a good one; texts: the greatest). Null labels, ids and
    texts without words teach nothing. Without labels of both kinds every line is content.
    """
    prepared(docs.sparkSession)
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(F.col(label_col).cast("int")).alias("good"))
    few = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(F.broadcast(few), "id")
    rows = rows.groupBy("id").agg(F.max("good").alias("good"), F.max("text").alias("text")).select("good", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            _, lines = measured(batch.column("text"))
            codes = pa.ListArray.from_arrays(pa.array(lines.first.astype(np.int32)), pa.array(lines.code.astype(np.int16)))
            yield pa.RecordBatch.from_arrays([batch.column("good"), codes], ["good", "codes"])

    got = rows.mapInArrow(run, "good int, codes array<smallint>").filter(F.size("codes") > 0).collect()
    got.sort(key=lambda r: (r["good"], r["codes"]))
    if len({r["good"] for r in got}) < 2:
        return Field.neutral()
    return labelled_field([np.array(r["codes"], np.int64) for r in got], np.array([1 - r["good"] for r in got]))


def quality_rules(docs: DataFrame, model: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept.

    A text without words has a content share of 0 and fails the base rules; null counts as
    empty. Rows stay as they are, other columns are not read. One narrow pass, no shuffle.
    """
    prepared(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches):
            counts, lines = measured(batch.column("text"))
            content = np.bincount(lines.doc, lines.n_words * (model.viterbi(lines) == 0), batch.num_rows)
            n = counts["n_words"]
            failed = (n < LEAST_WORDS) | (100 * counts["n_repeat_words"] > MOST_REPEATED * n)
            share = content / np.maximum(n, 1)
            values = [counts[x].astype(np.int64) for x in names] + [failed, share, ~failed & (share >= CONTENT_SHARE)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *map(pa.array, values)], ["id", *names, "base_failed", "content_share", "kept"])

    schema = f"id {kind}, " + ", ".join(f"{x} long" for x in names) + ", base_failed boolean, content_share double, kept boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
