"""Toxicity, quality rules and decontamination against brute force and held-out rows."""

import re
from collections import Counter

import numpy as np
import pytest
from samples import ODD
from pyspark.sql import functions as F

from tangentia.llm import decontaminate as D
from tangentia.llm import quality_rules as Q
from tangentia.llm import toxicity as T
from tangentia.llm.decontaminate import RADIUS, Index, benchmark_leaks, distance, fingerprints, signs
from tangentia.llm.toxicity import score_toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(t):
    t = t or ""
    w, lines = WORD.findall(t), [x for x in t.split("\n") if WORD.search(x)]
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    n, hit = Counter(windows), set()
    for k, x in enumerate(windows):
        if n[x] > 1:
            hit.update(range(k, k + 5))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit)


def test_quality_counts_match_brute_force(spark, docs_of, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").unionByName(docs_of([(10_000 + k, t) for k, (_, t) in enumerate(ODD)]).select("doc_id", "text"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in Q.quality_rules(docs, Q.Field.neutral()).collect():
        e = base_counts(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == e
        assert r["base_failed"] == (e[0] < 10 or 100 * e[4] > 20 * e[0])


def test_viterbi_matches_all_labellings():
    rng = np.random.default_rng(0)
    f = Q.Field(rng.normal(size=(2, Q.N_FEATURES + 1)), rng.normal(size=(2, 2)), rng.normal(size=2))
    code = rng.integers(0, 1 << Q.N_FEATURES, 11)
    lines = Q.Lines(np.repeat([0, 2], [6, 5]), np.array([0, 6, 6, 11]), np.ones(11, int), code, np.zeros(11, bool))
    got = f.viterbi(lines)
    score = Q._bits(code) @ f.weights.T
    for a, b in ((0, 6), (6, 11)):
        best = max((tuple((k >> i) & 1 for i in range(b - a)) for k in range(1 << (b - a))), key=lambda y: f.start[y[0]] + sum(score[a + i, y[i]] for i in range(b - a)) + sum(f.moves[y[i], y[i + 1]] for i in range(b - a - 1)))
        assert tuple(got[a:b]) == best


def test_likelihood_and_gradient_match_all_labellings():
    rng = np.random.default_rng(3)
    f = Q.Field(rng.normal(size=(2, Q.N_FEATURES + 1)), rng.normal(size=(2, 2)), rng.normal(size=2))
    codes = [rng.integers(0, 1 << Q.N_FEATURES, n) for n in (4, 1, 6, 3)]
    states = [rng.integers(0, 2, len(c)) for c in codes]
    held = Q.Stretches(codes, states)

    def value(f):
        total = 0.0
        for c, y in zip(codes, states):
            score = Q._bits(c) @ f.weights.T
            of = lambda z, c=c, score=score: f.start[z[0]] + sum(score[i, z[i]] for i in range(len(c))) + sum(f.moves[z[i], z[i + 1]] for i in range(len(c) - 1))
            total += of(y) - np.logaddexp.reduce([of([(k >> i) & 1 for i in range(len(c))]) for k in range(1 << len(c))])
        return total

    got, gradient = held.likelihood(f)
    assert got == pytest.approx(value(f))
    theta, step = f.theta(), 1e-5
    for i in range(len(theta)):
        e = np.eye(len(theta))[i] * step
        assert gradient[i] == pytest.approx((value(Q.Field.of(theta + e)) - value(Q.Field.of(theta - e))) / (2 * step), abs=1e-5)


def test_lines_of_mixed_documents_get_their_own_labels():
    rng = np.random.default_rng(8)
    content, junk = (lambda n: rng.choice([0, 128], n)), (lambda n: rng.choice([3, 35, 515], n))
    codes, truth, poor = [], [], []
    for i in range(300):
        poor.append(i % 3 == 0)
        n = int(rng.integers(1, 300 if i < 9 else 20))
        parts = [content(int(rng.integers(1, 6))), junk(n), content(int(rng.integers(0, 3)))] if poor[-1] else [content(n)]
        codes.append(np.concatenate(parts))
        truth.append(np.concatenate([np.full(len(p), k % 2) for k, p in enumerate(parts)]))
    f = Q.labelled_field(codes, np.array(poor))
    first = np.concatenate([[0], np.cumsum([len(c) for c in codes])])
    flat = np.concatenate(codes)
    got = f.viterbi(Q.Lines(np.repeat(np.arange(300), np.diff(first)), first, np.ones(len(flat), int), flat, np.zeros(len(flat), int)))
    assert (got == np.concatenate(truth)).mean() > 0.99 and np.abs(f.moves).max() < 8


def test_quality_of_held_out_documents(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = Q.quality_rules(docs, Q.fit_field(docs, labels.filter(T.fold(F.col("doc_id")) != 2))).join(labels, "doc_id").filter("not base_failed").cache()
    n = {(r["quality"], r["kept"]): r["count"] for r in out.filter(T.fold(F.col("doc_id")) == 2).groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.02 * n[1, True] and n.get((0, True), 0) <= 0.1 * n[0, False]
    assert out.filter("content_share > 0 and content_share < 1").count() > 0


def test_fields_of_odd_labels(spark, docs_of):
    docs = docs_of(ODD)
    kind = "doc_id long, quality int"
    assert Q.fit_field(docs, spark.createDataFrame([], kind)).start[1] == -1
    assert Q.fit_field(docs_of([]), spark.createDataFrame([(4, 1)], kind)).start[1] == -1
    odd = spark.createDataFrame([(4, 1), (4, 0), (4, 1), (6, 0), (7, 1), (None, 0), (5, None), (3, 0), (99, 1)], kind)
    out = Q.quality_rules(docs, Q.fit_field(docs, odd)).collect()
    assert len(out) == len(ODD) and all(0 <= r["content_share"] <= 1 for r in out)
    assert Q.quality_rules(docs_of([]), Q.Field.neutral()).count() == 0


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    out = score_toxicity(docs, labels).join(labels, "doc_id").filter("held_out")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n.get((0, 1), 0) <= 0.1 * n[0, 0]


def test_toxicity_of_odd_rows(spark, docs_of):
    labels = spark.createDataFrame([(4, 1), (6, 0), (5, None), (None, 1), (7, 3)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in score_toxicity(docs_of(ODD), labels).collect())
    none = score_toxicity(docs_of(ODD), labels.limit(0)).collect()
    assert len(none) == len(ODD) and {r["score"] for r in none} == {0.0}
    assert score_toxicity(docs_of([]), labels).count() == 0


def test_toxicity_counts_grams_exactly(spark):
    rng = np.random.default_rng(5)
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz", np.uint8)
    rows = [(i, " ".join(bytes(x).decode() for x in rng.choice(letters, (600, 9))), int(i % 10 == 0)) for i in range(400)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = T.Model.unpacked(*T.fit_toxicity(texts.select("doc_id", "text"), texts.select("doc_id", "toxic")).model.value)
    taught = {r[0] for r in texts.filter(T.fold(F.col("doc_id")).isin(0, 3)).select("doc_id").collect()}
    top = [Counter(), Counter()]
    for i, text, c in rows:
        if i in taught:
            for w in text.encode().split(b" "):
                w = b" " * 8 + w + b" "
                top[c].update(w[k - 7 : k + 1] for k in range(8, len(w)))
    assert sum(map(len, top)) > 800_000
    pairs = Counter()
    for c in top:
        for g, n in c.items():
            pairs[g[-2:]] += n
    total, single = Counter(), Counter()
    for g, n in pairs.items():
        total[g[:1]] += n
        single[g[1:]] += n
    seen = list(top[1])[:100] + list(top[0])[:100]
    asked = seen + [bytes(rng.permutation(np.frombuffer(g, np.uint8))) for g in seen]
    logs = []
    for c in (1, 0):
        level = [top[c]]
        for k in (5, 3):
            level.append(Counter(g[-k:] for g in level[-1]))
        p = [(pairs[g[-2:]] + 4 * (single[g[-1:]] + 0.5) / (sum(pairs.values()) + 128)) / (total[g[-2:-1]] + 4) for g in asked]
        for own, k in zip(level[::-1], (3, 5, 8)):
            rest, types = Counter(), Counter(g[:-1] for g in own)
            for g, n in own.items():
                rest[g[:-1]] += n
            for i, g in enumerate(asked):
                g = g[-k:]
                if rest[g[:-1]]:
                    p[i] = max(own[g] - 0.75, 0) / rest[g[:-1]] + min(0.75 * types[g[:-1]] / rest[g[:-1]], 1) * p[i]
        logs.append(np.log(p))
    assert model.evidence(np.array([int.from_bytes(g, "big", signed=True) for g in asked])) == pytest.approx(logs[0] - logs[1], abs=0.01)


def test_leaks_match_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in benchmark_leaks(docs, items).collect()}
    words = lambda t: WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)] or [tuple(w)]
    wanted = {}
    bench = [(r["item_id"], words(r["text"])) for r in items.collect()]
    held = {x for _, w in bench for x in shingles(w)}
    for r in docs.collect():
        w = words(r["text"])
        s = shingles(w)
        if not held.intersection(s):
            continue
        for i, item in bench:
            n, c = len(item), Counter(shingles(item))
            best = max((sum((c & Counter(s[k : k + n - 4])).values()) for k in range(len(w) - n + 1)), default=0)
            j = best / (2 * (n - 4) - best)
            if j >= 0.8:
                wanted[r["doc_id"], i] = j
    assert got == pytest.approx(wanted)


def test_texts_shorter_than_an_item_are_compared_whole(spark, docs_of):
    w = [f"w{k}" for k in range(59)]
    items = spark.createDataFrame([(1, " ".join(w)), (2, "a b c d e f g h i"), (3, "p q r s")], "item_id long, text string")
    cut = [w[:-1], w[3:-4], w[11:], w[12:], "a b c d e f g h".split(), "b c d e f g h".split(), "p q r".split(), ["x"] + w[:-1]]
    got = {(r["doc_id"], r["item_id"]): (r["first_word"], r["n_words"], r["similarity"]) for r in benchmark_leaks(docs_of([(k, " ".join(x)) for k, x in enumerate(cut)]), items).collect()}
    wanted = {(0, 1): (0, 58, 54 / 55), (1, 1): (0, 52, 48 / 55), (2, 1): (0, 48, 44 / 55), (4, 2): (0, 8, 0.8), (7, 1): (0, 59, 54 / 56)}
    assert set(got) == set(wanted) and all(got[k] == pytest.approx(wanted[k]) for k in wanted)


def test_index_gives_all_within_the_radius_and_little_else():
    rng = np.random.default_rng(2)
    index = Index.of(9, 5, list(range(40)), [rng.integers(0, 1 << 63, 5, dtype=np.uint64) for _ in range(40)])
    near = index.prints[rng.integers(0, 40, 3000)] ^ np.packbits(rng.random((3000, 128)) < 0.2, axis=1).view(np.uint16)
    row, item = index.candidates(near)
    every = np.argwhere(distance(near[:, None], index.prints[None]) <= RADIUS)
    assert set(zip(row.tolist(), item.tolist())) == {tuple(x) for x in every.tolist()}
    assert fingerprints(np.array([[1] + [0] * 127]))[0, 0] == 128
    assert len(index.met(rng.integers(0, 1 << 16, (3000, 8)).astype(np.uint16))) < 0.1 * 3000 * 40


def test_fingerprints_recall_similar_windows():
    rng = np.random.default_rng(6)
    found, wanted, exact = 0, 0, []
    for _ in range(300):
        n = int(rng.integers(20, 90))
        item = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        window = item.copy()
        other = rng.permutation(n)[: int(rng.integers(0, n // 9 + 1))]
        window[other] = rng.integers(0, 1 << 63, len(other), dtype=np.uint64)
        index = Index.of(n + 4, 5, [0], [item])
        s = index.similarities(window, np.array([0]), np.array([n]), np.array([0]))[0]
        a, b = Counter(window.tolist()), Counter(item.tolist())
        exact.append(abs(s - (a & b).total() / (a | b).total()))
        if s >= 0.8:
            wanted += 1
            found += len(index.candidates(fingerprints(signs(window).sum(0, dtype=np.int32)[None]))[0])
    assert max(exact) < 1e-12 and wanted > 250 and found >= 0.99 * wanted


def test_leaks_of_odd_rows(spark, docs_of, monkeypatch):
    items = spark.createDataFrame([(1, "a b c d e f"), (2, None), (3, ""), (None, "f e d c b a"), (4, "one"), (4, "one"), (4, "x y z u v w")], "item_id long, text string")
    docs = docs_of([*ODD, (20, "f e d c b a q"), (21, "x y z u v w x y z u v w")])
    for most in (1024, 1):
        monkeypatch.setattr(D, "ITEMS_A_PASS", most)
        got = sorted(((r["doc_id"] or 0, r["item_id"] or 0, r["first_word"], r["n_words"]) for r in benchmark_leaks(docs, items).collect()))
        assert got == [(0, 1, 0, 6), (4, 4, 0, 1), (4, 4, 0, 1), (20, 0, 0, 6), (21, 4, 0, 6)]
        assert benchmark_leaks(docs_of([]), items).count() == 0
        assert benchmark_leaks(docs_of(ODD), items.limit(0)).count() == 0
    named = benchmark_leaks(docs, items.select(F.col("item_id").cast("decimal(9,0)").alias("item_id"), "text"))
    assert named.count() == 5
