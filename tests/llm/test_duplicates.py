"""Substring dedup, the Jaccard join and components against brute force."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from samples import ODD

from tangentia.llm import jaccard_join as J
from tangentia.llm.components import components
from tangentia.llm.jaccard_join import Forest, first_shared, jaccard_components, links
from tangentia.llm.substring_dedup import dedup_substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def kept_words(rows, window):
    own = {}
    for i, w in rows:
        for k in range(len(w) - window + 1):
            x = tuple(w[k : k + window])
            own[x] = min(i, own.get(x, i))
    out = []
    for i, w in rows:
        gone = set()
        for k in range(len(w) - window + 1):
            if own[tuple(w[k : k + window])] < i:
                gone.update(range(k, k + window))
        out.append((i, len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out)


def passages(seed):
    """Texts with shared passages, runs of one word, periodic stretches, copies, and hot passages."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") * rng.randint(1, 3)
    shared = [[word() for _ in range(rng.randint(45, 130))] for _ in range(6)] + [["z"] * 90, ["p", "q"] * 60, ["u", "v", "w"] * 40]
    rows = []
    for i in range(60):
        w = []
        for _ in range(rng.randint(0, 5)):
            p = rng.choice(shared)
            a = rng.randint(0, 30)
            w += [word() for _ in range(rng.randint(0, 40))] + p[a : len(p) - rng.randint(0, 30)]
        rows.append((i, w))
    return rows + [(100 + k, list(rows[7][1])) for k in range(9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings_match_brute_force(spark, docs_of, seed):
    rows = passages(seed)
    out = dedup_substrings(docs_of([(i, " ".join(w)) for i, w in rows])).collect()
    assert sorted((r["doc_id"], r["n_removed"], r["kept_text"]) for r in out) == kept_words(rows, 50)


def test_substrings_of_odd_rows(spark, docs_of):
    long = " ".join(f"w{k}" for k in range(80))
    rows = [*ODD, (8, long), (8, long), (9, long), (None, long), (10, long + " tail")]
    out = dedup_substrings(docs_of(rows)).collect()
    assert len(out) == len(rows)
    gone = Counter((r["doc_id"], r["n_removed"]) for r in out)
    assert gone[8, 0] == 2 and gone[9, 80] == 1 and gone[10, 80] == 1 and gone[None, 0] == 2
    assert next(r["kept_text"] for r in out if r["doc_id"] == 10) == "tail"
    assert next(r for r in out if r["doc_id"] == 2)["kept_text"] == ""
    assert dedup_substrings(docs_of([])).count() == 0


def brute_components(rows, k, num, den):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    sets = []
    for i, t in rows:
        w = WORD.findall(lower(t))
        sets.append((i, frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) or (frozenset([tuple(w)]) if w else frozenset())))
    root, degree = {i: i for i, _ in sets}, defaultdict(int)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, s) in enumerate(sets):
        for j, o in sets[:a]:
            both = len(s & o)
            if both and den * both >= num * (len(s) + len(o) - both):
                degree[i] += 1
                degree[j] += 1
                p, q = find(i), find(j)
                if p != q:
                    root[max(p, q)] = min(p, q)
    return sorted((i, len(s), find(i), degree[i]) for i, s in sets)


def families(seed):
    rng = random.Random(seed)
    rows, i = [], 0
    for _ in range(12):
        base = [rng.choice("abcdefghijklmnop") * rng.randint(1, 2) for _ in range(rng.randint(5, 160))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 25))):
                w[rng.randrange(len(w))] = f"new{rng.randint(0, 9999)}"
            rows.append((i, " ".join(w)))
            i += 1
    shared = " ".join(f"p{k}" for k in range(60))
    return rows + [(i + k, f"{shared} " + " ".join(f"own{k}x{j}" for j in range(200))) for k in range(20)] + [(i + 50, "The"), (i + 51, "the"), (i + 52, ""), (i + 53, None), (i + 54, "a b")]


@pytest.mark.parametrize("k, num, den", [(3, 90, 100), (5, 80, 100)])
def test_components_match_brute_force(spark, docs_of, k, num, den):
    rows = families(k)
    out = jaccard_components(docs_of(rows), k, num, den).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in out) == brute_components(rows, k, num, den)


def test_components_of_odd_rows(spark, docs_of):
    out = jaccard_components(docs_of(ODD)).collect()
    assert len(out) == len(ODD)
    by = {r["doc_id"]: r for r in out}
    assert by[1]["component_id"] == 1 and by[1]["n_links"] == 0 and by[4]["component_id"] == 4
    assert jaccard_components(docs_of([])).count() == 0


def test_matrix_finds_all_links():
    rng = np.random.default_rng(5)
    base = [rng.integers(0, 1 << 60, 200, dtype=np.uint64) for _ in range(9)]
    sets = []
    for k in range(300):
        b = base[k % 9].copy()
        n = int(rng.integers(0, 30))
        b[:n] = rng.integers(0, 1 << 60, n, dtype=np.uint64)
        sets.append(np.unique(b))
    for side in (np.zeros(300, int), np.arange(300) % 2):
        i, j = (np.concatenate(x) for x in zip(*links(sets, side, 9, 10)))
        got = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
        want = {(a, b) for a in range(300) for b in range(a + 1, 300) if (not side.any() or side[a] != side[b]) and 10 * (n := len(np.intersect1d(sets[a], sets[b]))) >= 9 * (len(sets[a]) + len(sets[b]) - n)}
        assert got == want and len(i) == len(want)
    forest = Forest(300)
    kept = [x for k in range(0, len(i), 50) for x in forest.added(i[k : k + 50], j[k : k + 50])]
    assert len(kept) == 300 - len(np.unique(forest.root)) < len(i)
    assert (forest.root[i] == forest.root[j]).all()


def test_many_near_copies_need_little_memory():
    import tracemalloc

    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 60, 20, dtype=np.uint64)
    sets = [np.unique(np.append(base[:19], U)) for U in rng.integers(0, 1 << 60, 5000, dtype=np.uint64)]
    forest, degree = Forest(5000), np.zeros(5000, int)
    tracemalloc.start()
    for i, j in links(sets, np.zeros(5000, int), 90, 100):
        forest.added(i, j)
        degree += np.bincount(i, minlength=5000) + np.bincount(j, minlength=5000)
    assert tracemalloc.get_traced_memory()[1] < 120e6
    tracemalloc.stop()
    assert (degree == 4999).all() and (forest.root == 0).all()


def test_partitions_in_several_blocks(spark, docs_of, monkeypatch):
    monkeypatch.setattr(J, "BLOCK", 400)
    rows = families(3)
    out = jaccard_components(docs_of(rows), 3, 90, 100).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["n_links"]) for r in out) == brute_components(rows, 3, 90, 100)


def test_first_shingles_are_enough():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 80)
        a = set(rng.sample(range(500), n))
        b = set(rng.sample(sorted(a), max(1, n - rng.randint(0, n // 4 + 1)))) | set(rng.sample(range(500, 900), rng.randint(0, n // 6 + 1)))
        if 100 * len(a & b) < 80 * len(a | b) or a == b:
            continue
        for share in (0.06, 0.3, 1.0):
            (la, lb), (na, nb) = (x.tolist() for x in first_shared(np.array([len(a), len(b)]), 80, 100, share))
            common = len(set(sorted(a)[:la]) & set(sorted(b)[:lb]))
            assert common >= max(na, nb) or common >= min(na, nb) and share < 1


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 300)] + [(1000, 1000 + k) for k in range(200)] + [(5, 5)] + [tuple(rng.sample(range(2000, 2100), 2)) for _ in range(60)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in range(400):
        moved = False
        for a, b in edges:
            m = min(root[a], root[b])
            moved |= root[a] != m or root[b] != m
            root[a] = root[b] = m
        if not moved:
            break
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0
