import random
import re
from itertools import combinations

import numpy as np
import pytest

from brindle.catalog import table
from brindle.llm import jaccard


def shingles(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    """(doc_id, size, component) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i, s in enumerate(sets):
        for x in s:
            by_shingle.setdefault(x, []).append(i)
    pairs = {p for ids in by_shingle.values() for p in combinations(ids, 2)}
    for i, j in pairs:
        both = len(sets[i] & sets[j])
        if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
            root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = find(i)
            least[r] = min(d, least.get(r, d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df):
    return sorted((tuple(r) for r in jaccard.join(df).collect()), key=str)


def near_copies(seed, n, sizes, edits):
    rng = random.Random(seed)
    bases = [[rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(rng.choice(sizes))] for _ in range(max(2, n // 12))]
    out = []
    for _ in range(n):
        w = list(rng.choice(bases))
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w) + 1)
            if rng.random() < 0.5 and w:
                w.pop(min(k, len(w) - 1))
            else:
                w.insert(k, rng.choice("abcdefghij"))
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("seed,sizes,edits", [(1, range(1, 16), 2), (2, range(8, 40), 2), (3, range(100, 300), 6)])
def test_near_copies(spark, seed, sizes, edits):
    texts = near_copies(seed, 400, sizes, edits)
    rows = [(7 * i + 3, t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "1 AS n", "2 AS cls")
    want = brute(rows)
    assert len({r[2] for r in want}) < len(rows)
    assert found(df) == want


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").select("doc_id", "text")
    odd = [None, "", " \n", "one", "ONE", "a b c d", "a b c d e", "A b\tc d e", "w " * 200_000]
    docs = docs.union(spark.createDataFrame([(9000 + i, t) for i, t in enumerate(odd)] + [(None, "one"), (None, None), (9003, "other"), (9003, "other"), (None, "null only"), (None, "null only")], docs.schema))
    assert found(docs) == brute([tuple(r) for r in docs.collect()])
    assert found(docs.limit(0)) == []


@pytest.mark.parametrize("light", [0, 9])
def test_any_boundary_gives_the_same(spark, monkeypatch, light):
    monkeypatch.setattr(jaccard, "boundary", lambda sizes, shared: light)
    rows = [(i, t) for i, t in enumerate(near_copies(5, 250, range(1, 20), 2))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_sizes():
    for n in range(1, 80):
        for m in range(1, 80):
            for both in range(1, min(n, m) + 1):
                if 100 * both >= 80 * (n + m - both):
                    assert both >= jaccard.needed(n, m)
                    assert jaccard.prefix(n) > n - both
                    assert jaccard.needed(n, m) in jaccard.subset_sizes(n, max(n, m))
                else:
                    assert both < jaccard.needed(n, m)
    assert jaccard.boundary(np.array([0] + [100] * 63), 0.5) >= 1


def edited_group(seed, n, words, edits):
    """Copies of one text with so many words replaced, dropped or put in, a common line, and other texts."""
    rng = random.Random(seed)
    base = [f"{rng.choice('abcdefgh')}{rng.randrange(40)}" for _ in range(words)]
    few = ["in", "of", "or"]
    out = []
    for i in range(n):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(w))
            kind = rng.randrange(3)
            if kind == 0:
                w.pop(k)
            elif kind == 1:
                w[k] = rng.choice(few)
            else:
                w.insert(k, rng.choice(few))
        out.append(" ".join(w))
    line = " ".join(f"common{i}" for i in range(12))
    out += [line + "\n" + " ".join(f"{rng.choice('xyz')}{rng.randrange(500)}" for _ in range(rng.randint(1, 60))) for _ in range(n // 2)]
    return out


@pytest.mark.parametrize("hot,seed,words,edits", [(2, 11, 60, 6), (16, 12, 90, 9)])
def test_one_large_group(spark, monkeypatch, hot, seed, words, edits):
    monkeypatch.setattr(jaccard, "HOT", hot)
    made = []
    differing = jaccard.differing
    monkeypatch.setattr(jaccard, "differing", lambda *a: made.append(differing(*a)) or made[-1])
    rows = [(i, t) for i, t in enumerate(edited_group(seed, 400, words, edits))]
    want = brute(rows)
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == want
    assert made[0].count() < 400 * 20


def test_differences_reach():
    rng = random.Random(3)
    universe = list(range(60))
    for _ in range(3000):
        head = set(rng.sample(universe, rng.randint(5, 40)))
        near = [set(head) ^ set(rng.sample(universe, rng.randint(0, 14))) for _ in range(2)]
        x, y = near
        if not x or not y:
            continue
        alike = lambda a, b: len(a & b) >= jaccard.needed(len(a), len(b))
        if not alike(x, y) or alike(x, head) and alike(y, head):
            continue
        order = {t: rng.random() for t in universe}
        first = [sorted(z ^ head, key=order.get)[: jaccard.reach(len(z), len(head), len(z & head))] for z in near]
        assert set(first[0]) & set(first[1])


def test_levels_that_do_not_fit(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "SLOTS", 256)
    rows = [(i, t) for i, t in enumerate(near_copies(8, 200, range(15, 60), 3))]
    assert found(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_deduplicate_keeps_other_texts(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    rows = [(1, a, 1), (1, b, 2), (2, a, 3), (3, b, 4), (None, c, 5), (None, c, 6), (4, None, 7), (4, "", 8), (5, c + " z", 9), (6, "w", 10), (6, "w", 11)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int")
    for known in (jaccard.KNOWN, 0):
        kept = sorted((r["extra"] for r in (df.transform(lambda d: dedup(d, known))).collect()))
        assert kept[:2] == [1, 2] and kept[2:5] == [7, 8, 9] and len(kept) == 6 and kept[5] in (10, 11)


def dedup(df, known):
    before, jaccard.KNOWN = jaccard.KNOWN, known
    try:
        return jaccard.deduplicate(df)
    finally:
        jaccard.KNOWN = before
