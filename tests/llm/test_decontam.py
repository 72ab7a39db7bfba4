import hashlib
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.catalog import table
from brindle.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, width=10):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(width, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str("" if item is None else item))
    sizes = {len(w) for w in windows}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        yield doc_id, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="aAbé -", max_size=30), max_size=4), st.lists(st.text(alphabet="abé ", max_size=12), max_size=3), st.integers(1, 4), st.integers(0, 2))
def test_blocks_find_what_brute_force_finds(docs, items, width, slop):
    tests = decontam.tests_of([(str(i), t) for i, t in enumerate(items)], width)
    orders = tests.ordered(np.zeros(len(tests.vocabulary), np.int64))
    found = {}
    for row, _, hashes, at in decontam.rows_words(pa.array(docs, pa.string()), decontam.Hasher(decontam.ALNUM_LOWER)):
        for d, (spans, names, near) in decontam.matches(decontam.block_of(hashes, at, tests.vocabulary), tests, orders, slop).items():
            assert names <= near
            if names:
                found[row + d] = (len({x for a, b in spans for x in range(a, b)}), len(names))
    want = {i: (h, n) for i, _, h, n, _, c in brute(list(enumerate(docs)), list(enumerate(items)), width) if c}
    assert found == want


def test_tables(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents").selectExpr("doc_id", "text", "1 AS items", "2 AS n_hit")
    items = table(spark, "/root/testdata/sf0.001", "benchmark").selectExpr("item_id", "text", "'x' AS doc_id")
    long = items.first()["text"]
    odd = [None, "", "---", long, long + " " + long, "tiny Item", "x " * 300_000 + long, long.upper()]
    docs = docs.union(spark.createDataFrame([(9000 + i, t, 0, 0) for i, t in enumerate(odd)] + [(None, long, 0, 0), (9003, long, 0, 0)], docs.schema))
    items = items.union(spark.createDataFrame([(77, "tiny item", "x"), (78, None, "x"), (None, "", "x"), (None, "tiny ITEM", "x"), (79, "!!", "x")], items.schema))
    want = sorted(brute([tuple(r)[:2] for r in docs.collect()], [tuple(r)[:2] for r in items.collect()]), key=str)
    found = decontam.report(docs, items).collect()
    assert sorted((tuple(r)[:6] for r in found), key=str) == want
    assert sum(r["contaminated"] for r in found) > 8
    assert decontam.clean(docs, items).count() == sum(not r[-1] for r in want)
    assert decontam.clean(docs, items).schema == docs.schema
    monkeypatch.setattr(decontam, "KNOWN", 1)
    assert decontam.clean(docs, items).count() == sum(not r[-1] for r in want)
    assert decontam.report(docs.limit(0), items).count() == 0
    assert not any(r["contaminated"] for r in decontam.report(docs, items.limit(0)).collect())


def test_items_in_parts(spark, monkeypatch):
    docs, items = (table(spark, "/root/testdata/sf0.001", t) for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, decontam.report(docs, items).collect()))
    monkeypatch.setattr(decontam.parts, "__defaults__", (decontam.WINDOW, 3000))
    assert len(list(decontam.parts(items))) > 2
    kept = sorted(map(tuple, decontam.clean(docs, items).select("doc_id").collect()))
    assert kept == sorted((r[0],) for r in whole if not r[5])
    assert sorted(map(tuple, decontam.report(docs, items).collect())) == whole


def test_proximity(spark):
    item = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, "so one two and three four five six seven eight nine ten"), (2, "ten nine eight seven six five four three two one"), (3, item)], "doc_id long, text string")
    found = {r["doc_id"]: (r["n_items"], r["n_near"]) for r in decontam.report(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert found == {1: (0, 1), 2: (0, 0), 3: (1, 1)}
