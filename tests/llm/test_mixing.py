import re

import pytest
from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, rank int, copies int"


def water(sizes, total):
    """Targets by repeated resharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full = set()
    while True:
        rest = [s for s in order if s not in full]
        left = total - sum(2 * sizes[s] for s in full)
        target = {s: 2 * sizes[s] if s in full else left * weight[s] / sum(weight[r] for r in rest) for s in order}
        above = {s for s in rest if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


def test_targets_and_cut(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), ["b", None, "a", "B", "ä"][min(4, i % 11)], "x", 1, 2) for i in range(3000)] + [(5000, None, "a", "", 0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    per = {}
    for r in rows:
        per[r[2]] = per.get(r[2], 0) + size[r[0]]
    want = water(per, 1.5 * sum(per.values()))
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    source = {r[0]: r[2] for r in rows}
    taken = dict.fromkeys(per, 0)
    for r in found:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["source_size"] == per[s]
        assert r["target"] == pytest.approx(want[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    for s in per:
        assert abs(taken[s] - want[s]) <= 37
    assert sorted(map(tuple, mixing.mix(docs.repartition(7)).collect())) == sorted(map(tuple, found))
    mixed = mixing.mixed_documents(docs)
    assert mixed.schema == docs.schema
    assert mixed.count() == sum(r["copies"] for r in found)


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0
    same = spark.createDataFrame([(1, "a b", "s", "", 0, 0)] * 6 + [(None, None, None, None, None, None)], SCHEMA)
    assert mixing.mix(same).count() == 7


def test_texts_of_any_blanks(spark):
    texts = [None, "", " ", "a", "\x0b\x0ca\tb\rc\nd", "a b c", "x" * 9_000_000, "é é"]
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    found = {r["doc_id"]: r["size"] for r in mixing.sizes(docs).collect()}
    assert found == {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in enumerate(texts)}
