import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from brindle.catalog import table
from brindle.llm import quality
from brindle.llm.words import SPACED, Hasher

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    hit = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 20 or 100 * len(hit) > 30 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed)


ODD = [None, "", " \n\t", "a", "é ü x y", "a b " * 40, "x\n" * 30, "## <b>|$%&", "\x0b\x0cq\x1c\x1dr", "w " * 8 + "v " * 9, "z" * 300_000, "long word " * 400_000]


def test_statistics_match_brute_force(spark):
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    odd = spark.createDataFrame([(10_000 + i, t, i, "x") for i, t in enumerate(ODD)], "doc_id long, text string, n_words int, kept string")
    texts |= {10_000 + i: t for i, t in enumerate(ODD)}
    found = quality.assess(docs.select("doc_id", "text").union(odd.select("doc_id", "text")), None).collect()
    assert len(found) == len(texts)
    for r in found:
        assert tuple(r)[1:7] == brute(texts[r["doc_id"]]), r["doc_id"]
        assert r["kept"] == (not r["base_failed"])
    assert quality.assess(odd, None).count() == len(ODD)


def test_model_separates_held_out_labels(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.1", t) for t in ("documents", "labels"))
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    truth = labels.where("doc_id % 2 = 1").selectExpr("doc_id", "quality AS good")
    found = quality.assess(docs, model).join(truth, "doc_id").where("NOT base_failed").collect()
    right = Counter((r["good"], r["kept"]) for r in found)
    assert right[1, True] >= 0.99 * (right[1, True] + right[1, False])
    assert right[0, False] >= 0.95 * (right[0, False] + right[0, True])


def test_driver_gets_weights_alone(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", t) for t in ("documents", "labels"))
    tracemalloc.start()
    model = quality.train(docs, labels)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert model is not None and most < 3e6  # the rows' features take 16 KB each


def test_without_labels_or_rows(spark):
    docs = table(spark, SF, "documents")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.train(docs, none) is None
    assert quality.train(docs, spark.createDataFrame([(1, 1), (None, 0), (2, None)], none.schema)) is None
    assert quality.assess(docs.limit(0), None).count() == 0
    kept = quality.keep(docs, None)
    assert kept.schema == docs.schema and 0 < kept.count() <= docs.count()


def test_long_texts_in_blocks(monkeypatch):
    texts = ["wörd one two, " * 400, "日本 x" * 300, "a" * 700, "b c " * 200 + "é"]
    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=quality.DIM).astype(np.float32), rng.normal(size=quality.DIM).astype(np.float32), 0.1)
    want = quality.judged(pa.array(texts), Hasher(SPACED), model)
    rows = [r["x"].as_py() for r in quality_rows(texts)]
    monkeypatch.setattr(quality, "BLOCK", 100)
    for i, t in enumerate(texts):
        got = quality.judged(pa.array([t]), Hasher(SPACED), model)
        for k, v in got.items():
            assert np.allclose(v[0], want[k][i]), k
    assert [r["x"].as_py() for r in quality_rows(texts)] == rows


def quality_rows(texts):
    for t in texts:
        batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([t])], ["doc_id", "quality", "text"])
        for out in quality.training_rows([batch]):
            yield {"x": out.column("x")[0]}


def test_labels_that_disagree_and_repeated_ids(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["good", "fine", "word"] if i % 2 else ["bad", "junk", "zzz"], 40)) for i in range(60)]
    docs = spark.createDataFrame([(i // 2 * 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, q) for i in range(60) for q in ((1, 0) if i % 4 == 0 else (1, None))], "doc_id long, quality int")
    a, b = (quality.train(docs.repartition(n), labels) for n in (1, 7))
    assert a is not None and np.array_equal(a.words, b.words) and a.bias == b.bias
