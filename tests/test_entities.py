"""Entity rules on hard texts, entity queries, pushdown."""

import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.functions import predicates as P
from brindle.catalog import table
from brindle.operators import documents as X
from brindle.operators import entities as E

PIECES = "foo Foo Bar Inc Inc. Group Holdings a b-c - _ . .com com x9 9x @ / // C:\\ \\ & Corp 12 1,200.50 USD $ % : a.b@c.de 1.2.3.4 Ab9 LLC é https:// x.y/z foo-bar.com_".split() + [" ", "  ", "\n", " EUR"]


def test_linear_rules_match_as_the_plain_ones(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 14))) for _ in range(8000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    wrong = [F.sum((X.surfaces(rule) != F.regexp_extract_all("text", F.lit(rule.pattern), F.lit(0))).cast("int")).alias(f"r{i}") for i, rule in enumerate(X.RULES)]
    email = next(d for d in X.DETECTORS if d.subtype == "email")
    wrong.append(F.sum((X.detections(email, F.col("text")) != F.regexp_extract_all("text", F.lit(email.pattern), F.lit(0))).cast("int")))
    assert set(df.agg(*wrong).first()) == {0}


def test_rules_take_linear_time(spark):
    hard = ["/a", "a.", "Word ", "x", "1,", "a-", "Foo Inc ", "a@", "C:\\a", "x.com_", "1.1.", "+1 ", "sk-", "_a.b", "A&", "January ", " "]
    texts = [h * (1_000_000 // len(h)) for h in hard] + ["x" * 1_000_000 + ":\\", "a@" + "a." * 400_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(8)
    began = time.time()
    assert X.entities(df).count() >= 3
    assert X.classify(df).count() == len(texts)
    assert time.time() - began < 120


def test_entity_query(spark):
    rows = [(1, "p", "b", {"g": "x"}, None, 1, 9), (2, "p", "a", {"g": "y"}, {"m": "1"}, 2, 8), (3, "q", None, None, {"m": "1"}, 3, 7), (4, "p", "a", {"g": "x", "h": "z"}, {"m": "2"}, None, 6)]
    df = spark.createDataFrame(rows, "id long, type string, name string, tags map<string,string>, metadata map<string,string>, created int, modified int")
    ids = lambda **k: [r["id"] for r in E.query(df, **k).collect()]
    assert ids() == [3, 2, 4, 1] and ids(descending=True) == [1, 2, 4, 3] and ids(order="nonsense", limit=2, offset=1) == [2, 4]
    assert ids(type="p") == [2, 4, 1] and ids(tags={"g": "x"}) == [4, 1] and ids(tags={"g": "x", "h": "z"}) == [4]
    assert ids(metadata={"m": "1"}) == [3, 2] and ids(created=(2, 3)) == [3, 2] and ids(modified=(None, 7), order="modified") == [4, 3]


def test_keyword_search(spark):
    rows = [(1, "Error ERR-42 in the api"), (2, "the api api fails"), (3, "nothing"), (4, None), (5, "err-42 again, and err-43")]
    df = spark.createDataFrame(rows, "chunk_id long, chunk string")
    ids = lambda q, m=False: [r["chunk_id"] for r in E.keyword_search(df, q, m).collect()]
    assert ids("api") == [2, 1] and ids("the api fails") == [2] and ids("api fails", True) == [2, 1]
    assert ids("ERR-42 api") == [1, 5] and ids("err-42 err-43") == [5] and ids("") == []


def test_listing_and_versions(spark):
    df = spark.createDataFrame([("a/b/c", 1), ("a/b/d", 2), ("a/e", 3), ("f", 4)], "key string, size long")
    assert [tuple(r) for r in E.listing(df, "a/", "/").collect()] == [("a/b/", True, 2, 3), ("a/e", False, 1, 3)]
    assert [r["key"] for r in E.listing(df, start_after="a/b/c", most=2).collect()] == ["a/b/d", "a/e"]
    v = spark.createDataFrame([("k", 1, False), ("k", 2, False), ("d", 1, False), ("d", 2, True)], "key string, version int, deleted boolean")
    assert sorted((r["key"], r["version"]) for r in E.versions(v).where("is_latest").collect()) == [("k", 2)]


def test_filters_reach_the_scan(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").where(P.all_of([("lang", "=", "en"), ("n_chars", ">", 300)]))
    plan = docs._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan.split("PushedFilters:")[1]
    assert docs.where("lang <> 'en' OR n_chars <= 300").count() == 0
