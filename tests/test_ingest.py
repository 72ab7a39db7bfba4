"""Ingest, deletion, sync, merges and operation validation on small rows."""

from pyspark.sql import functions as F

from brindle.operators import documents as X
from brindle.operators import governance as V
from brindle.operators import ingest as I
from brindle.operators import merges as M


def test_ingest_takes_each_source_once(spark):
    rows = [("a", "mail bob@example.com and Bob@example.com"), ("a", "mail bob@example.com and Bob@example.com"), ("b", ""), (None, "x"), ("", "x"), ("c", None), ("d", "new text"), ("d", "other text"), ("k", "known")]
    items = spark.createDataFrame(rows, "source string, text string").selectExpr("*", "1 AS doc_id", "2 AS digest")
    corpus = I.ingest(items, spark.createDataFrame([("k",), ("k",)], "source string"))
    docs = {r["source"]: r["text"] for r in corpus.documents.collect()}
    assert sorted(docs) == ["a", "d"] and corpus.documents.count() == 2
    assert I.ingest(items.orderBy("text", ascending=False)).documents.where("source = 'd'").first()["text"] == docs["d"]
    assert corpus.chunks.count() == 2
    emails = corpus.entities.where("type = 'EMAIL'").collect()
    assert [(r["canonical"].lower(), r["mentions"]) for r in emails] == [("bob@example.com", 2)]
    assert corpus.chunk_entities().where("type = 'EMAIL'").count() == 1
    assert I.ingest(items.limit(0)).documents.count() == 0


def test_entities_are_found_and_resolved_in_one_pass(spark):
    texts = ["mail jane.doe@example.com, jane.doe@example.org; jane.doe@example.com and joe@x.io", "on 2024-01-02 and 2024-01-03 see PROJ-7", "PROJ-8 of Acme Corp and Acme Corp. for Globex Inc", "nothing"]
    corpus = I.ingest(spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "source string, text string"))
    found = X.entities(corpus.documents)
    groups = X.resolve(found.select(F.col("doc_id").alias("scope"), "type", "surface")).selectExpr("scope AS doc_id", "type", "surface", "canonical AS leader")
    want = found.join(groups, ["doc_id", "type", "surface"]).groupBy("doc_id", "type", "leader").agg(F.max("confidence"), F.sum("mentions"))
    got = corpus.entities.select("doc_id", "type", "canonical", "confidence", "mentions")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() < found.count()
    plan = corpus.entities._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "FlatMapGroupsInPandas" not in plan


def test_delete_cascades(spark):
    items = spark.createDataFrame([("a", "see bob@example.com"), ("b", "see eve@example.com")], "source string, text string")
    left = I.ingest(items).without_sources(spark.createDataFrame([("a",), ("zz",)], "source string"))
    assert [r["source"] for r in left.documents.collect()] == ["b"]
    assert left.chunks.count() == 1
    assert [r["canonical"] for r in left.entities.where("type = 'EMAIL'").collect()] == ["eve@example.com"]


def test_resources(spark):
    rows = spark.createDataFrame([("k", "value"), ("n", None), ("e", ""), ("big", "x" * 50)], "key string, value string")
    found = I.resources({"kv": rows, "secret": rows}, max_bytes=20)
    assert {r["type"]: (r["indexed"], r["skipped"]) for r in I.sync_status(found).collect()} == {"kv": (1, 3), "secret": (4, 0)}
    assert {r["text"] for r in found.where("type = 'secret'").collect()} == {"k", "n", "e", "big"}
    assert I.resources({"secret": rows}, 20, secret_values=True).where("indexed").first()["text"] == "value"


def test_merges(spark):
    rows = [("t", [" b", "a", "", "t", "a", None], "why"), ("t", ["a", "b"], " why "), ("t", ["t"], "x"), ("", ["a"], "x"), (None, ["a"], "x"), ("u", None, "x"), ("u", ["c"], None)]
    proposed = M.propose(spark.createDataFrame(rows, "target string, sources array<string>, reason string"))
    found = {r["target"]: r for r in proposed.collect()}
    assert proposed.count() == 2 and found["t"]["sources"] == ["a", "b"] and found["u"]["reason"] == ""
    ids = {t: r["proposal_id"] for t, r in found.items()}
    verdicts = spark.createDataFrame([(ids["t"], 2, "rejected"), (ids["t"], 1, "approved"), (ids["u"], 1, "nonsense"), ("none", 1, "approved")], "proposal_id string, place int, status string")
    once = M.review(proposed, verdicts)
    assert {r["target"]: r["status"] for r in once.collect()} == {"t": "approved", "u": "pending"}
    again = M.review(once, spark.createDataFrame([(ids["t"], 3, "rejected"), (ids["u"], 3, "rejected")], "proposal_id string, place int, status string"))
    assert {r["target"]: r["status"] for r in again.collect()} == {"t": "approved", "u": "rejected"}
    aliases = M.merge(spark.createDataFrame([("a", "old"), ("z", "y")], "alias string, canonical string"), once.where("status = 'approved'"))
    assert sorted(tuple(r) for r in aliases.collect()) == [("a", "t"), ("b", "t"), ("z", "y")]
    assert sorted(r["alias"] for r in M.split(aliases, spark.createDataFrame([("b",), ("b",)], "alias string")).collect()) == ["a", "z"]


def test_operation_validation(spark):
    tags = spark.createDataFrame([("p", ["gdpr", "pci"], True, 0, "confidential"), ("f", ["fips"], False, 5, "public")], "path string, frameworks array<string>, encrypt boolean, retention_days int, data_class string")
    schema = "request int, path string, operation string, actor string, algorithm string, reason string, encrypted boolean, mfa boolean, system boolean, data_age int"
    rows = [
        (1, "p", "write", "u", None, None, False, True, False, 1),
        (2, "p", "write", "u", None, None, True, True, False, 1),
        (3, "p", "write", None, None, None, False, None, True, 1),
        (4, "q", "write", None, None, None, None, None, None, None),
        (5, "f", "write", "u", "MD5", None, True, True, False, 1),
        (6, "f", "read", "u", "MD5", None, True, True, False, 1),
        (7, None, "read", "u", "MD5", None, True, True, False, 1),
        (8, "p", "delete", None, None, "", None, None, None, None),
    ]
    found = {r["request"]: r for r in V.validate_operations(spark.createDataFrame(rows, schema), tags).collect()}
    assert {k: r["allowed"] for k, r in found.items()} == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True, 7: True, 8: False}
    assert found[1]["violated"] == ["GDPR Article 32: confidential data must be encrypted", "PCI DSS 3.4: cardholder data must be encrypted", "PCI DSS 3.1: retention policy required", "encryption required but data is not encrypted"]
    assert found[2]["violated"] == ["PCI DSS 3.1: retention policy required"] and found[3]["why"] == V.BYPASSED and found[4]["why"] == V.UNTAGGED == found[7]["why"]
    assert found[8]["actions"] == ["record deletion reason for GDPR compliance", "PCI DSS 10.1: log all access to cardholder data"]
