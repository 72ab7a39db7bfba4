"""Odd rows of the operators that are DataFrame functions only; whole tables are compared with their SQL."""

import datetime

from pyspark.sql import functions as F

from brindle.llm import chat, licenses, urls


def test_rotation(spark):
    rows = [
        (1, 2, "bob", "hi <|im_end|>", 5),
        (1, 1, "amy", "hello", 5),
        (1, 1, "amy", "hello", 6),
        (1, None, None, None, 5),
        (1, 0, "system", "be kind", 5),
        (2, 0, "system", "alone", 5),
        (3, 70, "amy", "later", 5),
        (3, 0, "amy", "é", 5),
        (None, 0, "zoe", "x", 5),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n_messages int")
    found = {(r["conv_id"], r["perspective"], r["part"]): r for r in chat.rotate(df).collect()}
    assert set(found) == {(1, p, k) for p in ("amy", "bob", "unknown") for k in (0, None)} | {(3, "amy", 0), (3, "amy", 1), (None, "zoe", 0)}
    bob = found[1, "bob", 0]
    assert bob["text"] == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>user name=amy\nhello<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n"
    )
    a, b = map(int, bob["spans"].split(":"))
    assert bob["text"][a:b] == "hi < |im_end|><|im_end|>"
    assert (bob["n_messages"], bob["n_repeats"], bob["n_trained"]) == (3, 1, 1)
    assert found[1, "unknown", None]["spans"] and not found[1, "bob", None]["spans"]
    assert chat.rotate(df.limit(0)).count() == 0


def test_rotation_of_one_hot_conversation(spark):
    hot = spark.range(5000).selectExpr("7 AS conv_id", "id AS turn", "IF(id % 2 = 0, 'a', 'b') AS role", "'t' AS text")
    found = chat.rotate(hot)
    assert found.count() == 2 * (5000 // 64 + 1)
    assert found.groupBy().sum("n_messages").first()[0] == 10_000


def test_licenses(spark):
    apache = "Licensed under the Apache License, Version 2.0."
    header = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files\n(the \"Software\"), to deal in the Software without restriction."
    rows = [(1, None), (2, ""), (3, "some words\n" + apache.upper() + "\nmore"), (4, header), (5, "x " * 200_000 + "\n" + apache), (6, "word"), (7, "The quick brown fox jumps over the lazy dog."), (3, apache + "\nReleased under the MIT License")]
    found = licenses.scan(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS found", "2 AS norm")).collect()
    got = sorted((r["doc_id"], r["n_matches"], r["licenses"], r["best_license"], r["best_dice"]) for r in found if r["n_matches"])
    assert got == [(3, 2, "Apache-2.0", "Apache-2.0", 1.0), (3, 2, "Apache-2.0,MIT", "Apache-2.0", 1.0), (4, 1, "MIT", "MIT", 1.0), (5, 2, "Apache-2.0", "Apache-2.0", 1.0)]
    assert len(found) == len(rows)
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def day(n):
    return datetime.date(2024, 1, n)


CHANGES = [("bad.org", "add", "block", day(5)), ("BAD.org", "remove", "block", day(9)), ("ok.bad.org/x", "add", "allow", day(6)), ("bad.org", "add", "block", day(12)), (None, "add", "block", day(1)), ("never.org", "remove", "block", day(1))]


def captures(spark):
    rows = [(1, "http://bad.org", day(4)), (1, "http://bad.org", day(5)), (2, "https://u@www.Bad.org:80/a?b", day(8)), (3, "http://bad.org/", day(9)), (4, "http://ok.bad.org/x/y", day(7)), (5, "http://ok.bad.org/xy", day(20)), (6, None, day(8)), (7, "nonsense", day(8)), (8, "http://bad.org", None), (None, "http://notbad.org", day(8)), (9, "http://never.org", day(8))]
    return spark.createDataFrame(rows, "page_id long, url string, fetched_on date").selectExpr("*", "1 AS row", "2 AS key", "3 AS entry")


def test_url_lists(spark, monkeypatch):
    changes = spark.createDataFrame(CHANGES, "entry string, action string, list string, changed_on date")
    want = [(1, 0, None, False), (1, 1, "bad.org", True), (2, 1, "bad.org", True), (3, 0, None, False), (4, 2, "ok.bad.org/x", False), (5, 1, "bad.org", True), (6, 0, None, False), (7, 0, None, False), (8, 0, None, False), (9, 0, None, False), (None, 0, None, False)]
    for bound in (100, 0):  # broadcast, and salted
        monkeypatch.setattr(urls, "BROADCAST", bound)
        found = urls.judge(captures(spark), changes).collect()
        assert sorted(((r["page_id"], r["n_active"], r["decided_by"], r["blocked"]) for r in found), key=str) == sorted(want, key=str)
    assert urls.judge(captures(spark), changes.limit(0)).where("blocked").count() == 0
    assert urls.judge(captures(spark).limit(0), changes).count() == 0


def test_lists_have_intervals_of_their_own(spark):
    log = [("spam.example.org", "add", "block", "2024-01-10"), ("spam.example.org", "add", "allow", "2024-02-10"), ("spam.example.org", "remove", "allow", "2024-03-10"), ("spam.example.org", None, "block", "2024-03-11"), ("x.y", "add", None, "2024-01-01")]
    changes = spark.createDataFrame(log, "entry string, action string, list string, changed_on string").withColumn("changed_on", F.col("changed_on").cast("date")).where("action IS NOT NULL")
    days = ["2024-01-09", "2024-01-10", "2024-02-20", "2024-04-01"]
    pages = spark.createDataFrame([(i, "https://spam.example.org/a", d) for i, d in enumerate(days)], "page_id long, url string, fetched_on string").withColumn("fetched_on", F.col("fetched_on").cast("date"))
    found = {r["page_id"]: (r["n_active"], r["blocked"]) for r in urls.judge(pages, changes).collect()}
    assert found == {0: (0, False), 1: (1, True), 2: (2, True), 3: (1, True)}
