"""Byte ranges, multipart ETags and audit chains against plain Python."""

import hashlib
import random

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.operators import governance as V
from brindle.plans import registry

SF = "/root/testdata/sf0.001"


def test_byte_ranges(spark):
    text = "aé0123456789".encode()  # 13 bytes
    asked = [("bytes=0-1", 206, [text[:2]]), ("bytes=2-", 206, [text[2:]]), ("bytes=-3", 206, [text[-3:]]), ("bytes=-99", 206, [text]), ("bytes=5-99", 206, [text[5:]])]
    asked += [("bytes=0-0, 12-12,-1", 206, [text[:1], text[12:], text[12:]]), ("bytes=13-", 416, None), ("bytes=3-2", 416, None), ("bytes=-0", 416, None), ("bytes=0-1,50-60", 416, None)]
    asked += [("bytes=a-1", 400, None), ("bytes=-", 400, None), ("bytes=5", 400, None), ("items=0-1", 400, None), ("bytes=99999999999999999999-", 400, None), (None, 200, None), ("", 200, None), ("bytes=", 200, None)]
    rows = [(i, bytearray(text), h) for i, (h, _, _) in enumerate(asked)] + [(100, bytearray(), "bytes=0-")]
    found = {r["id"]: (r["status"], r["ranges"] and [bytes(x["content"]) for x in r["ranges"]]) for r in V.byte_ranges(spark.createDataFrame(rows, "id long, content binary, range string")).collect()}
    assert found == {i: (s, want) for i, (_, s, want) in enumerate(asked)} | {100: (416, None)}


def test_queries_of_bytes(spark):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, SF, "documents").collect()}
    for r in registry.queries["byte_ranges"](spark, SF).collect():
        if r["status"] == 206:
            assert r["md5"] == hashlib.md5(texts[r["doc_id"]][r["start"] : r["stop"] + 1]).hexdigest()
    etags = {r["doc_id"]: r["etag"] for r in registry.queries["multipart_etags"](spark, SF).collect()}
    for i, t in texts.items():
        parts = [hashlib.md5(t[k : k + 1024]).digest() for k in range(0, max(len(t), 1), 1024)]
        assert etags[i] == f"{hashlib.md5(b''.join(parts)).hexdigest()}-{len(parts)}"
    assert max(int(e.split("-")[1]) for e in etags.values()) > 2


def sha(*parts):
    return hashlib.sha256("|".join(map(str, parts)).encode()).hexdigest()


def chain(n):
    """Blocks of five events, each hash over the one before, and the events."""
    blocks, events, previous = [], [], ""
    for h in range(n):
        leaves = [sha(h, i) for i in range(5)]
        root = V.merkle(leaves)
        blocks.append([h, sha(h, previous, 1000 + h, root), previous, 1000 + h, root])
        events += [(h, i, x) for i, x in enumerate(leaves)]
        previous = blocks[-1][1]
    return blocks, events


def checked(spark, blocks, events):
    blocks = spark.createDataFrame([tuple(b) for b in blocks], "height long, hash string, previous string, ts long, root string")
    return sorted(map(tuple, V.chain_check(blocks, spark.createDataFrame(events, "block long, place long, leaf string"), "leaf").collect()))


def test_chain_over_many_ranges(spark):
    blocks, events = chain(120)
    random.Random(2).shuffle(blocks)
    assert checked(spark, blocks, events) == []
    at = {b[0]: b for b in blocks}
    at[7][1] = "0"  # a hash of its own
    at[20][2] = "0"  # another block before
    at[31][3] = 5  # an early time
    events[40 * 5] = (40, 0, "0")  # an altered event
    blocks.remove(at[55])
    want = [(7, "hash"), (8, "link"), (20, "hash"), (20, "link"), (31, "hash"), (31, "time"), (40, "root"), (55, "orphan"), (56, "gap")]
    assert checked(spark, blocks, events) == sorted(want)
    heights = spark.range(0, 3000).where("id % 500 <> 499").selectExpr("id AS height", "CAST(id AS STRING) AS hash", "IF(id > 0, CAST(id - 1 AS STRING), NULL) AS previous", "id AS ts")
    faults = V.chain_faults(heights)
    assert sorted(map(tuple, faults.collect())) == [(h, "gap") for h in range(500, 3000, 500)]
    assert V.chain_faults(heights.limit(0)).count() == 0


def test_chain_of_events(spark):
    found = sorted(map(tuple, registry.queries["audit_chain_events"](spark, SF).collect()))
    ids = sorted(r["event_id"] for r in table(spark, SF, "events").select("event_id").collect())
    heights = sorted({i // 64 for i in ids})
    want = {(h, "orphan") for h in heights if h % 37 == 30} | {(h, "hash") for h in heights if h % 31 == 5} | {(i // 64, "root") for i in ids if i % 1009 == 7}
    kept = [h for h in heights if h % 37 != 30]
    want = {(h, f) for h, f in want if f == "orphan" or h in kept}
    want |= {(h, "gap") for g, h in zip(kept, kept[1:]) if h != g + 1} | {(h, "link") for g, h in zip(kept, kept[1:]) if h == g + 1 and h % 29 == 11}
    assert {x for x in found if x[1] != "time"} == want
    assert len(found) == len(set(found)) and {h for h, f in found if f == "time"} <= {h for h in kept if h % 41 == 20 or (h - 1) % 31 == 5}
