import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from brindle.catalog import shared_folder, table
from brindle.llm import grammar, tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", "  ", "Don't <|endoftext|> STOP", "<|ENDOFTEXT|>", "été É", "ΣΑΣ ΟΔΟΣ", "naïve_x 12½ ²³ ٣", "a b c\u0085d\x1ce", "日本語 text", "I'LL we'Re", "a" * 5000, "İ ß ﬁ", "x\n" * 3000]


def plain(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=800, deadline=None)
@given(st.text(alphabet="aBéÉ' .s1_tΣ́²ßx-×ĳ<|", max_size=24))
def test_cached_words_are_the_tokenizer(text):
    texts = [text, None, text + " " + text, text]
    assert [x.tolist() for x in ENCODER.rows(pa.array(texts))] == [plain(TOKENIZER, t) for t in texts]


def test_blocks_of_long_texts(monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 64)
    monkeypatch.setattr(tokens, "CACHED", 300)
    texts = [t for x in ODD for t in (x, (x or "") * 40 if len(x or "") < 100 else x, f"{x} " * 3)]
    assert [x.tolist() for x in tokens.WordEncoder(PATH).rows(pa.array(texts))] == [plain(TOKENIZER, t) for t in texts]


def test_no_pair_stays_frequent():
    rng = np.random.default_rng(3)
    ids = np.concatenate([rng.zipf(1.3, 60_000) % 500 + 2, np.tile(rng.integers(2, 500, 300), 40), np.full(500, 3)]).astype("<u2")
    last = rng.random(len(ids)) < 0.01
    last[-1] = True
    codes, ends, rules = grammar.compress(ids, last.copy(), 600)
    lengths = np.ones(600 + len(rules), np.uint32)
    for i, (a, b) in enumerate(rules.tolist()):
        lengths[600 + i] = lengths[a] + lengths[b]
    assert (grammar.expand(codes, rules, 600) == ids).all()
    assert (grammar.expand_all(codes, rules, lengths[600:], 600) == ids).all()
    left = Counter((a, b) for a, b, e in zip(codes.tolist(), codes.tolist()[1:], ends.tolist()) if not e)
    assert max(left.values()) < grammar.OFTEN and ends.sum() == last.sum()
    assert len(rules) > grammar.PER_ROUND / 4


ENCODER, TOKENIZER = tokens.WordEncoder(PATH), Tokenizer.from_file(PATH)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), max_size=40), min_size=1, max_size=8), st.integers(1, 9))
def test_grammar_round_trip(texts, times):
    texts = [np.array([*t * times, 9], "<u2") for t in texts]
    s = grammar.Shard(grammar.shard(0, 0, list(range(len(texts))), texts, 10))
    for i, t in enumerate(texts):
        assert s.document(i).tolist() == t.tolist()
        for k in range(0, len(t), 7):
            assert s.token(i, k) == t[k]


def test_files_hold_all_ids(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").selectExpr("doc_id", "text", "1 AS start", "2 AS part")
    docs = docs.union(spark.createDataFrame([(-5 - i, t, 0, 0) for i, t in enumerate(ODD)], docs.schema))
    want, at = {}, 0
    for r in sorted(docs.collect(), key=lambda r: r["doc_id"]):
        ids = np.array([*plain(TOKENIZER, r["text"]), 1], "<u4")
        want[r["doc_id"]] = (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    path = shared_folder(spark)
    grammar.write(docs.repartition(5), PATH, path, shard_ids=20_000)
    found = grammar.read(spark, path).collect()
    assert len(found) == len(want) and {r["doc_id"]: tuple(r)[1:] for r in found} == want
    shards = spark.read.parquet(path)
    assert shards.count() > 3
    assert shards.selectExpr("sum(length(codes) / width) AS n").first()["n"] < 0.9 * at


def test_ties_nulls_and_no_rows(spark):
    rows = spark.createDataFrame([(1, "b"), (None, "a"), (1, "b"), (1, None), (2, "c")], "doc_id long, text string")
    found = sorted((tuple(r)[:3] for r in grammar.round_trip(rows, PATH).collect()), key=lambda r: r[1])
    assert found == [(None, 0, 2), (1, 2, 1), (1, 3, 2), (1, 5, 2), (2, 7, 2)]
    assert grammar.round_trip(rows.limit(0), PATH).count() == 0


def test_no_frequent_pair_is_left():
    ids = np.tile(np.arange(10, 210), 64)
    last = np.zeros(len(ids), dtype=bool)
    last[199::200] = True  # one passage of 200 ids, 64 times
    codes, ends, rules = grammar.compress(ids, last, 1000)
    pairs = Counter(p for i, p in enumerate(zip(codes[:-1].tolist(), codes[1:].tolist())) if not ends[i])
    assert max(pairs.values(), default=0) < grammar.OFTEN
    assert len(codes) == 64 and ends.all() and grammar.expand(codes, rules, 1000).tolist() == ids.tolist()
