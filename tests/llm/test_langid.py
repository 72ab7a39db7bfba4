import zlib

import zstandard

from brindle.catalog import table
from brindle.llm import langid


def test_held_out_accuracy(spark):
    docs = table(spark, "/root/testdata/sf0.1", "documents")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    found = langid.identify(docs, langid.learn(docs)).collect()
    assert len(found) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    right = sum(r["lang_pred"] == truth[r["doc_id"]] for r in held)
    print("accuracy", right / len(held))
    assert right >= 0.97 * len(held)


def test_odd_rows(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 ##", "fr"), (None, "the house and the garden " * 5, None), (5, "la maison et le jardin " * 500_000, "fr"), (6, "the house", "en"), (6, "the house", "en"), (7, "Δ", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS score", "2 AS held_out")
    found = langid.identify(docs, {"en": b"the house and the garden ", "fr": b"la maison et le jardin "}).collect()
    got = sorted((r["doc_id"] or 0, r["lang_pred"]) for r in found)
    assert got[:7] == [(0, "en"), (1, "und"), (2, "und"), (3, "und"), (5, "fr"), (6, "en"), (6, "en")] and len(got) == 8
    assert {r["lang_pred"] for r in langid.identify(docs, {}).collect()} == {"und"}
    assert langid.identify(docs.limit(0), {}).count() == 0
    assert langid.learn(docs.limit(0)) == {}
    assert set(langid.learn(docs)) <= {"en", "fr"}


def plain_prediction(text, content):
    """Encodes the folded text with each dictionary in turn, blocks summed; ties by a finer encoding, then by name."""
    letters = "".join(c if "a" <= c <= "z" or ord(c) > 127 else " " for c in text.lower())
    data = " ".join(letters.split(" ")).encode()
    data = b" ".join(data.split())
    blocks = [data[i : i + langid.BLOCK] for i in range(0, len(data), langid.BLOCK)]

    def size(lang, level, pad):
        total = 0
        for block in blocks:
            known = zstandard.ZstdCompressionDict(content[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            total += len(zstandard.ZstdCompressor(level=level, dict_data=known, write_content_size=False, write_dict_id=False).compress(block + pad))
        return total

    sizes = {lang: size(lang, langid.LEVEL, b"") for lang in content}
    least = min(sizes.values())
    tied = [lang for lang in content if sizes[lang] == least]
    if len(tied) > 1:
        finer = {lang: size(lang, langid.FINE_LEVEL, langid.PAD) for lang in tied}
        return min(tied, key=lambda x: (finer[x], x)), sizes, True
    return tied[0], sizes, False


def test_equals_encoding_with_each_dictionary_one_by_one(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    content = langid.learn(docs)
    assert len(content) > 1
    texts = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    found = {r["doc_id"]: r for r in langid.identify(docs, content).collect()}
    checked = 0
    for doc_id, text in texts.items():
        if text is None or not any(c.isalpha() for c in text):
            assert found[doc_id]["lang_pred"] == "und"
            continue
        lang, sizes, tied = plain_prediction(text, content)
        assert found[doc_id]["lang_pred"] == lang
        if not tied:
            first, second = sorted(sizes.values())[:2]
            assert abs(found[doc_id]["score"] - (second - first) / second) < 1e-12
            assert found[doc_id]["rejected"] == (found[doc_id]["score"] < langid.MIN_MARGIN)
        checked += 1
    assert checked > 100


def test_ties_go_to_the_first_language(spark):
    same = b"the house and the garden and the long way home "
    docs = spark.createDataFrame([(1, "the house and the garden"), (2, "zz qq")], "doc_id long, text string")
    found = langid.identify(docs, {"xx": same, "aa": same}).collect()
    assert {(r["lang_pred"], r["score"], r["rejected"]) for r in found} == {("aa", 0.0, True)}


def test_rare_languages_are_learned_beside_common_ones(spark):
    rows = [(2, "the house and the garden by the river " * 20_000, "en"), (4, "la petite maison", "fr"), (5, "la petite maison", "fr"), (6, "das kleine haus", None)]
    rows = [r for i in range(9) for r in [(r[0] + 10 * i, *r[1:]) for r in rows]]
    content = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert b"la petite maison" in content["fr"] and set(content) == {"en", "fr"}
    assert len(content["en"]) <= langid.DICT + langid.PIECE + 1
    few = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), total=1000)
    assert set(few) == {"en"}
