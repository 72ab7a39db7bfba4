import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from brindle.catalog import table
from brindle.llm import pii

PLAIN = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def passes(kind, text):
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return all(int(p) <= 255 for p in text.split("."))
    if kind == 2:
        total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return kind == 0 or 10 <= len(digits) <= 15


def brute(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in re.finditer(p, text) if passes(k, m[0]))


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="a1.@-+ 0(é9_%", max_size=40))
def test_base_is_the_plain_patterns(text):
    assert pii.base_spans(text) == brute(text)


def test_documents(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents").selectExpr("doc_id", "text", "1 AS n_ip", "2 AS row")
    odd = [None, "", "@", "1" * 2000, "a" * 2000 + "@b.c", "x@y.z" * 500, "+1 (521) 555-6210", "4111 1111 1111 1111", "é 10.0.0.1.2 999.1.1.1"]
    docs = docs.union(spark.createDataFrame([(9000 + i, t, 0, 0) for i, t in enumerate(odd)], docs.schema))
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    found = pii.find(docs).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = brute(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        assert r["base_sha256"] == hashlib.sha256(pii.text_of(spans).encode()).hexdigest()
        assert set(filter(None, pii.text_of(spans).split(","))) <= set(filter(None, r["spans"].split(",")))
    assert pii.find(docs.limit(0)).count() == 0


def test_long_runs_take_linear_time():
    for text in ("1" * 500_000, "a" * 500_000 + "@b.c", "x@y.z" * 50_000, "+1" * 200_000, "1.2." * 100_000, "@" * 500_000):
        pii.examined(text)


def test_bootstrapping_finds_unseen_identifiers(spark):
    rows = [(i, f"please call me at +1 (555) 555-00{i:02d} today") for i in range(8)]
    rows += [(100, "please call me at 555-0199-88 today"), (101, "we counted 555-0199-77 pebbles there"), (100, "please call me at 555-0199-88 today"), (None, None)]
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted((r["doc_id"] or 0, r["spans"], r["n_phone"]) for r in found if r["n_added"])
    assert got == [(100, "phone:18:29", 0), (100, "phone:18:29", 0)]


def test_bootstrapping_opens_patterns_until_nothing_is_added(spark):
    """A chain of contexts: the seeds open the first, and what each holds opens the next."""
    contexts = [f"{w} {w} {{}} {w}" for w in ("one", "two", "three", "four", "five", "six")]
    rows = [(0, contexts[0].format(f"+1 (555) 555-01{k:02d}")) for k in range(40)]
    want = []
    for step in range(6):
        for k in range(30):  # each number is in its own context and in the next
            number = f"555-{step:02d}{k:02d}-77"
            for at in range(step, min(step + 2, 6)):
                rows.append((step + 1, contexts[at].format(number)))
                want.append(number)
    found = pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r["n_added"] for r in found) == len(want)
    assert {s.split(":")[0] for r in found for s in r["spans"].split(",")} == {"phone"}


def test_number_of_phone_or_card_length_is_offered_as_both(spark):
    assert [(k, b - a) for a, k, b in pii.likely_spans("ring 0044 20 7946 0018 now")] == [(2, 17), (3, 17)]
    rows = [(i, f"please call me at +1 (555) 555-00{i:02d} today") for i in range(12)]
    rows += [(100, "please call me at 0044 20 7946 0018 today")]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_added"]}
    assert found == {100: "phone:18:35"}


def test_one_label_and_line_starts_are_patterns(spark):
    rng = random.Random(5)
    rows = [(i, f"{rng.choice('abcdefgh')} {rng.choice('pqrstu')} phone: +1 (555) 555-01{i:02d} {rng.choice('abcdefgh')}") for i in range(40)]
    rows += [(100, "q z phone: 555-0199-88 z"), (101, "q z counted 555-0199-77 pebbles")]
    found = {r["doc_id"]: r["spans"] for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["n_added"]}
    assert found == {100: "phone:11:22"}


def test_digits_within_words_are_no_candidates():
    assert list(pii.likely_spans('token = "9b0b3c6a43eb78aa99572391524f37a8" x1234567 1234567y 1234567_')) == []
