"""Golden values and brute force for operators that SQL can't express, and odd inputs."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from brindle.functions import predicates as P
from brindle.functions import text as T
from brindle.operators import documents as X
from brindle.operators import dml as D
from brindle.operators import governance as V
from brindle.operators import graph as G
from brindle.operators import search as S
from brindle.operators import vectors as N
from brindle.operators.ranks import placed
from brindle.operators.components import components

DOCS = [(1, "alpha", "Vector retrieval with graphs"), (2, "beta", "graph store; retrieval augmented"), (3, "gamma", "billing invoice overdue"), (4, "delta", "invoice workflow for retrieval")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "doc_id long, title string, text string")


@pytest.mark.parametrize(
    "query,mode,want",
    [
        ("retrieval graphs", "", {1}),
        ("overdue OR workflow", "", {3, 4}),
        ("retrieval -graph", "", {1, 4}),
        ('"graph store"', "", {2}),
        ("graph*", "", {1, 2}),
        ("graph invoice", "any", {2, 3, 4}),
        ("retrieval augmented", "phrase", {2}),
        ("-retrieval", "", {3}),
        ("NOT invoice retrieval", "boolean", {1, 2}),
    ],
)
def test_search_modes(docs, query, mode, want):
    assert {r["doc_id"] for r in S.search(docs, "doc_id", F.col("text"), S.parse(query, mode)).collect()} == want


def test_search_score_and_order(docs):
    found = S.search(docs, "doc_id", F.concat_ws(" ", "text", "text"), S.parse('retrieval "vector retrieval" graph*')).collect()
    assert [tuple(r) for r in found] == [(1, 2 + 4 + 0.75 * 2)]


def test_two_valued_predicates(spark):
    df = spark.createDataFrame([(1,), (None,), (3,)], "x int")
    kept = lambda p: [r["x"] for r in df.where(p).collect()]
    assert kept(P.in_list(F.col("x"), [1, None])) == [1]
    assert kept(P.not_in_list(F.col("x"), [1, None])) == [3]
    assert kept(~P.truth(F.col("x") == 1)) == [None, 3]
    assert kept(P.compare(F.col("x"), ">=", "2")) == [3]
    assert kept(P.Condition(children=[]).column()) == [1, None, 3]
    with pytest.raises(ValueError):
        P.compare(F.col("x"), "~", 1)


def test_glob(spark):
    df = spark.createDataFrame([("a.b",), ("axb",), ("a.bc",), (None,)], "k string")
    assert [r["k"] for r in df.where(P.glob(F.col("k"), "a.?")).collect()] == ["a.b"]
    assert [r["k"] for r in df.where(P.glob(F.col("k"), "a*c")).collect()] == ["a.bc"]


def test_text_functions(spark):
    one = lambda e: spark.range(1).select(e).first()[0]
    assert one(T.grams(F.lit("graph"))) == ["gr", "ra", "ap", "ph"]
    assert one(T.grams(F.lit("search"))) == ["sea", "ear", "arc", "rch"]
    assert one(F.levenshtein(F.lit("retrieval"), F.lit("retrival"))) == 1
    assert one(F.levenshtein(F.lit("graph"), F.lit("grahp"))) == 2
    assert one(T.search_tokens(F.lit("What is the status of case-123 and order:ab-9?"))) == ["case-123", "order:ab-9", "ab-9", "status", "case", "123", "order", "ab", "9"]
    assert one(T.search_tokens(F.lit("the of"))) == ["the", "of"]
    assert one(T.html_to_text(F.lit("<html><script>x()</script><p>A &amp; B</p><style>p{}</style>  &lt;c&gt;</html>"))) == "A & B <c>"
    assert one(T.mask(F.lit("4111111111111111"), "partial")) == "*" * 12 + "1111"
    assert one(T.mask(F.lit("abc"), "partial")) == "***"
    assert one(T.snippet(F.lit("x" * 60 + "term" + "y" * 60), "TERM")) == "..." + "x" * 48 + "term" + "y" * 48 + "..."
    assert one(T.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) == 0.0
    assert one(T.class_rank(F.lit("restricted"))) == 4 and one(T.class_rank(F.lit("?"))) == 0


def test_chunks_of_words(spark):
    text = " ".join(f"w{i}" for i in range(25))
    got = X.chunks(spark.createDataFrame([(1, text), (2, "a  b"), (3, " "), (4, None)], "doc_id long, text string"), 10, 3).collect()
    mine = sorted((r["index"], r["chunk"]) for r in got if r["doc_id"] == 1)
    assert [len(c.split()) for _, c in mine] == [10, 10, 10, 4] and mine[-1][1].endswith("w24")
    assert len({r["chunk_id"] for r in got}) == len(got)
    assert [r["chunk"] for r in got if r["doc_id"] == 2] == ["a  b"]
    assert {r["doc_id"] for r in got} == {1, 2}


def test_entities_of_one_sentence(spark):
    text = "Dr. Jane Doe of Acme Corp (jane@acme.com) paid $1,200.50 on 2024-01-02 for CASE-12345, PROJ-77 at 10.0.0.1, see https://acme.com/x and 12%."
    got = {r["type"]: r["canonical"] for r in X.entities(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert got["EMAIL"] == "jane@acme.com" and got["MONEY"] == "$1,200.50" and got["DATE"] == "2024-01-02" and got["IP_ADDRESS"] == "10.0.0.1"
    assert got["URL"] == "https://acme.com/x" and got["PERCENTAGE"] == "12%" and got["PERSON"] == "Dr. Jane Doe" and "TICKET_ID" in got and "ORG" in got


def test_resolution(spark):
    rows = [("s", "ORG", x) for x in ("Acme Corp", "Acme Corp", "acme corp.", "Globex")] + [("t", "ORG", "Acme Corps")]
    got = {(r["scope"], r["surface"]): r["canonical"] for r in X.resolve(spark.createDataFrame(rows, "scope string, type string, surface string")).collect()}
    assert got == {("s", "Acme Corp"): "Acme Corp", ("s", "acme corp."): "Acme Corp", ("s", "Globex"): "Globex", ("t", "Acme Corps"): "Acme Corps"}
    assert X.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert X.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
    assert X.jaro("abc", "xyz") == 0


def test_masking_matches_brute_force(spark):
    text = "mail a.b@c.org or d@e.org, call 555-123-4567 or +1-5551234567 from 10.1.2.3, born 01/02/1990"
    want = text
    for d in X.DETECTORS:
        if d.action == "mask":
            for m in dict.fromkeys(re.findall(d.pattern, want)):
                want = want.replace(m, "*" * max(0, len(m) - 4) + (m[-4:] if len(m) > 4 else "*" * len(m)))
    got = X.masked(spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r["text"] for r in got] == [want, None, ""]
    assert "a.b@" not in want


def test_classification(spark):
    rows = [(1, "SSN 123-45-6789"), (2, "nothing here"), (3, "card 4111111111111111"), (4, "card 4111111111111112"), (5, "10 mg"), (6, None)]
    got = {r["doc_id"]: (r["confidence"], r["data_class"]) for r in X.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (0.95, "restricted"), 2: (0.0, "internal"), 3: (0.9, "restricted"), 4: (0.0, "internal"), 5: (0.6, "internal"), 6: (0.0, "internal")}


EDGES = [("api", "worker", "calls", 0.9), ("worker", "jobs", "reads", 0.8), ("jobs", "events", "emits", 0.7), ("billing", "invoices", "writes", 0.6)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, "source string, target string, type string, confidence double")


def test_graph(spark, edges):
    seed = spark.createDataFrame([("api",)], "node string")
    assert {tuple(r) for r in G.reach(edges, seed, 3).collect()} == {("api", 0), ("worker", 1), ("jobs", 2), ("events", 3)}
    assert G.expand(edges, seed, 3).count() == 3
    assert G.shortest_paths(edges, "api", "events").first()["path"] == ["api", "worker", "jobs", "events"]
    assert G.shortest_paths(edges, "events", "api").count() == 0
    assert G.shortest_paths(edges, "api", "api").first()["path"] == ["api"]
    assert sorted(r["members"] for r in G.component_sizes(edges).collect()) == [2, 4]
    assert {r["node"]: r["degree"] for r in G.degrees(edges).collect()}["worker"] == 2


def test_aliases_with_a_cycle(spark):
    aliases = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")], "alias string, canonical string")
    names = spark.createDataFrame([("a",), ("c",), ("x",), ("q",)], "name string")
    assert {tuple(r) for r in G.resolve_aliases(names, aliases).collect()} == {("a", "c"), ("c", "c"), ("x", None), ("q", "q")}


def test_components_against_union_find(spark):
    rng = random.Random(3)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(400 + i, 401 + i) for i in range(60)]
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        root[max(find(a), find(b))] = min(find(a), find(b))
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert found == {x: find(x) for x in root}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_write_few_rows(spark, monkeypatch):
    """Hubs in a row with leaves: what all rounds write is a multiple of the edges, not edges times rounds."""
    from brindle.operators import components as C

    hubs, each = 300, 20
    pairs = [(h, h + 1) for h in range(hubs - 1)] + [(h, 1000 + h * each + i) for h in range(hubs) for i in range(each)]
    written, write = [], C.materialize

    def counted(df):
        out = write(df)
        written.append(out.count())
        return out

    monkeypatch.setattr(C, "materialize", counted)
    found = C.components(spark.createDataFrame(pairs, "a long, b long")).collect()
    assert len(found) == hubs * (each + 1) and {r["component"] for r in found} == {0}
    assert sum(written) < 6 * len(pairs)


def test_merkle_tree(spark):
    def plain(leaves):
        while len(leaves) > 1:
            leaves = leaves + leaves[-1:] * (len(leaves) % 2)
            leaves = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(leaves[::2], leaves[1::2])]
        return leaves[0]

    for n in (1, 2, 3, 4, 5, 8, 9, 13, 17, 33):
        leaves = [hashlib.sha256(str(i).encode()).hexdigest() for i in range(n)]
        rows = spark.createDataFrame([("b", i, x) for i, x in enumerate(leaves)], "block string, place long, hash string")
        assert V.merkle_roots(rows, "hash", fan=4).first()["root"] == plain(leaves), n


def test_nearest(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (2, [0.9, 0.1, 0.0]), (3, [0.0, 1.0, 0.0]), (4, [0.0, 0.0, 0.0]), (5, None), (6, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert [r["vec_id"] for r in N.nearest(df, [1.0, 0.0, 0.0], 2).collect()] == [1, 2]
    found = N.nearest_of_each(df, df.where("vec_id < 4").withColumnRenamed("vec_id", "query_id"), 1).collect()
    assert {r["query_id"]: r["vec_id"] for r in found} == {1: 1, 2: 2, 3: 3}


def test_fuzzy(spark):
    df = spark.createDataFrame([(1, "graph retrieval engine"), (2, "grahp retrival"), (3, "other words"), (4, "case 12345")], "doc_id long, text string")
    found = {r["doc_id"]: r["score"] for r in N.fuzzy_search(df, ["retrieval", "graph"], 2).collect()}
    assert found[1] == 1.0 and 0.6 < found[2] < 0.9 and 3 not in found
    assert not N.fuzzy_search(df, ["12346"], 2).collect()


def test_changes_with_nulls_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    assert sorted(map(tuple, D.upsert(df, spark.createDataFrame([(2, "b"), (3, None)], df.schema), "k").collect())) == [(1, "a"), (2, "b"), (3, None)]
    assert sorted(map(tuple, D.upsert(df.limit(0), df, "k").collect())) == [(1, "a"), (2, None)]
    assert [r["k"] for r in D.delete(df, F.col("v") == "a").collect()] == [2]
    log = spark.createDataFrame([(1, 5, 1, "x"), (1, 5, 2, "y"), (1, 4, 9, "z")], "k long, ts long, seq long, v string")
    assert D.latest(log, "k", "ts", "seq").first()["v"] == "y"


def test_places_over_a_whole_table(spark):
    rows = [(i, None if i % 7 == 0 else (i * 37) % 100, None if i % 3 == 0 else i % 3) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v long, g long").repartition(7)
    order = [F.col("v").desc_nulls_first(), F.col("id")]
    key = lambda r: (r[1] is not None, -(r[1] or 0), r[0])
    want = {r[0]: i for i, r in enumerate(sorted(rows, key=key), 1)}
    assert {r["id"]: r["place"] for r in placed(df, order, "place").collect()} == want
    within = {}
    for g in {r[2] for r in rows}:
        within |= {r[0]: i for i, r in enumerate(sorted((r for r in rows if r[2] == g), key=key), 1)}
    assert {r["id"]: r["place"] for r in placed(df, order, "place", ("g",)).collect()} == within
    assert placed(df.limit(0), order, "place").count() == 0
