"""Walks over the whole graph, and long alias chains, against plain Python."""

from collections import Counter, deque

from brindle.catalog import table
from brindle.operators import graph as G
from brindle.plans import graphs, registry

SF = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    return [tuple(r) for r in table(spark, SF, name).select(*columns).collect()]


def plain_edges(spark):
    keys = [k for k, in rows(spark, "supplier", "s_suppkey")]
    out = [(f"nation:{a}", f"region:{b}") for a, b in rows(spark, "nation", "n_nationkey", "n_regionkey")]
    out += [(f"supplier:{a}", f"nation:{b}") for a, b in rows(spark, "supplier", "s_suppkey", "s_nationkey")]
    out += [(f"supplier:{k}", f"supplier:{k + 1}") for k in keys if k + 1 in keys]
    out += [(f"customer:{a}", f"nation:{b}") for a, b in rows(spark, "customer", "c_custkey", "c_nationkey")]
    return out + [(f"order:{a}", f"customer:{b}") for a, b in rows(spark, "orders", "o_orderkey", "o_custkey")]


def walk(links, start, depth):
    far, queue = {start: 0}, deque([start])
    while queue:
        at = queue.popleft()
        for to in links.get(at, ()) if far[at] < depth else ():
            if to not in far:
                far[to] = far[at] + 1
                queue.append(to)
    return far


def test_whole_graph(spark):
    edges = plain_edges(spark)
    assert Counter(edges) == Counter((r["source"], r["target"]) for r in graphs.whole_edges(spark, SF).collect())
    out, both = {}, {}
    for a, b in edges:
        out.setdefault(a, set()).add(b)
        both.setdefault(a, set()).add(b)
        both.setdefault(b, set()).add(a)
    run = {n: registry.queries[f"whole_graph_{n}"](spark, SF).collect() for n in ("components", "bfs_both", "bfs_out", "shortest_path")}
    assert {r["node"]: r["distance"] for r in run["bfs_both"]} == walk(both, "region:1", 3)
    assert {r["node"]: r["distance"] for r in run["bfs_out"]} == walk(out, "supplier:3", 8)
    left, sizes = set(both), {}
    while left:
        group = set(walk(both, next(iter(left)), len(both)))
        sizes[min(group)] = len(group)
        left -= group
    assert {r["component"]: r["members"] for r in run["components"]} == sizes
    path = run["shortest_path"][0]["path"].split(">")
    assert (path[0], path[-1], len(path) - 1) == ("supplier:1", "supplier:9", walk(out, "supplier:1", 99)["supplier:9"])


def test_long_chains(spark):
    n = 300
    aliases = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(n)] + [("t", "x"), ("x", "y"), ("y", "z"), ("z", "x"), ("q", "q")], "alias string, canonical string")
    names = spark.createDataFrame([("a0",), ("a299",), ("a300",), ("t",), ("q",), ("a0",), (None,)], "name string")
    got = Counter(map(tuple, G.resolve_aliases(names, aliases, None).collect()))
    assert got == Counter([("a0", "a300")] * 2 + [("a299", "a300"), ("a300", "a300"), ("t", None), ("q", "q"), (None, None)])
    limited = {r["name"]: r["canonical"] for r in G.resolve_aliases(names, aliases).collect()}
    assert limited["a0"] is None and limited["a299"] == "a300"
    edges = spark.createDataFrame([(f"a{i}", f"a{i + 1}") for i in range(20)], "source string, target string")
    assert len(G.shortest_paths(edges, "a0", "a20", 24).first()["path"]) == 21


def test_whole_alias_resolve(spark):
    keys = {k for k, in rows(spark, "supplier", "s_suppkey")}
    want = {}
    for k in keys:
        end = k
        while end + 1 in keys:
            end += 1
        want[f"supplier:{k}"] = f"supplier:{end}"
    assert {r["name"]: r["canonical"] for r in registry.queries["whole_alias_resolve"](spark, SF).collect()} == want
