"""Graph queries over edges derived from nations and some suppliers, small enough for recursive SQL, and over whole tables.

The whole_… queries take every nation, supplier, customer and order. Where walks would be recursive in SQL, the tests
compare them with plain Python instead.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.operators import documents as X
from brindle.operators import graph as G
from brindle.plans.base import registry as r
from brindle.plans.documents import NER

EDGES = """(
    SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'in' AS type, 0.9::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in', 0.8::DOUBLE FROM supplier WHERE s_suppkey % 3 <> 0
    UNION ALL SELECT 'supplier:' || s_suppkey, 'supplier:' || (s_suppkey + 3), 'next', 0.5::DOUBLE FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey < 60
)"""


def edges(spark, sf_dir):
    nation, supplier = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    a = nation.selectExpr("'nation:' || n_nationkey AS source", "'region:' || n_regionkey AS target", "'in' AS type", "0.9D AS confidence")
    b = supplier.where("s_suppkey % 3 <> 0").selectExpr("'supplier:' || s_suppkey", "'nation:' || s_nationkey", "'based_in'", "0.8D")
    c = supplier.where("s_suppkey % 3 = 0 AND s_suppkey < 60").selectExpr("'supplier:' || s_suppkey", "'supplier:' || (s_suppkey + 3)", "'next'", "0.5D")
    return a.union(b).union(c)


def seeds(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


@r.query("graph_relations", f"SELECT source, target FROM {EDGES} WHERE type IN ('in', 'next') AND confidence >= 0.6")
def graph_relations(spark, sf_dir):
    return G.relations(edges(spark, sf_dir), {"type": ["in", "next"]}, 0.6).select("source", "target")


REACH = f"""
WITH RECURSIVE both_ways AS (SELECT source AS a, target AS b FROM {EDGES} UNION SELECT target, source FROM {EDGES}),
walk AS (SELECT 'region:1' AS node, 0 AS distance UNION SELECT b, distance + 1 FROM walk JOIN both_ways ON a = node WHERE distance < 3)
SELECT node, min(distance) AS distance FROM walk GROUP BY node
"""


@r.query("graph_bfs_both", REACH)
def graph_bfs_both(spark, sf_dir):
    return G.reach(edges(spark, sf_dir), seeds(spark, "region:1"), 3, "both")


@r.query(
    "graph_bfs_out",
    f"WITH RECURSIVE walk AS (SELECT 'supplier:3' AS node, 0 AS distance UNION SELECT target, distance + 1 FROM walk JOIN {EDGES} e ON source = node WHERE distance < 8) SELECT node, min(distance) AS distance FROM walk GROUP BY node",
)
def graph_bfs_out(spark, sf_dir):
    return G.reach(edges(spark, sf_dir), seeds(spark, "supplier:3"), 8, "out")


@r.query(
    "graph_impact",
    f"WITH RECURSIVE walk AS (SELECT 'supplier:3' AS node, 0 AS distance UNION SELECT target, distance + 1 FROM walk JOIN {EDGES} e ON source = node WHERE distance < 2) SELECT DISTINCT source, target, type FROM {EDGES} e JOIN walk ON source = node WHERE distance < 2",
)
def graph_impact(spark, sf_dir):
    return G.expand(edges(spark, sf_dir), seeds(spark, "supplier:3"), 2, "out").select("source", "target", "type")


@r.query(
    "graph_shortest_path",
    f"""
    WITH RECURSIVE walk AS (SELECT 'supplier:6' AS node, ['supplier:6'] AS path UNION ALL SELECT target, list_append(path, target) FROM walk JOIN {EDGES} e ON source = node WHERE len(path) < 9)
    SELECT array_to_string(path, '>') AS path FROM walk WHERE node = 'supplier:21' ORDER BY len(path), path LIMIT 1
    """,
)
def graph_shortest_path(spark, sf_dir):
    return G.shortest_paths(edges(spark, sf_dir), "supplier:6", "supplier:21").select(F.array_join("path", ">").alias("path"))


COMPONENTS = f"""
WITH RECURSIVE both_ways AS (SELECT source AS a, target AS b FROM {EDGES} UNION SELECT target, source FROM {EDGES}),
closure AS (SELECT a, b FROM both_ways UNION SELECT c.a, w.b FROM closure c JOIN both_ways w ON c.b = w.a)
SELECT component, count(*) AS members FROM (SELECT a, least(a, min(b)) AS component FROM closure GROUP BY a) GROUP BY component
"""


@r.query("graph_components", COMPONENTS)
def graph_components(spark, sf_dir):
    return G.component_sizes(edges(spark, sf_dir))


@r.query(
    "graph_degrees",
    f"SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM {EDGES} UNION ALL SELECT target, 0, 1 FROM {EDGES}) GROUP BY node",
)
def graph_degrees(spark, sf_dir):
    return G.degrees(edges(spark, sf_dir))


@r.query("graph_node_types", f"SELECT split_part(node, ':', 1) AS type, count(*) AS nodes FROM (SELECT source AS node FROM {EDGES} UNION SELECT target FROM {EDGES}) GROUP BY ALL")
def graph_node_types(spark, sf_dir):
    e = edges(spark, sf_dir)
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return nodes.groupBy(G.node_type(F.col("node")).alias("type")).agg(F.count("*").alias("nodes"))


@r.query("alias_resolve", "SELECT 'supplier:' || s_suppkey AS name, CASE WHEN s_suppkey % 3 = 0 AND s_suppkey < 40 THEN 'supplier:' || (SELECT max(s_suppkey) + 3 FROM supplier WHERE s_suppkey % 3 = 0 AND s_suppkey < 40) ELSE 'supplier:' || s_suppkey END AS canonical FROM supplier")
def alias_resolve(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    aliases = supplier.where("s_suppkey % 3 = 0 AND s_suppkey < 40").selectExpr("'supplier:' || s_suppkey AS alias", "'supplier:' || (s_suppkey + 3) AS canonical")
    return G.resolve_aliases(supplier.selectExpr("'supplier:' || s_suppkey AS name"), aliases)


@r.query(
    "ontology_check",
    f"""
    WITH rules(type, st, tt, mo, mi) AS (VALUES ('in', ['nation'], ['region'], 1, 4), ('based_in', ['customer'], ['nation'], 1, 100)),
    counted AS (SELECT e.*, st, tt, mo, mi, count(*) OVER (PARTITION BY e.type, source) AS o, count(*) OVER (PARTITION BY e.type, target) AS i FROM {EDGES} e LEFT JOIN rules r ON r.type = e.type)
    SELECT source, target, type, rule FROM (
        SELECT *, unnest(list_filter([CASE WHEN st IS NULL THEN 'unknown_type' END, CASE WHEN NOT list_contains(st, split_part(source, ':', 1)) THEN 'source_type' END,
            CASE WHEN NOT list_contains(tt, split_part(target, ':', 1)) THEN 'target_type' END, CASE WHEN o > mo THEN 'max_out' END, CASE WHEN i > mi THEN 'max_in' END], lambda x: x IS NOT NULL)) AS rule FROM counted)
    """,
)
def ontology_check(spark, sf_dir):
    rules = spark.createDataFrame([("in", ["nation"], ["region"], 1, 4), ("based_in", ["customer"], ["nation"], 1, 100)], "type string, source_types array<string>, target_types array<string>, max_out int, max_in int")
    return G.ontology_violations(edges(spark, sf_dir), rules)


@r.query(
    "resource_graph",
    f"""
    WITH m AS (SELECT doc_id AS resource, lang AS family, type, canonical, max(confidence) AS confidence FROM ({NER}) JOIN (SELECT doc_id, lang FROM documents) USING (doc_id) WHERE type IN ('EMAIL', 'IP_ADDRESS', 'PHONE', 'DATE', 'HASH', 'ORG') GROUP BY ALL),
    p AS (SELECT x.resource AS a, y.resource AS b, x.family AS fa, y.family AS fb, x.type, x.canonical, x.confidence FROM m x JOIN m y ON x.type = y.type AND x.canonical = y.canonical AND x.resource < y.resource),
    g AS (SELECT a, b, fa, fb, count(*) AS shared, max((confidence, type, canonical)) AS best, arg_max(type, (confidence, type, canonical)) AS t, max(confidence) AS c FROM p GROUP BY ALL)
    SELECT a, b, shared, CASE WHEN t IN ('EMAIL', 'DOMAIN', 'URL', 'ORG', 'PERSON') AND fa = fb THEN 'same_as' WHEN t IN ('TICKET_ID', 'CASE_ID', 'INVOICE_ID', 'CONTRACT_ID', 'POLICY_ID', 'ACCOUNT_ID') THEN 'references'
           WHEN shared > 1 THEN 'related_to' ELSE 'mentions_same_entity' END AS kind, round(least(0.99, c + 0.05 * (shared - 1)), 6) AS confidence
    FROM g
    """,
)
def resource_graph(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    kinds = ("EMAIL", "IP_ADDRESS", "PHONE", "DATE", "HASH", "ORG")
    found = X.entities(docs, [rule for rule in X.RULES if rule.type in kinds])
    mentions = found.join(docs.select("doc_id", F.col("lang").alias("family")), "doc_id").withColumnRenamed("doc_id", "resource")
    return G.resource_graph(mentions)


@r.query("mention_edges", f"SELECT DISTINCT 'doc:' || doc_id AS source, lower(type) || ':' || lower(trim(canonical)) AS target, 'mentions' AS type FROM ({NER}) WHERE type = 'EMAIL'")
def mention_edges(spark, sf_dir):
    found = X.entities(table(spark, sf_dir, "documents"), X.RULES[:1])
    return found.select(F.concat(F.lit("doc:"), F.col("doc_id").cast("string")).alias("source"), X.entity_key(F.col("type"), F.col("canonical")).alias("target"), F.lit("mentions").alias("type")).distinct()


@r.query("relation_materialize", f"SELECT source || '>' || target AS relation_id, CASE WHEN type = 'in' THEN 'skipped' ELSE 'created' END AS status FROM {EDGES}")
def relation_materialize(spark, sf_dir):
    e = edges(spark, sf_dir).withColumn("relation_id", F.concat_ws(">", "source", "target"))
    return G.materialize_edges(e, e.where("type = 'in'"), "relation_id", overwrite=False)


@r.query("relation_latest", "SELECT o_custkey AS relation_id, arg_max(o_orderstatus, (o_orderkey)) AS status, max(o_orderkey) AS revision FROM orders GROUP BY o_custkey HAVING arg_max(o_orderstatus, o_orderkey) <> 'F'")
def relation_latest(spark, sf_dir):
    log = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("relation_id"), F.col("o_orderkey").alias("revision"), F.when(F.col("o_orderstatus") == "F", "deleted").otherwise(F.col("o_orderstatus")).alias("status"))
    return G.latest_relations(log)


@r.query("graph_boosted_hits", f"WITH d AS ({REACH.strip()}) SELECT 'supplier:' || s_suppkey AS key, round(s_acctbal / 1000 + coalesce(0.8 / (distance + 1), 0), 6) AS score FROM supplier LEFT JOIN d ON node = 'nation:' || s_nationkey")
def graph_boosted_hits(spark, sf_dir):
    supplier = table(spark, sf_dir, "supplier")
    hits = supplier.selectExpr("'supplier:' || s_suppkey AS key", "s_acctbal / 1000 AS score")
    mentions = supplier.selectExpr("'supplier:' || s_suppkey AS key", "'nation:' || s_nationkey AS node", "0.8D AS confidence")
    distances = G.reach(edges(spark, sf_dir), seeds(spark, "region:1"), 3, "both")
    return G.boost(hits, distances, mentions).select("key", F.round("score", 6).alias("score"))


@r.query(
    "context_search",
    f"""
    WITH hits AS (SELECT 'nation:' || n_nationkey AS key, n_nationkey / 10.0 AS score FROM nation WHERE n_nationkey < 12 UNION ALL SELECT 'region:0', 2.0),
    ends AS (SELECT source AS key, target AS other, confidence FROM {EDGES} UNION ALL SELECT target, source, confidence FROM {EDGES}),
    near AS (SELECT e.key, sum(confidence) AS context FROM ends e JOIN hits h ON e.other = h.key GROUP BY e.key)
    SELECT key, round(coalesce(score, 0) + 0.35 * coalesce(context, 0), 6)::DOUBLE AS score, CASE WHEN score IS NULL THEN 'related' WHEN context IS NULL THEN 'direct' ELSE 'direct+context' END AS match_kind
    FROM hits FULL JOIN near USING (key)
    """,
)
def context_search(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    hits = nation.where("n_nationkey < 12").selectExpr("'nation:' || n_nationkey AS key", "n_nationkey / 10 AS score").union(spark.createDataFrame([("region:0", 2.0)], "key string, score double"))
    found = G.with_context(hits, edges(spark, sf_dir))
    return found.select("key", F.round("score", 6).alias("score"), "match_kind")


WHOLE = """(
    SELECT 'nation:' || n_nationkey AS source, 'region:' || n_regionkey AS target, 'in' AS type, 0.9::DOUBLE AS confidence FROM nation
    UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 'based_in', 0.8::DOUBLE FROM supplier
    UNION ALL SELECT 'supplier:' || s.s_suppkey, 'supplier:' || n.s_suppkey, 'next', 0.5::DOUBLE FROM supplier s JOIN supplier n ON n.s_suppkey = s.s_suppkey + 1
    UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'based_in', 0.7::DOUBLE FROM customer
    UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 'placed_by', 0.6::DOUBLE FROM orders
)"""


def successors(spark, sf_dir):
    """Each supplier and the one of the next key, where there is one."""
    supplier = table(spark, sf_dir, "supplier")
    following = supplier.selectExpr("s_suppkey AS n", "s_suppkey - 1 AS s")
    return supplier.join(following, F.col("s_suppkey") == F.col("s")).selectExpr("'supplier:' || s AS source", "'supplier:' || n AS target")


def whole_edges(spark, sf_dir):
    nation, supplier, customer, orders = (table(spark, sf_dir, t) for t in ("nation", "supplier", "customer", "orders"))
    made = nation.selectExpr("'nation:' || n_nationkey AS source", "'region:' || n_regionkey AS target", "'in' AS type", "0.9D AS confidence")
    made = made.union(supplier.selectExpr("'supplier:' || s_suppkey", "'nation:' || s_nationkey", "'based_in'", "0.8D"))
    made = made.union(successors(spark, sf_dir).selectExpr("source", "target", "'next'", "0.5D"))
    made = made.union(customer.selectExpr("'customer:' || c_custkey", "'nation:' || c_nationkey", "'based_in'", "0.7D"))
    return made.union(orders.selectExpr("'order:' || o_orderkey", "'customer:' || o_custkey", "'placed_by'", "0.6D"))


r.query("whole_graph_components")(lambda spark, sf_dir: G.component_sizes(whole_edges(spark, sf_dir)))
r.query("whole_graph_bfs_both")(lambda spark, sf_dir: G.reach(whole_edges(spark, sf_dir), seeds(spark, "region:1"), 3, "both"))
r.query("whole_graph_bfs_out")(lambda spark, sf_dir: G.reach(whole_edges(spark, sf_dir), seeds(spark, "supplier:3"), 8, "out"))
r.query("whole_graph_shortest_path")(lambda spark, sf_dir: G.shortest_paths(whole_edges(spark, sf_dir), "supplier:1", "supplier:9", 24).select(F.array_join("path", ">").alias("path")))


@r.query(
    "whole_graph_degrees",
    f"SELECT node, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o + i) AS BIGINT) AS degree FROM (SELECT source AS node, 1 AS o, 0 AS i FROM {WHOLE} UNION ALL SELECT target, 0, 1 FROM {WHOLE}) GROUP BY node",
)
def whole_graph_degrees(spark, sf_dir):
    return G.degrees(whole_edges(spark, sf_dir))


@r.query("whole_graph_node_types", f"SELECT split_part(node, ':', 1) AS type, count(*) AS nodes FROM (SELECT source AS node FROM {WHOLE} UNION SELECT target FROM {WHOLE}) GROUP BY ALL")
def whole_graph_node_types(spark, sf_dir):
    e = whole_edges(spark, sf_dir)
    nodes = e.select(F.col("source").alias("node")).union(e.select("target")).distinct()
    return nodes.groupBy(G.node_type(F.col("node")).alias("type")).agg(F.count("*").alias("nodes"))


@r.query("whole_alias_resolve")
def whole_alias_resolve(spark, sf_dir):
    """Every supplier is an alias of the next one, so a name resolves to the last of its run of keys."""
    names = table(spark, sf_dir, "supplier").selectExpr("'supplier:' || s_suppkey AS name")
    return G.resolve_aliases(names, successors(spark, sf_dir).selectExpr("source AS alias", "target AS canonical"), limit=None)


@r.query(
    "whole_ontology_check",
    f"""
    WITH rules(type, st, tt, mo, mi) AS (VALUES ('in', ['nation'], ['region'], 1, 4), ('based_in', ['customer'], ['nation'], 1, 100), ('placed_by', ['order'], ['customer'], 1, 20)),
    e AS (SELECT * FROM {WHOLE}),
    outs AS (SELECT type, source, count(*) AS o FROM e GROUP BY ALL), ins AS (SELECT type, target, count(*) AS i FROM e GROUP BY ALL),
    counted AS (SELECT e.*, st, tt, mo, mi, o, i FROM e JOIN outs USING (type, source) JOIN ins USING (type, target) LEFT JOIN rules USING (type))
    SELECT source, target, type, rule FROM (
        SELECT *, unnest(list_filter([CASE WHEN st IS NULL THEN 'unknown_type' END, CASE WHEN NOT list_contains(st, split_part(source, ':', 1)) THEN 'source_type' END,
            CASE WHEN NOT list_contains(tt, split_part(target, ':', 1)) THEN 'target_type' END, CASE WHEN o > mo THEN 'max_out' END, CASE WHEN i > mi THEN 'max_in' END], lambda x: x IS NOT NULL)) AS rule FROM counted)
    """,
)
def whole_ontology_check(spark, sf_dir):
    rows = [("in", ["nation"], ["region"], 1, 4), ("based_in", ["customer"], ["nation"], 1, 100), ("placed_by", ["order"], ["customer"], 1, 20)]
    rules = spark.createDataFrame(rows, "type string, source_types array<string>, target_types array<string>, max_out int, max_in int")
    return G.ontology_violations(whole_edges(spark, sf_dir), rules)


@r.query(
    "whole_context_search",
    f"""
    WITH hits AS (SELECT 'nation:' || n_nationkey AS key, n_nationkey / 10.0 AS score FROM nation UNION ALL SELECT 'region:0', 2.0),
    ends AS (SELECT source AS key, target AS other, confidence FROM {WHOLE} UNION ALL SELECT target, source, confidence FROM {WHOLE}),
    near AS (SELECT e.key, sum(confidence) AS context FROM ends e JOIN hits h ON e.other = h.key GROUP BY e.key)
    SELECT key, round(coalesce(score, 0) + 0.35 * coalesce(context, 0), 6)::DOUBLE AS score, CASE WHEN score IS NULL THEN 'related' WHEN context IS NULL THEN 'direct' ELSE 'direct+context' END AS match_kind
    FROM hits FULL JOIN near USING (key)
    """,
)
def whole_context_search(spark, sf_dir):
    hits = table(spark, sf_dir, "nation").selectExpr("'nation:' || n_nationkey AS key", "n_nationkey / 10 AS score").union(spark.createDataFrame([("region:0", 2.0)], "key string, score double"))
    found = G.with_context(hits, whole_edges(spark, sf_dir))
    return found.select("key", F.round("score", 6).alias("score"), "match_kind")
