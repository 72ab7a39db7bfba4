"""Queries of ingest, deletion, resource sync, entity merges, seed search and operation validation, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.operators import entities as E
from brindle.operators import governance as V
from brindle.operators import graph as G
from brindle.operators import ingest as I
from brindle.operators import merges as M
from brindle.plans.base import registry as r
from brindle.plans.documents import CHUNKS
from brindle.plans.governance import MERGED, TAG_SCHEMA, TAG_VALUES, TAGS
from brindle.plans.graphs import WHOLE, seeds, whole_edges


def items(spark, sf_dir):
    """Documents as items, each with a source of its own."""
    return table(spark, sf_dir, "documents").select(F.expr("source || '/' || doc_id").alias("source"), "text", "doc_id")


def labelled(spark, sf_dir, where="TRUE"):
    """Sources of documents that have a label."""
    return items(spark, sf_dir).join(table(spark, sf_dir, "labels").where(where).select("doc_id"), "doc_id", "left_semi").select("source")


COUNTS = f"SELECT doc_id, count(*) AS chunks FROM ({CHUNKS}) GROUP BY doc_id"
INGESTED = f"""
SELECT source || '/' || doc_id AS source, substr(sha256(source || '/' || doc_id || ':' || text), 1, 32) AS doc_id, coalesce(chunks, 0) AS chunks
FROM documents LEFT JOIN ({COUNTS}) c USING (doc_id) WHERE text <> ''
"""


def counted(corpus):
    n = corpus.chunks.groupBy("doc_id").agg(F.count("*").alias("chunks"))
    return corpus.documents.join(n, "doc_id", "left").select("source", "doc_id", F.coalesce("chunks", F.lit(0)).cast("long").alias("chunks"))


@r.query("ingest_documents", f"{INGESTED} AND doc_id NOT IN (SELECT doc_id FROM labels)")
def ingest_documents(spark, sf_dir):
    """The documents without a label are new; those with one count as ingested before."""
    return counted(I.ingest(items(spark, sf_dir), labelled(spark, sf_dir)))


@r.query("ingest_delete", f"{INGESTED} AND doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def ingest_delete(spark, sf_dir):
    """All documents, then those labelled as toxic are deleted with their chunks."""
    return counted(I.ingest(items(spark, sf_dir)).without_sources(labelled(spark, sf_dir, "toxic = 1")))


@r.query("ingest_entities")
def ingest_entities(spark, sf_dir):
    """Entities of each chunk, alike ones of a document as one."""
    corpus = I.ingest(items(spark, sf_dir))
    return corpus.chunk_entities().groupBy("type").agg(F.count("*").alias("places"), F.count_distinct("canonical").alias("entities"))


@r.query(
    "auto_index_sync",
    """
    SELECT 'kv' AS type, count(*) FILTER (strlen(props) BETWEEN 1 AND 2000) AS indexed, count(*) - count(*) FILTER (strlen(props) BETWEEN 1 AND 2000) AS skipped FROM events
    UNION ALL SELECT 'object', count(*) FILTER (strlen(text) BETWEEN 1 AND 2000), count(*) - count(*) FILTER (strlen(text) BETWEEN 1 AND 2000) FROM documents
    UNION ALL SELECT 'secret', count(*), 0 FROM supplier
    UNION ALL SELECT 'sql_row', count(*), 0 FROM customer
    """,
)
def auto_index_sync(spark, sf_dir):
    """Events as keyed values, documents as objects, suppliers as secrets and customers as rows."""
    rows = table(spark, sf_dir, "customer")
    found = I.resources(
        {
            "kv": table(spark, sf_dir, "events").selectExpr("'event/' || event_id AS key", "props AS value"),
            "object": table(spark, sf_dir, "documents").selectExpr("source || '/' || doc_id AS key", "text AS value"),
            "secret": table(spark, sf_dir, "supplier").selectExpr("s_name AS key", "CAST(s_acctbal AS STRING) AS value"),
            "sql_row": rows.select(F.expr("'customer/' || c_custkey").alias("key"), F.to_json(F.struct(*rows.columns)).alias("value")),
        },
        max_bytes=2000,
    )
    return I.sync_status(found)


REQUESTS = """
SELECT 'supplier:' || s.s_suppkey AS source, 'supplier:' || least_key AS target, 'same nation' AS reason, s.s_nationkey, s.s_acctbal
FROM supplier s JOIN (SELECT s_nationkey, min(s_suppkey) AS least_key FROM supplier GROUP BY s_nationkey) l ON s.s_nationkey = l.s_nationkey
"""
PROPOSALS = f"""
SELECT 'merge-' || substr(sha256(source || chr(0) || target || chr(0) || reason), 1, 24) AS proposal_id, source, target,
       CASE s_nationkey % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'rejected' ELSE 'pending' END AS status, s_acctbal
FROM ({REQUESTS}) WHERE source <> target
"""


def proposals(spark, sf_dir):
    """Each supplier may merge into the first one of its nation; nations decide on it."""
    supplier = table(spark, sf_dir, "supplier")
    least = supplier.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("least"))
    asked = supplier.join(least, "s_nationkey").select(
        F.expr("'supplier:' || least").alias("target"), F.array(F.expr("' supplier:' || s_suppkey"), F.expr("'supplier:' || least")).alias("sources"), F.lit("same nation").alias("reason"), "s_nationkey"
    )
    proposed = M.propose(asked)
    of = M.propose(asked.where("s_nationkey % 3 = 0")).select("proposal_id", F.lit(1).alias("place"), F.lit("approved").alias("status"))
    late = M.propose(asked.where("s_nationkey % 3 < 2")).select("proposal_id", F.lit(2).alias("place"), F.lit("rejected").alias("status"))
    return M.review(proposed, of.union(late))


@r.query("merge_proposals", f"SELECT proposal_id, source, target, status FROM ({PROPOSALS})")
def merge_proposals(spark, sf_dir):
    return proposals(spark, sf_dir).select("proposal_id", F.col("sources")[0].alias("source"), "target", "status")


@r.query("entity_merge_split", f"SELECT source AS alias, target AS canonical FROM ({PROPOSALS}) WHERE status = 'approved' AND s_acctbal >= 0")
def entity_merge_split(spark, sf_dir):
    """Aliases of the approved proposals; suppliers that owe are split off again."""
    owing = table(spark, sf_dir, "supplier").where("s_acctbal < 0").select(F.expr("'supplier:' || s_suppkey").alias("alias"))
    none = spark.createDataFrame([], "alias string, canonical string")
    return M.split(M.merge(none, proposals(spark, sf_dir).where(F.col("status") == M.APPROVED)), owing)


@r.query(
    "graph_seed_search",
    f"""
    WITH seeds AS (SELECT 'region:1' AS node UNION SELECT 'nation:' || n_nationkey FROM nation WHERE n_name = 'NATION_7'),
    near AS (SELECT target AS node FROM {WHOLE} e JOIN seeds ON source = node UNION SELECT source FROM {WHOLE} e JOIN seeds ON target = node)
    SELECT node, min(distance) AS distance FROM (SELECT node, 0 AS distance FROM seeds UNION ALL SELECT node, 1 FROM near) GROUP BY node
    """,
)
def graph_seed_search(spark, sf_dir):
    """What lies one step from a given node and from those that a keyword search over names finds."""
    names = table(spark, sf_dir, "nation").select(F.expr("'nation:' || n_nationkey").alias("chunk_id"), F.col("n_name").alias("chunk"))
    return G.reach(whole_edges(spark, sf_dir), G.seeded(seeds(spark, "region:1"), E.keyword_search(names, "NATION_7")), 1, "both")


REQUEST_COLUMNS = """
event_id AS request, CASE event_id % 5 WHEN 0 THEN 'a' WHEN 1 THEN 'a/b' WHEN 2 THEN 'a/b/c' WHEN 3 THEN 'd' ELSE 'e' END AS path,
CASE event_type WHEN 'view' THEN 'read' WHEN 'click' THEN 'write' ELSE 'delete' END AS operation, CASE WHEN user_id % 7 = 0 THEN '' WHEN user_id % 7 = 1 THEN 'internal-1' ELSE 'u' END AS actor,
CASE WHEN event_id % 11 = 0 THEN 'MD5' WHEN event_id % 11 < 6 THEN '' ELSE 'SHA-256' END AS algorithm, CASE WHEN event_id % 2 = 0 THEN '' ELSE 'asked for' END AS reason,
value > 10 AS encrypted, user_id % 2 = 0 AS mfa, event_id % 97 = 0 AS system, CAST(value AS INT) AS data_age
"""


def sql_finding(framework, condition, denies, violated, action, field):
    applies = f"coalesce({condition}, false)" + ("" if framework is None else f" AND coalesce(list_contains(frameworks, '{framework}'), false)")
    return f"CASE WHEN {applies} THEN {field} END"


def sql_findings(column: int) -> str:
    return "list_filter([" + ", ".join(sql_finding(*rule, f"'{rule[column]}'") for rule in V.OPERATION_RULES if rule[column]) + "], lambda x: x IS NOT NULL)"


DENIED = " OR ".join(f"({sql_finding(*rule, 'true')}) IS TRUE" for rule in V.OPERATION_RULES if rule[2])


@r.query(
    "operation_validation",
    f"""
    WITH requests AS (SELECT {REQUEST_COLUMNS.replace('CAST(value AS INT)', 'CAST(trunc(value) AS INTEGER)')} FROM events), tags AS (SELECT path, {MERGED} FROM {TAG_VALUES} GROUP BY path),
    judged AS (SELECT q.*, t.path IS NULL AS untagged, frameworks, encrypt, retention_days, data_class FROM requests q LEFT JOIN tags t ON q.path = t.path)
    SELECT request, path, untagged OR system OR NOT ({DENIED}) AS allowed, CASE WHEN system THEN '{V.BYPASSED}' WHEN untagged THEN '{V.UNTAGGED}' END AS why,
           CASE WHEN untagged OR system THEN '' ELSE array_to_string({sql_findings(3)}, '; ') END AS violated, CASE WHEN untagged OR system THEN '' ELSE array_to_string({sql_findings(4)}, '; ') END AS actions FROM judged
    """,
)
def operation_validation(spark, sf_dir):
    """Events as requests on tagged folders."""
    requests = table(spark, sf_dir, "events").selectExpr(*split_columns(REQUEST_COLUMNS))
    found = V.validate_operations(requests, V.merge_tags(spark.createDataFrame(TAGS, TAG_SCHEMA)))
    return found.select("request", "path", "allowed", "why", F.array_join("violated", "; ").alias("violated"), F.array_join("actions", "; ").alias("actions"))


def split_columns(text: str) -> list[str]:
    """Select expressions of a list of them, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in text.strip():
        depth += (c == "(") - (c == ")")
        if c == "," and depth == 0:
            out.append("")
        else:
            out[-1] += c
    return [x.strip() for x in out]
