"""Queries over entities, object listings, logs, and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.operators import entities as E
from brindle.plans.base import registry as r


def customers(spark, sf_dir):
    """Customers as entities, tagged by nation; created on a day that their key gives."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_mktsegment").alias("type"),
        F.col("c_name").alias("name"),
        F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string")).alias("tags"),
        F.create_map(F.lit("band"), F.when(F.col("c_acctbal") < 0, "owing").otherwise("paid")).alias("metadata"),
        F.expr("date_add(DATE'2020-01-01', CAST(c_custkey % 1000 AS INT))").alias("created"),
        F.expr("date_add(DATE'2021-01-01', CAST(c_custkey % 700 AS INT))").alias("modified"),
    )


ENTITIES = "(SELECT c_custkey AS id, c_mktsegment AS type, c_name AS name, c_nationkey, c_acctbal, DATE '2020-01-01' + CAST(c_custkey % 1000 AS INTEGER) AS created, DATE '2021-01-01' + CAST(c_custkey % 700 AS INTEGER) AS modified FROM customer)"


@r.query("entity_filter", f"SELECT id, name FROM {ENTITIES} WHERE type = 'BUILDING' AND c_nationkey < 25 AND c_nationkey = 7 AND created BETWEEN DATE '2020-02-01' AND DATE '2022-01-01' AND modified <= DATE '2022-06-30'")
def entity_filter(spark, sf_dir):
    found = E.query(customers(spark, sf_dir), "BUILDING", {"nation": "7"}, created=("2020-02-01", "2022-01-01"), modified=(None, "2022-06-30"))
    return found.select("id", "name")


@r.query("entity_page", f"SELECT id, created FROM {ENTITIES} ORDER BY created DESC, id LIMIT 50 OFFSET 100")
def entity_page(spark, sf_dir):
    return E.query(customers(spark, sf_dir), order="created", descending=True, limit=50, offset=100).select("id", "created")


@r.query("metadata_equality", f"SELECT id FROM {ENTITIES} WHERE c_acctbal < 0 AND c_nationkey = 3")
def metadata_equality(spark, sf_dir):
    return customers(spark, sf_dir).where(E.equal_entries("metadata", {"band": "owing"}) & E.equal_entries("tags", {"nation": "3"})).select("id")


@r.query("relation_sort", "SELECT o_orderkey AS source, o_custkey AS target, o_orderdate AS created FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def relation_sort(spark, sf_dir):
    edges = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS source", "o_custkey AS target", "'placed_by' AS type", "o_orderdate AS created")
    return E.relations(edges, limit=100).select("source", "target", "created")


def objects(spark, sf_dir):
    return table(spark, sf_dir, "documents").selectExpr("concat(lang, '/', source, '/', doc_id) AS key", "n_chars AS size")


OBJECTS = "(SELECT lang || '/' || source || '/' || doc_id AS key, n_chars AS size FROM documents)"


@r.query("folder_listing", f"SELECT split_part(key, '/', 1) || '/' || split_part(key, '/', 2) || '/' AS key, true AS is_prefix, count(*) AS n, CAST(sum(size) AS BIGINT) AS size FROM {OBJECTS} WHERE key LIKE 'en/%' AND key > 'en/src1' GROUP BY ALL")
def folder_listing(spark, sf_dir):
    return E.listing(objects(spark, sf_dir), "en/", "/", start_after="en/src1")


@r.query("object_listing_page", f"SELECT key, false AS is_prefix, CAST(1 AS BIGINT) AS n, CAST(size AS BIGINT) AS size FROM {OBJECTS} WHERE key > 'fr/' ORDER BY key LIMIT 250")
def object_listing_page(spark, sf_dir):
    return E.listing(objects(spark, sf_dir), start_after="fr/", most=250)


@r.query("object_versions", "SELECT o_custkey AS key, o_orderkey AS version, o_orderstatus = 'P' AS deleted, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AND o_orderstatus <> 'P' AS is_latest FROM orders")
def object_versions(spark, sf_dir):
    return E.versions(table(spark, sf_dir, "orders").selectExpr("o_custkey AS key", "o_orderkey AS version", "o_orderstatus = 'P' AS deleted"))


@r.query("log_tail", "SELECT event_id AS seq, event_type FROM events ORDER BY seq DESC LIMIT 100")
def log_tail(spark, sf_dir):
    return E.tail(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type"), 100)


@r.query("log_after", "SELECT event_id AS seq, event_type FROM events WHERE event_id > 500 ORDER BY seq LIMIT 100")
def log_after(spark, sf_dir):
    return E.tail(table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), "event_type"), 100, after=500)


@r.query(
    "keyword_search",
    r"""
    WITH t AS (SELECT p_partkey AS chunk_id, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^\p{L}\p{Nd}]+'), lambda x: x IN ('steel', 'red')) AS mine FROM part)
    SELECT chunk_id, CAST(len(list_distinct(mine)) AS INTEGER) AS hits FROM t WHERE len(mine) > 0
    """,
)
def keyword_search(spark, sf_dir):
    parts = table(spark, sf_dir, "part").selectExpr("p_partkey AS chunk_id", "concat(p_name, ' ', p_type) AS chunk")
    return E.keyword_search(parts, "the steel or red", any_mode=True).select("chunk_id", "hits")


r.sql(
    "cast_boolean",
    "orders",
    "SELECT o_orderkey, CAST(o_orderkey % 2 AS BOOLEAN) AS odd, CAST(CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' END AS BOOLEAN) AS finished FROM orders",
)
r.sql(
    "time_and_id_functions",
    "region",
    "SELECT r_regionkey, current_date() = CAST(now() AS DATE) AS same_day, current_timestamp() IS NOT NULL AS has_now, length(uuid()) AS id_length, now() >= TIMESTAMP '2020-01-01 00:00:00' AS later FROM region",
    "SELECT r_regionkey, true AS same_day, current_timestamp IS NOT NULL AS has_now, CAST(length(CAST(uuid() AS VARCHAR)) AS INTEGER) AS id_length, now() >= TIMESTAMPTZ '2020-01-01 00:00:00+00' AS later FROM region",
)
r.sql("anti_not_exists_large", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
r.sql("anti_not_in_urgent", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_custkey IS NOT NULL)")
