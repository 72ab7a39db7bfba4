"""Row changes and key/value queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.operators import dml as D
from brindle.plans.base import registry as r

CUSTOMER = "c_custkey, c_nationkey, c_acctbal"


def customer(spark, sf_dir):
    return table(spark, sf_dir, "customer").selectExpr(*CUSTOMER.split(", "))


def changed(spark, sf_dir):
    """New versions of every seventh customer, and as many new ones."""
    return customer(spark, sf_dir).where("c_custkey % 7 = 0").selectExpr("IF(c_custkey % 2 = 0, c_custkey, c_custkey + 1000000) AS c_custkey", "c_nationkey + 1 AS c_nationkey", "-c_acctbal AS c_acctbal")


CHANGED = "(SELECT CASE WHEN c_custkey % 2 = 0 THEN c_custkey ELSE c_custkey + 1000000 END AS c_custkey, c_nationkey + 1 AS c_nationkey, -c_acctbal AS c_acctbal FROM customer WHERE c_custkey % 7 = 0)"


@r.query("insert_with_defaults", f"SELECT {CUSTOMER} FROM customer UNION ALL SELECT c_custkey + 5000000, 9, c_acctbal FROM customer WHERE c_custkey < 10")
def insert_with_defaults(spark, sf_dir):
    new = customer(spark, sf_dir).where("c_custkey < 10").selectExpr("c_custkey + 5000000 AS c_custkey", "c_acctbal")
    return D.insert(customer(spark, sf_dir), new, {"c_nationkey": F.lit(9)})


@r.query("insert_ignore", f"SELECT {CUSTOMER} FROM customer UNION ALL SELECT * FROM {CHANGED} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)")
def insert_ignore(spark, sf_dir):
    return D.insert_ignore(customer(spark, sf_dir), changed(spark, sf_dir), "c_custkey")


@r.query("upsert", f"SELECT {CUSTOMER} FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {CHANGED}) UNION ALL SELECT * FROM {CHANGED}")
def upsert(spark, sf_dir):
    return D.upsert(customer(spark, sf_dir), changed(spark, sf_dir), "c_custkey")


@r.query(
    "upsert_some_columns",
    f"""
    SELECT c.c_custkey, c.c_nationkey, coalesce(n.c_acctbal, c.c_acctbal) AS c_acctbal FROM customer c LEFT JOIN {CHANGED} n USING (c_custkey)
    UNION ALL SELECT * FROM {CHANGED} WHERE c_custkey NOT IN (SELECT c_custkey FROM customer)
    """,
)
def upsert_some_columns(spark, sf_dir):
    return D.upsert(customer(spark, sf_dir), changed(spark, sf_dir), "c_custkey", ["c_acctbal"])


@r.query(
    "update_sequential",
    "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_nationkey + 1 ELSE c_nationkey END AS c_nationkey, CASE WHEN c_acctbal < 0 THEN c_acctbal + c_nationkey + 1 ELSE c_acctbal END AS c_acctbal FROM customer",
)
def update_sequential(spark, sf_dir):
    sets = [("c_nationkey", F.col("c_nationkey") + 1), ("c_acctbal", F.col("c_acctbal") + F.col("c_nationkey"))]
    return D.update(customer(spark, sf_dir), F.col("c_acctbal") < 0, sets)


@r.query(
    "update_order_limit",
    "SELECT c_custkey, c_nationkey, CASE WHEN c_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 100 ORDER BY c_acctbal DESC, c_custkey LIMIT 30) THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer",
)
def update_order_limit(spark, sf_dir):
    return D.update_first(customer(spark, sf_dir), "c_custkey", F.col("c_acctbal") > 100, [F.desc("c_acctbal")], 30, [("c_acctbal", F.lit(0.0))])


@r.query("delete_where", f"SELECT {CUSTOMER} FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) > 10, false)")
def delete_where(spark, sf_dir):
    return D.delete(customer(spark, sf_dir), F.nullif("c_nationkey", F.lit(3)) > 10)


@r.query("delete_order_limit", f"SELECT {CUSTOMER} FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 4 ORDER BY c_acctbal, c_custkey LIMIT 12)")
def delete_order_limit(spark, sf_dir):
    return D.delete_first(customer(spark, sf_dir), "c_custkey", F.col("c_nationkey") == 4, [F.col("c_acctbal")], 12)


@r.query("truncate", f"SELECT {CUSTOMER} FROM customer WHERE false")
def truncate(spark, sf_dir):
    return D.delete(customer(spark, sf_dir), F.lit(True))


@r.query("insert_select_ctas", "SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def insert_select_ctas(spark, sf_dir):
    """CREATE TABLE AS SELECT, then read; the table is a folder of the shared space."""
    from brindle.catalog import materialize

    return materialize(table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n")).where("n > 12"))


@r.query(
    "merge_tx_overlay",
    f"SELECT {CUSTOMER} FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM {CHANGED}) UNION ALL SELECT * FROM {CHANGED} WHERE c_custkey % 3 <> 0",
)
def merge_tx_overlay(spark, sf_dir):
    pending = changed(spark, sf_dir).withColumn("deleted", F.col("c_custkey") % 3 == 0)
    return D.overlay(customer(spark, sf_dir), pending, "c_custkey")


@r.query("lww_compact", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id")
def lww_compact(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return D.latest(log, "user_id", "ts", "event_id")


@r.query("lww_with_tombstones", "SELECT user_id, event_id FROM (SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) WHERE event_type <> 'error'")
def lww_with_tombstones(spark, sf_dir):
    log = table(spark, sf_dir, "events").select("user_id", "event_id", "ts", "event_type")
    return D.latest(log, "user_id", "ts", "event_id").where("event_type <> 'error'").select("user_id", "event_id")


@r.query("ttl_visible", "SELECT event_id FROM events WHERE event_id % 5 = 0 OR ts + INTERVAL 6 HOUR > TIMESTAMP '2024-01-10 00:00:00'")
def ttl_visible(spark, sf_dir):
    expiring = table(spark, sf_dir, "events").withColumn("expires_at", F.expr("IF(event_id % 5 = 0, NULL, ts + INTERVAL 6 HOUR)"))
    return D.visible(expiring, F.expr("TIMESTAMP_NTZ'2024-01-10 00:00:00'")).select("event_id")


@r.query("incr", "SELECT k AS key, round(coalesce(any_value(v), 0) + coalesce(sum(step), 0), 4) AS value FROM (SELECT user_id AS k, NULL::DOUBLE AS v, value AS step FROM events UNION ALL SELECT c_custkey, 10.0, NULL FROM customer WHERE c_custkey < 50) GROUP BY k")
def incr(spark, sf_dir):
    counters = table(spark, sf_dir, "customer").where("c_custkey < 50").selectExpr("c_custkey AS key", "10.0D AS value")
    steps = table(spark, sf_dir, "events").selectExpr("user_id AS key", "value AS step")
    return D.increments(counters, steps, "key").select("key", F.round("value", 4).alias("value"))


def keys(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.concat_ws(":", "source", F.col("doc_id").cast("string")).alias("key"), "n_chars")


KEYS = "(SELECT source || ':' || CAST(doc_id AS VARCHAR) AS key, n_chars FROM documents)"
r.query("kv_prefix_scan", f"SELECT key, n_chars FROM {KEYS} WHERE starts_with(key, 'src1')")(lambda spark, sf_dir: D.prefix_scan(keys(spark, sf_dir), "key", "src1"))
r.query("kv_glob", f"SELECT key FROM {KEYS} WHERE regexp_full_match(key, 'src.:.*7')")(lambda spark, sf_dir: D.glob_keys(keys(spark, sf_dir), "key", "src?:*7"))
r.query("kv_page", f"SELECT key, (SELECT count(*) FROM {KEYS}) AS total FROM {KEYS} ORDER BY key LIMIT 40 OFFSET 100")(lambda spark, sf_dir: D.page(keys(spark, sf_dir), "key", 100, 40))
r.query("unique_violations", "SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1")(lambda spark, sf_dir: D.unique_violations(table(spark, sf_dir, "lineitem"), "l_orderkey"))
r.query("object_listing", "SELECT source, max(doc_id) AS latest, count(*) AS versions, CAST(sum(n_chars) AS BIGINT) AS bytes FROM documents WHERE source > 'src1' GROUP BY source ORDER BY source LIMIT 10")(
    lambda spark, sf_dir: table(spark, sf_dir, "documents").where("source > 'src1'").groupBy("source").agg(F.max("doc_id").alias("latest"), F.count("*").alias("versions"), F.sum("n_chars").alias("bytes")).orderBy("source").limit(10)
)
