"""Relational queries: filters, joins, aggregates, set operations, subqueries."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table, views
from brindle.operators.ranks import placed
from brindle.plans.base import registry as r

r.sql(
    "flagship_customer_revenue",
    "orders customer nation",
    """
    WITH finished AS (
        SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n_orders
        FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey
        HAVING sum(o_totalprice) > 100000
    )
    SELECT c.c_custkey AS c_custkey, c.c_name AS c_name, n.n_name AS n_name,
           round(f.total, 2) AS total, CAST(f.n_orders AS BIGINT) AS n_orders
    FROM finished f
    JOIN customer c ON c.c_custkey = f.o_custkey
    JOIN nation n ON n.n_nationkey = c.c_nationkey
    ORDER BY total DESC, c_custkey
    """,
)

# Predicates. The three-valued logic is SQL's; the two-valued forms, where NULL compares as false, have queries of their own.

r.sql(
    "filter_between_in_like_null",
    "orders",
    """
    SELECT o_orderkey, o_totalprice, nullif(o_orderpriority, '3-MEDIUM') AS priority
    FROM orders
    WHERE o_totalprice BETWEEN 50000 AND 200000 AND o_orderstatus IN ('F', 'O')
      AND o_orderpriority ILIKE '%r%' AND o_orderpriority NOT ILIKE '5-_ow' AND nullif(o_orderpriority, '3-MEDIUM') IS NOT NULL
    """,
)
r.sql(
    "filter_negated_forms",
    "orders",
    """
    SELECT o_orderkey, o_custkey FROM orders
    WHERE nullif(o_custkey, 7) NOT BETWEEN 100 AND 1400 AND nullif(o_orderstatus, 'P') NOT IN ('F') AND NOT (o_totalprice < 30000)
    """,
)
r.sql(
    "filter_two_valued",
    "customer",
    """
    SELECT c_custkey, coalesce(nullif(c_nationkey, 3) = 5, false) AS is_five,
           NOT coalesce(nullif(c_nationkey, 3) = 5, false) AS not_five,
           coalesce(nullif(c_nationkey, 3) IN (1, 2), false) AS in_list,
           coalesce(nullif(c_nationkey, 3) NOT IN (1, 2), false) AS not_in_list
    FROM customer WHERE NOT coalesce(nullif(c_nationkey, 3) = 5, false)
    """,
)
r.sql(
    "case_simple_searched",
    "customer",
    """
    SELECT c_custkey,
           CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS simple_case,
           CASE WHEN nullif(c_nationkey, 4) IS NOT DISTINCT FROM NULL THEN 'none' WHEN c_nationkey > 12 THEN 'high' ELSE 'low' END AS searched_case
    FROM customer
    """,
)
r.sql(
    "case_cast_concat_length",
    "part",
    """
    SELECT p_partkey, p_brand || ':' || CAST(p_size AS STRING) AS label, octet_length(p_name) AS n_bytes, upper(p_type) AS up, lower(p_brand) AS low,
           CAST(CAST('2.7' AS DOUBLE) AS BIGINT) + p_size AS cast_int, coalesce(nullif(p_size, 5), -1) AS size_or, ifnull(nullif(p_size, 6), -2) AS size_if
    FROM part
    """,
    """
    SELECT p_partkey, p_brand || ':' || CAST(p_size AS VARCHAR) AS label, CAST(strlen(p_name) AS INTEGER) AS n_bytes, upper(p_type) AS up, lower(p_brand) AS low,
           CAST(trunc(CAST('2.7' AS DOUBLE)) AS BIGINT) + p_size AS cast_int, coalesce(nullif(p_size, 5), -1) AS size_or, ifnull(nullif(p_size, 6), -2) AS size_if
    FROM part
    """,
)
r.sql(
    "arithmetic_as_double",
    "lineitem",
    """
    SELECT l_orderkey, l_partkey, l_linenumber, l_suppkey,
           CAST(l_partkey AS DOUBLE) / 7 AS quotient, CAST(l_partkey % 7 AS DOUBLE) AS remainder, -l_quantity AS negative,
           CAST(-7 % 3 AS DOUBLE) AS negative_remainder, l_extendedprice * (1 - l_discount) AS net
    FROM lineitem WHERE l_quantity < 10
    """,
)
r.sql(
    "projection_without_from",
    "region",
    "SELECT 1 AS one, 'x' AS letter, CAST(NULL AS INT) AS nothing, true AS yes",
)
r.sql("star_sorted_columns", "nation", "SELECT n_name, n_nationkey, n_regionkey FROM nation")
r.sql("point_lookup", "customer", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")

# Joins.

r.sql("join_inner", "customer orders", "SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'F'")
r.sql("join_left", "customer orders", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
r.sql("join_right", "customer orders", "SELECT c_name, o_orderkey FROM (SELECT * FROM customer WHERE c_custkey < 100) c RIGHT JOIN orders ON c_custkey = o_custkey")
r.sql("join_full", "nation supplier", "SELECT n_nationkey, s_suppkey FROM (SELECT * FROM nation WHERE n_regionkey < 3) n FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 0) s ON n_nationkey = s_nationkey")
r.sql("join_cross", "region nation", "SELECT r_name, n_name FROM region CROSS JOIN nation")
r.sql("join_comma", "region nation", "SELECT r_name, n_name FROM region, nation WHERE r_regionkey = n_regionkey")
r.sql("join_theta", "nation region", "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey > r_regionkey AND n_name <> r_name")
r.sql(
    "join_using_nullsafe",
    "customer nation",
    """
    SELECT a.c_custkey AS c_custkey, b.n_name AS n_name
    FROM (SELECT c_custkey, nullif(c_nationkey, 3) AS k FROM customer) a
    JOIN (SELECT n_name, nullif(n_nationkey, 3) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k
    """,
)
r.sql("join_pk_fk_point", "customer orders", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey = 77")
r.sql("semi_in", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
r.sql("semi_exists_correlated", "customer orders", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
r.sql("anti_not_exists", "customer orders", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
r.sql("anti_not_in", "customer orders", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL)")
r.sql(
    "anti_not_in_ignoring_nulls",
    "customer orders",
    """
    SELECT c_custkey FROM customer
    WHERE nullif(c_custkey, 9) IS NOT NULL AND NOT EXISTS (SELECT 1 FROM (SELECT nullif(o_custkey, 5) AS k FROM orders) o WHERE o.k = c_custkey)
    """,
)
r.sql(
    "scalar_subquery",
    "customer orders",
    """
    SELECT c_custkey, (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) AS largest,
           (SELECT count(*) FROM orders) AS n_orders
    FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer)
    """,
)
r.sql("derived_table", "orders", "SELECT s.k AS k, s.total AS total FROM (SELECT o_custkey AS k, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey) AS s WHERE s.total > 500000")

# Aggregates.

r.sql(
    "agg_group_having",
    "lineitem",
    """
    SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_extendedprice), 4) AS avg_price,
           min(l_shipdate) AS first_ship, max(l_discount) AS max_discount
    FROM lineitem GROUP BY l_returnflag, l_linestatus HAVING count(*) > 10
    """,
)
r.sql("agg_null_group", "customer", "SELECT nullif(c_nationkey, 3) AS k, count(*) AS n, count(nullif(c_nationkey, 3)) AS n_known FROM customer GROUP BY nullif(c_nationkey, 3)")
r.sql("agg_global_empty_sum_zero", "orders", "SELECT coalesce(sum(o_totalprice), 0.0E0) AS total, avg(o_totalprice) AS mean, count(*) AS n, min(o_orderkey) AS least FROM orders WHERE o_orderkey < 0", "SELECT coalesce(sum(o_totalprice), 0.0::DOUBLE) AS total, avg(o_totalprice) AS mean, count(*) AS n, min(o_orderkey) AS least FROM orders WHERE o_orderkey < 0")
r.sql("agg_distinct", "orders", "SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, CAST(sum(DISTINCT o_custkey) AS BIGINT) AS key_sum, round(avg(DISTINCT o_custkey), 4) AS key_mean FROM orders GROUP BY o_orderstatus")
r.sql(
    "agg_expr_case",
    "orders",
    """
    SELECT o_orderpriority, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished,
           round(sum(o_totalprice) / count(*), 4) AS mean, coalesce(max(CASE WHEN o_totalprice < 0 THEN o_totalprice END), -1) AS none
    FROM orders GROUP BY o_orderpriority
    """,
)
r.sql("count_star_filtered", "customer", "SELECT count(*) AS n FROM customer WHERE c_acctbal >= 30")
r.sql("select_distinct", "supplier", "SELECT DISTINCT s_nationkey, s_acctbal > 0 AS positive FROM supplier")
r.sql(
    "agg_sparse_filter_join",
    "lineitem orders customer",
    """
    SELECT c_mktsegment, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE o_orderpriority = '1-URGENT' GROUP BY c_mktsegment
    """,
)

# Order, limits, set operations, CTEs.

@r.query(
    "order_nulls_limit_offset",
    """
    SELECT event_id, v, row_number() OVER (ORDER BY v ASC NULLS LAST, event_id) AS place_asc,
           row_number() OVER (ORDER BY v DESC NULLS FIRST, event_id) AS place_desc
    FROM (SELECT event_id, nullif(value, 6.55) AS v FROM events) ORDER BY v ASC NULLS LAST, event_id LIMIT 500 OFFSET 20
    """,
)
def order_nulls_limit_offset(spark, sf_dir):
    """A page in ascending order, with the places that its rows have in both orders of the whole table."""
    rows = table(spark, sf_dir, "events").select("event_id", F.expr("nullif(value, 6.55D)").alias("v"))
    up = placed(rows, [F.col("v").asc_nulls_last(), F.col("event_id")], "place_asc")
    both = placed(up, [F.col("v").desc_nulls_first(), F.col("event_id")], "place_desc")
    return both.orderBy(F.col("v").asc_nulls_last(), "event_id").offset(20).limit(500)


r.sql("order_limit_topk", "orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
r.sql("union_all", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
r.sql("union_distinct", "customer supplier", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
r.sql("intersect_distinct", "customer supplier", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
r.sql("except_distinct", "nation supplier", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
r.sql("intersect_keep_dups", "customer supplier", "SELECT c_nationkey AS k FROM customer WHERE EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 8000 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")
r.sql("except_keep_dups", "customer supplier", "SELECT c_nationkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_acctbal > 8000 AND s_nationkey IS NOT DISTINCT FROM c_nationkey)")
r.sql(
    "set_operation_chain",
    "nation customer supplier",
    "(SELECT n_nationkey AS k FROM nation UNION SELECT c_nationkey FROM customer) EXCEPT SELECT s_nationkey FROM supplier WHERE s_suppkey < 20",
)
r.sql(
    "cte_nested_aliases",
    "orders customer",
    """
    WITH spend(k, total) AS (SELECT o_custkey, sum(o_totalprice) FROM orders GROUP BY o_custkey),
         big AS (SELECT k, total FROM spend WHERE total > 400000)
    SELECT c_name, round(total, 2) AS total FROM big JOIN customer ON c_custkey = k
    """,
)
r.sql(
    "cte_recursive_superset",
    "nation",
    """
    WITH RECURSIVE steps(n) AS (SELECT 1 AS n UNION ALL SELECT n + 1 FROM steps WHERE n < 20)
    SELECT n FROM steps
    """,
)


@r.query("view_of_view", "SELECT n_name, count(*) AS n FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def view_of_view(spark, sf_dir):
    """CREATE OR REPLACE VIEW, and a view over it."""
    views(spark, sf_dir, "customer", "nation")
    spark.sql("CREATE OR REPLACE TEMP VIEW solvent AS SELECT * FROM customer WHERE c_acctbal > 0")
    spark.sql("CREATE OR REPLACE TEMP VIEW solvent_by_nation AS SELECT n_name, count(*) AS n FROM solvent JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name")
    return spark.table("solvent_by_nation")


@r.query("parameters", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 250000 AND o_custkey BETWEEN 10 AND 900")
def parameters(spark, sf_dir):
    """Named bind parameters; positional ones are a list in args."""
    views(spark, sf_dir, "orders")
    text = "SELECT o_orderkey FROM orders WHERE o_orderstatus = :status AND o_totalprice > :least AND o_custkey BETWEEN :low AND :high"
    return spark.sql(text, args={"status": "F", "least": 250000, "low": 10, "high": 900})


@r.query("parameters_positional", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' AND o_totalprice > 1000")
def parameters_positional(spark, sf_dir):
    views(spark, sf_dir, "orders")
    return spark.sql("SELECT o_orderkey FROM orders WHERE o_orderstatus = ? AND o_totalprice > ?", args=["P", 1000])
