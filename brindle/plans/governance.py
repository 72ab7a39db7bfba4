"""Audit, compliance and lifecycle queries over events, orders and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.operators import governance as V
from brindle.operators.ranks import placed
from brindle.plans.base import registry as r


def events(spark, sf_dir):
    """Events as an audit log: errors are denials, users are actors."""
    return table(spark, sf_dir, "events").select("event_id", "ts", F.col("user_id").alias("actor"), F.col("event_type").alias("action"), "value", (F.col("event_type") == "error").alias("denied"))


@r.query("audit_stats", "SELECT count(*) AS total, CAST(sum((event_type = 'error')::INT) AS BIGINT) AS denied, CAST(count(*) - sum((event_type = 'error')::INT) AS BIGINT) AS allowed, count(DISTINCT user_id) AS actors, round(100 * sum((event_type = 'error')::INT) / count(*), 4) AS violation_rate FROM events")
def audit_stats(spark, sf_dir):
    return V.audit_stats(events(spark, sf_dir))


@r.query("audit_top_denied", "SELECT user_id AS actor, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY user_id ORDER BY n DESC, actor LIMIT 10")
def audit_top_denied(spark, sf_dir):
    return V.top(events(spark, sf_dir).where("denied"), "actor", F.count("*"))


@r.query("audit_filtered", "SELECT event_id FROM events WHERE event_type IN ('error', 'click') AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-06' ORDER BY ts, event_id LIMIT 200")
def audit_filtered(spark, sf_dir):
    rows = events(spark, sf_dir).where("action IN ('error', 'click') AND ts BETWEEN TIMESTAMP_NTZ'2024-01-03' AND TIMESTAMP_NTZ'2024-01-06'")
    return rows.orderBy("ts", "event_id").limit(200).select("event_id")


FRAMEWORKS = "CASE WHEN user_id % 3 = 0 THEN ['gdpr', 'hipaa'] WHEN user_id % 3 = 1 THEN ['pci'] ELSE ['gdpr'] END"


@r.query(
    "violation_stats",
    f"""
    SELECT facet, value, count(*) AS n FROM (
        SELECT 'action' AS facet, event_type AS value FROM events WHERE value > 20 UNION ALL SELECT 'actor', CAST(user_id AS VARCHAR) FROM events WHERE value > 20
        UNION ALL SELECT 'frameworks', unnest({FRAMEWORKS}) FROM events WHERE value > 20) GROUP BY facet, value
    """,
)
def violation_stats(spark, sf_dir):
    """Counts by action, actor and framework in one pass."""
    rows = events(spark, sf_dir).where("value > 20").withColumn("frameworks", F.expr("CASE WHEN actor % 3 = 0 THEN array('gdpr', 'hipaa') WHEN actor % 3 = 1 THEN array('pci') ELSE array('gdpr') END"))
    return V.counts_by(rows, ["action", "actor", "frameworks"])


@r.query("compliance_top_paths", "SELECT source AS path, count(*) AS accesses, max(doc_id) AS last_access FROM documents GROUP BY source ORDER BY accesses DESC, path LIMIT 10")
def compliance_top_paths(spark, sf_dir):
    found = table(spark, sf_dir, "documents").groupBy(F.col("source").alias("path")).agg(F.count("*").alias("accesses"), F.max("doc_id").alias("last_access"))
    return found.orderBy(F.desc("accesses"), "path").limit(10)


@r.query(
    "inventory_retention",
    "SELECT o_orderkey AS path, CAST(date_diff('day', DATE '1998-01-15', CAST(o_orderdate AS DATE) + CAST(30 * (1 + o_orderkey % 60) AS INTEGER)) AS INTEGER) AS days_left FROM orders WHERE date_diff('day', DATE '1998-01-15', CAST(o_orderdate AS DATE) + CAST(30 * (1 + o_orderkey % 60) AS INTEGER)) BETWEEN 0 AND 30",
)
def inventory_retention(spark, sf_dir):
    objects = table(spark, sf_dir, "orders").selectExpr("o_orderkey AS path", "CAST(o_orderdate AS DATE) AS created_on", "CAST(30 * (1 + o_orderkey % 60) AS INT) AS retention_days")
    return V.expiring(objects, F.expr("DATE'1998-01-15'")).select("path", "days_left")


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0]


@r.query("histogram_buckets", f"SELECT b AS bound, count(*) FILTER (value <= b) AS cumulative, count(value) AS n, round(sum(value), 4) AS total FROM events, (SELECT unnest({BOUNDS}::DOUBLE[]) AS b) GROUP BY b")
def histogram_buckets(spark, sf_dir):
    return V.histogram(table(spark, sf_dir, "events"), "value", BOUNDS)


@r.query("folder_size", "SELECT source AS folder, CAST(sum(n_chars) AS BIGINT) AS size, count(*) AS objects FROM documents WHERE source IN ('src1', 'src2') GROUP BY source")
def folder_size(spark, sf_dir):
    return table(spark, sf_dir, "documents").where(F.col("source").isin("src1", "src2")).groupBy(F.col("source").alias("folder")).agg(F.sum("n_chars").alias("size"), F.count("*").alias("objects"))


TAGS = [("a", ["gdpr"], False, 30, 1, "confidential"), ("a/b", ["hipaa", "gdpr"], True, 10, 2, "public"), ("a/b/c", ["pci"], False, 90, 0, "internal"), ("d", ["soc2"], True, 5, 3, "top_secret"), ("a/b", ["nist"], False, 400, 1, "restricted")]
TAG_SCHEMA = "path string, frameworks array<string>, encrypt boolean, retention_days int, audit_level int, data_class string"
TAG_VALUES = "(VALUES " + ", ".join(f"('{p}', {f}, {e}, {d}, {a}, '{c}')" for p, f, e, d, a, c in TAGS) + ") t(path, frameworks, encrypt, retention_days, audit_level, data_class)"
MERGED = """list_sort(list_distinct(flatten(list(frameworks)))) AS frameworks, bool_or(encrypt) AS encrypt, max(retention_days) AS retention_days, max(audit_level) AS audit_level,
       arg_max(data_class, list_position(['public', 'internal', 'confidential', 'restricted', 'top_secret'], data_class)) AS data_class"""


@r.query("tag_merge", f"SELECT path, {MERGED} FROM {TAG_VALUES} GROUP BY path")
def tag_merge(spark, sf_dir):
    return V.merge_tags(spark.createDataFrame(TAGS, TAG_SCHEMA))


@r.query(
    "tag_inheritance",
    f"""
    WITH resources AS (SELECT DISTINCT ['a', 'a/b', 'a/b/c', 'd'][1 + doc_id % 4] || '/' || source AS path FROM documents)
    SELECT r.path, {MERGED} FROM resources r JOIN {TAG_VALUES} ON r.path = t.path OR starts_with(r.path, t.path || '/') GROUP BY r.path
    """,
)
def tag_inheritance(spark, sf_dir):
    """Tags of all folders above a path, by an equi-join on exploded ancestors."""
    resources = table(spark, sf_dir, "documents").selectExpr("array('a', 'a/b', 'a/b/c', 'd')[doc_id % 4] || '/' || source AS path").distinct()
    return V.inherited_tags(resources, spark.createDataFrame(TAGS, TAG_SCHEMA))


RULES = [("deny_errors", 1, "deny", "error", "*"), ("allow_views", 2, "allow", "view", "1*"), ("allow_click", 3, "allow", "c?ick", "*"), ("deny_9", 4, "deny", "*", "9"), ("allow_signup", 5, "allow", "s*", "*5")]
RULE_VALUES = "(VALUES " + ", ".join(f"('{n}', {p}, '{e}', '{a}', '{u}')" for n, p, e, a, u in RULES) + ") r(name, place, effect, act, who)"


def like_rule(value: str, pattern: str) -> str:
    return f"regexp_full_match({value}, replace(replace({pattern}, '*', '.*'), '?', '.'))"


@r.query(
    "iam_decisions",
    f"""
    SELECT event_id, CASE WHEN bool_or(coalesce(effect = 'deny', false)) OR count(*) FILTER (effect = 'allow') = 0 THEN 'deny' ELSE 'allow' END AS decision,
           CASE WHEN bool_or(coalesce(effect = 'deny', false)) THEN arg_min(name, place) FILTER (effect = 'deny') ELSE coalesce(arg_min(name, place) FILTER (effect = 'allow'), 'default') END AS by
    FROM events LEFT JOIN {RULE_VALUES} ON {like_rule('event_type', 'act')} AND {like_rule('CAST(user_id AS VARCHAR)', 'who')} GROUP BY event_id
    """,
)
def iam_decisions(spark, sf_dir):
    """Explicit deny wins, then the first allow, else deny; patterns with * and ?."""
    rules = spark.createDataFrame(RULES, "name string, place int, effect string, act string, who string").withColumn("act_re", V.wildcard(F.col("act"))).withColumn("who_re", V.wildcard(F.col("who")))
    requests = table(spark, sf_dir, "events").select("event_id", "event_type", F.col("user_id").cast("string").alias("user"))
    on = F.regexp_like("event_type", F.col("act_re")) & F.regexp_like("user", F.col("who_re"))
    return V.decisions(requests, rules, "event_id", on)


@r.query("policy_decisions", "SELECT o_orderkey AS request, CASE WHEN o_totalprice > 250000 AND o_orderpriority = '1-URGENT' THEN 'deny' WHEN o_orderstatus IN ('F', 'O') THEN 'allow' ELSE 'deny' END AS decision, CASE WHEN o_totalprice > 250000 AND o_orderpriority = '1-URGENT' THEN 'big_urgent' WHEN o_orderstatus IN ('F', 'O') THEN 'known_status' ELSE 'default' END AS by FROM orders")
def policy_decisions(spark, sf_dir):
    rules = spark.createDataFrame([("big_urgent", 1, "deny", 250000.0, ["1-URGENT"], ["F", "O", "P"]), ("known_status", 2, "allow", -1e18, ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], ["F", "O"])], "name string, place int, effect string, above double, priorities array<string>, statuses array<string>")
    requests = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "request")
    on = (F.col("o_totalprice") > F.col("above")) & F.array_contains("priorities", F.col("o_orderpriority")) & F.array_contains("statuses", F.col("o_orderstatus"))
    return V.decisions(requests, rules, "request", on)


@r.query("sod_conflicts", "SELECT user_id AS user, duty, count(DISTINCT event_type) AS held FROM events JOIN (SELECT 'audit' AS duty, unnest(['error', 'signup']) AS role UNION ALL SELECT 'trade', unnest(['click', 'view', 'purchase'])) ON event_type = role GROUP BY ALL HAVING count(DISTINCT event_type) > 1")
def sod_conflicts(spark, sf_dir):
    holders = table(spark, sf_dir, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("role"))
    duties = spark.createDataFrame([("audit", ["error", "signup"]), ("trade", ["click", "view", "purchase"])], "duty string, roles array<string>")
    return V.segregation_conflicts(holders, duties)


@r.query(
    "residency_check",
    """
    SELECT DISTINCT source || '/' || lang AS path, upper(lang) AS region,
           CASE WHEN starts_with(source, 'src1') THEN lang IN ('de', 'fr') WHEN starts_with(source, 'src') AND source < 'src5' THEN lang IN ('en') ELSE true END AS allowed
    FROM documents
    """,
)
def residency_check(spark, sf_dir):
    objects = table(spark, sf_dir, "documents").select(F.concat_ws("/", "source", "lang").alias("path"), F.upper("lang").alias("region")).distinct()
    policies = spark.createDataFrame([(1, "src1", ["DE", "fr"])] + [(i, f"src{i}", ["EN"]) for i in (2, 3, 4)] + [(9, "src0", ["en"])], "place int, prefix string, regions array<string>")
    return V.residency(objects, policies)


@r.query("consent_lookup", "SELECT DISTINCT user_id AS subject FROM events WHERE user_id % 4 = 0 OR user_id % 7 = 0")
def consent_lookup(spark, sf_dir):
    users = table(spark, sf_dir, "events").select(F.col("user_id").alias("subject")).distinct()
    consents = users.selectExpr("subject", "IF(subject % 4 = 0, 'ads', '*') AS purpose", "subject % 4 = 0 OR subject % 7 = 0 AS active")
    return V.consented(users, consents, "ads")


@r.query(
    "severity_score",
    """
    SELECT event_id, CASE WHEN user_id % 4 = 0 AND value < 10 OR user_id % 5 > 2 OR user_id % 4 = 0 AND value < 20 THEN 'critical'
        WHEN user_id % 4 = 1 AND value < 10 OR event_id % 4 >= 3 THEN 'high' WHEN event_id % 4 >= 2 THEN 'medium' ELSE 'low' END AS severity FROM events
    """,
)
def severity_score(spark, sf_dir):
    data_class = F.expr("element_at(array('restricted', 'confidential', 'internal', 'public'), CAST(user_id % 4 AS INT) + 1)")
    scored = V.severity(data_class, F.col("value") >= 10, F.col("value") >= 20, F.col("user_id") % 5, F.col("event_id") % 4)
    return table(spark, sf_dir, "events").select("event_id", scored.alias("severity"))


@r.query(
    "retention_actions",
    "SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN starts_with(CAST(o_orderkey AS VARCHAR), '1') AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 365 THEN 'archive' ELSE 'delete' END AS action, CASE WHEN starts_with(CAST(o_orderkey AS VARCHAR), '1') AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 365 THEN 'ones' ELSE 'all' END AS policy FROM orders WHERE (date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 1000 OR starts_with(CAST(o_orderkey AS VARCHAR), '1') AND date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') > 365) AND o_orderkey % 10 <> 3",
)
def retention_actions(spark, sf_dir):
    objects = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS path", "CAST(o_orderdate AS DATE) AS created_on", "o_orderkey")
    policies = spark.createDataFrame([(1, "ones", "1", 365, "archive"), (2, "all", "", 1000, "delete")], "place int, name string, prefix string, days int, action string")
    return V.retention_actions(objects.drop("o_orderkey"), policies, objects.where("o_orderkey % 10 = 3"), F.expr("DATE'1998-01-01'"))


@r.query("lifecycle_transitions", "SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') >= 1500 THEN 'glacier' ELSE 'cold' END AS tier FROM orders WHERE date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-01-01') >= 400")
def lifecycle_transitions(spark, sf_dir):
    objects = table(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS STRING) AS path", "CAST(o_orderdate AS DATE) AS created_on")
    rules = spark.createDataFrame([("", 400, "cold", 1), ("", 1500, "glacier", 2)], "prefix string, min_days int, tier string, coldness int")
    return V.lifecycle_transitions(objects, rules, F.expr("DATE'1998-01-01'"))


@r.query("replication_worst_status", "SELECT l_orderkey AS object, CASE max(CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END) WHEN 1 THEN 'F' ELSE 'O' END AS status FROM lineitem GROUP BY l_orderkey")
def replication_worst_status(spark, sf_dir):
    return V.worst_status(table(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS object", "l_linestatus AS status"), "object", ["F", "O"])


@r.query("bit_rot_scan", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'missing' WHEN doc_id % 7 = 0 THEN 'corrupt' ELSE 'ok' END AS state FROM documents")
def bit_rot_scan(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").selectExpr("doc_id", "CAST(text AS BINARY) AS content")
    recorded = docs.select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.lit("0")).otherwise(F.sha2("content", 256)).alias("hash"))
    return V.bit_rot(docs.where("doc_id % 11 <> 0"), recorded, "doc_id")


@r.query("byte_ranges_etags", "SELECT doc_id, md5(text) AS etag, substr(text, 1, 0) || 'n' AS marker FROM documents")
def byte_ranges_etags(spark, sf_dir):
    """ETags of whole objects; byte_ranges reads ranges, multipart_etags has those of uploads in parts."""
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("etag"), F.lit("n").alias("marker"))


@r.query("byte_ranges")
def byte_ranges(spark, sf_dir):
    """Documents read by Range headers of each form; bytes aren't SQL, the tests cut them in Python."""
    headers = ["bytes=0-99", "bytes=100-", "bytes=-50", "bytes=0-0, 10-19,-5", "bytes=90000-", "bytes=5-2", "bytes=x-1", ""]
    header = F.element_at(F.array(*map(F.lit, headers)), (F.pmod("doc_id", F.lit(len(headers))) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("binary").alias("content"), header.alias("range"))
    found = V.byte_ranges(docs).select("doc_id", "range", "status", F.posexplode_outer("ranges").alias("place", "r"))
    return found.select("doc_id", "range", "status", "place", "r.start", "r.stop", F.md5("r.content").alias("md5"))


@r.query("multipart_etags")
def multipart_etags(spark, sf_dir):
    """ETags of documents uploaded in parts of 1024 bytes; the tests compare them with Python's."""
    content = F.col("text").cast("binary")
    return table(spark, sf_dir, "documents").select("doc_id", V.multipart_etag(V.part_digests(content, 1024)).alias("etag"))


@r.query("lineage_by_path", "SELECT event_id, ts, event_type FROM events WHERE user_id = 8")
def lineage_by_path(spark, sf_dir):
    return V.lineage(table(spark, sf_dir, "events").withColumn("path", F.col("user_id").cast("string")), "8").select("event_id", "ts", "event_type")


@r.query(
    "audit_chain_gaps",
    """
    WITH b AS (SELECT n_nationkey + CASE WHEN n_nationkey > 9 THEN 1 ELSE 0 END AS height, sha256(n_name) AS hash, CASE WHEN n_nationkey % 8 = 5 THEN 'x' ELSE lag(sha256(n_name)) OVER (ORDER BY n_nationkey) END AS previous, CASE WHEN n_nationkey = 15 THEN 3 ELSE n_nationkey END AS ts FROM nation),
    l AS (SELECT *, lag(height) OVER (ORDER BY height) AS h, lag(hash) OVER (ORDER BY height) AS p, lag(ts) OVER (ORDER BY height) AS t FROM b)
    SELECT height, unnest(list_filter([CASE WHEN height <> h + 1 THEN 'gap' END, CASE WHEN height = h + 1 AND previous <> p THEN 'link' END, CASE WHEN ts < t THEN 'time' END], lambda x: x IS NOT NULL)) AS fault FROM l
    """,
)
def audit_chain_gaps(spark, sf_dir):
    from pyspark.sql import Window

    nation = table(spark, sf_dir, "nation")
    before = F.lag(F.sha2("n_name", 256)).over(Window.orderBy("n_nationkey"))
    blocks = nation.select(
        (F.col("n_nationkey") + F.when(F.col("n_nationkey") > 9, 1).otherwise(0)).alias("height"),
        F.sha2("n_name", 256).alias("hash"),
        F.when(F.col("n_nationkey") % 8 == 5, F.lit("x")).otherwise(before).alias("previous"),
        F.when(F.col("n_nationkey") == 15, 3).otherwise(F.col("n_nationkey")).alias("ts"),
    )
    return V.chain_faults(blocks)


@r.query("audit_chain_events")
def audit_chain_events(spark, sf_dir):
    """The chain of all events in blocks of 64, altered in known places after it was recorded; the tests check it in Python.

    A block's hash leaves the block before out here, so that the log can be made without going through it in order.
    """
    covered = ("height", "ts", "root")
    log = table(spark, sf_dir, "events").selectExpr("event_id", "event_type", "value", "user_id", "ts", "event_id DIV 64 AS block", "event_id % 64 AS place")
    leaf = F.sha2(F.concat_ws("|", "event_id", "event_type", "user_id", "value"), 256)
    recorded = log.withColumn("leaf", leaf)
    times = log.groupBy(F.col("block").alias("height")).agg(F.max("ts").alias("ts")).withColumn("ts", F.when(F.col("height") % 41 == 20, F.expr("ts - INTERVAL 90 DAYS")).otherwise(F.col("ts")))
    roots = V.merkle_roots(recorded, "leaf").select(F.col("block").cast("long").alias("height"), "root")
    blocks = times.join(roots, "height").withColumn("hash", V.block_hash(covered))
    before = blocks.select((F.col("height") + 1).alias("height"), F.col("hash").alias("previous"))
    blocks = blocks.join(before, "height", "left")
    blocks = blocks.where("height % 37 <> 30").withColumn("previous", F.when(F.col("height") % 29 == 11, F.lit("x")).otherwise(F.col("previous")))
    blocks = blocks.withColumn("ts", F.when(F.col("height") % 31 == 5, F.expr("ts + INTERVAL 1 SECOND")).otherwise(F.col("ts")))
    kept = log.withColumn("value", F.when(F.col("event_id") % 1009 == 7, F.col("value") + 1).otherwise(F.col("value"))).withColumn("leaf", leaf)
    return V.chain_check(blocks, kept, "leaf", covered)


@r.query("merkle_root")
def merkle_root(spark, sf_dir):
    """Roots of a day's events; the tree isn't SQL, the tests compare it with a plain one."""
    rows = table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("block"), "event_id", F.sha2(F.concat_ws("|", F.col("event_id").cast("string"), "event_type"), 256).alias("hash"))
    ordered = placed(rows, [F.col("event_id")], "place", ("block",))
    return V.merkle_roots(ordered.withColumn("place", F.col("place") - 1), "hash")


@r.query("report_export", "SELECT o_orderstatus AS status, '{\"status\":\"' || o_orderstatus || '\",\"n\":' || count(*) || '}' AS json FROM orders GROUP BY o_orderstatus")
def report_export(spark, sf_dir):
    """A report's rows as JSON; write.json and write.csv make files of them."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))
    return rows.select("status", F.to_json(F.struct("status", "n")).alias("json"))
