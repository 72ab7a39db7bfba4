"""Audit, compliance and lifecycle operators: rollups, and facts joined to rules."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.catalog import materialize
from brindle.functions.predicates import truth
from brindle.functions.text import class_rank

SMALL = 10_000  # rows of a rule table up to which it is broadcast


def small(rules: DataFrame) -> DataFrame:
    """Rules, broadcast if there are few; else the join is an ordinary one."""
    return F.broadcast(rules) if rules.limit(SMALL + 1).count() <= SMALL else rules


def audit_stats(events: DataFrame) -> DataFrame:
    """One row: totals, denied and allowed, distinct actors, and the share denied in percent; from (actor, denied)."""
    denied = F.sum(F.col("denied").cast("int"))
    return events.agg(F.count("*").alias("total"), denied.alias("denied"), (F.count("*") - denied).alias("allowed"), F.count_distinct("actor").alias("actors"), F.round(100 * denied / F.count("*"), 4).alias("violation_rate"))


def top(df: DataFrame, key: str, count: Column, n: int = 10) -> DataFrame:
    """The n keys of largest count, ties by key; a top-k of pre-aggregated rows."""
    return df.groupBy(key).agg(count.alias("n")).orderBy(F.desc("n"), key).limit(n)


def counts_by(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) over several columns at once, in one pass; arrays count each element."""
    facets = []
    for c in columns:
        values = F.col(c) if dict(df.dtypes)[c].startswith("array") else F.array(F.col(c).cast("string"))
        facets.append(pairs(c, values))
    return df.select(F.explode(F.concat(*facets)).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def pairs(name: str, values: Column) -> Column:
    return F.transform(values, lambda v: F.struct(F.lit(name).alias("facet"), v.cast("string").alias("value")))


def expiring(objects: DataFrame, today: Column, within: int = 30) -> DataFrame:
    """Objects(path, created_on, retention_days) whose retention ends in 0 to within days."""
    left = F.datediff(F.date_add("created_on", F.col("retention_days")), today)
    return objects.withColumn("days_left", left).where(F.col("days_left").between(0, within))


def histogram(df: DataFrame, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative counts up to each bound, sum and count, in one row's aggregates, one row a bound."""
    sums = [F.sum(F.when(F.col(value) <= b, 1).otherwise(0)).alias(f"b{i}") for i, b in enumerate(bounds)]
    one = df.agg(*sums, F.count(value).alias("n"), F.round(F.sum(value), 4).alias("total"))
    rows = F.array(*(F.struct(F.lit(float(b)).alias("bound"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)))
    return one.select(F.explode(rows).alias("r"), "n", "total").select("r.bound", "r.cumulative", "n", "total")


def merge_tags(tags: DataFrame) -> DataFrame:
    """One tag a path of tags(path, frameworks, encrypt, retention_days, audit_level, data_class): unions and the strictest."""
    ranked = tags.withColumn("rank", class_rank(F.col("data_class")))
    return ranked.groupBy("path").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("frameworks")))).alias("frameworks"),
        F.bool_or("encrypt").alias("encrypt"),
        F.max("retention_days").alias("retention_days"),
        F.max("audit_level").alias("audit_level"),
        F.max(F.struct("rank", "data_class"))["data_class"].alias("data_class"),
    )


def ancestors(path: Column) -> Column:
    """A path and all folders above it, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def inherited_tags(resources: DataFrame, tags: DataFrame) -> DataFrame:
    """resources(path) with the merged tags of the path and of all folders above it."""
    above = resources.select("path", F.explode(ancestors(F.col("path"))).alias("folder"))
    of = small(tags.withColumnRenamed("path", "folder"))
    return merge_tags(above.join(of, "folder"))


def decisions(requests: DataFrame, rules: DataFrame, key: str, on: Column) -> DataFrame:
    """(key, decision, by): an explicit deny wins, then the first allow in order, else deny by default.

    rules(name, place, effect) apply to a request where `on` holds.
    """
    hits = requests.join(small(rules), on, "left")
    deny = F.max(truth(F.col("effect") == "deny"))
    first = F.min(F.when(F.col("effect") == "allow", F.struct("place", "name")))
    denier = F.min(F.when(F.col("effect") == "deny", F.struct("place", "name")))
    out = hits.groupBy(key).agg(deny.alias("deny"), first.alias("first"), denier.alias("denier"))
    decision = F.when(F.col("deny") | F.col("first").isNull(), "deny").otherwise("allow")
    return out.select(key, decision.alias("decision"), F.coalesce(F.when(F.col("deny"), F.col("denier.name")).otherwise(F.col("first.name")), F.lit("default")).alias("by"))


def wildcard(pattern: Column) -> Column:
    """A regular expression for a pattern with * and ?."""
    quoted = F.regexp_replace(pattern, r"([.^$+{}()\[\]|\\])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def segregation_conflicts(holders: DataFrame, duties: DataFrame) -> DataFrame:
    """(user, duty) of users with more than one of a duty's incompatible roles; holders(user, role)."""
    pairs = small(duties.select("duty", F.explode("roles").alias("role")))
    held = holders.select("user", "role").distinct().join(pairs, "role")
    return held.groupBy("user", "duty").agg(F.count_distinct("role").alias("held")).where("held > 1")


def residency(objects: DataFrame, policies: DataFrame) -> DataFrame:
    """(path, region, allowed): the first policy(place, prefix, regions) of a path decides; none allows."""
    hits = objects.join(small(policies), F.startswith("path", F.col("prefix")), "left")
    first = F.min(F.when(F.col("place").isNotNull(), F.struct("place", F.exists("regions", lambda r: F.lower(r) == F.lower("region")).alias("ok")))).alias("first")
    return hits.groupBy("path", "region").agg(first).select("path", "region", F.coalesce("first.ok", F.lit(True)).alias("allowed"))


def consented(subjects: DataFrame, consents: DataFrame, purpose: str) -> DataFrame:
    """Subjects with an active consent for the purpose, or for all."""
    ok = consents.where(F.col("active") & F.col("purpose").isin(purpose, "*"))
    return subjects.join(ok, "subject", "left_semi")


def severity(data_class: Column, encrypted: Column, mfa: Column, n_frameworks: Column, n_rules: Column) -> Column:
    restricted = data_class == "restricted"
    critical = (restricted & ~truth(encrypted)) | (n_frameworks > 2) | (restricted & ~truth(mfa))
    high = ((data_class == "confidential") & ~truth(encrypted)) | (n_rules >= 3)
    return F.when(critical, "critical").when(high, "high").when(n_rules >= 2, "medium").otherwise("low")


def retention_actions(objects: DataFrame, policies: DataFrame, holds: DataFrame, today: Column) -> DataFrame:
    """(path, action, policy): the first policy(place, name, prefix, days, action) whose period is over; a legal hold blocks."""
    due = (F.datediff(today, "created_on") > F.col("days")) & F.startswith("path", F.col("prefix"))
    hits = objects.join(small(policies), due)
    first = hits.groupBy("path").agg(F.min(F.struct("place", "name", "action")).alias("first"))
    return first.join(holds.select("path"), "path", "left_anti").select("path", F.col("first.action").alias("action"), F.col("first.name").alias("policy"))


def lifecycle_transitions(objects: DataFrame, rules: DataFrame, today: Column) -> DataFrame:
    """(path, tier): the coldest tier that age allows, of rules(prefix, min_days, tier, coldness)."""
    hits = objects.join(small(rules), F.startswith("path", F.col("prefix")) & (F.datediff(today, "created_on") >= F.col("min_days")))
    return hits.groupBy("path").agg(F.max(F.struct("coldness", "tier")).alias("c")).select("path", F.col("c.tier").alias("tier"))


def worst_status(reports: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The worst status of each key; order from best to worst."""
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("status"))
    return reports.groupBy(key).agg(F.max(F.struct(rank.alias("rank"), "status"))["status"].alias("status"))


def bit_rot(contents: DataFrame, recorded: DataFrame, key: str) -> DataFrame:
    """(key, state): ok, corrupt or missing, by SHA-256 of content against the recorded hash."""
    actual = contents.select(key, F.sha2("content", 256).alias("actual"))
    state = F.when(F.col("actual").isNull(), "missing").when(F.col("actual") == F.col("hash"), "ok").otherwise("corrupt")
    return recorded.join(actual, key, "left").select(key, state.alias("state"))


def merkle(leaves: list[str]) -> str:
    """Root over hex hashes: pairs hashed together, an odd last one with itself."""
    if not leaves:
        return ""
    while len(leaves) > 1:
        leaves = [hashlib.sha256((a + b).encode()).hexdigest() for a, b in zip(leaves[::2], leaves[1::2] + leaves[-1:] * (len(leaves) % 2))]
    return leaves[0]


def merkle_roots(events: DataFrame, leaf: str, fan: int = 1 << 12) -> DataFrame:
    """(block, root) over events(block, place, …) with hex column leaf, places 0, 1, … within a block.

    Subtrees of fan leaves (a power of two) are built first, so no group holds more; their roots are
    the leaves of the next level. The result is that of one tree over all leaves: a block of several
    subtrees pads the last one to its full height.
    """

    def root(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place", kind="stable")
        full = rows["n"].iloc[0] > fan
        leaves = list(rows["leaf"])
        out = merkle(leaves)
        if full:
            height, size = fan.bit_length() - 1, max(1, (len(leaves) - 1).bit_length() if len(leaves) > 1 else 0)
            for _ in range(height - (size if len(leaves) > 1 else 0)):
                out = hashlib.sha256((out + out).encode()).hexdigest()
        return pd.DataFrame({"block": [rows["block"].iloc[0]], "place": [rows["place"].iloc[0] // fan], "leaf": [out], "n": [-(-rows["n"].iloc[0] // fan)]})

    schema = "block string, place long, leaf string, n long"
    sizes = events.groupBy("block").agg(F.count("*").alias("n"))
    level = events.select(F.col("block").cast("string").alias("block"), F.col("place").cast("long").alias("place"), F.col(leaf).alias("leaf"))
    level = level.join(sizes.withColumn("block", F.col("block").cast("string")), "block")
    most = sizes.agg(F.max("n")).first()[0] or 0
    while True:
        level = level.groupBy("block", F.floor(F.col("place") / fan)).applyInPandas(lambda rows: root(rows), schema)
        if most <= fan:
            return level.select("block", F.col("leaf").alias("root"))
        most = -(-most // fan)


def chain_faults(blocks: DataFrame) -> DataFrame:
    """(height, fault) of blocks(height, hash, previous, ts): gaps, broken links and time going back.

    The log is cut into ranges of heights. The block before a range's first one is the last of the range
    before, so besides its own blocks a range needs one row only.
    """
    ranged = blocks.select("height", "hash", "previous", "ts").repartitionByRange("height")
    ranged = materialize(ranged.withColumn("part", F.spark_partition_id()))
    block = F.struct("height", "ts", "hash")
    lasts = ranged.groupBy("part").agg(F.max(block).alias("last"))
    edges = lasts.select("part", F.lag("last").over(Window.orderBy("part")).alias("edge"))  # a row for each range
    within = F.lag(block).over(Window.partitionBy("part").orderBy("height", "ts", "hash"))
    before = ranged.withColumn("within", within).join(F.broadcast(edges), "part").withColumn("b", F.coalesce("within", "edge"))
    faults = F.array(
        F.when(F.col("height") != F.col("b.height") + 1, F.lit("gap")),
        F.when((F.col("height") == F.col("b.height") + 1) & ~F.col("previous").eqNullSafe(F.col("b.hash")), F.lit("link")),
        F.when(F.col("ts") < F.col("b.ts"), F.lit("time")),
    )
    return before.select("height", F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))


COVERED = ("height", "previous", "ts", "root")  # what a block's hash is of


def block_hash(covered=COVERED) -> Column:
    return F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in covered)), 256)


def chain_check(blocks: DataFrame, events: DataFrame, leaf: str, covered=COVERED) -> DataFrame:
    """(height, fault) of blocks(height, hash, previous, ts, root) and their events(block, place, leaf, …).

    Besides chain_faults: hash, if a block's hash isn't that of what it covers, and root, if its root
    isn't that of its events. Events of a block that isn't there are an orphan fault of its height.
    """
    blocks = materialize(blocks)
    roots = merkle_roots(events, leaf).select(F.col("block").cast("long").alias("at"), F.col("root").alias("actual"))
    both = blocks.withColumn("there", F.lit(True)).join(roots, F.col("height") == F.col("at"), "full")
    faults = F.array(
        F.when(F.col("there").isNull(), F.lit("orphan")),
        F.when(F.col("there") & ~F.col("hash").eqNullSafe(block_hash(covered)), F.lit("hash")),
        F.when(F.col("there") & ~F.col("root").eqNullSafe(F.coalesce("actual", F.lit(""))), F.lit("root")),
    )
    content = both.select(F.coalesce("height", "at").alias("height"), F.explode(F.filter(faults, lambda f: f.isNotNull())).alias("fault"))
    return chain_faults(blocks).select(F.col("height").cast("long").alias("height"), "fault").union(content)


def byte_ranges(objects: DataFrame) -> DataFrame:
    """objects(content, range, …) with `status` and `ranges` (start, stop and content of each), as a Range header asks.

    'bytes=a-b', 'a-' and a suffix '-n', several with commas; stop is the last byte, at most the object's
    last. 206 with ranges; 200 without a header; 400 if any range is malformed, 416 if any lies outside.
    """
    length = F.octet_length("content").cast("long")
    asked = F.filter(F.transform(F.split(F.substr("range", F.lit(7)), ","), lambda x: F.trim(x)), lambda x: x != "")

    def bounds(spec: Column) -> Column:
        first, last = (F.regexp_extract(spec, "^([0-9]*)-([0-9]*)$", i).try_cast("long") for i in (1, 2))
        suffix = spec.startswith("-")
        well = F.rlike(spec, F.lit("^[0-9]*-[0-9]*$")) & F.when(suffix, last.isNotNull()).otherwise(first.isNotNull() & (spec.endswith("-") | last.isNotNull()))
        start = F.when(suffix, F.greatest(length - last, F.lit(0))).otherwise(first)
        stop = F.when(suffix | spec.endswith("-"), length - 1).otherwise(last)
        return F.struct(well.alias("well"), start.alias("start"), stop.alias("stop"))

    def cut(x: Column) -> Column:
        stop = F.least(x["stop"], F.col("length") - 1)
        return F.struct(x["start"].alias("start"), stop.alias("stop"), F.substr("content", (x["start"] + 1).cast("int"), (stop - x["start"] + 1).cast("int")).alias("content"))

    found = objects.withColumn("length", length).withColumn("bounds", F.transform(asked, bounds))
    bad = ~F.startswith("range", F.lit("bytes=")) | F.exists("bounds", lambda x: ~x["well"])
    outside = F.exists("bounds", lambda x: (x["start"] > x["stop"]) | (x["start"] >= F.col("length")))
    status = F.when(F.coalesce("range", F.lit("")) == "", 200).when(bad, 400).when(outside, 416).when(F.size("bounds") == 0, 200).otherwise(206)
    found = found.withColumn("status", status)
    return found.withColumn("ranges", F.when(F.col("status") == 206, F.transform("bounds", cut))).drop("length", "bounds")


def multipart_etag(digests: Column) -> Column:
    """The ETag of an object uploaded in parts, from the MD5 hex digests of its parts in order: MD5 of them joined, and -n."""
    return F.concat(F.md5(F.unhex(F.array_join(digests, ""))), F.lit("-"), F.size(digests).cast("string"))


def part_digests(content: Column, part_bytes: int) -> Column:
    """MD5 of each part of so many bytes; an empty content is one empty part."""
    last = F.greatest(F.ceil(F.octet_length(content) / part_bytes) - 1, F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.md5(F.substr(content, i * part_bytes + 1, F.lit(part_bytes))))


def lineage(events: DataFrame, path: str) -> DataFrame:
    return events.where(F.col("path") == path).orderBy("ts", "event_id")


# What each framework asks of an operation, as (framework, condition, denies, violated rule, required action).
OPERATION_RULES = [
    ("fips", "operation = 'write' AND algorithm <> '' AND algorithm NOT IN ('AES-256-GCM', 'SHA-256', 'SHA-512', 'PBKDF2')", True, "FIPS 140-2: non-approved cryptographic algorithm", None),
    ("fips", "TRUE", False, None, "FIPS 140-2: use approved key management"),
    ("gdpr", "operation = 'delete' AND reason = ''", False, None, "record deletion reason for GDPR compliance"),
    ("gdpr", "operation = 'write' AND NOT encrypted AND data_class >= 'confidential'", True, "GDPR Article 32: confidential data must be encrypted", None),
    ("gdpr", "retention_days > 0 AND data_age > retention_days", False, "GDPR Article 5: data exceeds retention period", "delete or anonymize expired data"),
    ("gdpr", "operation IN ('read', 'write')", False, None, "verify consent for personal data processing"),
    ("hipaa", "operation = 'write' AND NOT encrypted", True, "HIPAA Security Rule: PHI must be encrypted", None),
    ("hipaa", "operation = 'read'", False, None, "enforce minimum necessary access for PHI"),
    ("hipaa", "TRUE", False, None, "log PHI access for HIPAA audit trail"),
    ("hipaa", "actor <> '' AND actor NOT LIKE '%internal%'", False, None, "verify BAA exists for external access"),
    ("nist", "actor = ''", True, "NIST AC-3: authenticated identity required", None),
    ("nist", "operation IN ('read', 'write')", False, None, "NIST SC-8: ensure TLS 1.3 for transmission"),
    ("nist", "TRUE", False, None, "NIST AU-2: log security-relevant events"),
    ("nist", "data_class >= 'confidential' AND NOT encrypted", True, "NIST SC-13: FIPS-approved crypto required", None),
    ("pci", "operation = 'write' AND NOT encrypted", True, "PCI DSS 3.4: cardholder data must be encrypted", None),
    ("pci", "actor = '' OR NOT mfa", True, "PCI DSS 8.3: MFA required for cardholder data access", None),
    ("pci", "TRUE", False, None, "PCI DSS 10.1: log all access to cardholder data"),
    ("pci", "retention_days = 0", False, "PCI DSS 3.1: retention policy required", None),
    ("soc2", "actor = ''", True, "SOC2 CC6.1: authenticated access required", None),
    ("soc2", "operation = 'write' AND NOT encrypted", False, "SOC2 CC6.6: encryption at rest required", None),
    ("soc2", "TRUE", False, None, "SOC2 CC7.2: log and monitor system activities"),
    (None, "encrypt AND operation = 'write' AND NOT encrypted", True, "encryption required but data is not encrypted", "encrypt data before write"),
]
# The reasons of requests that no rule is applied to.
BYPASSED, UNTAGGED = "system operation - compliance checks bypassed", "no compliance tags applied"
REQUEST = {"operation": "", "actor": "", "algorithm": "", "reason": "", "encrypted": False, "mfa": False, "system": False, "data_age": 0}


def validate_operations(requests: DataFrame, tags: DataFrame) -> DataFrame:
    """(request, path, allowed, why, violated, actions) of requests on tagged paths, by the rules of the tags' frameworks.

    requests has request, path and the columns of REQUEST, whose NULLs count as the values there;
    tags(path, frameworks, encrypt, retention_days, data_class) has a row a path, as merge_tags()
    gives. A system operation and a path without a tag are allowed. A violated rule need not deny.
    Findings come by framework, then in the rules' order. Classes are compared as text, so that
    every class but the empty one counts as confidential at least.
    """
    filled = requests.select("request", "path", *(F.coalesce(F.col(c), F.lit(v)).alias(c) for c, v in REQUEST.items()))
    of = small(tags.select(F.col("path").alias("tagged"), "frameworks", "encrypt", "retention_days", "data_class"))
    both = filled.join(of, F.col("path") == F.col("tagged"), "left")

    def finding(framework, condition, denies, violated, action):
        applies = truth(F.expr(condition)) & (F.lit(True) if framework is None else truth(F.array_contains("frameworks", framework)))
        return F.when(applies, F.struct(F.lit(denies).alias("denies"), F.lit(violated).cast("string").alias("violated"), F.lit(action).cast("string").alias("action")))

    found = F.filter(F.array(*(finding(*rule) for rule in OPERATION_RULES)), lambda x: x.isNotNull())
    why = F.when(F.col("system"), BYPASSED).when(F.col("tagged").isNull(), UNTAGGED)
    judged = both.select("request", "path", why.alias("why"), F.when(why.isNull(), found).alias("found"))

    def texts(field: str) -> Column:
        return F.coalesce(F.filter(F.transform("found", lambda x: x[field]), lambda x: x.isNotNull()), F.array().cast("array<string>"))

    allowed = ~F.coalesce(F.exists("found", lambda x: x["denies"]), F.lit(False))
    return judged.select("request", "path", allowed.alias("allowed"), "why", texts("violated").alias("violated"), texts("action").alias("actions"))
