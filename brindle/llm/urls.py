"""URL filters against dated lists: a temporal join.

A list is a log of dated changes: an entry (a domain, or a host with the beginning of a path) is
put on the block or allow list or removed from it. Changes of an entry on one list become validity
intervals, from the change to the next one on that list. A capture is joined, by each domain above its host and each beginning of its
path, to the interval that holds at its fetch date; the most specific active entry decides, and
block wins over allow.

The list is broadcast if it has at most BROADCAST intervals; beyond, captures are salted by row and
the list's intervals are repeated for each salt, so a host with a third of all captures is spread.

Defined cases: a null URL, or one without a host, matches nothing and isn't blocked; neither is a
capture without a fetch date. Of changes of one entry on one list and date a removal counts.
Repeated captures are judged one by one. Entries are compared in lower case. Empty lists and tables
work; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST = 100_000
SALTS = 32
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+(/[^?#]*)"


def intervals(changes: DataFrame) -> DataFrame:
    """entry, verdict, since, until of changes(entry, action, list, changed_on); until is open for the last."""
    dated = changes.where("entry IS NOT NULL AND list IS NOT NULL AND changed_on IS NOT NULL").select(F.lower("entry").alias("entry"), F.col("list").alias("verdict"), "action", "changed_on")
    day = dated.groupBy("entry", "verdict", "changed_on").agg(F.max("action").alias("action"))
    later = Window.partitionBy("entry", "verdict").orderBy("changed_on")
    spans = day.select("entry", "verdict", "action", F.col("changed_on").alias("since"), F.lead("changed_on").over(later).alias("until"))
    return spans.where("action = 'add'").drop("action")


def beginnings(parts: Column, join: str) -> Column:
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), join))


def keys(url: Column) -> Column:
    """All entries that would match: domains from the host up, and beginnings of host and path."""
    host = F.lower(F.regexp_extract(url, HOST, 1))
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    path = F.filter(F.split(F.lower(F.regexp_extract(url, PATH, 1)), "/"), lambda s: s != "")
    paths = F.when(F.size(path) > 0, F.transform(beginnings(path, "/"), lambda p: F.concat(host, F.lit("/"), p))).otherwise(F.array().cast("array<string>"))
    return F.when(F.coalesce(host, F.lit("")) != "", F.array_distinct(F.concat(domains, paths))).otherwise(F.array().cast("array<string>"))


def judge(captures: DataFrame, changes: DataFrame) -> DataFrame:
    """page_id, host, fetched_on, n_active, decided_by and blocked of captures(page_id, url, fetched_on)."""
    spans = intervals(changes).withColumnRenamed("entry", "key")
    rows = captures.select(F.monotonically_increasing_id().alias("row"), "page_id", "url", "fetched_on")
    tried = rows.select("row", "page_id", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1)).alias("host"), "fetched_on", F.explode_outer(keys(F.col("url"))).alias("key"))
    holds = (F.col("fetched_on") >= F.col("since")) & (F.col("until").isNull() | (F.col("fetched_on") < F.col("until")))
    if spans.limit(BROADCAST + 1).count() <= BROADCAST:
        hits = tried.join(F.broadcast(spans.withColumnRenamed("key", "entry")), (F.col("key") == F.col("entry")) & holds, "left")
    else:
        salted = spans.withColumnRenamed("key", "entry").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        mine = tried.withColumn("mine", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
        hits = mine.join(salted, (F.col("key") == F.col("entry")) & (F.col("mine") == F.col("salt")) & holds, "left")
    rank = F.when(F.col("entry").isNotNull(), F.struct(F.length("entry").alias("size"), (F.col("verdict") == "block").alias("block"), "entry"))
    found = hits.groupBy("row").agg(F.first("page_id").alias("page_id"), F.first("host").alias("host"), F.first("fetched_on").alias("fetched_on"), F.count("entry").alias("n_active"), F.max(rank).alias("top"))
    return found.select("page_id", "host", "fetched_on", "n_active", F.col("top.entry").alias("decided_by"), F.coalesce("top.block", F.lit(False)).alias("blocked"))
