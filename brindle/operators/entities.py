"""Entities (id, type, name, tags, metadata, created, modified): filters, order and pages; keyed object listings; log tails."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.text import looks_like_identifier, search_tokens, tokens

ORDERS = ("name", "created", "modified")


def equal_entries(column: str, wanted: Mapping[str, str]) -> Column:
    """Whether a map column has all entries; false for NULL and for missing keys."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & F.coalesce(F.try_element_at(F.col(column), F.lit(key)) == F.lit(value), F.lit(False))
    return out


def query(
    entities: DataFrame,
    type: str | None = None,
    tags: Mapping[str, str] | None = None,
    metadata: Mapping[str, str] | None = None,
    created: tuple[Any, Any] = (None, None),
    modified: tuple[Any, Any] = (None, None),
    order: str = "name",
    descending: bool = False,
    limit: int | None = None,
    offset: int = 0,
) -> DataFrame:
    """Entities that satisfy every filter given, in order, ties by id, and a page of them.

    The bounds of created and modified are included. An unknown order is by name. NULL names and
    times sort first. A type or time filter is a bare comparison, so it reaches the scan.
    """
    found = entities
    if type:
        found = found.where(F.col("type") == type)
    for column, (low, high) in (("created", created), ("modified", modified)):
        if low is not None:
            found = found.where(F.col(column) >= low)
        if high is not None:
            found = found.where(F.col(column) <= high)
    found = found.where(equal_entries("tags", tags or {}) & equal_entries("metadata", metadata or {}))
    key = F.col(order if order in ORDERS else "name")
    found = found.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "id")
    if offset:
        found = found.offset(offset)
    return found if limit is None else found.limit(limit)


def relations(edges: DataFrame, order: str = "created", descending: bool = True, limit: int | None = None) -> DataFrame:
    """Relations in order of a column, ties by source, target and type."""
    key = F.col(order)
    found = edges.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_first(), "source", "target", "type")
    return found if limit is None else found.limit(limit)


def listing(objects: DataFrame, prefix: str = "", delimiter: str = "", start_after: str = "", most: int = 1000) -> DataFrame:
    """(key, is_prefix, n, size) of the first `most` keys, in order, that have a prefix and come after start_after.

    With a delimiter, keys that go on beyond it behind the prefix are rolled up into one common prefix.
    """
    found = objects.where(F.startswith("key", F.lit(prefix)) & (F.col("key") > start_after))
    if delimiter:
        rest = F.substr("key", F.lit(len(prefix) + 1))
        at = F.instr(rest, delimiter)
        rolled = F.concat(F.lit(prefix), F.substr(rest, F.lit(1), at))
        found = found.select(F.when(at > 0, rolled).otherwise(F.col("key")).alias("key"), (at > 0).alias("is_prefix"), "size")
    else:
        found = found.select("key", F.lit(False).alias("is_prefix"), "size")
    return found.groupBy("key", "is_prefix").agg(F.count("*").alias("n"), F.sum("size").alias("size")).orderBy("key").limit(most)


def versions(objects: DataFrame) -> DataFrame:
    """All versions of keyed objects(key, version, deleted), the latest of each key marked; a key deleted last has none."""
    latest = objects.groupBy("key").agg(F.max("version").alias("last"))
    return objects.join(latest, "key").select("key", "version", "deleted", ((F.col("version") == F.col("last")) & ~F.col("deleted")).alias("is_latest"))


def tail(log: DataFrame, n: int, after: int | None = None) -> DataFrame:
    """The last n rows of a log by seq, or the first n behind a row."""
    return log.orderBy(F.desc("seq")).limit(n) if after is None else log.where(F.col("seq") > after).orderBy("seq").limit(n)


def keyword_search(chunks: DataFrame, terms: str, any_mode: bool = False) -> DataFrame:
    """Candidate (chunk_id, hits, occurrences) of chunks(chunk_id, chunk) for a query's terms.

    The query is cut as search_tokens() does. If some terms look like identifiers, chunks must hold
    all of those and the others don't restrict; else chunks must hold all terms, or any in any_mode.
    Chunks come by terms held, then occurrences, then id. A query without a term finds nothing.
    """
    wanted = chunks.sparkSession.range(1).select(F.array_distinct(search_tokens(F.lit(terms))).alias("t")).first()["t"]
    if not wanted:
        return chunks.select("chunk_id", F.lit(0).alias("hits"), F.lit(0).alias("occurrences")).limit(0)
    names = chunks.sparkSession.range(1).select(F.filter(F.array(*map(F.lit, wanted)), looks_like_identifier).alias("t")).first()["t"]
    must = names or wanted
    held = F.concat(search_tokens(F.col("chunk")), F.filter(tokens(F.col("chunk")), lambda t: t.isin(wanted)))
    mine = F.filter(held, lambda t: t.isin(wanted))
    rows = chunks.select("chunk_id", mine.alias("mine")).where(F.size("mine") > 0)
    hits = F.array_distinct("mine")
    among = F.size(F.array_intersect("mine", F.array(*map(F.lit, must))))
    rows = rows.where(among >= 1 if any_mode and not names else among == len(must))
    return rows.select("chunk_id", F.size(hits).alias("hits"), F.size("mine").alias("occurrences")).orderBy(F.desc("hits"), F.desc("occurrences"), "chunk_id")
