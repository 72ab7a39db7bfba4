"""Merging and splitting of entities: proposals, their review, and the aliases that follow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, APPROVED, REJECTED = "pending", "approved", "rejected"


def cleaned(ids: Column, target: Column) -> Column:
    """Trimmed distinct ids in order, without empty ones and the target."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(ids, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != "") & (x != target))))


def propose(requests: DataFrame) -> DataFrame:
    """requests(target, sources, reason) to pending (proposal_id, target, sources, reason, status).

    A request without a target or any other source is refused. Equal requests are one proposal: its
    id is a hash of the sources in order, the target and the reason.
    """
    target, reason = F.trim("target"), F.trim(F.coalesce("reason", F.lit("")))
    clean = requests.select(target.alias("target"), cleaned(F.col("sources"), target).alias("sources"), reason.alias("reason"))
    clean = clean.where((F.col("target") != "") & (F.size("sources") > 0))
    parts = F.concat("sources", F.array("target", "reason"))
    named = F.concat(F.lit("merge-"), F.substring(F.sha2(F.array_join(parts, "\0"), 256), 1, 24))
    return clean.select(named.alias("proposal_id"), "target", "sources", "reason", F.lit(PENDING).alias("status")).dropDuplicates(["proposal_id"])


def review(proposals: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Proposals with the first verdict on each pending one, of verdicts(proposal_id, place, status)."""
    known = verdicts.where(F.col("status").isin(APPROVED, REJECTED))
    first = known.groupBy("proposal_id").agg(F.min(F.struct("place", "status"))["status"].alias("verdict"))
    status = F.when(F.col("status") == PENDING, F.coalesce("verdict", "status")).otherwise(F.col("status"))
    return proposals.join(first, "proposal_id", "left").withColumn("status", status).drop("verdict")


def merge(aliases: DataFrame, merges: DataFrame) -> DataFrame:
    """aliases(alias, canonical) after merges(target, sources): a source's alias is replaced; of several targets the least one stays."""
    new = merges.select(F.explode("sources").alias("alias"), F.col("target").alias("canonical")).groupBy("alias").agg(F.min("canonical").alias("canonical"))
    return aliases.select("alias", "canonical").join(new, "alias", "left_anti").union(new)


def split(aliases: DataFrame, names: DataFrame) -> DataFrame:
    """Aliases after names(alias) became entities of their own again."""
    return aliases.join(names.select("alias").distinct(), "alias", "left_anti")
