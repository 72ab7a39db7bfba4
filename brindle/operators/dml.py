"""Row changes as DataFrame to DataFrame transforms, and key/value tables.

Parquet has no row updates: each function returns the table after the change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions.predicates import glob, truth


def insert(df: DataFrame, rows: DataFrame, defaults: dict[str, Column] | None = None) -> DataFrame:
    """Append; columns that rows lack take their default, or NULL."""
    defaults = defaults or {}
    missing = {c: defaults.get(c, F.lit(None)).cast(t) for c, t in df.dtypes if c not in rows.columns}
    return df.unionByName(rows.withColumns(missing).select(df.columns))


def insert_ignore(df: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Append rows of new keys only."""
    return df.unionByName(rows.join(df.select(key), key, "left_anti").select(df.columns))


def upsert(df: DataFrame, rows: DataFrame, key: str, update: list[str] | None = None) -> DataFrame:
    """Rows of known keys replace the columns to update (all by default); others are appended. Keys are unique in rows."""
    update = [c for c in df.columns if c != key] if update is None else update
    new = rows.select(key, *[F.col(c).alias(f"new_{c}") for c in df.columns if c != key], F.lit(True).alias("is_new"))
    both = df.withColumn("is_old", F.lit(True)).join(new, key, "full")

    def pick(c: str) -> Column:
        if c == key:
            return F.col(key)
        take = F.col("is_new") & (F.col("is_old").isNull() | F.lit(c in update))
        return F.when(truth(take), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c)

    return both.select([pick(c) for c in df.columns])


def mark(df: DataFrame, key: str, where: Column, order: list[Column], limit: int) -> DataFrame:
    """Adds `chosen`: the first limit rows of where in order. The few keys are found by a top-k and joined back."""
    top = df.where(truth(where)).orderBy(*order, F.col(key)).limit(limit).select(F.col(key).alias("chosen_key"))
    return df.join(top, F.col(key) == F.col("chosen_key"), "left").withColumn("chosen", F.col("chosen_key").isNotNull()).drop("chosen_key")


def update(df: DataFrame, where: Column, sets: list[tuple[str, Column]]) -> DataFrame:
    """SET in order; each assignment sees the ones before it. The predicate sees the old row."""
    out = df.withColumn("chosen", truth(where))
    for name, value in sets:
        out = out.withColumn(name, F.when(F.col("chosen"), value).otherwise(F.col(name)))
    return out.drop("chosen")


def update_first(df: DataFrame, key: str, where: Column, order: list[Column], limit: int, sets: list[tuple[str, Column]]) -> DataFrame:
    out = mark(df, key, where, order, limit)
    for name, value in sets:
        out = out.withColumn(name, F.when(F.col("chosen"), value).otherwise(F.col(name)))
    return out.drop("chosen")


def delete(df: DataFrame, where: Column) -> DataFrame:
    return df.where(~truth(where))


def delete_first(df: DataFrame, key: str, where: Column, order: list[Column], limit: int) -> DataFrame:
    return mark(df, key, where, order, limit).where("NOT chosen").drop("chosen")


def overlay(committed: DataFrame, pending: DataFrame, key: str) -> DataFrame:
    """Committed rows under pending ones(…, deleted): pending wins, deletions hide."""
    kept = committed.join(pending.select(key), key, "left_anti")
    return kept.unionByName(pending.where(~truth(F.col("deleted"))).select(committed.columns))


def latest(log: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Last write of each key; partial maxima are combined before the shuffle."""
    rest = [c for c in log.columns if c not in (key, at, tie)]
    last = F.max(F.struct(at, tie, *rest)).alias("last")
    return log.groupBy(key).agg(last).select(key, *[F.col(f"last.{c}").alias(c) for c in log.columns if c != key])


def visible(df: DataFrame, now: Column) -> DataFrame:
    """Rows that haven't expired; without expires_at they never do."""
    return df.where(F.col("expires_at").isNull() | (F.col("expires_at") > now))


def increments(counters: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """Counters after the steps; a missing counter starts at 0."""
    total = steps.groupBy(key).agg(F.sum("step").alias("step"))
    return counters.join(total, key, "full").select(key, (F.coalesce("value", F.lit(0.0)) + F.coalesce("step", F.lit(0.0))).alias("value"))


def prefix_scan(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.where(F.startswith(F.col(key), F.lit(prefix))).orderBy(key)


def glob_keys(df: DataFrame, key: str, pattern: str) -> DataFrame:
    return df.where(glob(F.col(key), pattern)).select(key).orderBy(key)


def page(df: DataFrame, key: str, offset: int, limit: int) -> DataFrame:
    """A page of keys in order, with the total number of keys."""
    total = df.select(F.count("*").alias("total"))
    return df.select(key).orderBy(key).offset(offset).limit(limit).join(F.broadcast(total))  # one row


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
