"""Change streams: watching keys, prefixes and queries, time to live, rate limits, event windows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from brindle.catalog import shared_folder


def source(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of the Parquet files of a folder."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def watch(stream: DataFrame, key: str, exact: str | None = None, prefix: str | None = None) -> DataFrame:
    """Events of one key, of keys with a prefix, or of all."""
    if exact is not None:
        stream = stream.where(F.col(key) == exact)
    return stream if prefix is None else stream.where(F.startswith(F.col(key), F.lit(prefix)))


def collected(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Everything the stream has now, run to the end and written to the shared folder."""
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def put(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={n}")

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", path + "-state").trigger(availableNow=True).start().awaitTermination()
    batches = spark.read.schema(f"{stream._jdf.schema().toDDL()}, batch int").parquet(path)
    return batches.where(F.col("batch") == batches.agg(F.max("batch")).first()[0]).drop("batch")


def watch_query(stream: DataFrame, query: Callable[[DataFrame], DataFrame], matching: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """A snapshot of a query's result after each batch with a matching event: (sequence, the query's columns).

    The events so far are a table in the shared folder, to which each batch is appended.
    """
    spark, path = stream.sparkSession, shared_folder(stream.sparkSession)

    def step(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/log/batch={n}")
        if n == 0 or matching(batch).limit(1).count():
            log = spark.read.parquet(f"{path}/log").where(F.col("batch") <= n).drop("batch")
            query(log).write.mode("overwrite").parquet(f"{path}/snapshots/sequence={n}")

    stream.writeStream.foreachBatch(step).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/snapshots")


def latest_by_key(stream: DataFrame, key: str, at: str) -> DataFrame:
    """Last write of each key as a streaming aggregate; for complete or update mode."""
    rest = [c for c in stream.columns if c not in (key, at)]
    return stream.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("last")).select(key, f"last.{at}", *[f"last.{c}" for c in rest])


def limited(stream: DataFrame, key: str, most: int) -> DataFrame:
    """At most so many events of each key, in order of (ts, event_id) within a batch; state holds a count a key."""
    schema = stream.select(F.col(key).cast("string").alias("key"), "event_id", "ts").schema

    def take(group, batches, state: GroupState):
        seen = state.get[0] if state.exists else 0
        left = max(0, most - seen)
        rows = None
        for batch in batches:  # no more than the first rows so far are kept
            rows = (batch if rows is None else pd.concat([rows, batch])).sort_values(["ts", "event_id"], kind="stable").head(left)
        state.update((seen + len(rows),))
        yield rows

    keyed = stream.select(F.col(key).cast("string").alias("key"), "event_id", "ts")
    return keyed.groupBy("key").applyInPandasWithState(take, schema, "n long", "append", GroupStateTimeout.NoTimeout)


def windowed_counts(stream: DataFrame, ts: str, width: str, late: str, by: str) -> DataFrame:
    """Counts by tumbling event-time window; an addition to plain watching."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def notify(stream: DataFrame, rules: DataFrame, send: Callable[[DataFrame, int], None]) -> None:
    """Each batch's events that match a rule(event, prefix) go to send(batch, number); exactly once where send is idempotent."""
    checkpoint = shared_folder(stream.sparkSession) + "-" + uuid.uuid4().hex

    def step(batch: DataFrame, n: int) -> None:
        on = (F.col("event_type") == F.col("event")) & F.startswith(F.col("key"), F.col("prefix"))
        send(batch.join(F.broadcast(rules) if rules.limit(10_001).count() <= 10_000 else rules, on, "left_semi"), n)

    stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
