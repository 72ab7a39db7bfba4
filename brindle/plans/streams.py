"""Streaming queries, run to the end over the events table; their final state is compared with SQL."""

from __future__ import annotations

from math import ceil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.catalog import shared_folder, table
from brindle.plans.base import registry as r
from brindle.streaming import watch as W


FILE_ROWS = 200_000  # events in a file of the log


def log(spark: SparkSession, sf_dir: str, batches: int = 4) -> DataFrame:
    """The events as a stream of some batches, of files that are ranges of time; their number grows with the events."""
    path = shared_folder(spark)
    events = table(spark, sf_dir, "events").withColumn("key", F.concat_ws(":", "event_type", F.col("user_id").cast("string")))
    each = max(1, ceil(events.count() / FILE_ROWS / batches))  # files of a batch
    events.repartitionByRange(batches * each, "ts").write.parquet(path)
    return W.source(spark, path, each)


r.query("stream_watch_all", "SELECT event_id, event_type || ':' || user_id AS key FROM events")(lambda spark, sf_dir: W.collected(W.watch(log(spark, sf_dir), "key")).select("event_id", "key"))
r.query("stream_watch_key", "SELECT event_id FROM events WHERE event_type = 'view' AND user_id = 7")(lambda spark, sf_dir: W.collected(W.watch(log(spark, sf_dir), "key", exact="view:7")).select("event_id"))
r.query("stream_watch_prefix", "SELECT event_id, value FROM events WHERE event_type = 'error'")(lambda spark, sf_dir: W.collected(W.watch(log(spark, sf_dir), "key", prefix="error:")).select("event_id", "value"))


@r.query("stream_watch_query", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_watch_query(spark, sf_dir):
    """The last snapshot of a query that runs again after each batch with errors."""
    found = W.watch_query(log(spark, sf_dir), lambda df: df.groupBy("event_type").agg(F.count("*").alias("n")), lambda df: df.where("event_type = 'error'"))
    last = found.agg(F.max("sequence")).first()[0]
    return found.where(F.col("sequence") == last).drop("sequence")


@r.query("stream_latest_by_key", "SELECT user_id, max(ts) AS ts, arg_max(event_id, (ts, event_id)) AS event_id FROM events GROUP BY user_id")
def stream_latest_by_key(spark, sf_dir):
    return W.collected(W.latest_by_key(log(spark, sf_dir).select("user_id", "ts", "event_id"), "user_id", "ts"), "complete")


@r.query("stream_rate_limited", "SELECT CAST(user_id AS VARCHAR) AS key, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) WHERE n <= 3")
def stream_rate_limited(spark, sf_dir):
    return W.collected(W.limited(log(spark, sf_dir, batches=1), "user_id", 3)).select("key", "event_id")


@r.query("stream_event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_event_windows(spark, sf_dir):
    stream = log(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp"))
    found = W.collected(W.windowed_counts(stream, "ts", "1 day", "1 hour", "event_type"), "complete")
    return found.withColumn("start", F.col("start").cast("timestamp_ntz"))


@r.query("stream_notifications", "SELECT event_id FROM events WHERE event_type = 'signup' AND user_id < 10 OR event_type = 'error' AND starts_with(CAST(user_id AS VARCHAR), '1')")
def stream_notifications(spark, sf_dir):
    rules = spark.createDataFrame([("error", "error:1")] + [("signup", f"signup:{i}|") for i in range(10)], "event string, prefix string")
    path = shared_folder(spark)
    stream = log(spark, sf_dir).withColumn("key", F.when(F.col("event_type") == "signup", F.concat("key", F.lit("|"))).otherwise(F.col("key")))
    W.notify(stream, rules, lambda batch, n: batch.select("event_id").write.mode("overwrite").parquet(f"{path}/batch={n}"))
    return spark.read.parquet(path).select("event_id")
