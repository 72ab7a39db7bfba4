"""The log of events as files that grow in number with it."""

from pyspark.sql import functions as F

from brindle.catalog import table
from brindle.plans import registry, streams

SF = "/root/testdata/sf0.01"


def test_no_file_holds_all_events(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 1000, raising=False)
    made, folder = [], streams.shared_folder

    def kept(session):
        made.append(folder(session))
        return made[-1]

    monkeypatch.setattr(streams, "shared_folder", kept)
    found = {(r["key"], r["event_id"]) for r in registry.queries["stream_rate_limited"](spark, SF).collect()}
    sizes = [r["n"] for r in spark.read.parquet(made[0]).groupBy(F.input_file_name()).agg(F.count("*").alias("n")).collect()]
    rows = sorted(table(spark, SF, "events").select("ts", "event_id", "user_id").collect())
    want, of = set(), {}
    for r in rows:
        of[r["user_id"]] = of.get(r["user_id"], 0) + 1
        if of[r["user_id"]] <= 3:
            want.add((str(r["user_id"]), r["event_id"]))
    assert found == want
    assert sum(sizes) == len(rows) and max(sizes) < 2000
    assert registry.queries["stream_watch_all"](spark, SF).count() == len(rows)
