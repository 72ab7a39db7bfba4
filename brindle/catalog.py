"""Tables of a data folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the folder, read lazily."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, *names: str) -> None:
    """Register tables as temporary views for SQL."""
    for name in names:
        table(spark, sf_dir, name).createOrReplaceTempView(name)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that the cluster shares for checkpoints (spark.checkpoint.dir).

    Only where that is unset and the master is local, as in tests, a folder of the session's own is set.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.brindle.checkpoint.dir", None)
        if not root:
            root = f"/tmp/checkpoints/brindle-{uuid.uuid4().hex}"
            spark.conf.set("spark.brindle.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and outlives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)
