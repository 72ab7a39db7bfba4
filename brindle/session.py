"""Session settings, and shipping of this package's code to executors."""

from __future__ import annotations

import brindle
from pyspark import cloudpickle
from pyspark.sql import SparkSession


def ship_code() -> None:
    """Pickle this package's functions by value, so executors need no copy of the repository."""
    cloudpickle.register_pickle_by_value(brindle)


def local_session(cpus: int = 8, app: str = "brindle") -> SparkSession:
    """A local session for tests and benchmarks; on a cluster the caller brings its own."""
    ship_code()
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
