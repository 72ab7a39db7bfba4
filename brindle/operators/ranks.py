"""Places of rows in an order over a whole table, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.catalog import materialize
from brindle.operators.governance import small


def placed(df: DataFrame, order: list[Column], name: str, within: tuple[str, ...] = ()) -> DataFrame:
    """df with the 1-based place of each row in an order, over all rows or over those equal in some columns.

    The rows are cut into ranges of the order, which are written so that a lost executor changes none
    of them. A range's rows are counted on their own; before them come those of the ranges before, of
    which there is a row for each range and value of `within`. Rows equal in the whole order are in
    one range, in any order. `name`, `_range` and `_before` mustn't be columns of df.
    """
    ranged = materialize(df.repartitionByRange(*within, *order).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range", *within).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_range", *within, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
    same = F.lit(True)
    for c in ("_range", *within):
        starts = starts.withColumnRenamed(c, f"_{c}")
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    place = F.row_number().over(Window.partitionBy("_range", *within).orderBy(*order))
    both = ranged.withColumn(name, place).join(small(starts), same)
    return both.select(*df.columns, (F.col(name) + F.col("_before")).alias(name))
