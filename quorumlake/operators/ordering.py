"""Places in an order without a window that takes all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, parts


def ordered(df: DataFrame, *order) -> DataFrame:
    """Rows with their place in a total order, by a range sort and a running count over the partitions' sizes.

    A window without partitions would bring all rows to one task; here each task numbers its own range
    and adds the sizes of the ranges before, of which there are as many as partitions.
    """
    spark = df.sparkSession
    width = max(int(spark.conf.get("spark.sql.shuffle.partitions")), parts(df))
    ranged = cut(df.repartitionByRange(width, *order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part__"), F.monotonically_increasing_id().alias("at__")))
    sizes = ranged.groupBy("part__").agg(F.count("*").alias("n__"), F.min("at__").alias("first__"))
    before = sizes.withColumn("before__", F.coalesce(F.sum("n__").over(Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    placed = ranged.join(F.broadcast(before), "part__").withColumn("ord", F.col("before__") + F.col("at__") - F.col("first__") + 1)
    return placed.drop("part__", "at__", "n__", "first__", "before__")


def in_group(df: DataFrame, by: list[str], *order) -> DataFrame:
    """Rows with their place ``n``, from 1, in their group, however few and large the groups are."""
    placed = ordered(df, *by, *order)
    first = placed.groupBy(*by).agg(F.min("ord").alias("first__"))
    return placed.join(first, by).withColumn("n", F.col("ord") - F.col("first__") + 1).drop("ord", "first__")
