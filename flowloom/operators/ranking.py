"""Ranks and running sums over a whole table without a window over all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.sources.scratch import written


def ranked(df: DataFrame, order: Column, amount: str) -> DataFrame:
    """df with rank (from 1), upto (running sum of `amount`) and of (its total), in a strict order of all rows.

    Spark deals the rows out by ranges of the order, as many as the session has shuffle partitions. Each range is ranked by
    itself, after what the ranges before it hold: there is one sum for each range, and only these meet in one task.
    """
    rows = written(df, "to_rank")  # the input is read once, for the sample of the ranges and for the exchange
    ranges = written(rows.repartitionByRange(order).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = ranges.groupBy("_range").agg(F.count("*").alias("c"), F.sum(amount).alias("s"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    placed = sums.select("_range", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("_count"), F.coalesce(F.sum("s").over(before), F.lit(0)).alias("_sum"), F.sum("s").over(Window.partitionBy()).alias("of"))
    own = Window.partitionBy("_range").orderBy(order)
    return ranges.join(F.broadcast(placed), "_range").select(
        *df.columns, (F.col("_count") + F.row_number().over(own)).cast("long").alias("rank"),
        (F.col("_sum") + F.sum(amount).over(own.rowsBetween(Window.unboundedPreceding, 0))).alias("upto"), "of",
    )
