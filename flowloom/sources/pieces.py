"""Files as pieces between separators, with the places of the pieces, while Spark splits the files into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: at is the number of a task and of a row in it.
ROW_BITS = 33


def pieces(spark: SparkSession, path: str, separator: str | None = None, only: DataFrame | None = None) -> DataFrame:
    """(file, block, at, value): the lines of files, or what stands between separators; at orders the pieces of a block.

    Without a separator lines end as any system ends them. only: the files to take, a row each.
    """
    reader = spark.read if separator is None else spark.read.option("lineSep", separator)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")
    return rows if only is None else rows.join(F.broadcast(only), "file", "left_semi")


def quotes(c: Column | str) -> Column:
    """How many quotes a text has."""
    return F.length(c) - F.length(F.replace(c, F.lit('"'), F.lit("")))


def within(at: Column, n: Column, task_bits: int, row_bits: int, n_bits: int) -> Column:
    """One number that orders by task, row and n; a task, row or n beyond its bits is an error, so no two are the same."""
    task, row = F.shiftright(at, ROW_BITS), at.bitwiseAND(F.lit((1 << ROW_BITS) - 1))
    number = F.shiftleft(task, row_bits + n_bits) + F.shiftleft(row, n_bits) + n
    fits = (task < 1 << task_bits) & (row < 1 << row_bits) & (n < 1 << n_bits)
    return F.when(fits, number).otherwise(F.raise_error(F.lit("too many records in a block of a file")).cast("long"))


def counted_before(rows: DataFrame, amount) -> DataFrame:
    """(file, block, before): the sum of `amount` over the blocks of a file before this one. There are as many rows as blocks."""
    sums = rows.groupBy("file", "block").agg(F.sum(amount).alias("own"))
    order = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("file", "block", F.coalesce(F.sum("own").over(order), F.lit(0)).alias("before"))


def numbered(rows: DataFrame) -> DataFrame:
    """rows with n: their number in the file, from 1."""
    own = F.row_number().over(Window.partitionBy("file", "block").orderBy("at"))
    return rows.join(F.broadcast(counted_before(rows, F.lit(1))), ["file", "block"]).withColumn("n", (F.col("before") + own).cast("long")).drop("before")


def records(lines: DataFrame) -> DataFrame:
    """(file, block, at, value): lines put together where a quoted field goes on over a line's end; quotes of a file are even in number.

    A line begins a record if the quotes before it in its file are even in number. The rest of a record goes to the last
    line that began one, in whatever block that is.
    """
    rows = lines.withColumn("q", quotes("value"))
    before_block = F.broadcast(counted_before(rows, F.col("q")))
    inside = Window.partitionBy("file", "block").orderBy("at")
    rows = rows.join(before_block, ["file", "block"]).withColumn("seen", F.col("before") + F.sum("q").over(inside) - F.col("q"))
    start = F.when(F.col("seen") % 2 == 0, F.struct("block", "at"))
    rows = rows.withColumn("own", F.last(start, ignorenulls=True).over(inside))
    last = rows.groupBy("file", "block").agg(F.max("own").alias("last"))  # a row for each block
    carried = last.select("file", "block", F.last("last", ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    whole = rows.join(F.broadcast(carried), ["file", "block"]).withColumn("r", F.coalesce("own", "carried"))
    made = whole.groupBy("file", "r").agg(F.array_sort(F.collect_list(F.struct("block", "at", "value"))).alias("l"))
    return made.select("file", F.col("r.block").alias("block"), F.col("r.at").alias("at"), F.array_join(F.transform("l", lambda x: x["value"]), "\n").alias("value"))
