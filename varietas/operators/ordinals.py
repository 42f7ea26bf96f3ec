"""Row numbers without a window over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .settled import settled


def numbered(df: DataFrame, *by: str, out: str = "place") -> DataFrame:
    """``df``, computed once, with each row's place, from 1, in the order of ``by``, which tells rows apart.

    Rows are dealt by ranges of ``by`` and numbered there; what comes before a range is one row a range.
    """
    ranges = settled(df.repartitionByRange(*by).withColumn("part_", F.spark_partition_id()))
    before = F.coalesce(F.sum("rows_").over(Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranges.groupBy("part_").agg(F.count("*").alias("rows_")).withColumn("before_", before).drop("rows_")
    own = F.row_number().over(Window.partitionBy("part_").orderBy(*by))
    return ranges.withColumn(out, own).join(starts, "part_").withColumn(out, F.col(out) + F.col("before_")).drop("part_", "before_")


def in_file_order(df: DataFrame, out: str = "ord") -> DataFrame:
    """``df``, read from text files and computed once, with each row's number, from 0, in its file, files by path.

    Blocks of a file are read by different tasks, in any order; a row's place in its block is the distance of the
    task's row numbers, and the blocks before it, one row each, say how many rows precede.
    """
    block = ("file_", "start_")
    rows = settled(df.select("*", F.col("_metadata.file_path").alias("file_"), F.col("_metadata.file_block_start").alias("start_"), F.monotonically_increasing_id().alias("id_")))
    blocks = rows.groupBy(*block).agg(F.min("id_").alias("first_"), F.count("*").alias("rows_"))
    before = F.coalesce(F.sum("rows_").over(Window.orderBy(*block).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select(*block, "first_", before.alias("before_"))
    return rows.join(starts, list(block)).withColumn(out, F.col("id_") - F.col("first_") + F.col("before_")).select(*df.columns, out)
