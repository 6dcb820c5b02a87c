"""Numbering of rows in groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Values of the ordering number to a range.
WIDTH = 8192


def numbered(rows: DataFrame, group: Column, by: str, name: str) -> DataFrame:
    """rows with their place from 1 in their group, in the order of an integer column.

    A group is numbered range by range, so a hot one is dealt to many tasks; only
    the ranges' counts, one row for each WIDTH values, are summed up in one.  Equal
    numbers take neighbouring places in any order.
    """
    marked = rows.withColumns({"_group": group, "_range": F.floor(F.col(by) / WIDTH)})
    counts = marked.groupBy("_group", "_range").agg(F.count("*").alias("_n"))
    ahead = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select(F.col("_group").alias("_g"), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"))
    placed = marked.join(before, F.col("_group").eqNullSafe(F.col("_g")) & F.col("_range").eqNullSafe(F.col("_r")))
    inside = F.row_number().over(Window.partitionBy("_group", "_range").orderBy(by))
    return placed.withColumn(name, F.col("_before") + inside).drop("_group", "_range", "_g", "_r", "_before")
