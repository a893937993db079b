"""Numbering the rows of a large table in order, without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import written


def global_rank(df: DataFrame, *order, name: str = "rank") -> DataFrame:
    """``df`` with a row number from 1 in the given order. Rows are range-partitioned; a row's number is its place in
    its partition after the rows of all partitions before, of which one count each is needed."""
    ranged = written(df.repartitionByRange(*order).withColumn("_p", F.spark_partition_id()), "ranges")  # read twice: the ranges must stay
    before = F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = ranged.groupBy("_p").agg(F.count("*").alias("n")).select("_p", before.alias("_before"))
    place = F.row_number().over(Window.partitionBy("_p").orderBy(*order))
    return ranged.join(F.broadcast(counts), "_p").withColumn(name, (F.col("_before") + place).cast("bigint")).drop("_p", "_before")
