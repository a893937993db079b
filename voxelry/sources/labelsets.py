"""Label sets: a key and its member labels, as a table and as text lines ``key: m1 m2 ...``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_labelsets(lines: DataFrame, column: str = "value") -> DataFrame:
    """(key, members array<bigint>, ascending)."""
    parts = F.split(F.col(column), ":")
    numbers = F.filter(F.split(F.trim(F.get(parts, F.lit(1))), r"\s+"), lambda x: x != "")
    return lines.where(F.col(column).contains(":")).select(F.trim(F.get(parts, F.lit(0))).cast("bigint").alias("key"), F.array_sort(F.transform(numbers, lambda x: x.cast("bigint"))).alias("members"))


def format_labelsets(sets: DataFrame) -> DataFrame:
    """One ``line`` a set, numbers padded to eight places."""
    pad = lambda c: F.format_string("%8d", c)
    members = F.array_join(F.transform(F.array_sort("members"), lambda x: F.concat(pad(x), F.lit(" "))), "")
    return sets.select(F.concat(pad(F.col("key")), F.lit(": "), members).alias("line"))


def read_labelsets(spark: SparkSession, path: str) -> DataFrame:
    return parse_labelsets(spark.read.text(path))


def write_labelsets(sets: DataFrame, path: str, mode: str = "overwrite") -> None:
    format_labelsets(sets).write.mode(mode).text(path)


def exploded(sets: DataFrame) -> DataFrame:
    """(key, label): a row a member."""
    return sets.select("key", F.explode("members").alias("label"))


def collected(rows: DataFrame) -> DataFrame:
    """(key, members) of (key, label) rows."""
    return rows.groupBy("key").agg(F.array_sort(F.collect_set("label")).alias("members"))
