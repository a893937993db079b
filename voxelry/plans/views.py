"""Volumes derived from the driver's tables, once for Spark and once as SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Y, X = 25, 64


class Views:
    """Lazy DataFrames over the tables in ``sf_dir``. The volume is as large as ``dims`` and holds the lines along x for which
    there are vectors: its last slice may end early."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def vox(self) -> DataFrame:
        """Dense intensities 0..255; dims (vectors / 25, 25, 64)."""
        v = self.table("embeddings").select("vec_id", F.posexplode("embedding").alias("x", "e"))
        return v.select(
            F.expr("CAST(vec_id div 25 AS INT)").alias("z"), (F.col("vec_id") % Y).cast("int").alias("y"), "x",
            F.floor((F.col("e").cast("double") + 1) * 127.5).cast("int").alias("value"),
        )

    @cached_property
    def prob(self) -> DataFrame:
        return self.vox.select("z", "y", F.expr("CAST(x % 16 AS INT)").alias("x"), F.expr("CAST(x div 16 AS INT)").alias("c"), (F.col("value") / 255.0).alias("value"))

    @cached_property
    def mask_ds(self) -> DataFrame:
        return self.vox.where("y >= 2 AND y < 23 AND x >= 3 AND x < 61").select("z", "y", "x")

    @cached_property
    def seg_a(self) -> DataFrame:
        return self.vox.select("z", "y", "x", F.expr("CASE WHEN value < 96 THEN 0L ELSE 1 + (z div 5) * 64 + (y div 7) * 8 + (x div 11) END").alias("label"))

    @cached_property
    def seg_b(self) -> DataFrame:
        return self.vox.select("z", "y", "x", F.expr("CASE WHEN value > 170 THEN 0L ELSE 1 + ((z + 2) div 6) * 64 + ((y + 3) div 7) * 8 + ((x + 4) div 11) END").alias("label"))

    @cached_property
    def outer_seg(self) -> DataFrame:
        return self.vox.select("z", "y", "x", F.expr("1L + (z div 5) * 64 + (y div 7) * 8 + (x div 11)").alias("label"))

    @cached_property
    def inner_seg(self) -> DataFrame:
        inside = "y % 7 BETWEEN 1 AND 5 AND x % 11 BETWEEN 1 AND 9 AND value >= 96"
        return self.vox.select("z", "y", "x", F.expr(f"CASE WHEN {inside} THEN 1L + (z div 5) * 64 + (y div 7) * 8 + (x div 11) ELSE 0L END").alias("label"))

    @cached_property
    def sparse_vox(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_linenumber").cast("int").alias("z"), F.col("l_suppkey").cast("int").alias("y"), F.col("l_partkey").cast("int").alias("x")).agg(
            F.sum("l_quantity").cast("bigint").alias("value"))

    @cached_property
    def dims(self) -> tuple[int, int, int]:
        last = self._lines[1]
        return (0 if last is None else last // Y + 1, Y, X)

    @cached_property
    def _lines(self) -> tuple[int, int | None]:
        """The number of lines and the last one's; of one column, no voxel is made."""
        return tuple(self.table("embeddings").agg(F.countDistinct("vec_id"), F.max("vec_id")).first())

    @cached_property
    def inside(self) -> Column | DataFrame | None:
        """What the volume holds of ``dims``: all, all before the last line, or the lines that there are."""
        n, last = self._lines
        if n and n <= last:
            return self.table("embeddings").select(F.expr("CAST(vec_id div 25 AS INT)").alias("z"), (F.col("vec_id") % Y).cast("int").alias("y")).distinct()
        return F.col("z") * Y + F.col("y") < n if n % Y else None


#: name -> (views it needs, SQL)
SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "vox": ((), "SELECT CAST(vec_id // 25 AS INT) AS z, CAST(vec_id % 25 AS INT) AS y, CAST(i - 1 AS INT) AS x, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS INT) AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)"),
    "prob": (("vox",), "SELECT z, y, CAST(x % 16 AS INT) AS x, CAST(x // 16 AS INT) AS c, value / 255.0::DOUBLE AS value FROM vox"),
    "mask_ds": (("vox",), "SELECT z, y, x FROM vox WHERE y >= 2 AND y < 23 AND x >= 3 AND x < 61"),
    "seg_a": (("vox",), "SELECT z, y, x, CAST(CASE WHEN value < 96 THEN 0 ELSE 1 + (z // 5) * 64 + (y // 7) * 8 + (x // 11) END AS BIGINT) AS label FROM vox"),
    "seg_b": (("vox",), "SELECT z, y, x, CAST(CASE WHEN value > 170 THEN 0 ELSE 1 + ((z + 2) // 6) * 64 + ((y + 3) // 7) * 8 + ((x + 4) // 11) END AS BIGINT) AS label FROM vox"),
    "outer_seg": (("vox",), "SELECT z, y, x, CAST(1 + (z // 5) * 64 + (y // 7) * 8 + (x // 11) AS BIGINT) AS label FROM vox"),
    "inner_seg": (("vox",), "SELECT z, y, x, CAST(CASE WHEN y % 7 BETWEEN 1 AND 5 AND x % 11 BETWEEN 1 AND 9 AND value >= 96 THEN 1 + (z // 5) * 64 + (y // 7) * 8 + (x // 11) ELSE 0 END AS BIGINT) AS label FROM vox"),
    "sparse_vox": ((), "SELECT CAST(l_linenumber AS INT) AS z, CAST(l_suppkey AS INT) AS y, CAST(l_partkey AS INT) AS x, CAST(sum(l_quantity) AS BIGINT) AS value FROM lineitem GROUP BY 1, 2, 3"),
    "dims": (("vox",), "SELECT max(z) + 1 AS dz, 25 AS dy, 64 AS dx FROM vox"),
}


def with_views(views: str, sql: str) -> str:
    """``sql`` behind the common table expressions of the views named in ``views`` and of what they need."""
    order: list[str] = []

    def need(name: str) -> None:
        for x in SQL_VIEWS[name][0]:
            need(x)
        if name not in order:
            order.append(name)

    for name in views.split():
        need(name)
    ctes = ", ".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in order)
    body = sql.strip()
    if not ctes:
        return body
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"


@dataclass
class Registry:
    """Queries by name, with SQL where SQL can say it."""

    found: dict[str, Callable[[SparkSession, str], DataFrame]]
    sql: dict[str, str]

    def add(self, name: str, views: str = "", sql: str | None = None):
        def register(query: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
            self.found[name] = lambda spark, sf_dir: query(Views(spark, sf_dir))
            if sql:
                self.sql[name] = with_views(views, sql)
            return query

        return register


registry = Registry({}, {})
