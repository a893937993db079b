"""Skeleton annotations in XML."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = """_id bigint, _comment string,
nodes struct<node: array<struct<_id: bigint, _x: double, _y: double, _z: double, _radius: double>>>,
edges struct<edge: array<struct<_source: bigint, _target: bigint>>>"""


def write_annotations(nodes: DataFrame, edges: DataFrame, path: str, offset: tuple[int, int, int] = (0, 0, 0)) -> None:
    """Nodes (thing, node, z, y, x, radius) and edges (thing, source, target) as files that scan_annotations() reads."""
    place = lambda c, o: (F.col(c) + 1 + o).cast("double")
    node = F.struct(F.col("node").alias("_id"), place("y", offset[1]).alias("_x"), place("x", offset[2]).alias("_y"), place("z", offset[0]).alias("_z"), F.col("radius").alias("_radius"))
    n = nodes.groupBy("thing").agg(F.struct(F.array_sort(F.collect_list(node)).alias("node")).alias("nodes"))
    e = edges.groupBy("thing").agg(F.struct(F.array_sort(F.collect_list(F.struct(F.col("source").alias("_source"), F.col("target").alias("_target")))).alias("edge")).alias("edges"))
    things = n.join(e, "thing", "left").select(F.col("thing").alias("_id"), "nodes", "edges")
    things.write.mode("overwrite").format("xml").option("rowTag", "thing").option("rootTag", "things").save(path)


def scan_annotations(spark: SparkSession, path: str, offset: tuple[int, int, int] = (0, 0, 0)) -> tuple[DataFrame, DataFrame]:
    """Nodes (thing, node, z, y, x, radius) and edges (thing, source, target).

    Files count from 1 and call the dataset's y axis x and the reverse; ``offset`` (z, y, x) is the place of the
    dataset in the annotated volume. The schema is fixed: a thing with one edge parses like one with many."""
    things = spark.read.format("xml").option("rowTag", "thing").schema(_SCHEMA).load(path)
    n = things.select(F.col("_id").alias("thing"), F.explode("nodes.node").alias("n"))
    place = lambda c, o: (F.col(c) - 1 - o).cast("double")
    nodes = n.select("thing", F.col("n._id").alias("node"), place("n._z", offset[0]).alias("z"), place("n._x", offset[1]).alias("y"), place("n._y", offset[2]).alias("x"), F.col("n._radius").alias("radius"))
    e = things.select(F.col("_id").alias("thing"), F.explode("edges.edge").alias("e"))
    return nodes, e.select("thing", F.col("e._source").alias("source"), F.col("e._target").alias("target"))
