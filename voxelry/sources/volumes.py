"""Volumes as Parquet tables, their metadata, and other forms of storage."""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def metadata(spark: SparkSession, name: str, elsize: tuple[float, ...] | None = None, axlab: str | None = None, ndim: int = 3, aux: DataFrame | None = None) -> DataFrame:
    """name, elsize array<double>, axlab: what is given, else what an auxiliary volume has, else ones and zyxct."""
    given = spark.createDataFrame([(name, [float(x) for x in elsize] if elsize else None, axlab)], "name string, elsize array<double>, axlab string")
    if aux is not None:
        given = given.crossJoin(F.broadcast(aux.select(F.col("elsize").alias("_e"), F.col("axlab").alias("_a")).limit(1)))
        given = given.select("name", F.coalesce("elsize", "_e").alias("elsize"), F.coalesce("axlab", "_a").alias("axlab"))
    return given.select("name", F.coalesce("elsize", F.array_repeat(F.lit(1.0), ndim)).alias("elsize"), F.coalesce("axlab", F.lit("zyxct"[:ndim])).alias("axlab"))


def read_volume(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Voxels and the one-row metadata table, lazily."""
    return spark.read.parquet(f"{path}/voxels"), spark.read.parquet(f"{path}/meta")


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def output_guard(spark: SparkSession, path: str, protective: bool = False) -> str:
    """'CANCELLED' if ``protective`` and the output is there, else the write mode to use."""
    if protective and exists(spark, path):
        return "CANCELLED"
    return "overwrite"


#: Columns of a stored voxel's block, by which files are laid out.
BLOCKS = ("bz", "by", "bx")


def write_volume(vol: DataFrame, meta: DataFrame, path: str, block: tuple[int, int, int] = (64, 256, 256), protective: bool = False) -> str:
    """Writes a volume, or replaces the blocks that ``vol`` has in one that is there (a slab). Partitioned by
    block, which ``meta`` records, and sorted inside, so a crop opens the files and row groups it needs. Metadata
    come first: a volume without them isn't there, and those of a volume that is there stay. A slab must come in its
    blocks."""
    spark = vol.sparkSession
    mode = output_guard(spark, path, protective)
    if mode == "CANCELLED":
        return mode
    if exists(spark, f"{path}/meta"):
        there = tuple(spark.read.parquet(f"{path}/meta").first().block)
        if there != tuple(block):
            raise ValueError(f"the volume is in blocks of {there}, not {tuple(block)}")
    else:
        meta.withColumn("block", F.array(*map(F.lit, block))).write.parquet(f"{path}/meta")
    rows = vol.withColumns({b: F.expr(f"CAST({a} div {n} AS INT)") for a, b, n in zip(AXES, BLOCKS, block)})
    rows = rows.repartition(*BLOCKS).sortWithinPartitions(*BLOCKS, *AXES)
    rows.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*BLOCKS).parquet(f"{path}/voxels")
    return "WRITTEN"


def save_step(df: DataFrame, path: str, step: str, protective: bool = False) -> DataFrame:
    """A named intermediate beside the main output, read back so that lineage ends here."""
    where = f"{path}_steps/{step}"
    mode = output_guard(df.sparkSession, where, protective)
    if mode != "CANCELLED":
        df.write.mode(mode).parquet(where)
    return df.sparkSession.read.parquet(where)


def tensor_to_voxels(tensors: DataFrame, shape: dict[str, int]) -> DataFrame:
    """An array column ``data`` in C order -> a row an element with its indices."""
    out = tensors.select(*[c for c in tensors.columns if c != "data"], F.posexplode("data").alias("_i", "value"))
    inner = 1
    for axis, n in reversed(shape.items()):
        out = out.withColumn(axis, F.expr(f"CAST(_i div {inner} % {n} AS INT)"))
        inner *= n
    return out.drop("_i")


def _npy_slices(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        for z, content in zip(b.z, b.content):
            plane = np.load(io.BytesIO(content), allow_pickle=False)
            y, x = np.indices(plane.shape)
            yield pd.DataFrame({"z": z, "y": y.ravel(), "x": x.ravel(), "value": plane.ravel().astype(float)})


def write_slice_series(vol: DataFrame, folder: str) -> DataFrame:
    """Writes each slice of a dense volume as a 2D .npy file named by its z, where it is gathered; (z, name) of the
    files. The folder can be in any store that its scheme names."""

    def save(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        from pyarrow import fs

        plane = np.zeros((p.y.max() + 1, p.x.max() + 1), p.value.to_numpy().dtype)
        plane[p.y, p.x] = p.value
        held = io.BytesIO()
        np.save(held, plane)
        store, where = fs.FileSystem.from_uri(folder)
        store.create_dir(where, recursive=True)
        name = f"slice_{key[0]:08d}.npy"
        with store.open_output_stream(f"{where}/{name}") as f:
            f.write(held.getvalue())
        return pd.DataFrame({"z": [key[0]], "name": [name]})

    return vol.select(*AXES, "value").groupBy("z").applyInPandas(save, "z int, name string")


def scan_slice_series(spark: SparkSession, folder: str) -> DataFrame:
    """A folder of 2D .npy slices as a stack; z is the rank of the file name. Only names are ranked in one place;
    contents are decoded where they are read."""
    from pyspark.sql import Window

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(folder)
    ranks = files.select("path", (F.row_number().over(Window.orderBy("path")) - 1).alias("z"))
    return files.select("path", "content").join(F.broadcast(ranks), "path").select("z", "content").mapInPandas(_npy_slices, "z int, y int, x int, value double")


def stats_matrix(stats: DataFrame, value: str, labels: list[int]) -> DataFrame:
    """A row a slice, a column a label; missing is null."""
    return stats.groupBy("z").pivot("label", labels).agg(F.first(value))


def pyramid(vol: DataFrame, levels: int) -> DataFrame:
    """(level, z, y, x, value): level k keeps every 2^k-th voxel of each axis, on its own grid. One scan."""
    strides = F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level")
    every = vol.select("*", strides).withColumn("_s", F.expr("shiftleft(1, level)"))
    on_grid = reduce(lambda a, b: a & b, [F.col(a) % F.col("_s") == 0 for a in AXES])
    return every.where(on_grid).withColumns({a: F.expr(f"CAST({a} div _s AS INT)") for a in AXES}).drop("_s")


def histogram_bin(value, low: float, high: float, bins: int):
    """Fixed-width bin from 0; the upper edge belongs to the last bin, null outside the range."""
    at = F.floor((value - low) * bins / (high - low)).cast("int")
    return F.when((value >= low) & (value <= high), F.least(at, F.lit(bins - 1)))


def pyramid_histogram(levels: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    return levels.groupBy("level", histogram_bin(F.col("value"), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))
