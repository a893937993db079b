"""Blocks and halos. A block grid is a table (block_no, core and halo bounds); voxels join their blocks by
arithmetic on coordinates, never by a range join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
Triple = tuple[int, int, int]


def block_grid(spark: SparkSession, dims: Triple, size: Triple, margin: Triple = (0, 0, 0), first: int | None = None, last: int | None = None) -> DataFrame:
    """block_no, iz, iy, ix, z0..x1 (with margins, clipped to the volume), cz0..cx1 (cores); numbered z-major.
    ``first``/``last`` keep a range of block numbers."""
    n = [-(-d // s) for d, s in zip(dims, size)]
    g = spark.range(n[0] * n[1] * n[2]).select(F.col("id").cast("int").alias("block_no"))
    g = g.withColumns({"iz": F.expr(f"block_no div {n[1] * n[2]}").cast("int"), "iy": F.expr(f"block_no div {n[2]} % {n[1]}").cast("int"), "ix": (F.col("block_no") % n[2]).cast("int")})
    for a, d, s, m in zip(AXES, dims, size, margin):
        b = F.col(f"i{a}")
        g = g.withColumns({
            f"{a}0": F.greatest(b * s - m, F.lit(0)), f"{a}1": F.least((b + 1) * s + m, F.lit(d)),
            f"c{a}0": b * s, f"c{a}1": F.least((b + 1) * s, F.lit(d)),
        })
    if first is not None:
        g = g.where(F.col("block_no") >= first)
    if last is not None:
        g = g.where(F.col("block_no") < last)
    return g


def voxels_to_blocks(vol: DataFrame, size: Triple) -> DataFrame:
    """(iz, iy, ix, data): a block's voxels as a sorted array of structs."""
    keys = [F.expr(f"{a} div {s}").alias(f"i{a}") for a, s in zip(AXES, size)]
    return vol.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*AXES, "value"))).alias("data"))


def split_blocks(vol: DataFrame, dims: Triple, size: Triple, margin: Triple) -> DataFrame:
    """A row for each block whose halo holds the voxel: iz, iy, ix before the voxel's columns."""
    for a, d, s, m in zip(AXES, dims, size, margin):
        low = F.greatest(F.expr(f"CAST(floor(({a} - {m}) / {s}) AS INT)"), F.lit(0))
        high = F.least(F.expr(f"CAST(({a} + {m}) div {s} AS INT)"), F.lit(-(-d // s) - 1))
        vol = vol.withColumn(f"i{a}", F.explode(F.sequence(low, high)))
    return vol


def _in_core(size: Triple):
    return reduce(lambda a, b: a & b, [F.expr(f"{a} div {s}") == F.col(f"i{a}") for a, s in zip(AXES, size)])


def merge_blocks(blocks: DataFrame, size: Triple) -> DataFrame:
    """Drops halos: each voxel is taken from the block whose core holds it. Volume borders have no halo to drop."""
    return blocks.where(_in_core(size)).drop("iz", "iy", "ix")


def relabel_blocks(blocks: DataFrame) -> DataFrame:
    """Labels unique over all blocks: dense inside a block, after those of all earlier blocks; 0 stays 0."""
    keys = ["iz", "iy", "ix"]
    labels = blocks.where("label <> 0").select(*keys, "label").distinct()
    inside = labels.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy("label")))
    counts = inside.groupBy(*keys).agg(F.max("_r").alias("_n"))  # a row a block: small enough for one ordering
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    names = inside.join(before, keys).select(*keys, "label", (F.col("_before") + F.col("_r")).cast("bigint").alias("_new"))
    return blocks.join(names, [*keys, "label"], "left").withColumn("label", F.coalesce("_new", F.lit(0).cast("bigint"))).drop("_new")


def _majority(pairs: DataFrame, share: float) -> DataFrame:
    """(label, new_label): of (label, other) voxel pairs, the other label with the most voxels, ties to the
    smallest, if its share of the label's voxels there is ``share`` or more."""
    counts = pairs.groupBy("label", "other").agg(F.count("*").alias("n"))
    size = F.sum("n").over(Window.partitionBy("label"))
    best = F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "other"))
    ranked = counts.withColumn("_size", size).where("other <> 0").withColumn("_best", best)
    return ranked.where((F.col("_best") == 1) & (F.col("n") >= share * F.col("_size"))).select("label", F.col("other").alias("new_label"))


def merge_block_overlap(blocks: DataFrame, size: Triple, share: float = 0.1) -> DataFrame:
    """(label, new_label) from the margins: blocks (iz, iy, ix, z, y, x, label) with halos, labels unique.

    Where a voxel lies in the core of one block and in the halo of another, the halo's label and the core's are a
    pair; a core label moves to the neighbour's majority label if that neighbour comes earlier."""
    core = blocks.where(_in_core(size) & (F.col("label") != 0)).select(*AXES, "label", F.struct("iz", "iy", "ix").alias("_b"))
    halo = blocks.where(~_in_core(size)).select(*AXES, F.col("label").alias("other"), F.struct("iz", "iy", "ix").alias("_o"))
    return _majority(core.join(halo, list(AXES)).where("_o < _b").select("label", "other"), share)


def merge_block_faces(vol: DataFrame, size: Triple, share: float = 0.1) -> DataFrame:
    """The same over one-voxel faces: a label at the low face of a block meets the earlier block's last plane."""
    faces = []
    for a, s in zip(AXES, size):
        here = vol.where((F.col("label") != 0) & (F.col(a) % s == 0) & (F.col(a) > 0)).withColumn(a, F.col(a) - 1)
        there = vol.where(F.col(a) % s == s - 1).select(*AXES, F.col("label").alias("other"))
        faces.append(here.join(there, list(AXES)).select("label", "other"))
    return _majority(reduce(DataFrame.unionByName, faces), share)


def missing_blocks(expected: DataFrame, done: DataFrame, key: str = "block_no") -> DataFrame:
    return expected.join(done.select(key).distinct(), key, "left_anti")


def seed_from_neighbour_faces(vol: DataFrame, size: Triple) -> DataFrame:
    """(iz, iy, ix, z, y, x, label): for each block, its earlier neighbours' last planes, moved to its first plane."""
    seeds = []
    for a, s in zip(AXES, size):
        moved = vol.where((F.col("label") != 0) & (F.col(a) % s == s - 1)).withColumn(a, F.col(a) + 1)
        seeds.append(moved.select(*[F.expr(f"CAST({b} div {n} AS INT)").alias(f"i{b}") for b, n in zip(AXES, size)], *AXES, "label"))
    return reduce(DataFrame.unionByName, seeds).groupBy("iz", "iy", "ix", *AXES).agg(F.max("label").alias("label"))


def downsampled_bounds(grid: DataFrame, factor: Triple) -> DataFrame:
    """Bounds on the reduced grid, rounded up."""
    return grid.withColumns({f"{a}{e}": F.ceil(F.col(f"{a}{e}") / f).cast("int") for a, f in zip(AXES, factor) for e in (0, 1)})
