"""Connected components: labelled inside blocks by a kernel, joined over block borders through a graph of labels.

The voxel set never gathers in one task; the graph has an edge for each pair of pieces that touch across a
border, not for each pair of voxels. A component is named 1 + its smallest linear index."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.graph import written
from voxelry.functions.ranking import global_rank

from .labels import AXES, Held, forward_map, held, label_union, shifted

BLOCK = (32, 128, 128)
_BITS = 21


def half_neighbours(connectivity: int) -> list[tuple[int, int, int]]:
    """One of each pair of opposite offsets: 4 and 8 in the plane, 6, 18 and 26 in space."""
    flat, most = connectivity in (4, 8), {4: 1, 8: 2, 6: 1, 18: 2, 26: 3}[connectivity]
    out = []
    for dz in (0,) if flat else (-1, 0, 1):
        for dy in (-1, 0, 1):
            for dx in (-1, 0, 1):
                if 0 < abs(dz) + abs(dy) + abs(dx) <= most and (dz, dy, dx) > (0, 0, 0):
                    out.append((dz, dy, dx))
    return out


def local_components(z: np.ndarray, y: np.ndarray, x: np.ndarray, within: np.ndarray, offsets: list[tuple[int, int, int]]) -> np.ndarray:
    """For each voxel, the position of its component's first voxel; voxels are sorted by (z, y, x)."""
    pack = lambda a, b, c: ((a.astype(np.int64) + 1) << 2 * _BITS) | ((b.astype(np.int64) + 1) << _BITS) | (c.astype(np.int64) + 1)
    key = pack(z, y, x)
    ends = []
    for dz, dy, dx in offsets:
        near = pack(z + dz, y + dy, x + dx)
        at = np.minimum(np.searchsorted(key, near), len(key) - 1)
        ok = (key[at] == near) & (within[at] == within)
        ends.append(np.stack([np.flatnonzero(ok), at[ok]]))
    a, b = np.concatenate(ends, axis=1)
    label = np.arange(len(key))
    while True:
        low = np.minimum(label[a], label[b])
        if (low == label[a]).all() and (low == label[b]).all():
            return label
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():
            label = label[label]


def components(vol: DataFrame, connectivity: int, dims: tuple[int, int, int] | None = None, within: str | None = None, block: tuple[int, int, int] = BLOCK) -> DataFrame:
    """(z, y, x, label[, within]) of the foreground voxels in ``vol``; neighbours must share ``within``, if given.

    Coordinates are from 0 to 2^21 - 2. Without ``dims`` linear indices pack 21 bits an axis."""
    offsets = half_neighbours(connectivity)
    if connectivity in (4, 8):
        block = (1, *block[1:])
    dy, dx = (dims[1], dims[2]) if dims else (1 << _BITS, 1 << _BITS)
    v = vol.select(*AXES, (F.col(within) if within else F.lit(0)).cast("bigint").alias("w"), *[F.expr(f"CAST({a} div {n} AS INT)").alias(f"i{a}") for a, n in zip(AXES, block)])

    def label(p: pd.DataFrame) -> pd.DataFrame:
        p = p.drop_duplicates(AXES).sort_values(AXES, ignore_index=True)
        z, y, x = (p[a].to_numpy() for a in AXES)
        first = local_components(z, y, x, p.w.to_numpy(), offsets)
        index = (z.astype(np.int64) * dy + y) * dx + x + 1
        return p.assign(label=index[first])

    pieces = written(v.groupBy("iz", "iy", "ix").applyInPandas(label, "z int, y int, x int, w bigint, iz int, iy int, ix int, label bigint"), "pieces")
    edge = " OR ".join(f"{a} % {n} IN (0, {n - 1})" for a, n in zip(AXES, block) if n > 1 or connectivity not in (4, 8))
    rim = pieces.where(edge)
    moved = shifted(rim.select(*AXES, "w", F.struct("iz", "iy", "ix").alias("_b"), F.col("label").alias("a")), offsets)
    crossing = moved.join(rim.select(*AXES, "w", F.struct("iz", "iy", "ix").alias("_c"), F.col("label").alias("b")), [*AXES, "w"]).where("_b <> _c").select("a", "b").distinct()
    out = forward_map(pieces.select(*AXES, "label", "w"), label_union(crossing))
    return out.select(*AXES, "label", F.col("w").alias(within)) if within else out.select(*AXES, "label")


def remove_small_components(mask: DataFrame, size: int, connectivity: int = 26, dims=None) -> tuple[DataFrame, DataFrame]:
    """Kept and removed voxels of a mask by the size of their component."""
    c = written(components(mask, connectivity, dims), "components")
    big = c.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= size).select("label")
    return c.join(big, "label", "left_semi").select(*AXES), c.join(big, "label", "left_anti").select(*AXES)


def complement(mask: DataFrame, dims: tuple[int, int, int], inside: Held = None) -> DataFrame:
    """Voxels of the volume (or of a second mask) that aren't in ``mask``."""
    if not isinstance(inside, DataFrame) or not set(AXES) <= set(inside.columns):
        spark = mask.sparkSession
        grid = spark.range(dims[0] * dims[1] * dims[2]).select(
            F.expr(f"CAST(id div {dims[1] * dims[2]} AS INT)").alias("z"), F.expr(f"CAST(id div {dims[2]} % {dims[1]} AS INT)").alias("y"), F.expr(f"CAST(id % {dims[2]} AS INT)").alias("x")
        )
        inside = held(grid, inside)
    return inside.select(*AXES).join(mask.select(*AXES), AXES, "left_anti")


def components_2d(mask: DataFrame, dims: tuple[int, int, int], inside: Held = None, axis: str = "z") -> DataFrame:
    """8-connected components of the complement of a mask, slice by slice along any axis; unique over slices."""
    free = complement(mask, dims, inside)
    names = {"z": AXES, "y": ["y", "z", "x"], "x": ["x", "z", "y"]}[axis]
    turned = free.select(*[F.col(n).alias(a) for n, a in zip(names, AXES)])
    size = tuple(dict(zip(AXES, dims))[n] for n in names)
    out = components(turned, 8, size)
    return out.select(*[F.col(AXES[names.index(a)]).alias(a) for a in AXES], "label")


def components_3d(mask: DataFrame, dims: tuple[int, int, int], min_size: int = 0, drop_largest: bool = True, relabel: bool = True, inside: Held = None) -> DataFrame:
    """26-connected components of the complement of a mask, without small ones and the largest, renumbered."""
    from .regions import filter_small_labels, relabel_sequential, remove_largest

    c = written(components(complement(mask, dims, inside), 26, dims), "components")
    c = filter_small_labels(c, min_size) if min_size else c
    c = remove_largest(c) if drop_largest else c
    c = c.where("label <> 0")
    return relabel_sequential(c) if relabel else c


def components_2d_to_3d(vol: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """26-connected components of label <> 0."""
    return components(vol.where("label <> 0"), 26, dims)


def split_disconnected(vol: DataFrame, dims: tuple[int, int, int], least: int = 10, labels: DataFrame | None = None, connectivity: int = 26) -> DataFrame:
    """(z, y, x, label): of each label's pieces the largest keeps it (ties: the first), others of more than
    ``least`` voxels get new labels above the largest one, in order of label and size, and the rest become 0.
    ``labels`` restricts it to listed ones."""
    v = vol.where("label <> 0")
    if labels is not None:
        v = v.join(labels.select("label").distinct(), "label", "left_semi")
    p = written(components(v.withColumnRenamed("label", "own"), connectivity, dims, "own"), "split")
    size = p.groupBy("own", F.col("label").alias("piece")).agg(F.count("*").alias("n"))
    size = size.withColumn("r", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("n"), "piece")))
    top = vol.agg(F.max("label").alias("top"))  # one row
    fresh = size.where((F.col("r") > 1) & (F.col("n") > least)).crossJoin(F.broadcast(top))
    fresh = global_rank(fresh.select("own", "piece", "r", "top"), "own", "r").select("own", "piece", (F.col("top") + F.col("rank")).alias("new"))
    names = size.join(fresh, ["own", "piece"], "left").select("own", F.col("piece").alias("label"), F.when(F.col("r") == 1, F.col("own")).otherwise(F.coalesce("new", F.lit(0))).cast("bigint").alias("new"))
    out = p.join(names, ["own", "label"]).select(*AXES, F.col("new").alias("label"))
    if labels is None:
        return out
    return out.unionByName(vol.where("label <> 0").join(labels.select("label").distinct(), "label", "left_anti").select(*AXES, "label"))


def disconnected(vol: DataFrame, dims: tuple[int, int, int]) -> DataFrame:
    """(label, pieces) of labels in more than one piece: the report without the change."""
    p = components(vol.where("label <> 0").withColumnRenamed("label", "own"), 26, dims, "own")
    return p.groupBy(F.col("own").alias("label")).agg(F.countDistinct("label").alias("pieces")).where("pieces > 1")


def filter_segments(vol: DataFrame, dims: tuple[int, int, int], min_size: int = 0, only_largest: bool = False) -> DataFrame:
    """Foreground without pieces below a size, or with each label's largest piece alone."""
    p = written(components(vol.where("label <> 0").withColumnRenamed("label", "own"), 26, dims, "own"), "segments")
    size = p.groupBy("own", "label").agg(F.count("*").alias("n")).withColumn("r", F.row_number().over(Window.partitionBy("own").orderBy(F.desc("n"), "label")))
    good = size.where((F.col("r") == 1) if only_largest else (F.col("n") >= min_size)).select("own", "label")
    return p.join(good, ["own", "label"], "left_semi").select(*AXES, F.col("own").alias("label"))
