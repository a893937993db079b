"""Projections, filters and predicates on volumes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
Triple = tuple[int, int, int]


def crop(vol: DataFrame, block: Triple | None = None, **ranges: tuple[int, int, int]) -> DataFrame:
    """start, stop, step per axis; stop 0 means the full extent. Coordinates stay. Of a stored volume with its
    ``block`` size, only the blocks that the ranges meet are opened."""
    for axis, (start, stop, step) in ranges.items():
        c = F.col(axis)
        if block is not None:
            n = block[AXES.index(axis)]
            vol = vol.where(F.col(f"b{axis}") >= start // n)
            if stop:
                vol = vol.where(F.col(f"b{axis}") <= (stop - 1) // n)
        vol = vol.where(c >= start)
        if stop:
            vol = vol.where(c < stop)
        if step > 1:
            vol = vol.where((c - start) % step == 0)
    return vol


def take_slice(vol: DataFrame, axis: str, at: int) -> DataFrame:
    """One plane; the axis is dropped."""
    return vol.where(F.col(axis) == at).drop(axis)


def permute_axes(vol: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Axis i of the result is axis ``order[i]`` of the input."""
    names = dict(zip(order, AXES))
    return vol.withColumnsRenamed({k: f"_{v}" for k, v in names.items()}).withColumnsRenamed({f"_{v}": v for v in names.values()})


def squeeze_axis(vol: DataFrame, axis: str, at: int = 0) -> DataFrame:
    """Drops an axis that the result's layout lacks, keeping one position of it."""
    return vol.where(F.col(axis) == at).drop(axis)


def flip_axis(vol: DataFrame, axis: str, size: int) -> DataFrame:
    return vol.withColumn(axis, (F.lit(size) - 1 - F.col(axis)).cast("int"))


def cast_volume(vol: DataFrame, low: int, high: int, to: str, scale: tuple[float, float] | None = None) -> DataFrame:
    """Values clipped to [low, high] and rounded; with ``scale`` (from, to) stretched over that range first."""
    v = F.col("value").cast("double")
    if scale:
        v = (v - scale[0]) / (scale[1] - scale[0]) * (high - low) + low
    return vol.withColumn("value", F.round(F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high)))).cast(to))


def normalize_minmax(vol: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """(v - min) / (max - min), with the volume's own range unless one is given; 0 in a constant volume."""
    if low is not None and high is not None:
        return vol.withColumn("value", (F.col("value") - low) / (high - low))
    span = vol.agg(F.min("value").cast("double").alias("_low"), F.max("value").cast("double").alias("_high"))  # one row
    v = F.when(F.col("_high") > F.col("_low"), (F.col("value") - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    return vol.crossJoin(F.broadcast(span)).withColumn("value", v).drop("_low", "_high")


def normalize_to_reference_mean(vols: DataFrame, key: str, reference: int) -> DataFrame:
    """Scales each dataset (``key``) by mean of the reference over its own mean."""
    means = vols.groupBy(key).agg(F.avg("value").alias("_mean"))
    ref = means.where(F.col(key) == reference).select(F.col("_mean").alias("_ref"))  # one row
    factor = means.crossJoin(F.broadcast(ref)).select(key, (F.col("_ref") / F.col("_mean")).alias("_factor"))
    return vols.join(factor, key).withColumn("value", F.col("value") * F.col("_factor")).drop("_factor")


def _band(lower: float, upper: float) -> Column:
    if not lower and not upper:
        return F.col("value").cast("boolean")
    return (F.col("value") > lower) & (F.col("value") <= upper)


def threshold_mask(vol: DataFrame, lower: float = 0, upper: float = 0) -> DataFrame:
    """lower < v <= upper; if both are 0 the input as a mask."""
    return vol.select(*AXES, _band(lower, upper).alias("value"))


def threshold_sweep(vol: DataFrame, step: float) -> DataFrame:
    """A mask for each threshold step, 2 step, ... below 1: (step, z, y, x) of values above it."""
    n = round(1 / step)
    steps = F.explode(F.sequence(F.lit(1), F.lit(n - 1)))
    return vol.withColumn("step", steps).where(F.col("value") > F.col("step") * F.lit(step)).select("step", *AXES)


def mask_expression(first: DataFrame, terms: list[tuple[str, DataFrame]]) -> DataFrame:
    """NOT / AND / OR / XOR over dense masks from left to right, starting with ones on ``first``'s voxels.

    An operator is one of AND, OR, XOR, optionally followed by NOT."""
    out = first.select(*AXES, F.lit(True).alias("value"))
    for op, mask in terms:
        name, negate = op.split()[0], op.endswith("NOT")
        out = out.join(mask.select(*AXES, F.col("value").alias("_m")), list(AXES), "left")
        m = F.coalesce("_m", F.lit(False))
        m = ~m if negate else m
        value = {"AND": F.col("value") & m, "OR": F.col("value") | m, "XOR": F.col("value") != m}[name]
        out = out.select(*AXES, value.alias("value"))
    return out


def exclusion_mask(dataset: DataFrame, labels: DataFrame, mask: DataFrame | None = None) -> DataFrame:
    """Voxels of the dataset mask that carry no label and aren't in the other mask."""
    out = dataset.select(*AXES).join(labels.where("label <> 0").select(*AXES), list(AXES), "left_anti")
    return out.join(mask.select(*AXES), list(AXES), "left_anti") if mask is not None else out


def class_composite(base: DataFrame, masks: list[DataFrame]) -> DataFrame:
    """Class index of each voxel: the last of the masks 1..k that holds it, else 0. One pass over tagged rows."""
    tagged = [base.select(*AXES, F.lit(0).alias("class"))] + [m.select(*AXES, F.lit(i + 1).alias("class")) for i, m in enumerate(masks)]
    return reduce(DataFrame.unionByName, tagged).groupBy(*AXES).agg(F.max("class").alias("class"))


def voxel_to_world(vol: DataFrame, elsize: tuple[float, float, float], offset: tuple[int, int, int] = (0, 0, 0)) -> DataFrame:
    """Physical coordinates wz, wy, wx: (index + block offset) * element size."""
    return vol.withColumns({f"w{a}": (F.col(a) + o) * F.lit(e) for a, e, o in zip(AXES, elsize, offset)})


def affine(vol: DataFrame, matrix: list[list[float]]) -> DataFrame:
    """wz, wy, wx by a 3x4 or 4x4 matrix over (z, y, x, 1)."""
    rows = {f"w{a}": F.col("z") * r[0] + F.col("y") * r[1] + F.col("x") * r[2] + F.lit(r[3]) for a, r in zip(AXES, matrix)}
    return vol.withColumns(rows)


def strided_subsample(vol: DataFrame, step: int) -> DataFrame:
    """Every step-th voxel of each axis, on the reduced grid."""
    keep = reduce(lambda a, b: a & b, [F.col(a) % step == 0 for a in AXES])
    return vol.where(keep).withColumns({a: F.expr(f"CAST({a} div {step} AS INT)") for a in AXES})
