"""Resampling and channels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labels import Held, held

AXES = ("z", "y", "x")
Triple = tuple[int, int, int]
#: Reducers by name; user code is never evaluated.
REDUCERS = {"max": F.max, "min": F.min, "sum": F.sum, "median": F.median, "mode": F.mode, "std": F.stddev_pop}


def _cells(size: Triple):
    return [F.expr(f"CAST({a} div {n} AS INT)").alias(a) for a, n in zip(AXES, size)]


def block_reduce(vol: DataFrame, size: Triple, how: str = "mean") -> DataFrame:
    """max, min, sum or mean over cells. Ragged cells are padded with 0: the mean divides by the whole cell, and
    max and min see the padding."""
    whole = size[0] * size[1] * size[2]
    g = vol.groupBy(*_cells(size))
    if how == "mean":
        return g.agg((F.sum("value") / whole).alias("value"))
    if how == "sum":
        return g.agg(F.sum("value").alias("value"))
    pad = F.greatest if how == "max" else F.least
    v = REDUCERS[how]("value")
    return g.agg(F.when(F.count("*") < whole, pad(v, F.lit(0))).otherwise(v).alias("value"))


def reduce_with(vol: DataFrame, size: Triple, how: str) -> DataFrame:
    """Any reducer of ``REDUCERS`` over the voxels that a cell has."""
    if how not in REDUCERS:
        raise ValueError(f"unknown reducer {how!r}; known: {', '.join(REDUCERS)}")
    return vol.groupBy(*_cells(size)).agg(REDUCERS[how]("value").alias("value"))


def block_mode(vol: DataFrame, size: Triple) -> DataFrame:
    """Majority label of a cell, ties to the smallest; padding counts as 0."""
    whole = size[0] * size[1] * size[2]
    n = vol.groupBy(*_cells(size), "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy(*AXES)
    pad = F.lit(whole) - F.sum("n").over(w)
    votes = n.withColumn("_pad", pad).withColumn("_zero", F.max((F.col("label") == 0).cast("int")).over(w))
    votes = votes.withColumn("n", F.when(F.col("label") == 0, F.col("n") + F.col("_pad")).otherwise(F.col("n")))
    best = votes.withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "label"))).where("_r = 1")
    zero_wins = (F.col("_zero") == 0) & (F.col("_pad") >= F.col("n"))
    return best.select(*AXES, F.when(zero_wins, F.lit(0).cast("bigint")).otherwise(F.col("label")).alias("label"))


def expand_blocks(vol: DataFrame, size: Triple, dims: Triple, inside: Held = None) -> DataFrame:
    """Nearest-neighbour upsampling, clipped to the full size and to what the full volume holds."""
    for a, n, d in zip(AXES, size, dims):
        vol = vol.withColumn(a, F.explode(F.sequence(F.col(a) * n, F.least((F.col(a) + 1) * n, F.lit(d)) - 1)))
    return held(vol, inside)


def resample_inplane(vol: DataFrame, dims: Triple, factor: int) -> DataFrame:
    """Bilinear in-plane reduction by a whole factor: output pixel centres lie at (i + 1/2) factor - 1/2. Every
    input pixel is sent to the outputs that it weighs in."""
    v = vol.select("z", "y", "x", "value")
    for a, d in (("y", dims[1]), ("x", dims[2])):
        n = d // factor
        centre = lambda i, f=factor: (i + 0.5) * f - 0.5
        first = F.greatest(F.floor((F.col(a) - 1 + 0.5) / factor - 0.5), F.lit(0))
        last = F.least(F.ceil((F.col(a) + 1 + 0.5) / factor - 0.5), F.lit(n - 1))
        v = v.where(first <= last).withColumn("_o", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
        weight = 1 - F.abs(F.col(a) - centre(F.col("_o")))
        v = v.withColumn("value", F.col("value") * weight).where(weight > 0).withColumn(a, F.col("_o")).drop("_o")
    return v.groupBy(*AXES).agg(F.sum("value").alias("value"))


def combine_channels(vol: DataFrame, channels: list[int] | None = None, how: str = "sum") -> DataFrame:
    """Sum or mean of selected channels, of all if none is named; the mean is over the channels used."""
    v = vol.where(F.col("c").isin(channels)) if channels else vol
    return v.groupBy(*AXES).agg((F.sum if how == "sum" else F.avg)("value").alias("value"))


def bias_correct(vol: DataFrame, bias: DataFrame, factor: Triple) -> DataFrame:
    """Each channel divided by its coarse bias field (c, z, y, x, value) at the voxel's cell; what isn't finite
    becomes 0."""
    v = vol.withColumns({f"_{a}": F.expr(f"CAST({a} div {n} AS INT)") for a, n in zip(AXES, factor)})
    b = bias.select("c", *[F.col(a).alias(f"_{a}") for a in AXES], F.col("value").alias("_bias"))
    ratio = F.when(F.col("_bias") != 0, F.col("value") / F.col("_bias")).otherwise(0.0)
    return v.join(b, ["c", "_z", "_y", "_x"], "left").select("c", *AXES, F.coalesce(F.nanvl(ratio, F.lit(0.0)), F.lit(0.0)).alias("value"))


def combine_corrected(vol: DataFrame, bias: DataFrame, factor: Triple, channels: list[int] | None = None, how: str = "sum") -> DataFrame:
    return combine_channels(bias_correct(vol, bias, factor), channels, how)
