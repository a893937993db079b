"""Statistics of objects over slices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.graph import written
from voxelry.functions.ranking import global_rank

from .regions import eccentricity, equivalent_diameter, region_solidity


def slicewise_stats(vol: DataFrame, solidity: bool = False, frame: bool = True) -> DataFrame:
    """(z, label, area, diameter, cy, cx, eccentricity[, solidity]) over all slices and labels; missing is null. Without a
    ``frame`` only of the slices that a label is in."""
    v = vol.where("label <> 0")
    g = v.groupBy("z", "label").agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("c"))
    g = g.select("z", "label", "area", equivalent_diameter(F.col("area"), 2).alias("diameter"), "cy", "cx", eccentricity(F.col("vy"), F.col("vx"), F.col("c")).alias("eccentricity"))
    if solidity:
        g = g.join(region_solidity(v), ["z", "label"], "left")
    if not frame:
        return g
    slices = vol.agg(F.min("z").alias("a"), F.max("z").alias("b")).where("a IS NOT NULL")  # one row
    # a label's row stands for the slices up to its next one, so the frame is spun out where the row is: it is neither
    # shuffled nor joined
    along = Window.partitionBy("label").orderBy("z")
    parts = int(vol.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = g.repartition(parts, "label").withColumn("_first", F.row_number().over(along) == 1).withColumn("_next", F.lead("z").over(along)).crossJoin(F.broadcast(slices))
    start, end = F.when(F.col("_first"), F.col("a")).otherwise(F.col("z")), F.coalesce(F.col("_next") - 1, F.col("b"))
    rows = rows.withColumn("_z", F.explode(F.when(start <= end, F.sequence(start, end))))
    return rows.select(F.col("_z").alias("z"), "label", *[F.when(F.col("z") == F.col("_z"), F.col(c)).alias(c) for c in g.columns if c not in ("z", "label")])


def g_ratio(inner: DataFrame, outer: DataFrame, slicewise: bool = False) -> DataFrame:
    """sqrt(1 - (MF - MA) / MF) per object, or per slice and object, of total areas of nested objects; MF is the
    whole (outer), MA the inner part, so MF - MA is what lies around it."""
    keys = (["z"] if slicewise else []) + ["label"]
    a = inner.where("label <> 0").groupBy(*keys).agg(F.count("*").alias("ma"))
    f = outer.where("label <> 0").groupBy(*keys).agg(F.count("*").alias("mf"))
    return f.join(a, keys).select(*keys, F.sqrt(1 - (F.col("mf") - F.col("ma")) / F.col("mf")).alias("g_ratio"))


def sheath_thickness(inner: DataFrame, outer: DataFrame, most: float = 0.99) -> DataFrame:
    """(z, label, thickness, ratio, valid): half the difference of equivalent diameters per slice. Invalid are an
    object's first and last slices and ratios above ``most``."""
    d = lambda v, n: v.where("label <> 0").groupBy("z", "label").agg(equivalent_diameter(F.count("*"), 2).alias(n))
    j = d(outer, "do").join(d(inner, "di"), ["z", "label"])
    w = Window.partitionBy("label")
    j = j.withColumn("ratio", F.col("di") / F.col("do")).withColumn("_a", F.min("z").over(w)).withColumn("_b", F.max("z").over(w))
    return j.select("z", "label", ((F.col("do") - F.col("di")) / 2).alias("thickness"), "ratio", ((F.col("z") > F.col("_a")) & (F.col("z") < F.col("_b")) & (F.col("ratio") <= most)).alias("valid"))


def object_variability(stats: DataFrame, value: str) -> DataFrame:
    """(label, cv, variance, spread) of a statistic over slices."""
    g = stats.where(F.col(value).isNotNull()).groupBy("label")
    return g.agg((F.stddev_samp(value) / F.avg(value)).alias("cv"), F.var_samp(value).alias("variance"), (F.max(value) - F.min(value)).alias("spread"))


def permutation_null(stats: DataFrame, value: str, seed: int = 0) -> DataFrame:
    """Variability after a seeded shuffle of the values over all (slice, object) cells."""
    cells = written(stats.where(F.col(value).isNotNull()).select("z", "label", value, F.md5(F.concat_ws(",", "z", "label", F.lit(seed))).alias("_h")), "cells")
    a = global_rank(cells.select("z", "label"), "z", "label")
    b = global_rank(cells, "_h", "z", "label").select(value, "rank")
    return object_variability(a.join(b, "rank"), value)


def distribution_summary(stats: DataFrame, value: str) -> DataFrame:
    """One row: mean, median, standard deviation and number."""
    return stats.agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.stddev_samp(value).alias("std"), F.count(value).alias("n"))


def joint_histogram(stats: DataFrame, x: str, y: str, x_range: tuple[float, float, int], y_range: tuple[float, float, int]) -> DataFrame:
    """(xbin, ybin, n): log-spaced bins of x, even ones of y; values outside are left out."""
    bx = F.floor((F.ln(x) - float(np.log(x_range[0]))) * x_range[2] / float(np.log(x_range[1] / x_range[0]))).cast("int")
    by = F.floor((F.col(y) - y_range[0]) * y_range[2] / (y_range[1] - y_range[0])).cast("int")
    inside = F.col(x).between(x_range[0], x_range[1]) & F.col(y).between(y_range[0], y_range[1]) & (F.col(x) < x_range[1]) & (F.col(y) < y_range[1])
    return stats.where(inside).groupBy(bx.alias("xbin"), by.alias("ybin")).agg(F.count("*").alias("n"))


def log_linear_fit(stats: DataFrame, ratio: str, diameter: str) -> DataFrame:
    """(scope, slope, intercept) of ratio on ln(diameter): pooled, and on object means."""
    fit = lambda d, scope: d.agg(F.lit(scope).alias("scope"), F.regr_slope(ratio, "_x").alias("slope"), F.regr_intercept(ratio, "_x").alias("intercept"))
    s = stats.where(F.col(ratio).isNotNull() & (F.col(diameter) > 0))
    means = s.groupBy("label").agg(F.avg(ratio).alias(ratio), F.avg(diameter).alias(diameter))
    return fit(s.withColumn("_x", F.ln(diameter)), "pooled").unionByName(fit(means.withColumn("_x", F.ln(diameter)), "objects"))


def peaks(v: np.ndarray, distance: int, prominence: float) -> list[int]:
    """Local maxima (the middle of a plateau) with a prominence, highest first at least ``distance`` apart."""
    found, i = [], 1
    while i < len(v) - 1:
        if v[i] > v[i - 1]:
            j = i
            while j < len(v) - 1 and v[j + 1] == v[i]:
                j += 1
            if j < len(v) - 1 and v[j + 1] < v[i]:
                found.append((i + j) // 2)
            i = j
        i += 1

    def base(i: int, step: int) -> float:
        low, j = v[i], i
        while 0 <= j < len(v) and v[j] <= v[i]:
            low, j = min(low, v[j]), j + step
        return low

    found = [i for i in found if v[i] - max(base(i, -1), base(i, 1)) >= prominence]
    kept: list[int] = []
    for i in sorted(found, key=lambda i: (-v[i], i)):
        if all(abs(i - k) >= distance for k in kept):
            kept.append(i)
    return sorted(kept)


def profile_peaks(stats: DataFrame, value: str, distance: int = 1, prominence: float = 0.0) -> DataFrame:
    """(label, z, value) of the peaks of a profile along z, a group an object."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.dropna(subset=[value]).sort_values("z", ignore_index=True)
        at = peaks(p[value].to_numpy(float), distance, prominence)
        return pd.DataFrame({"label": key[0], "z": p.z[at], "value": p[value][at].astype(float)})

    return stats.select("label", "z", value).groupBy("label").applyInPandas(run, "label bigint, z int, value double")
