"""Regions: properties of labels by grouped aggregates, filters on them, windows over slices."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.graph import written
from voxelry.functions.ranking import global_rank

from .labels import AXES, forward_map, shifted

PI = float(np.pi)


def _fore(vol: DataFrame) -> DataFrame:
    return vol.where("label <> 0")


def unique_labels(vol: DataFrame) -> DataFrame:
    return vol.select("label").distinct()


def max_label(vol: DataFrame) -> DataFrame:
    return vol.agg(F.coalesce(F.max("label"), F.lit(0)).cast("bigint").alias("max_label"))


def label_sizes(vol: DataFrame) -> DataFrame:
    return _fore(vol).groupBy("label").agg(F.count("*").alias("n"))


def small_labels(vol: DataFrame, size: int) -> DataFrame:
    return label_sizes(vol).where(F.col("n") < size).select("label")


def filter_small_labels(vol: DataFrame, size: int) -> DataFrame:
    """Labels of fewer than ``size`` voxels become 0."""
    return forward_map(vol, small_labels(vol, size).withColumn("new_label", F.lit(0).cast("bigint")))


def region_bbox(vol: DataFrame) -> DataFrame:
    """Half-open bounds z0 z1 y0 y1 x0 x1."""
    return _fore(vol).groupBy("label").agg(*[e.alias(f"{a}{i}") for a in AXES for i, e in ((0, F.min(a)), (1, (F.max(a) + 1).cast("int")))])


def region_centroid(vol: DataFrame, slicewise: bool = False) -> DataFrame:
    return _fore(vol).groupBy(*(["z"] if slicewise else []), "label").agg(*[F.avg(a).alias(f"c{a}") for a in (AXES[1:] if slicewise else AXES)])


def equivalent_diameter(n: Column, ndim: int) -> Column:
    return F.sqrt(n * 4 / F.lit(PI)) if ndim == 2 else F.cbrt(n * 6 / F.lit(PI))


def region_equivalent_diameter(vol: DataFrame, slicewise: bool = False) -> DataFrame:
    g = _fore(vol).groupBy(*(["z"] if slicewise else []), "label").agg(F.count("*").alias("n"))
    return g.withColumn("diameter", equivalent_diameter(F.col("n"), 2 if slicewise else 3)).drop("n")


def region_extent(vol: DataFrame) -> DataFrame:
    """Voxels over the voxels of the bounding box."""
    box = (F.max("z") - F.min("z") + 1) * (F.max("y") - F.min("y") + 1) * (F.max("x") - F.min("x") + 1)
    return _fore(vol).groupBy("label").agg((F.count("*") / box).alias("extent"))


def region_intensity(vol: DataFrame, intensity: DataFrame) -> DataFrame:
    j = _fore(vol).join(intensity.select(*AXES, "value"), AXES)
    return j.groupBy("label").agg(F.avg("value").alias("mean"), F.max("value").alias("max"))


def eccentricity(vy: Column, vx: Column, c: Column) -> Column:
    """Of the ellipse with second moments vy, vx and covariance c; 0 for a point."""
    half, root = (vy + vx) / 2, F.sqrt(((vy - vx) / 2) * ((vy - vx) / 2) + c * c)
    return F.when(half + root > 1e-12, F.sqrt(F.greatest(F.lit(0.0), 1 - (half - root) / (half + root)))).otherwise(0.0)


def region_eccentricity(vol: DataFrame) -> DataFrame:
    """Per slice and label, of the population moments."""
    g = _fore(vol).groupBy("z", "label").agg(F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("c"))
    return g.select("z", "label", eccentricity(F.col("vy"), F.col("vx"), F.col("c")).alias("eccentricity"))


def hull_pixels(y: np.ndarray, x: np.ndarray) -> int:
    """Grid points inside the convex hull of pixel centres (Pick's theorem over a monotone chain)."""
    pts = sorted(set(zip(x.tolist(), y.tolist())))
    if len(pts) < 3:
        return len(pts) if len(pts) < 2 else int(np.gcd(abs(pts[1][0] - pts[0][0]), abs(pts[1][1] - pts[0][1]))) + 1

    def half(points):
        out: list[tuple[int, int]] = []
        for p in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    hull = half(pts) + half(pts[::-1])
    twice, edge = 0, 0
    for (x0, y0), (x1, y1) in zip(hull, hull[1:] + hull[:1]):
        twice += x0 * y1 - x1 * y0
        edge += int(np.gcd(abs(x1 - x0), abs(y1 - y0)))
    return (abs(twice) + edge) // 2 + 1


def region_solidity(vol: DataFrame) -> DataFrame:
    """Per slice and label: pixels over grid points in their convex hull. Rows are cut down to each row's ends
    before the group reaches one task, which leaves the hull as it is."""
    rows = _fore(vol).groupBy("z", "label", "y").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.count("*").alias("n"))

    def solidity(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        y, x = np.concatenate([p.y, p.y]), np.concatenate([p.x0, p.x1])
        return pd.DataFrame([[*key, p.n.sum() / hull_pixels(y, x)]], columns=["z", "label", "solidity"])

    return rows.groupBy("z", "label").applyInPandas(solidity, "z int, label bigint, solidity double")


def region_euler_number(vol: DataFrame) -> DataFrame:
    """Objects less holes per slice and label, 8-connected, from counts of 2x2 cells."""
    v = _fore(vol).select("z", "label", "y", "x")
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)])).alias("o")
    cells = v.select("*", corner)
    cells = cells.select("z", "label", (F.col("y") - F.col("o.a")).alias("y"), (F.col("x") - F.col("o.b")).alias("x"), F.expr("shiftleft(1, o.a * 2 + o.b)").alias("bit"))
    q = cells.groupBy("z", "label", "y", "x").agg(F.sum("bit").alias("bits"))
    weight = F.when(F.bit_count("bits") == 1, 1).when(F.bit_count("bits") == 3, -1).when(F.col("bits").isin(6, 9), -2).otherwise(0)
    return q.groupBy("z", "label").agg((F.sum(weight) / 4).cast("int").alias("euler"))


def property_filter(props: DataFrame, min_area=None, max_area=None, max_intensity=None, max_eccentricity=None, min_solidity=None, min_euler=None, min_extent=None) -> DataFrame:
    """(label, new_label): label where every given criterion holds, else 0; without criteria all are valid."""
    ok = F.lit(True)
    for name, bound, least in (("area", min_area, True), ("area", max_area, False), ("mean", max_intensity, False), ("eccentricity", max_eccentricity, False), ("solidity", min_solidity, True), ("euler", min_euler, True), ("extent", min_extent, True)):
        if bound is not None:
            ok = ok & ((F.col(name) >= bound) if least else (F.col(name) <= bound))
    return props.select("label", F.when(ok, F.col("label")).otherwise(F.lit(0)).cast("bigint").alias("new_label"))


def property_volume(vol: DataFrame, props: DataFrame, name: str) -> DataFrame:
    """A label's property on its voxels."""
    return _fore(vol).join(props.select("label", name), "label").select(*AXES, F.col(name).alias("value"))


def compartment_volumes(compartments: DataFrame, dataset: DataFrame, voxel_volume: float) -> DataFrame:
    """(compartment, volume, fraction, mean, std) from (compartment, label) voxels: physical volume, share of the
    dataset mask, and mean and standard deviation over objects."""
    total = dataset.agg(F.count("*").alias("_all"))  # one row
    objects = compartments.where("label <> 0").groupBy("compartment", "label").agg(F.count("*").alias("n"))
    v = F.lit(voxel_volume)
    g = objects.groupBy("compartment").agg(F.sum("n").alias("_n"), (F.avg("n") * v).alias("mean"), (F.stddev_pop("n") * v).alias("std"))
    return g.crossJoin(F.broadcast(total)).select("compartment", (F.col("_n") * v).alias("volume"), (F.col("_n") / F.col("_all")).alias("fraction"), "mean", "std")


def boundary_composition(vol: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, in_a, in_b, difference): shares of a label's one-voxel outer shell in two masks."""
    from .labels import SHELL

    v = _fore(vol).select(*AXES, "label")
    shell = shifted(v, SHELL).distinct().join(v, [*AXES, "label"], "left_anti")
    tag = lambda m, n: m.select(*AXES, F.lit(1).alias(n))
    s = shell.join(vol.select(*AXES), AXES, "left_semi").join(tag(a, "_a"), AXES, "left").join(tag(b, "_b"), AXES, "left")
    g = s.groupBy("label").agg(F.avg(F.coalesce("_a", F.lit(0))).alias("in_a"), F.avg(F.coalesce("_b", F.lit(0))).alias("in_b"))
    return g.withColumn("difference", F.col("in_a") - F.col("in_b"))


def slice_label_sets(vol: DataFrame) -> DataFrame:
    return _fore(vol).groupBy("z").agg(F.array_sort(F.collect_set("label")).alias("labels"))


def volume_histogram(vol: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    from voxelry.sources.volumes import histogram_bin

    return vol.groupBy(histogram_bin(F.col("value"), low, high, bins).alias("bin")).agg(F.count("*").alias("n"))


def relabel_sequential(vol: DataFrame, offset: int = 0) -> DataFrame:
    """Dense renumbering by label order, from offset + 1; 0 stays 0."""
    ranks = global_rank(_fore(vol).select("label").distinct(), "label")
    return forward_map(vol, ranks.select("label", (F.col("rank") + offset).alias("new_label")))


def shuffle_labels(vol: DataFrame, seed: int = 0) -> DataFrame:
    """A seeded permutation of the labels; the same for every volume with the same label set."""
    labels = written(_fore(vol).select("label").distinct(), "labels")
    a = global_rank(labels, "label")
    b = global_rank(labels.select(F.col("label").alias("new_label"), F.md5(F.concat_ws(",", "label", F.lit(seed))).alias("_h")), "_h", "new_label").drop("_h")
    return forward_map(vol, a.join(b, "rank").select("label", "new_label"))


def remove_largest(vol: DataFrame) -> DataFrame:
    """The largest label, ties to the smallest, becomes 0."""
    top = label_sizes(vol).orderBy(F.desc("n"), "label").limit(1).select("label", F.lit(0).cast("bigint").alias("new_label"))
    return forward_map(vol, top)


def rank_regions(vol: DataFrame, by: str = "size") -> DataFrame:
    """(label, place): by size, largest first, or by first slice; ties by label."""
    g = _fore(vol).groupBy("label").agg(F.count("*").alias("n"), F.min("z").alias("first"))
    order = [F.desc("n"), "label"] if by == "size" else ["first", "label"]
    return global_rank(g, *order, name="place").select("label", F.col("place").cast("int").alias("place"))


def border_slice(vol: DataFrame, end: str = "first") -> DataFrame:
    """(label, z, cy, cx): a label's first or last slice and its centroid there."""
    g = region_centroid(vol, slicewise=True)
    edge = (F.min if end == "first" else F.max)("z").over(Window.partitionBy("label"))
    return g.withColumn("_edge", edge).where("z = _edge").select("label", "z", "cy", "cx")


def consecutive_runs(slices: DataFrame, longer_than: int = 0) -> DataFrame:
    """(label, z0, z1, n) of runs of consecutive slices in (label, z) rows, if longer than asked."""
    island = F.col("z") - F.row_number().over(Window.partitionBy("label").orderBy("z"))
    g = slices.select("label", "z").distinct().withColumn("_i", island).groupBy("label", "_i").agg(F.min("z").alias("z0"), F.max("z").alias("z1"), F.count("*").alias("n"))
    return g.where(F.col("n") > longer_than).select("label", "z0", "z1", "n")


def centreline(vol: DataFrame, elsize: tuple[float, float, float], jump: float) -> DataFrame:
    """(label, length, gap): length of the polyline of slice centroids; gap if one step is longer than ``jump``."""
    w = Window.partitionBy("label").orderBy("z")
    step = lambda c, e: (F.col(c) - F.lag(c).over(w)) * F.lit(e)
    s = region_centroid(vol, slicewise=True).select("label", step("z", elsize[0]).alias("a"), step("cy", elsize[1]).alias("b"), step("cx", elsize[2]).alias("c"))
    s = s.select("label", F.sqrt(F.col("a") ** 2 + F.col("b") ** 2 + F.col("c") ** 2).alias("d"))
    return s.groupBy("label").agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"), (F.coalesce(F.max("d"), F.lit(0.0)) > jump).alias("gap"))


def project_centroid(vol: DataFrame, n: int, reach: int, margin: int) -> DataFrame:
    """(label, z, cy, cx, y0, y1, x0, x1): the direction over a label's last n slices carried on ``reach`` slices
    beyond its end, and the search box around that point."""
    c = region_centroid(vol, slicewise=True).withColumn("_last", F.max("z").over(Window.partitionBy("label")))
    end = c.where("z = _last").select("label", "z", "cy", "cx")
    start = c.where(F.col("z") == F.col("_last") - (n - 1)).select("label", F.col("z").alias("z_"), F.col("cy").alias("y_"), F.col("cx").alias("x_"))
    slope = lambda a, b: (F.col(a) - F.col(b)) / F.greatest(F.col("z") - F.col("z_"), F.lit(1))
    p = end.join(start, "label").select("label", (F.col("z") + reach).alias("z"), (F.col("cy") + reach * slope("cy", "y_")).alias("cy"), (F.col("cx") + reach * slope("cx", "x_")).alias("cx"))
    box = {f"{a}{i}": (F.floor(f"c{a}") + s * margin + int(s > 0)).cast("int") for a in ("y", "x") for i, s in ((0, -1), (1, 1))}
    return p.withColumns(box)


def rasterize_segments(segments: DataFrame) -> DataFrame:
    """(label, z, y, x): voxels along segments (label, z0, y0, x0, z1, y1, x1), a point a unit of the longest axis."""
    steps = F.greatest(*[F.ceil(F.abs(F.col(f"{a}1") - F.col(f"{a}0"))) for a in AXES]).cast("int")
    s = segments.withColumn("_n", steps).withColumn("_t", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    at = {a: F.floor(F.col(f"{a}0") + (F.col(f"{a}1") - F.col(f"{a}0")) * F.col("_t") / F.greatest("_n", F.lit(1)) + 0.5).cast("int") for a in AXES}
    return s.select("label", *[c.alias(a) for a, c in at.items()]).distinct()


def sample_matches(matches: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most n matches a pair, in the order of a hash of their points, to a millionth."""
    points = [F.round(F.col(c) * 1e6).cast("bigint") for c in ("sx", "sy", "dx", "dy")]
    order = F.row_number().over(Window.partitionBy("pair_id").orderBy(F.md5(F.concat_ws(",", *points, F.lit(seed))), "sx", "sy", "dx", "dy"))
    return matches.withColumn("_r", order).where(F.col("_r") <= n).drop("_r")
