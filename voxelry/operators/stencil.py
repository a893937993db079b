"""Neighbourhood operators. A structuring element is a list of offsets, with weights where it has any; voxels
are scattered to what they touch and aggregated there."""

from __future__ import annotations

from functools import reduce
from math import ceil, exp

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelry.functions.graph import written

from .blocks import split_blocks
from .labels import AXES, FACES, Held, held, shifted

Offset = tuple[int, int, int]
Triple = tuple[int, int, int]
#: Blocks that windows are taken in.
BLOCK = (32, 128, 128)


def structuring_element(shape: str, radius: Triple | int) -> list[Offset]:
    """disk (in the plane), ball, box or diamond; radii per axis make it anisotropic."""
    r = (radius,) * 3 if isinstance(radius, int) else radius
    if shape == "disk":
        r = (0, r[1], r[2])
    part = lambda d, n: abs(d) / n if n else 0.0
    out = []
    for dz in range(-r[0], r[0] + 1):
        for dy in range(-r[1], r[1] + 1):
            for dx in range(-r[2], r[2] + 1):
                p = [part(d, n) for d, n in zip((dz, dy, dx), r)]
                if shape == "box" or (shape == "diamond" and sum(p) <= 1 + 1e-9) or (shape in ("disk", "ball") and sum(q * q for q in p) <= 1 + 1e-9):
                    out.append((dz, dy, dx))
    return out


def element_table(spark: SparkSession, element: list[Offset]) -> DataFrame:
    return spark.createDataFrame(element, "dz int, dy int, dx int")


def _inside(v: DataFrame, dims: Triple) -> DataFrame:
    return v.where(" AND ".join(f"{a} >= 0 AND {a} < {d}" for a, d in zip(AXES, dims)))


def binary_dilate(mask: DataFrame, element: list[Offset], dims: Triple, inside: Held = None) -> DataFrame:
    return held(_inside(shifted(mask.select(*AXES), element), dims).distinct(), inside)


def binary_erode(mask: DataFrame, element: list[Offset], dims: Triple, border: bool = False) -> DataFrame:
    """Voxels whose whole neighbourhood is set; ``border`` is the value outside the volume."""
    hits = _inside(shifted(mask.select(*AXES), [(-a, -b, -c) for a, b, c in element]), dims).groupBy(*AXES).agg(F.count("*").alias("n"))
    need = F.lit(len(element))
    if border:
        within = lambda o: reduce(lambda p, q: p & q, [(F.col(a) + d >= 0) & (F.col(a) + d < n) for a, d, n in zip(AXES, o, dims)])
        need = reduce(lambda p, q: p + q, [within(o).cast("int") for o in element])
    return hits.where(F.col("n") == need).select(*AXES)


def boundary_mask(dataset: DataFrame, dims: Triple, element: list[Offset], eroded: bool = True, z_margin: int = 0) -> DataFrame:
    """The eroded dataset mask, or the dilation of its complement without ``z_margin`` slices at both ends."""
    if eroded:
        return binary_erode(dataset, element, dims)
    from .components import complement

    return binary_dilate(complement(dataset, dims), element, dims).where((F.col("z") >= z_margin) & (F.col("z") < dims[0] - z_margin))


def _window(vol: DataFrame, element: list[Offset], dims: Triple, column: str, largest: bool) -> DataFrame:
    """The largest or smallest value of the window of each voxel that it reaches. Halo blocks, so that a voxel moves once for
    each block that it may reach, not once an offset, and a task holds one block; nulls don't count, NaN is above all."""
    margin = tuple(max(abs(o[i]) for o in element) for i in range(3))
    kind = vol.schema[column].dataType.simpleString()
    near = reduce(lambda p, q: p & q, [F.col(a).between(-m, d - 1 + m) for a, d, m in zip(AXES, dims, margin)])
    v = vol.where(near).select(*AXES, F.coalesce(column, F.lit(0).cast(kind)).alias("_v"), F.col(column).isNotNull().alias("_ok"))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        core = np.array([k * s for k, s in zip(key, BLOCK)])
        size = np.minimum(core + BLOCK, dims) - core
        shape = tuple(size + 2 * np.array(margin))
        order = np.argsort(p["_v"].to_numpy(), kind="stable")
        p = p.iloc[order if largest else order[::-1]]  # of voxels given twice, the last one holds
        place = lambda q: tuple(q[a].to_numpy() - c + m for a, c, m in zip(AXES, core, margin))
        there, ok, value = np.zeros(shape, bool), np.zeros(shape, bool), np.zeros(shape, p["_v"].to_numpy().dtype)
        there[place(p)] = True
        q = p[p["_ok"]]
        ok[place(q)], value[place(q)] = True, q["_v"].to_numpy()
        best, has, touched = np.zeros(tuple(size), value.dtype), np.zeros(tuple(size), bool), np.zeros(tuple(size), bool)
        for o in element:
            part = tuple(slice(m + d, m + d + n) for m, d, n in zip(margin, o, size))
            touched |= there[part]
            new = value[part]
            better = new > best if largest else new < best
            if value.dtype.kind == "f":
                better |= np.isnan(new) if largest else np.isnan(best) & ~np.isnan(new)
            best = np.where(ok[part] & (~has | better), new, best)
            has |= ok[part]
        z, y, x = np.nonzero(touched)
        got, known = best[z, y, x], has[z, y, x].astype(np.int32)
        if value.dtype.kind == "f":
            known += known * np.isnan(got)  # on its way back NaN would turn to null
        return pd.DataFrame({"z": z + core[0], "y": y + core[1], "x": x + core[2], "_v": got, "_ok": known})

    out = split_blocks(v, dims, BLOCK, margin).groupBy("iz", "iy", "ix").applyInPandas(run, f"z int, y int, x int, _v {kind}, _ok int")
    back = F.when(F.col("_ok") == 1, F.col("_v"))
    return out.select(*AXES, (back.when(F.col("_ok") == 2, F.lit("NaN").cast(kind)) if kind in ("float", "double") else back).alias(column))


def grey_dilate(vol: DataFrame, element: list[Offset], dims: Triple, column: str = "label", inside: Held = None) -> DataFrame:
    """Maximum over the window, at the voxels that the volume holds."""
    return held(_window(vol, element, dims, column, True), inside)


def grey_erode(vol: DataFrame, element: list[Offset], dims: Triple, column: str = "label", inside: Held = None) -> DataFrame:
    """Minimum over the window of a dense volume; outside voxels don't count."""
    return held(_window(vol, element, dims, column, False), inside)


def close_labels(vol: DataFrame, element: list[Offset], dims: Triple, mask: DataFrame | None = None, min_size: int = 0, relabel: bool = False, inside: Held = None) -> DataFrame:
    """Grey closing of a dense label volume, then a mask, a size filter and renumbering, as asked."""
    from .regions import filter_small_labels, relabel_sequential

    out = grey_erode(grey_dilate(vol, element, dims, inside=inside), element, dims, inside=inside)
    if mask is not None:
        out = out.join(mask.select(*AXES), AXES, "left_semi")
    if min_size:
        out = filter_small_labels(out, min_size)
    return relabel_sequential(out) if relabel else out


def label_rim(vol: DataFrame, dims: Triple, outer: bool = True, element: list[Offset] | None = None, inside: Held = None) -> DataFrame:
    """(z, y, x, label): one-voxel rim of each label, outside it (in any other voxel) or inside it."""
    v = vol.where("label <> 0").select(*AXES, "label")
    if outer:
        return held(_inside(shifted(v, element or FACES), dims).distinct(), inside).join(v, [*AXES, "label"], "left_anti")
    hit = _inside(shifted(v, element or FACES), dims).groupBy(*AXES, "label").agg(F.count("*").alias("_n"))
    return v.join(hit, [*AXES, "label"], "left").where(F.coalesce("_n", F.lit(0)) < len(element or FACES)).select(*AXES, "label")


def gaussian_kernel(sigma: float, order: int = 0, truncate: float = 4.0) -> list[tuple[int, float]]:
    """(offset, weight) of a sampled Gaussian or its derivative."""
    if sigma <= 0:
        return [(0, 1.0)]
    r = int(ceil(truncate * sigma - 0.5))
    g = [exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    total = sum(g)
    return [(i, w / total * (1.0 if not order else -i / sigma**2)) for i, w in zip(range(-r, r + 1), g)]


def _convolve(vol: DataFrame, axis: str, size: int, kernel: list[tuple[int, float]]) -> DataFrame:
    """1-D weighted scatter with the border reflected (edge voxel repeated). Voxels that ``vol`` lacks add nothing and get
    no value."""
    taps = F.explode(F.array(*[F.struct(F.lit(o).alias("o"), F.lit(float(w)).alias("w")) for o, w in kernel])).alias("_k")
    # output p takes input reflect(p + o): an input at i feeds p = i - o, and mirrored outputs at the borders
    i = F.col(axis)
    v = vol.select(*AXES, "value", taps)
    period = 2 * size
    feeds = F.array_distinct(F.array(F.pmod(i - F.col("_k.o"), F.lit(period)), F.pmod(-i - 1 - F.col("_k.o"), F.lit(period))))
    v = v.withColumn("_p", F.explode(feeds)).where(F.col("_p") < size)
    rest = [a for a in AXES if a != axis]
    out = v.groupBy(*rest, F.col("_p").cast("int").alias(axis)).agg(F.sum(F.col("value") * F.col("_k.w")).alias("value"), F.max(F.col("_k.o") == 0).alias("_held"))
    return out.where("_held").select(*AXES, "value")


def gaussian_smooth(vol: DataFrame, dims: Triple, sigma: tuple[float, float, float], elsize: tuple[float, float, float] = (1, 1, 1), orders: Triple = (0, 0, 0)) -> DataFrame:
    """Separable Gaussian of a dense volume; sigma in physical units."""
    for a, d, s, e, o in zip(AXES, dims, sigma, elsize, orders):
        k = gaussian_kernel(s / e, o)
        if len(k) > 1:
            vol = _convolve(vol, a, d, k)
    return vol.select(*AXES, F.col("value").cast("double").alias("value"))


def difference_of_gaussians(vol: DataFrame, dims: Triple, low: tuple, high: tuple) -> DataFrame:
    a = gaussian_smooth(vol, dims, low)
    b = gaussian_smooth(vol, dims, high).withColumnRenamed("value", "_b")
    return a.join(b, AXES).select(*AXES, (F.col("value") - F.col("_b")).alias("value"))


def gradient_magnitude(vol: DataFrame, dims: Triple, sigma: tuple[float, float, float]) -> DataFrame:
    """Norm of the Gaussian-derivative gradient; axes of size 1 or sigma 0 have none."""
    parts = []
    for i, (d, s) in enumerate(zip(dims, sigma)):
        if s > 0 and d > 1:
            orders = tuple(int(i == j) for j in range(3))
            parts.append(gaussian_smooth(vol, dims, sigma, orders=orders).select(*AXES, (F.col("value") ** 2).alias("value")))
    return reduce(DataFrame.unionByName, parts).groupBy(*AXES).agg(F.sqrt(F.sum("value")).alias("value"))


def local_maxima(vol: DataFrame, element: list[Offset], dims: Triple, threshold: float) -> DataFrame:
    """Voxels equal to their window's maximum and above a threshold."""
    top = grey_dilate(vol, element, dims, "value").withColumnRenamed("value", "_top")
    return vol.where(F.col("value") > threshold).join(top, AXES).where("value = _top").select(*AXES, "value")


def separate_touching_labels(vol: DataFrame) -> DataFrame:
    """A voxel becomes 0 if one of the 12 neighbours of the half cube before it holds another label."""
    from .components import half_neighbours

    half = [o for o in half_neighbours(26) if max(map(abs, o)) == 1][:13]
    half = [o for o in half if o != (1, 1, 1)]
    v = vol.where("label <> 0").select(*AXES, "label")
    hit = shifted(v.withColumnRenamed("label", "_other"), half).join(v, AXES).where("label <> _other").select(*AXES).distinct()
    return vol.join(hit.withColumn("_hit", F.lit(True)), AXES, "left").withColumn("label", F.when(F.col("_hit"), F.lit(0).cast("bigint")).otherwise(F.col("label"))).select(*vol.columns)


def lower_envelope(f: np.ndarray, step: float) -> np.ndarray:
    """min over j of f[j] + (step (i - j))^2, for every i; infinities are no sources."""
    n = len(f)
    src = np.flatnonzero(np.isfinite(f))
    if not len(src):
        return np.full(n, np.inf)
    v, z = [int(src[0])], [-np.inf, np.inf]
    s2 = step * step
    for q in src[1:].tolist():
        while True:
            p = v[-1]
            s = (f[q] - f[p] + s2 * (q * q - p * p)) / (2 * s2 * (q - p))
            if s > z[-2]:
                break
            v.pop()
            z.pop(-2)
        v.append(q)
        z[-1:] = [s, np.inf]
    i = np.arange(n)
    at = np.array(v)[np.searchsorted(np.array(z[1:-1]), i, side="left")]
    return f[at] + s2 * (i - at) ** 2


#: Lines that one group of a pass holds.
LINES = 64


def _sweep(axis: str, rest: list[str], n: int, step: float, by: str | None = None):
    def sweep(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        lines, at = np.unique(p[rest[1]].to_numpy(), return_inverse=True)
        f = np.full((len(lines), n), np.inf)
        f[at, p[axis].to_numpy()] = p.value.to_numpy()
        g = np.concatenate([lower_envelope(row, step) for row in f])
        out = pd.DataFrame({rest[0]: key[0], rest[1]: np.repeat(lines, n), axis: np.tile(np.arange(n), len(lines)), "value": g})[[*AXES, "value"]]
        return out.assign(**{by: key[2]}) if by else out

    return sweep


def distance_transform(mask: DataFrame, dims: Triple, elsize: tuple[float, float, float] = (1, 1, 1), by: str | None = None, inside: Held = None) -> DataFrame:
    """(z, y, x, value): Euclidean distance of every voxel to the nearest mask voxel, on an anisotropic grid; null
    if there is none. One pass an axis, a group a bundle of lines; lines without any source have no rows until a
    later pass reaches them. ``by`` (a double column) gives one transform for each of its values."""
    keys = [by] if by else []
    d = mask.select(*keys, *AXES, F.lit(0.0).alias("value")).distinct()
    kind = "z int, y int, x int, value double" + (f", {by} double" if by else "")
    for axis, n, e in ((a, dims[i], elsize[i]) for i, a in ((2, "x"), (1, "y"), (0, "z"))):
        rest = [a for a in AXES if a != axis]

        d = d.groupBy(rest[0], F.expr(f"{rest[1]} div {LINES}"), *keys).applyInPandas(_sweep(axis, rest, n, e, by), kind)
    return held(d, inside).select(*keys, *AXES, F.sqrt("value").alias("value"))


def near_distance(mask: DataFrame, dims: Triple, radius: float, elsize: tuple[float, float, float] = (1, 1, 1), inside: Held = None) -> DataFrame:
    """The same up to a radius, for each value of the columns besides the axes: one scatter and minimum an axis, so
    that a voxel makes a row a step along an axis, not a row a voxel of a ball."""
    keys = [c for c in mask.columns if c not in AXES]
    d = mask.select(*keys, *AXES, F.lit(0.0).alias("value"))
    most = radius * radius * (1 + 1e-12)
    for axis, n, e in ((a, dims[i], float(abs(elsize[i]))) for i, a in ((2, "x"), (1, "y"), (0, "z"))):
        reach = min(n - 1, int(radius / e + 1e-9))
        low, high = F.greatest(F.col(axis) - reach, F.lit(0)), F.least(F.col(axis) + reach, F.lit(n - 1))
        moved = d.withColumn("_to", F.explode(F.sequence(low, high)))
        far = F.col("value") + (F.col("_to") - F.col(axis)) * (F.col("_to") - F.col(axis)) * F.lit(e * e)
        rest = [a for a in AXES if a != axis]
        d = moved.select(*keys, *rest, F.col("_to").cast("int").alias(axis), far.alias("value")).where(F.col("value") <= most)
        d = d.groupBy(*keys, *AXES).agg(F.min("value").alias("value"))
    return held(d, inside).withColumn("value", F.sqrt("value"))


def inward_distance(vol: DataFrame, most: int) -> DataFrame:
    """(z, y, x, label, d): steps over faces from each label voxel to the first one that isn't of its label, or beyond the
    volume; ``most`` stands for that and more. One pass over the lines of each axis: how far the voxel's run goes on, and
    the least of what the lines before gave along it. Windows hold ``most`` rows on either side."""
    v = vol.where("label <> 0").select(*AXES, "label").distinct().withColumn("d", F.lit(most))
    for axis in reversed(AXES):
        line = Window.partitionBy("label", *[a for a in AXES if a != axis]).orderBy(axis)
        at = F.col(axis)
        v = v.withColumn("_run", at - F.row_number().over(line))
        run = Window.partitionBy("label", *[a for a in AXES if a != axis], "_run")
        left = F.min(F.col("d") - at).over(line.rangeBetween(-most, 0)) + at
        right = F.min(F.col("d") + at).over(line.rangeBetween(0, most)) - at
        v = v.withColumn("d", F.least("d", left, right, at - F.min(axis).over(run) + 1, F.max(axis).over(run) - at + 1)).drop("_run")
    return v


def snap_to_gradient(vol: DataFrame, gradient: DataFrame, dims: Triple, most: int = 6) -> DataFrame:
    """Erodes each label 0 to ``most`` times and keeps the erosion whose outermost ring has the highest mean
    gradient (ties: the fewest erosions). Ring k holds voxels whose distance to the outside is k by faces."""
    ring = written(inward_distance(vol, most + 2).withColumn("ring", F.col("d") - 1), "rings")
    mean = ring.where(F.col("ring") <= most).join(gradient.select(*AXES, F.col("value").alias("_g")), AXES).groupBy("label", "ring").agg(F.avg("_g").alias("g"))
    best = mean.withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("g"), "ring"))).where("_r = 1").select("label", F.col("ring").alias("_keep"))
    return ring.join(best, "label").where("ring >= _keep").select(*AXES, "label")
