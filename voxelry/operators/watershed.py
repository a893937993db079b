"""Seeds, flooding of labels, sheaths and nodes."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.graph import discard, written

from .components import components
from .kernels import block_distance, flood, whole_watershed
from .labels import AXES, FACES, Held, forward_map, label_union
from .regions import consecutive_runs, filter_small_labels, region_bbox, relabel_sequential
from .stencil import binary_dilate, distance_transform, label_rim, local_maxima, near_distance

Triple = tuple[int, int, int]
#: Labels up to which a table with a row a label is broadcast to voxels; with more of them, voxels are shuffled to it.
FEW_LABELS = 1 << 17


def by_voxel(v: DataFrame) -> DataFrame:
    """A table of voxels that joins must not broadcast: its files are so small beside its rows (a byte for eight voxels) that
    Spark takes a volume for a small table and gathers it on the driver."""
    return v.hint("merge")


def label_ends(vol: DataFrame) -> DataFrame:
    """(label, z0, z1): each label's first and last slice, written."""
    return written(vol.where("label <> 0").groupBy("label").agg(F.min("z").alias("z0"), F.max("z").alias("z1")), "label-ends")


def threshold_seeds(vol: DataFrame, dims: Triple, lower: float, upper: float, min_size: int = 0) -> DataFrame:
    """Face-connected components of a threshold band, without small ones, renumbered."""
    c = written(components(vol.where((F.col("value") > lower) & (F.col("value") <= upper)), 6, dims), "seeds")
    c = filter_small_labels(c, min_size) if min_size else c
    return relabel_sequential(c.where("label <> 0"))


def end_slice_seeds(vol: DataFrame, end: str = "last", reach: int = 5, margin: int = 5, cylinder: int | None = None, span: DataFrame | None = None) -> DataFrame:
    """(label, z, y, x, seed) in each label's search box beyond its end: the label on its end slice, -1 around it
    there, 0 elsewhere; within ``cylinder`` of the end's centroid, if given. ``span`` is the volume's label_ends(), if at hand."""
    span = label_ends(vol) if span is None else span
    tip = F.col("z1") if end == "last" else F.col("z0")
    first, last = (tip, tip + reach) if end == "last" else (tip - reach, tip)
    own = vol.where("label <> 0").select("label", *AXES)
    ends = span.select("label", first.alias("a"), last.alias("b"), tip.alias("tip"))
    on_tip = own.join(F.broadcast(ends) if span.count() <= FEW_LABELS else by_voxel(ends), "label").where("z = tip")
    frame = on_tip.groupBy("label", "a", "b", "tip").agg(*[f(c).alias(f"{c}{i}") for c in ("y", "x") for i, f in ((0, F.min), (1, F.max))], F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    cells = frame.withColumn("z", F.explode(F.sequence(F.greatest("a", F.lit(0)), "b")))
    for c in ("y", "x"):
        cells = cells.withColumn(c, F.explode(F.sequence(F.greatest(F.col(f"{c}0") - margin, F.lit(0)), F.col(f"{c}1") + margin)))
    if cylinder is not None:
        cells = cells.where((F.col("y") - F.col("cy")) ** 2 + (F.col("x") - F.col("cx")) ** 2 <= cylinder**2)
    hit = on_tip.select("label", *AXES, F.lit(True).alias("_own"))
    seed = F.when(F.col("_own"), F.col("label")).when(F.col("z") == F.col("tip"), F.lit(-1)).otherwise(F.lit(0))
    return cells.join(by_voxel(hit), ["label", *AXES], "left").select("label", *AXES, seed.cast("bigint").alias("seed"))


def flood_boxes(boxes: DataFrame, value: DataFrame, mask: DataFrame | None = None, part: str | None = None) -> DataFrame:
    """(label, z, y, x): each label's box (label, z, y, x, seed) flooded from its seeds over ``value``; what the
    label itself reached. If a label has several boxes, the int column ``part`` tells them apart, in the result too."""
    keys = ["label", part] if part else ["label"]
    b = boxes.join(by_voxel(value.select(*AXES, F.col("value").cast("double").alias("value"))), AXES)
    b = b.join(by_voxel(mask.select(*AXES)), AXES, "left_semi") if mask is not None else b

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        lo = np.array([p[a].min() for a in AXES])
        at = tuple(p[a].to_numpy() - o for a, o in zip(AXES, lo))
        shape = tuple(a.max() + 1 for a in at)
        v, s, m = np.full(shape, np.inf), np.zeros(shape, np.int64), np.zeros(shape, bool)
        v[at], s[at], m[at] = p.value, p.seed, True
        z, y, x = np.nonzero(flood(v, s, m) == key[0])
        return pd.DataFrame({**dict(zip(keys, key)), "z": z + lo[0], "y": y + lo[1], "x": x + lo[2]})

    return b.groupBy(*keys).applyInPandas(run, f"label bigint, {part + ' int, ' if part else ''}z int, y int, x int")


def merge_by_watershed(vol: DataFrame, value: DataFrame, reach: int = 5, margin: int = 5, min_size: int = 1, rounds: int = 5) -> DataFrame:
    """(label, new_label): in rounds on a frozen volume, each label is flooded beyond both ends; the candidate it
    covers most (not itself, at least ``min_size`` voxels, disjoint in z) joins it; then all joins at once, until
    nothing changes. ``rounds`` is a bound; reaching it without rest raises."""
    total = vol.where("label <> 0").select("label").distinct().withColumn("new_label", F.col("label"))
    current, made = vol, []
    for _ in range(rounds):
        span = label_ends(current)
        boxes = [end_slice_seeds(current, end, reach, margin, span=span).withColumn("up", F.lit(up)) for up, end in enumerate(("first", "last"))]
        grown = flood_boxes(reduce(DataFrame.unionByName, boxes), value, part="up")
        there = by_voxel(current.where("label <> 0").select(*AXES, F.col("label").alias("other")))
        hit = grown.join(there, AXES).where("label <> other").groupBy("label", "up", "other").agg(F.count("*").alias("n")).where(F.col("n") >= min_size)
        pairs = hit.join(span, "label").join(span.select(F.col("label").alias("other"), F.col("z0").alias("o0"), F.col("z1").alias("o1")), "other")
        pairs = pairs.where("o0 > z1 OR o1 < z0").withColumn("_r", F.row_number().over(Window.partitionBy("label").orderBy(F.desc("n"), "other"))).where("_r = 1")
        joined = written(pairs.select(F.col("label").alias("a"), F.col("other").alias("b")), "merge-pairs")
        if joined.isEmpty():
            discard(span, joined, *made[:1])
            return total
        m = label_union(joined)
        total = written(total.join(m.select(F.col("label").alias("new_label"), F.col("new_label").alias("_n")), "new_label", "left").select("label", F.coalesce("_n", "new_label").alias("new_label")), "merge-map")
        current = written(forward_map(current, m), "merge-volume")
        discard(span, joined, *made)
        made = [current, total]
    raise RuntimeError(f"labels still join after {rounds} rounds")


def bridge_label_gaps(pieces: DataFrame, value: DataFrame, margin: int = 5) -> DataFrame:
    """(label, z, y, x) of new voxels: (z, y, x, label, piece) pieces of a label in z order; the gap between two
    consecutive ones is flooded from the first one's last slice, and kept if it meets the second one."""
    span = pieces.groupBy("label", "piece").agg(F.min("z").alias("z0"), F.max("z").alias("z1"))
    after = Window.partitionBy("label").orderBy("z0", "piece")
    gap = span.withColumn("next", F.lead("piece").over(after)).withColumn("until", F.lead("z0").over(after)).where("until > z1 + 1")
    ends = pieces.join(gap.select("label", "piece", "z1", "until", "next"), ["label", "piece"]).where("z = z1")
    frame = ends.groupBy("label", "piece", "z1", "until", "next").agg(*[f(c).alias(f"{c}{i}") for c in ("y", "x") for i, f in ((0, F.min), (1, F.max))])
    cells = frame.withColumn("z", F.explode(F.sequence("z1", "until")))
    for c in ("y", "x"):
        cells = cells.withColumn(c, F.explode(F.sequence(F.greatest(F.col(f"{c}0") - margin, F.lit(0)), F.col(f"{c}1") + margin)))
    own = ends.select("piece", *AXES, F.lit(True).alias("_own"))
    cells = cells.join(own, ["piece", *AXES], "left").withColumn("seed", F.when(F.col("_own"), F.col("piece")).when(F.col("z") == F.col("z1"), -1).otherwise(0).cast("bigint"))
    grown = written(flood_boxes(cells.select(F.col("piece").alias("label"), *AXES, "seed"), value), "bridges").withColumnRenamed("label", "piece")
    met = grown.join(pieces.select(*AXES, F.col("piece").alias("next")), AXES).join(gap.select("piece", "next"), ["piece", "next"], "left_semi").select("piece").distinct()
    return grown.join(met, "piece", "left_semi").join(gap.select("label", "piece", "z1", "until"), "piece").where("z > z1 AND z < until").select("label", *AXES)


def extend_to_border(vol: DataFrame, value: DataFrame, dims: Triple, reach: int = 5, margin: int = 5) -> DataFrame:
    """(label, z, y, x) of new voxels towards the first or last slice, for labels that end within ``reach`` of it."""
    box = region_bbox(vol)
    out = []
    for end, near in (("first", (F.col("z0") > 0) & (F.col("z0") <= reach)), ("last", (F.col("z1") < dims[0]) & (F.col("z1") >= dims[0] - reach))):
        close = vol.join(box.where(near).select("label"), "label", "left_semi")
        grown = flood_boxes(end_slice_seeds(close, end, reach, margin).where(F.col("z") < dims[0]), value)
        out.append(grown)
    return reduce(DataFrame.unionByName, out).join(vol.where("label <> 0").select(*AXES), AXES, "left_anti").distinct()


def sheath_mask(distance: DataFrame, tissue: DataFrame, dataset: DataFrame, threshold: float, ring: DataFrame | None = None) -> DataFrame:
    """Voxels nearer than a threshold (or in a dilation ring), in the tissue mask and the dataset mask."""
    near = ring.select(*AXES) if ring is not None else distance.where(F.col("value") <= threshold).select(*AXES)
    return near.join(tissue.select(*AXES), AXES, "left_semi").join(dataset.select(*AXES), AXES, "left_semi")


def separate_sheaths(objects: DataFrame, tissue: DataFrame, dataset: DataFrame, dims: Triple, threshold: float, elsize=(1, 1, 1), block: Triple = (64, 256, 256)) -> DataFrame:
    """(z, y, x, label): each sheath voxel goes to the object whose flood over the distance map reaches it first."""
    core = objects.where("label <> 0").select(*AXES, "label")
    # nothing farther than the threshold takes part; where it is wider than a block, lines are cheaper than halos
    near = threshold <= 16 * min(map(abs, elsize))
    d = written(block_distance(core, dims, threshold, elsize) if near else distance_transform(core, dims, elsize), "distance")
    sheath = sheath_mask(d.where("value > 0"), tissue, dataset, threshold)
    space = d.where("value = 0").unionByName(d.join(sheath, AXES, "left_semi"))
    grown = whole_watershed(space, core, dims, block)
    return grown.join(sheath, AXES, "left_semi")


def _own_distance(points: DataFrame, objects: DataFrame, dims: Triple, reach: float, elsize=(1, 1, 1)) -> DataFrame:
    """(label, z, y, x, value): exact distance of each point to its label's object, however far; points without an
    object have no row. Points look in the cells around their own, cells twice as wide in every round."""
    own = written(label_rim(objects, dims, outer=False), "surface")
    left = written(points.select("label", *AXES).join(own.select("label").distinct(), "label", "left_semi"), "far")
    done = []
    while not left.isEmpty():
        cell = {a: F.floor(F.col(a) * abs(e) / reach) for a, e in zip(AXES, elsize)}
        around = [F.explode(F.sequence(cell[a] - 1, cell[a] + 1)).alias(f"c{a}") for a in AXES]
        near = left
        for c in around:
            near = near.select("*", c)
        cells = own.select("label", *[F.col(a).alias(f"o{a}") for a in AXES], *[cell[a].alias(f"c{a}") for a in AXES])
        d = F.sqrt(sum(((F.col(a) - F.col(f"o{a}")) * float(e)) ** 2 for a, e in zip(AXES, elsize)))
        got = near.join(cells, ["label", "cz", "cy", "cx"]).groupBy("label", *AXES).agg(F.min(d).alias("value")).where(F.col("value") <= reach)
        done.append(written(got, "far-found"))
        left, reach = written(left.join(done[-1], ["label", *AXES], "left_anti"), "far"), 2 * reach
    return reduce(DataFrame.unionByName, done) if done else points.select("label", *AXES, F.lit(0.0).alias("value")).limit(0)


def sheath_width(objects: DataFrame, sheaths: DataFrame, dims: Triple, radius: float, elsize=(1, 1, 1)) -> DataFrame:
    """(label, width): exact median, over a sheath's outer rim, of the distance to its object. ``radius`` is where
    the cheap search ends; the few rim voxels beyond it are searched one by one."""
    rim = label_rim(sheaths, dims, outer=False)
    core = objects.where("label <> 0").select("label", *AXES)
    d = written(rim.join(near_distance(core, dims, radius, elsize), ["label", *AXES], "left"), "rim")
    far = _own_distance(d.where("value IS NULL"), core, dims, 2 * max(radius, *map(abs, elsize)), elsize)
    return d.where("value IS NOT NULL").unionByName(far.select(*d.columns)).groupBy("label").agg(F.median("value").alias("width"))


def sigmoid_distance(objects: DataFrame, widths: DataFrame, dims: Triple, weight: float, elsize=(1, 1, 1)) -> DataFrame:
    """(z, y, x, value, near): the least over labels of 2 (sigmoid(d / (weight width)) - 1/2); near if any label's d is
    below 1.5 widths. For every voxel of the volume, however far, with a distance transform for each width."""
    core = objects.where("label <> 0").select("label", *AXES)
    sized = core.join(widths, "label").select(F.col("width").cast("double").alias("width"), *AXES)
    d = distance_transform(sized, dims, elsize, "width")
    s = 2 * (1 / (1 + F.exp(-F.col("value") / (F.lit(weight) * F.col("width")))) - 0.5)
    return d.groupBy(*AXES).agg(F.least(F.min(s), F.lit(1.0)).alias("value"), F.max(F.col("value") < 1.5 * F.col("width")).alias("near"))


def inner_compartment(filled: DataFrame, widths: DataFrame, dims: Triple, elsize=(1, 1, 1), inside: Held = None) -> DataFrame:
    """(z, y, x, label, part): a filled object less half its median width is the inner part, the rest its sheath.
    Distances are searched as far as half the largest width."""
    reach = (widths.agg(F.max("width")).first()[0] or 0.0) / 2
    f = filled.where("label <> 0").select(*AXES, "label")
    outside = label_rim(f, dims, inside=inside)
    d = near_distance(outside.select("label", *AXES), dims, reach, elsize)
    j = f.join(d, ["label", *AXES], "left").join(widths, "label")
    return j.select(*AXES, "label", F.when(F.coalesce("value", F.lit(float("inf"))) > F.col("width") / 2, "inner").otherwise("sheath").alias("part"))


def rim_coverage(vol: DataFrame, mask: DataFrame, dims: Triple, inside: Held = None) -> DataFrame:
    """(label, z, ratio): share of a label's outer in-plane rim, per slice, that a mask covers."""
    rim = label_rim(vol, dims, element=[o for o in FACES if o[0] == 0], inside=inside)
    return rim.join(mask.select(*AXES, F.lit(1).alias("_m")), AXES, "left").groupBy("label", "z").agg(F.avg(F.coalesce("_m", F.lit(0))).alias("ratio"))


def detect_unsheathed(vol: DataFrame, mask: DataFrame, dims: Triple, ratio: float, longer_than: int, inside: Held = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and the rest: slices where the rim is covered below a ratio, in runs longer than asked."""
    bare = rim_coverage(vol, mask, dims, inside).where(F.col("ratio") < ratio)
    runs = consecutive_runs(bare, longer_than)
    slices = runs.select("label", F.explode(F.sequence("z0", "z1")).alias("z"))
    v = vol.where("label <> 0")
    return v.join(slices, ["label", "z"], "left_semi"), v.join(slices, ["label", "z"], "left_anti")


def spot_detection(vol: DataFrame, dims: Triple, element: list[Triple], threshold: float, low: float, least: int = 3, block: Triple = (64, 256, 256)) -> DataFrame:
    """Spots: maxima above a threshold are markers, voxels above ``low`` are flooded from them, brightest first, and
    spots under ``least`` voxels dropped."""
    peaks = local_maxima(vol, element, dims, threshold)
    marks = components(peaks, 26, dims)
    space = vol.where(F.col("value") > low)
    spots = written(whole_watershed(space, marks, dims, block, invert=True), "spots")
    return filter_small_labels(spots, least).where("label <> 0")
