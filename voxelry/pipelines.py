"""The two segmentation pipelines, as compositions of operators. Every step that is read more than once is written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.graph import written
from .operators import components as C
from .operators import kernels as K
from .operators import labels as L
from .operators import project as P
from .operators import regions as R
from .operators import stats as S
from .operators import watershed as W
from .operators.labels import AXES

Triple = tuple[int, int, int]
#: Steps of the 2D pipeline that can be left out.
STEPS_2D = ("normalise", "filter", "properties", "sheaths", "statistics")


def pipeline_2d(
    vol: DataFrame, dims: Triple, dataset: DataFrame, low: float = 0.52, high: float = 0.62, min_area: int = 3, max_eccentricity: float = 0.99, threshold: float = 2.0, block: Triple = (8, 32, 32), steps: tuple[str, ...] = STEPS_2D
) -> dict[str, DataFrame]:
    """normalise -> masks -> components_2d -> property_filter -> property volumes -> sheaths -> statistics.

    Tables by name: ``objects`` (z, y, x, label), ``properties`` (z, y, x, label, area, eccentricity), ``sheaths``
    (z, y, x, label) and ``statistics`` (z, label, area, diameter, eccentricity, sheath). ``steps`` names those that
    are done; without ``filter`` all components are objects, without ``sheaths`` their area is null."""
    if odd := set(steps) - set(STEPS_2D):
        raise ValueError(f"no such steps: {sorted(odd)}")
    v = written(P.normalize_minmax(vol), "p2d-normal") if "normalise" in steps else vol
    cores = P.threshold_mask(v, high, 1.0).where("value").select(*AXES)
    tissue = P.threshold_mask(v, low, 1.0).where("value").select(*AXES)
    flat = written(C.components(cores, 8, dims), "p2d-components")
    found = {"objects": flat}
    if "filter" in steps:
        stats = S.slicewise_stats(flat, frame=False)
        keep = R.property_filter(stats, min_area=min_area, max_eccentricity=max_eccentricity)
        found["objects"] = written(L.forward_map(flat, keep).where("label <> 0"), "p2d-objects")
    good = found["objects"]
    stats = written(S.slicewise_stats(good, frame=False), "p2d-statistics")
    if "properties" in steps:
        area, eccentricity = (R.property_volume(good, stats, c).withColumnRenamed("value", c) for c in ("area", "eccentricity"))
        found["properties"] = written(good.select(*AXES, "label").join(area, AXES).join(eccentricity, AXES), "p2d-properties")
    if "sheaths" in steps:
        found["sheaths"] = written(W.separate_sheaths(good, tissue, dataset, dims, threshold, block=block), "p2d-sheaths")
    if "statistics" in steps:
        out = stats.select("z", "label", "area", F.round("diameter", 6).alias("diameter"), F.round("eccentricity", 6).alias("eccentricity"))
        if "sheaths" in found:
            sheath = found["sheaths"].groupBy("z", "label").agg(F.count("*").alias("sheath"))
            found["statistics"] = out.join(sheath, ["z", "label"], "left").na.fill(0, ["sheath"])
        else:
            found["statistics"] = out.withColumn("sheath", F.lit(None).cast("bigint"))
    return found


def pipeline_3d(
    vol: DataFrame, dims: Triple, dataset: DataFrame, core: float = 158, tissue: float = 140, dice: float = 0.5, min_size: int = 4, ratio: float = 0.5, longer_than: int = 1, threshold: float = 1.5, block: Triple = (8, 32, 32), inside: L.Held = None
) -> dict[str, DataFrame]:
    """masks -> 3D core -> traversing split -> 2D aggregation -> merge -> hole filling -> nodes -> sheaths -> statistics.

    Objects of the 3D core that don't traverse the volume are joined anew, by slices of the wider tissue mask. Holes
    that an object encloses go to it; stretches of slices whose rim the tissue covers below ``ratio`` are nodes and
    get no sheath. Tables by name: ``joined`` (before holes are filled), ``objects``, ``nodes``, ``sheaths`` (z, y, x,
    label) and ``statistics`` (label, source, n, slices, traversing, nodes, sheath, g_ratio). ``inside`` tells what the
    volume holds of ``dims``, if not all."""
    labels3 = written(R.filter_small_labels(C.components(vol.where(F.col("value") > core), 26, dims), min_size).where("label <> 0"), "p3d-core")
    classes = written(L.classify_traversing(labels3, dims, min_size, 1), "p3d-classes")
    through = labels3.join(classes.where("traversing").select("label"), "label", "left_semi").select(*AXES, "label")
    wide = vol.where(F.col("value") > tissue).select(*AXES)
    flat = written(C.components(wide.join(through.select(*AXES), AXES, "left_anti"), 8, dims), "p3d-flat")
    merged = L.forward_map(flat, L.merge_slice_labels(flat, dice))
    merged = R.filter_small_labels(merged, min_size).where("label <> 0")
    top = dims[0] * dims[1] * dims[2]  # labels of slices stand above those of the core
    both = written(through.unionByName(merged.select(*AXES, (F.col("label") + top).alias("label"))), "p3d-joined")
    objects = written(K.fill_holes_capped(both, dims), "p3d-objects")
    cover = wide.unionByName(objects.select(*AXES)).distinct()
    nodes, rest = (written(x.select(*AXES, "label"), "p3d-nodes") for x in W.detect_unsheathed(objects, cover, dims, ratio, longer_than, inside))
    sheaths = written(W.separate_sheaths(rest, wide.join(objects.select(*AXES), AXES, "left_anti"), dataset, dims, threshold, block=block), "p3d-sheaths")
    count = lambda t, name: t.groupBy("label").agg(F.count("*").alias(name))
    sizes = objects.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("z").alias("slices"))
    kinds = L.classify_traversing(objects, dims).select("label", "traversing")
    out = sizes.join(kinds, "label").join(count(nodes, "nodes"), "label", "left").join(count(sheaths, "sheath"), "label", "left").na.fill(0, ["nodes", "sheath"])
    source = F.when(F.col("label") > top, "slices").otherwise("core")
    own = F.col("n") - F.col("nodes")
    g = F.when(own > 0, F.sqrt(own / (own + F.col("sheath"))))
    return {"joined": both, "objects": objects, "nodes": nodes, "sheaths": sheaths, "statistics": out.select("label", source.alias("source"), "n", "slices", "traversing", "nodes", "sheath", F.round(g, 6).alias("g_ratio"))}
