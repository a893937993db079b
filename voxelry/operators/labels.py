"""Joins and set operations on label volumes, and their overlap tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.graph import connected_components
from voxelry.functions.ranking import global_rank

AXES = ["z", "y", "x"]
#: What a volume holds of its dims: all (None), what a condition on the axes admits, or listed voxels or lines.
Held = Column | DataFrame | None


def _zero():
    return F.lit(0).cast("bigint")


def held(v: DataFrame, inside: Held) -> DataFrame:
    """Rows at voxels that the volume holds. A table lists voxels, or lines by the axes that it has."""
    if inside is None:
        return v
    return v.where(inside) if isinstance(inside, Column) else v.join(inside, [a for a in AXES if a in inside.columns], "left_semi")


def forward_map(vol: DataFrame, mapping: DataFrame, from_empty: bool = False, delete: DataFrame | None = None) -> DataFrame:
    """Replaces labels by (label, new_label). Unmapped labels stay, or become 0 with ``from_empty``; labels in
    ``delete`` become 0; 0 stays 0. Spark broadcasts the map if it is small and shuffles otherwise."""
    m = mapping.where("label <> 0").select("label", F.col("new_label").alias("_new"))
    if delete is not None:
        m = m.join(delete.select("label").distinct(), "label", "left_anti").unionByName(delete.select("label", _zero().alias("_new")).distinct())
    other = _zero() if from_empty else F.col("label")
    return vol.join(m, "label", "left").withColumn("label", F.when(F.col("label") == 0, _zero()).otherwise(F.coalesce("_new", other))).drop("_new").select(*vol.columns)


def combine_labels(a: DataFrame, b: DataFrame, method: str = "add") -> DataFrame:
    """add: b where it isn't 0, else a; subtract: a where b is 0; mask: a where b isn't 0."""
    both = a.select(*AXES, F.col("label").alias("_a")).join(b.select(*AXES, F.col("label").alias("_b")), AXES, "full")
    x, y = F.coalesce("_a", _zero()), F.coalesce("_b", _zero())
    value = {"add": F.when(y != 0, y).otherwise(x), "subtract": F.when(y == 0, x).otherwise(_zero()), "mask": F.when(y != 0, x).otherwise(_zero())}[method]
    return both.select(*AXES, value.alias("label"))


def slice_overlap(vol: DataFrame, offsets: int = 2) -> DataFrame:
    """(z, j, label, other, n) of voxels of slice z and slice z + j, 1 <= j < offsets, both not 0."""
    v = vol.where("label <> 0")
    low = v.select(F.explode(F.sequence(F.lit(1), F.lit(offsets - 1))).alias("j"), "z", "y", "x", "label")
    high = v.select(F.col("z").alias("z2"), "y", "x", F.col("label").alias("other"))
    pairs = low.withColumn("z2", (F.col("z") + F.col("j")).cast("int")).join(high, ["z2", "y", "x"])
    return pairs.groupBy("z", "j", "label", "other").agg(F.count("*").alias("n"))


def delete_labels(vol: DataFrame, listed: DataFrame, keep: DataFrame | None = None) -> DataFrame:
    """Listed labels, except those in ``keep``, become 0."""
    gone = listed.select("label").distinct()
    gone = gone.join(keep.select("label").distinct(), "label", "left_anti") if keep is not None else gone
    return forward_map(vol, gone.withColumn("new_label", _zero()))


def labels_under_mask(vol: DataFrame, mask: DataFrame) -> DataFrame:
    return vol.where("label <> 0").join(mask.select(*AXES), AXES, "left_semi").select("label").distinct()


def filter_by_slice_presence(vol: DataFrame, plane_labels: DataFrame) -> DataFrame:
    """A label stays in slice z only if the 2D volume holds that label in z."""
    there = plane_labels.where("label <> 0").select("z", "label", F.lit(True).alias("_in")).distinct()
    return vol.join(there, ["z", "label"], "left").withColumn("label", F.when(F.col("_in"), F.col("label")).otherwise(_zero())).drop("_in").select(*vol.columns)


def change_volume(before: DataFrame, after: DataFrame) -> DataFrame:
    """Voxels whose label changed, with the new one."""
    return before.select(*AXES, F.col("label").alias("_old")).join(after.select(*AXES, "label"), AXES).where("_old <> label").select(*AXES, "label")


def merge_label_pairs(vol: DataFrame, pairs: DataFrame) -> DataFrame:
    """(keep, drop) pairs; chains end at the smallest label they connect only if the pairs say so: drop -> keep."""
    return forward_map(vol, pairs.select(F.col("drop").alias("label"), F.col("keep").alias("new_label")))


def split_by_aux_volume(vol: DataFrame, aux: DataFrame, labels: DataFrame) -> DataFrame:
    """A listed label's voxels get the auxiliary volume's labels; those that occur in ``vol`` already are
    renumbered from above its largest label."""
    listed = vol.join(labels.select("label").distinct(), "label", "left_semi").select(*AXES, "label")
    inside = listed.select(*AXES).join(aux.where("label <> 0").select(*AXES, F.col("label").alias("_aux")), AXES)
    top = vol.agg(F.max("label").alias("_top"))  # one row
    taken = vol.select(F.col("label").alias("_aux")).distinct()
    used = inside.select("_aux").distinct()
    fresh = global_rank(used.join(taken, "_aux").select("_aux"), "_aux").crossJoin(F.broadcast(top))
    names = fresh.select("_aux", (F.col("_top") + F.col("rank")).alias("_new"))
    names = used.join(names, "_aux", "left").select("_aux", F.coalesce("_new", "_aux").alias("_new"))
    return vol.join(inside.join(names, "_aux").select(*AXES, "_new"), AXES, "left").withColumn("label", F.coalesce("_new", "label")).drop("_new").select(*vol.columns)


def dissolve_nesting(vol: DataFrame, nesting: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(child, parent) table -> a volume where children are their parents, and one of the children alone."""
    m = nesting.select(F.col("child").alias("label"), F.col("parent").alias("new_label"))
    return forward_map(vol, m), forward_map(vol, nesting.select(F.col("child").alias("label"), F.col("child").alias("new_label")), from_empty=True)


def cut_label_ranges(vol: DataFrame, ranges: DataFrame) -> DataFrame:
    """(label, z0, z1): the label is blanked for z0 <= z < z1."""
    slices = ranges.where("z1 > z0").select("label", F.explode(F.sequence("z0", F.col("z1") - 1)).alias("z"), F.lit(True).alias("_cut")).distinct()
    return vol.join(slices, ["label", "z"], "left").withColumn("label", F.when(F.col("_cut"), _zero()).otherwise(F.col("label"))).drop("_cut").select(*vol.columns)


def label_contingency(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, b, n): voxels with label a in one volume and b in the other, both not 0."""
    x, y = a.where("label <> 0").select(*AXES, F.col("label").alias("a")), b.where("label <> 0").select(*AXES, F.col("label").alias("b"))
    return x.join(y, AXES).groupBy("a", "b").agg(F.count("*").alias("n"))


def label_union(edges: DataFrame) -> DataFrame:
    """(label, new_label): everything that (a, b) pairs connect gets its smallest label."""
    return connected_components(edges).select(F.col("node").alias("label"), F.col("component").alias("new_label"))


def union_of_sets(members: DataFrame) -> DataFrame:
    """(key, label) rows of sets -> (label, new_label): sets that share a label become one."""
    first = members.groupBy("key").agg(F.min("label").alias("a"))
    return label_union(members.join(first, "key").select("a", F.col("label").alias("b")))


def _best_dice(overlap: DataFrame, sizes_low: DataFrame, sizes_high: DataFrame, threshold: float) -> DataFrame:
    """Of (z, j, label, other, n): the other label with the most overlap, ties to the smallest, if Dice reaches it."""
    best = F.row_number().over(Window.partitionBy("z", "j", "label").orderBy(F.desc("n"), "other"))
    o = overlap.withColumn("_r", best).where("_r = 1").drop("_r").withColumn("z2", (F.col("z") + F.col("j")).cast("int"))
    o = o.join(sizes_low.select("z", "label", F.col("n").alias("n1")), ["z", "label"])
    o = o.join(sizes_high.select(F.col("z").alias("z2"), F.col("label").alias("other"), F.col("n").alias("n2")), ["z2", "other"])
    return o.where(2 * F.col("n") >= threshold * (F.col("n1") + F.col("n2")))


def merge_slice_labels(vol: DataFrame, threshold: float = 0.5, offsets: int = 2) -> DataFrame:
    """(label, new_label) of slicewise labels joined over slices by best overlap and Dice."""
    sizes = vol.where("label <> 0").groupBy("z", "label").agg(F.count("*").alias("n"))
    pairs = _best_dice(slice_overlap(vol, offsets), sizes, sizes, threshold)
    return label_union(pairs.select(F.col("label").alias("a"), F.col("other").alias("b")))


def merge_end_slices(vol: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The same from each label's first and last slice only, towards the slices outside its extent."""
    v = vol.where("label <> 0")
    ends = v.groupBy("label").agg(F.min("z").alias("first"), F.max("z").alias("last"))
    sizes = v.groupBy("z", "label").agg(F.count("*").alias("n"))
    tip = v.join(ends, "label")
    out = tip.where("z = last").select("label", "z", "y", "x", F.lit(1).alias("j")).unionByName(tip.where("z = first").select("label", "z", "y", "x", F.lit(-1).alias("j")))
    near = v.select(F.col("z").alias("z2"), "y", "x", F.col("label").alias("other"))
    pairs = out.withColumn("z2", (F.col("z") + F.col("j")).cast("int")).join(near, ["z2", "y", "x"]).groupBy("z", "j", "label", "other").agg(F.count("*").alias("n"))
    good = _best_dice(pairs, sizes, sizes, threshold)
    return label_union(good.where("label <> other").select(F.col("label").alias("a"), F.col("other").alias("b")))


SHELL = [(dz, dy, dx) for dz in (-1, 0, 1) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if (dz, dy, dx) != (0, 0, 0)]
FACES = [(0, 0, 1), (0, 1, 0), (1, 0, 0), (0, 0, -1), (0, -1, 0), (-1, 0, 0)]


def shifted(vol: DataFrame, offsets: list[tuple[int, int, int]]) -> DataFrame:
    """A row for each voxel and offset, moved by it."""
    o = F.explode(F.array(*[F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy"), F.lit(c).alias("dx")) for a, b, c in offsets])).alias("_o")
    rest = [c for c in vol.columns if c not in AXES]
    return vol.select("*", o).select(*[(F.col(a) + F.col(f"_o.d{a}")).cast("int").alias(a) for a in AXES], *rest)


def touching(vol: DataFrame, offsets: list[tuple[int, int, int]] | None = None) -> DataFrame:
    """(label, other, n): n voxels of ``other`` lie in the one-voxel shell of ``label``."""
    v = vol.where("label <> 0").select(*AXES, "label")
    shell = shifted(v, offsets or SHELL).distinct()
    return shell.join(v.select(*AXES, F.col("label").alias("other")), AXES).where("label <> other").groupBy("label", "other").agg(F.count("*").alias("n"))


def merge_touching(vol: DataFrame, voxels: int) -> DataFrame:
    """(label, new_label): labels with more than ``voxels`` voxels in another's shell join it."""
    return label_union(touching(vol).where(F.col("n") > voxels).select(F.col("label").alias("a"), F.col("other").alias("b")))


def merge_connected(vol: DataFrame) -> DataFrame:
    """(label, new_label): labels of one face-connected stretch of foreground. Edges between labels are enough: a
    label's own pieces are connected through the other labels' sets as in the voxel graph of pieces."""
    from .components import components

    c = components(vol.where("label <> 0").select(*AXES), 6).select(*AXES, F.col("label").alias("piece"))
    members = vol.where("label <> 0").select(*AXES, "label").join(c, AXES).select(F.col("piece").alias("key"), "label").distinct()
    return union_of_sets(members)


def assign_supervoxels(supervoxels: DataFrame, objects: DataFrame, ratio: float = 0.5, mask_to_object: bool = False) -> DataFrame:
    """Each supervoxel gets the object that holds more than ``ratio`` of its voxels, else 0."""
    size = supervoxels.where("label <> 0").groupBy(F.col("label").alias("a")).agg(F.count("*").alias("size"))
    best = F.row_number().over(Window.partitionBy("a").orderBy(F.desc("n"), "b"))
    m = label_contingency(supervoxels, objects).join(size, "a").where(F.col("n") > ratio * F.col("size")).withColumn("_r", best).where("_r = 1")
    out = forward_map(supervoxels, m.select(F.col("a").alias("label"), F.col("b").alias("new_label")), from_empty=True)
    return combine_labels(out, objects, "mask") if mask_to_object else out


def agglomerate_labelsets(vol: DataFrame, sets: DataFrame, form: str = "all", second: DataFrame | None = None) -> DataFrame:
    """Applies (key, label) sets: ``members`` alone (others 0), ``deleted`` (members become 0) or ``all``."""
    m = sets.select("label", F.col("key").alias("new_label"))
    if form == "deleted":
        out = forward_map(vol, m.withColumn("new_label", _zero()))
    else:
        out = forward_map(vol, m, from_empty=form == "members")
    return forward_map(out, second) if second is not None else out


def merge_by_shared_supervoxel(rows: DataFrame) -> DataFrame:
    """(object, supervoxel) rows -> (label, new_label): objects that share a supervoxel, named after the smallest."""
    return union_of_sets(rows.select(F.col("supervoxel").alias("key"), F.col("object").alias("label")))


def classify_traversing(vol: DataFrame, dims: tuple[int, int, int], min_size: int = 0, min_slices: int = 0) -> DataFrame:
    """(label, bottom, top, side, traversing): which borders a label touches; traversing labels touch exactly two
    of the three classes. Labels smaller or shorter than asked are left out."""
    b = vol.where("label <> 0").groupBy("label").agg(
        F.count("*").alias("n"), (F.max("z") - F.min("z") + 1).alias("slices"), (F.min("z") == 0).alias("bottom"), (F.max("z") == dims[0] - 1).alias("top"),
        ((F.min("y") == 0) | (F.max("y") == dims[1] - 1) | (F.min("x") == 0) | (F.max("x") == dims[2] - 1)).alias("side"),
    )
    touched = reduce(lambda a, c: a + c, [F.col(c).cast("int") for c in ("bottom", "top", "side")])
    return b.where((F.col("n") >= min_size) & (F.col("slices") >= min_slices)).select("label", "bottom", "top", "side", (touched == 2).alias("traversing"))


def reassign_traversing(classes: DataFrame, manual: DataFrame) -> DataFrame:
    """(label, traversing) with the labels of a manual list moved to the other class."""
    moved = manual.select("label").distinct().withColumn("_moved", F.lit(True))
    return classes.join(moved, "label", "left").select("label", F.when(F.col("_moved"), ~F.col("traversing")).otherwise(F.col("traversing")).alias("traversing"))


def split_compartments(vol: DataFrame, others: dict[str, DataFrame], rest: str = "rest") -> DataFrame:
    """(label, class): the first class whose label set holds it, the remainder by difference."""
    left = vol.where("label <> 0").select("label").distinct()
    out = []
    for name, other in others.items():
        own = other.where("label <> 0").select("label").distinct()
        out.append(left.join(own, "label", "left_semi").withColumn("class", F.lit(name)))
        left = left.join(own, "label", "left_anti")
    return reduce(DataFrame.unionByName, [*out, left.withColumn("class", F.lit(rest))])
