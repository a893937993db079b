"""Hand-built volumes with known results."""

import itertools
import math

import numpy as np
import pytest

from voxelry.operators import blocks as B
from voxelry.operators import components as C
from voxelry.operators import kernels as K
from voxelry.operators import labels as L
from voxelry.operators import regions as R
from voxelry.operators import resample as S
from voxelry.operators import stats, stencil, supervoxels
from voxelry.operators import watershed as W


def frame(spark, a, column="label", sparse=False):
    kind = "bigint" if column == "label" else "double"
    rows = [(int(z), int(y), int(x), (int if column == "label" else float)(a[z, y, x])) for z, y, x in np.ndindex(a.shape) if not sparse or a[z, y, x]]
    return spark.createDataFrame(rows, f"z int, y int, x int, {column} {kind}")


def array(df, shape, column="label"):
    out = np.zeros(shape, float)
    for r in df.collect():
        out[r.z, r.y, r.x] = r[column]
    return out


def test_block_reduce_known_values(spark):
    vol = frame(spark, np.arange(36).reshape(3, 3, 4), "value")
    values = lambda size, how: [r.value for r in S.block_reduce(vol, size, how).orderBy("z", "y", "x").collect()]
    assert values((3, 3, 1), "mean") == [16, 17, 18, 19]
    assert values((1, 3, 4), "max") == [11, 23, 35]
    assert values((3, 1, 4), "max") == [27, 31, 35]
    with pytest.raises(ValueError):
        S.reduce_with(vol, (1, 1, 1), "__import__('os')")


def test_connectivity(spark):
    a = np.zeros((1, 4, 4), int)
    a[0, 0, 0] = a[0, 1, 0] = a[0, 2, 1] = a[0, 2, 2] = 1  # two L shapes that touch at a corner
    v = frame(spark, a, sparse=True)
    count = lambda c: C.components(v, c, a.shape, block=(1, 2, 2)).select("label").distinct().count()
    assert (count(4), count(8), count(6), count(26)) == (2, 1, 2, 1)


def test_components_do_not_depend_on_blocks(spark):
    a = np.random.default_rng(0).random((6, 9, 11)) > 0.7
    v = frame(spark, a.astype(int), sparse=True)
    one = {(r.z, r.y, r.x): r.label for r in C.components(v, 26, a.shape).collect()}
    many = {(r.z, r.y, r.x): r.label for r in C.components(v, 26, a.shape, block=(2, 3, 4)).collect()}
    assert one == many and len(one) == a.sum()


def test_euler_number(spark):
    ring = np.ones((3, 3), int)
    ring[1, 1] = 0
    eight = np.ones((3, 5), int)
    eight[1, 1] = eight[1, 3] = 0
    diagonal = np.eye(2, dtype=int)
    for shape, expected in ((ring, 0), (eight, -1), (diagonal, 1)):
        assert R.region_euler_number(frame(spark, shape[None], sparse=True)).first().euler == expected


def test_shape_properties(spark):
    square, cross = np.ones((1, 4, 4), int), np.zeros((1, 3, 3), int)
    cross[0, 1, :] = cross[0, :, 1] = 1
    solid = lambda a: R.region_solidity(frame(spark, a, sparse=True)).first().solidity
    assert solid(square) == 1 and solid(cross) == 1 and solid(np.array([[[1, 1, 1], [1, 0, 0], [1, 0, 0]]])) == 5 / 6
    line = np.zeros((1, 5, 5), int)
    line[0, 2, :] = 1
    assert R.region_eccentricity(frame(spark, line, sparse=True)).first().eccentricity == pytest.approx(1)
    assert R.region_eccentricity(frame(spark, square, sparse=True)).first().eccentricity == pytest.approx(0)
    assert R.region_extent(frame(spark, cross, sparse=True)).first().extent == 5 / 9


def test_hole_filling(spark):
    box = np.ones((5, 5, 5), int)
    box[1:4, 1:4, 1:4] = 0
    a = np.pad(box, 1)
    assert array(K.fill_holes_enclosed(frame(spark, a), a.shape), a.shape).sum() == 125
    open_box = box.copy()
    open_box[0, 2, 2] = 0  # open at the volume's end
    b = np.pad(open_box, [(0, 0), (1, 1), (1, 1)])
    plain = K.map_labels(frame(spark, b), lambda label, mask, lo: K.fill(mask))
    assert array(plain, b.shape).sum() == open_box.sum()
    assert array(K.fill_holes_enclosed(frame(spark, b), b.shape), b.shape).sum() == 125  # not the largest free piece
    assert array(K.fill_holes_capped(frame(spark, b), b.shape), b.shape).sum() == 125


def test_large_labels_are_filled_like_small_ones(spark, monkeypatch):
    rng = np.random.default_rng(7)
    a = np.where(rng.random((5, 7, 8)) > 0.35, np.where(np.arange(8) < 4, 1, 2), 0)
    cross = stencil.structuring_element("ball", 1)
    work = [lambda v: K.fill_holes_closing(v, a.shape, cross), lambda v: K.fill_holes_closing(v, a.shape, cross, True), lambda v: K.fill_holes_capped(v, a.shape)]
    small = [array(f(frame(spark, a)), a.shape) for f in work]
    monkeypatch.setattr(K, "MOST_VOXELS", 20)  # as the driver sees it: every label is large
    monkeypatch.setattr(K, "map_labels", lambda v, *_: v)  # and none goes to a kernel
    assert all((array(f(frame(spark, a)), a.shape) == s).all() and (s > 0).sum() > (a > 0).sum() for f, s in zip(work, small))


def test_split_and_merge_blocks(spark):
    a = np.zeros((4, 8, 8), int)
    a[1:3, 2:6, 2:6] = 1
    v = frame(spark, a)
    split = B.split_blocks(v, a.shape, (4, 4, 4), (0, 2, 2))
    assert (array(B.merge_blocks(split, (4, 4, 4)), a.shape) == a).all()
    unique = B.relabel_blocks(B.split_blocks(v, a.shape, (4, 4, 4), (0, 0, 0)))
    assert sorted(r.label for r in unique.select("label").distinct().collect()) == [0, 1, 2, 3, 4]
    m = B.merge_block_faces(unique.select("z", "y", "x", "label"), (4, 4, 4))
    joined = L.forward_map(unique.select("z", "y", "x", "label"), L.label_union(m.selectExpr("label a", "new_label b")))
    assert (array(joined, a.shape) > 0).sum() == a.sum() and joined.where("label > 0").select("label").distinct().count() == 1


def test_label_union_is_transitive(spark):
    sets = spark.createDataFrame([(1, 1), (1, 2), (2, 3), (2, 4), (3, 2), (3, 3)], "key bigint, label bigint")
    assert {r.label: r.new_label for r in L.union_of_sets(sets).collect()} == {1: 1, 2: 1, 3: 1, 4: 1}
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)], "a bigint, b bigint")
    assert {r.new_label for r in L.label_union(chain).collect()} == {0}


def test_gaps(spark):
    a = np.zeros((20, 1, 1), int)
    a[0:3] = a[4:6] = a[18:20] = 1
    runs = R.consecutive_runs(frame(spark, a, sparse=True)).orderBy("z0").collect()
    assert [(r.z0, r.z1) for r in runs] == [(0, 2), (4, 5), (18, 19)]
    c = R.centreline(frame(spark, a, sparse=True), (1.0, 1.0, 1.0), 5).first()
    assert c.length == 19 and c.gap
    p = C.split_disconnected(frame(spark, a), a.shape, 1)
    assert sorted(r["count"] for r in p.groupBy("label").count().collect()) == [2, 2, 3]


def test_watershed_ridge_and_plateau(spark):
    value = np.array([[[0, 1, 5, 1, 0], [0, 1, 5, 1, 0]]], float)
    seeds = np.zeros(value.shape, int)
    seeds[0, 0, 0], seeds[0, 0, 4] = 1, 2
    got = array(K.seeded_watershed(frame(spark, value, "value"), frame(spark, seeds), value.shape), value.shape)
    assert got[0, :, :2].tolist() == [[1, 1], [1, 1]] and got[0, :, 3:].tolist() == [[2, 2], [2, 2]]
    flat = np.zeros((1, 1, 5))
    assert K.flood(flat, np.array([[[1, 0, 0, 0, 2]]]), np.ones((1, 1, 5), bool)).ravel().tolist() == [1, 1, 1, 2, 2]


def test_flood_across_blocks_is_the_whole_flood(spark):
    rng = np.random.default_rng(5)
    for top, invert in ((1, False), (4, True)):  # ties everywhere
        value = rng.integers(0, top, (4, 9, 10)).astype(float)
        mask = rng.random(value.shape) > 0.25
        seeds = np.where((rng.random(value.shape) > 0.97) & mask, rng.integers(1, 9, value.shape), 0)
        whole = K.flood(-value if invert else value, seeds, mask)
        vol = frame(spark, np.where(mask, value, np.nan), "value").where("NOT isnan(value)")
        for most in (1 << 20, 40, 0):  # pieces whole, some of them, none
            got = K.whole_watershed(vol, frame(spark, seeds, sparse=True), value.shape, (2, 3, 4), invert, most)
            assert (array(got, value.shape) == whole).all()


def test_flood_of_ramps_and_lakes(spark):
    """Paths that rise at every voxel, and levels that are met from two sides at once; keys are compared through all of them."""
    rng = np.random.default_rng(8)
    ramp = np.add.outer(np.zeros((1, 6)), np.arange(30.0)) + rng.integers(0, 2, (1, 6, 30))
    bowl = np.abs(np.arange(30) - 14.5)[None, None, :].repeat(6, axis=1).round()
    for value in (ramp, -bowl):
        seeds = np.zeros(value.shape, int)
        seeds[0, 1, [0, 29]], seeds[0, 4, [3, 20]] = (1, 2), (3, 4)
        whole = K.flood(value, seeds, np.ones(value.shape, bool))
        for most in (1 << 20, 0):
            got = K.whole_watershed(frame(spark, value, "value"), frame(spark, seeds, sparse=True), value.shape, (1, 4, 5), most=most)
            assert (array(got, value.shape) == whole).all()


def test_flood_rounds_do_not_grow_with_blocks(spark, monkeypatch):
    """A corridor of 16 blocks: no block is flooded twice, be it one label's or contested."""
    named, write = [], K.written
    monkeypatch.setattr(K, "written", lambda df, name: (named.append(name), write(df, name))[1])
    value = np.zeros((1, 2, 64))
    for ends in ((1, 0), (1, 2)):
        seeds = np.zeros(value.shape, int)
        seeds[0, 0, 0], seeds[0, 0, 1] = ends
        got = array(K.whole_watershed(frame(spark, value, "value"), frame(spark, seeds, sparse=True), value.shape, (1, 2, 4)), value.shape)
        assert (got == K.flood(value, seeds, np.ones(value.shape, bool))).all()
    assert "flood-faces" not in named


def test_slicewise_frame_is_not_joined(spark):
    """Labels by slices, each cell there once, without a join of the frame; slices are counted from the volume's first."""
    from voxelry.operators.stats import slicewise_stats

    rows = [(3, 0, 0, 0), (4, 0, 0, 7), (4, 0, 1, 7), (6, 1, 1, 7), (5, 2, 2, 9), (8, 3, 3, 0)]
    got = slicewise_stats(spark.createDataFrame(rows, "z int, y int, x int, label bigint"))
    assert {(r.z, r.label): r.area for r in got.collect()} == {(z, n): {(4, 7): 2, (6, 7): 1, (5, 9): 1}.get((z, n)) for z in range(3, 9) for n in (7, 9)}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert got.count() == 12 and "SortMergeJoin" not in plan and "HashJoin" not in plan


def test_grey_windows_by_block(spark, monkeypatch):
    """Windows over block borders, an uneven element, doubles with nulls and NaN, voxels given twice; each voxel moves once for
    each block that it may reach, not once an offset."""
    monkeypatch.setattr(stencil, "BLOCK", (2, 3, 4))
    rng = np.random.default_rng(4)
    dims, element = (5, 7, 9), [(0, 0, 0), (0, 0, 1), (0, -2, 0), (1, 1, -1)]
    rows = [(*map(int, p), [None, float("nan"), float(rng.integers(0, 9))][min(2, int(rng.integers(0, 8)))]) for p in np.argwhere(rng.random(dims) < 0.5)]
    rows += [(*r[:3], float(rng.integers(0, 9))) for r in rows[::5]]
    v = spark.createDataFrame(rows, "z int, y int, x int, value double")
    above = lambda c: (c != c, c)
    for run, pick in ((stencil.grey_dilate, max), (stencil.grey_erode, min)):
        expected = {}
        for q in itertools.product(*map(range, dims)):
            own = [r[3] for r in rows if tuple(a - b for a, b in zip(r[:3], q)) in element]
            if own:
                real = [c for c in own if c is not None]
                expected[q] = str(pick(real, key=above)) if real else "None"
        moved = run(v, element, dims, "value")
        assert {(r.z, r.y, r.x): str(r.value) for r in moved.collect()} == expected
        assert "applyInPandas" in str(moved._jdf.queryExecution().analyzed()) or "FlatMapGroupsInPandas" in str(moved._jdf.queryExecution().analyzed())


def test_sheath_distances_stay_within_the_threshold(spark, monkeypatch):
    """The distances that are written are those of voxels within the threshold of an object, not of the whole volume."""
    a = np.zeros((40, 12, 40), int)
    a[3, 4, 5], a[30, 9, 33] = 1, 2
    tables, write = {}, W.written
    monkeypatch.setattr(W, "written", lambda df, name: tables.setdefault(name, write(df, name)))
    all_ = frame(spark, np.ones_like(a), "value")
    got = array(W.separate_sheaths(frame(spark, a, sparse=True), all_, all_, a.shape, 2.5, (2.0, 1.0, 1.0)), a.shape)
    z, y, x = np.indices(a.shape)
    near = lambda p: np.sqrt(4.0 * (z - p[0]) ** 2 + (y - p[1]) ** 2 + (x - p[2]) ** 2) <= 2.5
    one, two = near((3, 4, 5)), near((30, 9, 33))
    assert (got == np.where(a > 0, 0, one + 2 * two)).all()
    assert tables["distance"].count() == (one | two).sum()


def test_block_floods_with_deep_chains():
    """Two equal ramps of more rises than nested tuples hold, and what a face would send of them."""
    n = 3 * K.MOST_RISES
    value = np.stack([np.arange(n), np.full(n, 1e9), np.arange(n)]).astype(float)[None]
    seeds = np.zeros(value.shape, int)
    seeds[0, 0, 0], seeds[0, 2, 0] = 1, 2
    label, keys = K._flood_keys(value, seeds, np.arange(value.size).reshape(value.shape), value < 1e8, [])
    assert (label[0, 0] == 1).all() and (label[0, 2] == 2).all() and not label[0, 1].any()
    (chain, steps), *_ = keys(np.array([[0], [2], [n - 1]]))
    assert steps == n - 1 and chain[0] == n - 1 and len(chain) == 2 * n + 2 and chain[-1] == 2 * n


def test_flooding_operators_cross_blocks(spark):
    a = np.zeros((1, 3, 12), int)
    a[0, 1, 1] = 1  # an object whose tissue runs on into the next blocks
    objects, all_ = frame(spark, a, sparse=True), frame(spark, np.ones_like(a), "value")
    assert W.separate_sheaths(objects, all_, all_, a.shape, 20.0, block=(1, 3, 4)).count() == a.size - 1
    bright = np.full(a.shape, 10.0)
    bright[0, 1, 2:7] = [20, 30, 20, 20, 20]
    assert W.spot_detection(frame(spark, bright, "value"), a.shape, stencil.structuring_element("box", 1), 25, 15, block=(1, 3, 4)).count() == 5
    walls = np.ones((3, 3, 12), int)
    walls[1, 1, 1:11] = 0  # a tunnel, at one end of it a label
    label = np.zeros_like(walls)
    label[1, 1, 1] = 7
    outer = np.pad(walls, 1)
    got = K.fill_holes_unreachable(frame(spark, np.pad(label, 1), sparse=True), outer.shape, [frame(spark, outer, sparse=True)], (2, 2, 4))
    assert got.where("label = 7").count() == 10


def test_distance_transform(spark):
    one = spark.createDataFrame([(1, 2, 3)], "z int, y int, x int")
    step = (0.05, 0.0073, 0.0073)
    for r in stencil.distance_transform(one, (3, 5, 6), step).collect():
        assert r.value == pytest.approx(math.dist([a * s for a, s in zip((r.z, r.y, r.x), step)], [a * s for a, s in zip((1, 2, 3), step)]))
    assert stencil.distance_transform(one.limit(0), (3, 5, 6)).count() == 0


def test_widths_and_sigmoids_have_no_reach(spark):
    a = np.zeros((2, 3, 14), int)
    a[0, 1, 0], a[1, 2, 3] = 1, 2
    objects, width = frame(spark, a, sparse=True), {1: 5.0, 2: 1.0}
    far = lambda p, label: math.dist(p, np.argwhere(a == label)[0])
    got = W.sigmoid_distance(objects, spark.createDataFrame(list(width.items()), "label bigint, width double"), a.shape, 0.5).collect()
    assert len(got) == a.size
    for r in got:
        d = {k: far((r.z, r.y, r.x), k) for k in width}
        assert r.value == pytest.approx(min(2 / (1 + math.exp(-d[k] / (0.5 * w))) - 1 for k, w in width.items()))
        assert r.near == any(d[k] < 1.5 * w for k, w in width.items())
    line = np.zeros_like(a)
    line[0, 1, 1:] = 1  # all of it is rim, and most of it beyond the radius
    assert W.sheath_width(objects, frame(spark, line, sparse=True), a.shape, 2.5).collect() == [(1, 7.0)]


def test_traversing(spark):
    a = np.zeros((4, 6, 6), int)
    a[:, 2, 2] = 1  # bottom and top
    a[1:3, 3, 3] = 2  # nothing
    a[0:2, 4, 4] = 3  # bottom
    a[0, 0, 5] = 4  # bottom and side
    a[:, 5, 0] = 5  # all three
    got = {r.label: r.traversing for r in L.classify_traversing(frame(spark, a), a.shape).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: False}


def test_unsheathed_runs(spark):
    a = np.zeros((30, 5, 5), int)
    a[:, 2, 2] = 1
    sheath = np.zeros_like(a)
    sheath[:, 1:4, 1:4] = 1
    sheath[8:23] = 0
    sheath[a > 0] = 0
    nodes, rest = W.detect_unsheathed(frame(spark, a), frame(spark, sheath, sparse=True), a.shape, 0.5, 10)
    assert sorted(r.z for r in nodes.collect()) == list(range(8, 23)) and rest.count() == 15


def test_dilation_is_monotone_and_forward_map_idempotent(spark):
    rng = np.random.default_rng(1)
    a = rng.random((3, 6, 6)) > 0.8
    b = a | (rng.random(a.shape) > 0.8)
    grow = lambda m: {tuple(r) for r in stencil.binary_dilate(frame(spark, m.astype(int), sparse=True), stencil.structuring_element("box", 1), a.shape).collect()}
    assert grow(a) <= grow(b)
    lab = frame(spark, rng.integers(0, 9, a.shape))
    m = L.label_union(spark.createDataFrame([(1, 2), (2, 5), (7, 8)], "a bigint, b bigint"))
    once = L.forward_map(lab, m)
    assert sorted(once.collect()) == sorted(L.forward_map(once, m).collect())


def test_closing_and_peaks():
    m = np.zeros((1, 5, 7), bool)
    m[0, 2, [1, 2, 4, 5]] = True
    # a cross can't close the gap in a line, as its tips beside the gap are not in the dilation; an element along it can
    assert K.closing(m, stencil.structuring_element("disk", 1))[0, 2].tolist() == [False, True, True, False, True, True, False]
    assert K.closing(m, [(0, 0, -1), (0, 0, 0), (0, 0, 1)])[0, 2].tolist() == [False, True, True, True, True, True, False]
    assert stats.peaks(np.array([0, 3, 1, 2, 2, 0, 5, 0.0]), 1, 1.0) == [1, 3, 6]
    assert stats.peaks(np.array([0, 3, 1, 2, 2, 0, 5, 0.0]), 3, 1.0) == [1, 6]


def test_inward_distance_is_what_erosions_leave(spark):
    rng = np.random.default_rng(6)
    label = np.where(rng.random((5, 11, 13)) > 0.03, np.arange(13) // 7 + 1, 0)
    expected = np.zeros(label.shape, int)
    for own in (1, 2):
        left, k = np.pad(label == own, 1), 0
        while left.any():
            k += 1
            expected[left[1:-1, 1:-1, 1:-1]] = k
            left = left & np.logical_and.reduce([np.roll(left, s, axis) for axis in range(3) for s in (-1, 1)])
    for most in (9, 2):
        got = array(stencil.inward_distance(frame(spark, label), most), label.shape, "d")
        assert (got == np.minimum(expected, most)).all()


def test_supervoxels_cover_the_volume(spark):
    a = np.random.default_rng(3).integers(0, 255, (2, 8, 8)).astype(float)
    got = supervoxels.supervoxels(frame(spark, a, "value"), a.shape, (2, 4, 4), rounds=2)
    assert got.count() == a.size and got.select("label").distinct().count() <= 4


def test_supervoxels_move_a_voxel_not_its_candidates(spark, monkeypatch):
    """No table of voxels times centres is grouped by voxel."""
    import re

    from voxelry.operators import supervoxels as V

    plans, real = [], V.written
    monkeypatch.setattr(V, "written", lambda df, name: (plans.append(df._jdf.queryExecution().optimizedPlan().toString()), real(df, name))[1])
    vol = frame(spark, np.arange(6 * 8 * 8).reshape(6, 8, 8) % 7)
    out = V.supervoxels(vol.withColumnRenamed("label", "value"), (6, 8, 8), (3, 4, 4), 10.0, 2)
    assert out.count() == 384 and len(plans) == 2
    assert not any(re.search(r"Aggregate \[z#", p) for p in plans)


def test_blended_tiles_join_no_pixels(spark):
    """Beside the transforms, one row a tile, nothing is joined, whatever Spark holds for small."""
    from voxelry.operators import register

    a = np.arange(3 * 5 * 6).reshape(3, 5, 6)
    tiles = frame(spark, a).withColumnsRenamed({"z": "tile", "label": "value"})
    t = spark.createDataFrame([(k, 0.1 * k, 2.25 * k, 1.5 * k) for k in range(3)], "tile int, theta double, tx double, ty double")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = register.blend_tiles(tiles, t, 5, 6)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in plan and plan.count("BroadcastHashJoin") == 1
    got = {(r.y, r.x): r.value for r in out.collect()}
    sums = {}
    for k in range(3):
        c, s = math.cos(0.1 * k), math.sin(0.1 * k)
        for y in range(-5, 15):
            for x in range(-5, 20):
                u, v = (round(w, 9) for w in (c * (x - 2.25 * k) + s * (y - 1.5 * k), -s * (x - 2.25 * k) + c * (y - 1.5 * k)))
                if 0 <= u <= 5 and 0 <= v <= 4:
                    i, j, edge = min(int(u), 4), min(int(v), 3), min(u, v, 5 - u, 4 - v) + 1
                    value = sum(a[k, j + q, i + p] * (u - i if p else 1 - u + i) * (v - j if q else 1 - v + j) for p in (0, 1) for q in (0, 1))
                    old = sums.get((y, x), (0.0, 0.0))
                    sums[y, x] = (old[0] + edge * value, old[1] + edge)
    assert got.keys() == sums.keys()
    assert all(abs(got[p] - n / d) < 1e-9 for p, (n, d) in sums.items())
