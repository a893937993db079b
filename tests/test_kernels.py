"""Kernels and what floods, against plain numpy written anew: no code is shared with the library."""

import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelry import pipelines
from voxelry.operators import classify, register, stencil, supervoxels
from voxelry.operators import kernels as K
from voxelry.operators import watershed as W
from voxelry.plans.all import registry
from voxelry.plans.views import Views

SF = "/root/testdata/sf0.001"
FACES = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0)]
FULL = [o for o in itertools.product((-1, 0, 1), repeat=3) if any(o)]
FLAT8 = [o for o in FULL if o[0] == 0]


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


@pytest.fixture(scope="module")
def vox(v):
    return array(v.vox, v.dims, "value")


def frame(spark, a, column="label"):
    kind = "bigint" if column == "label" else "double"
    rows = [(int(z), int(y), int(x), (int if column == "label" else float)(a[z, y, x])) for z, y, x in np.ndindex(a.shape)]
    return spark.createDataFrame(rows, f"z int, y int, x int, {column} {kind}")


def array(df, shape, column="label"):
    p = df.toPandas()
    out = np.zeros(shape, float)
    out[p.z, p.y, p.x] = p[column].astype(float)
    return out


def inside(q, shape):
    return all(0 <= a < n for a, n in zip(q, shape))


def pieces(mask, offsets):
    """Components named by 1 + their smallest linear index."""
    out = np.zeros(mask.shape, np.int64)
    for p in zip(*np.nonzero(mask)):
        if out[p]:
            continue
        name = int(np.ravel_multi_index(p, mask.shape)) + 1
        out[p], todo = name, [p]
        while todo:
            p0 = todo.pop()
            for o in offsets:
                q = tuple(int(a + b) for a, b in zip(p0, o))
                if inside(q, mask.shape) and mask[q] and not out[q]:
                    out[q] = name
                    todo.append(q)
    return out


def plain_flood(value, seeds, mask):
    """Voxels taken in order of value, then of age; a front sorted anew whenever it is needed."""
    label = np.where(mask, seeds, 0).astype(np.int64)
    levels: dict[float, list] = {}
    for p in zip(*np.nonzero(label)):
        levels.setdefault(float(value[p]), []).append(p)
    while levels:
        lowest = min(levels)
        front = levels[lowest]
        p = front.pop(0)
        if not front:
            del levels[lowest]
        for o in FACES:
            q = tuple(int(a + b) for a, b in zip(p, o))
            if inside(q, mask.shape) and mask[q] and not label[q]:
                label[q] = label[p]
                levels.setdefault(float(value[q]), []).append(q)
    return label


def distances(mask):
    at = np.argwhere(mask)
    cells = np.argwhere(np.ones_like(mask))
    best = np.full(len(cells), np.inf)
    for a in range(0, len(at), 200):
        best = np.minimum(best, ((cells[:, None, :] - at[None, a : a + 200]) ** 2).sum(axis=2).min(axis=1))
    return np.sqrt(best).reshape(mask.shape)


def test_seeded_watershed(v, vox):
    seeds = array(W.threshold_seeds(v.vox, v.dims, 0, 96, 2), v.dims)
    got = array(K.seeded_watershed(v.vox, W.threshold_seeds(v.vox, v.dims, 0, 96, 2), v.dims, block=(10, 25, 32)), v.dims)
    for z, x in itertools.product(range(0, v.dims[0], 10), (0, 32)):
        part = (slice(z, z + 10), slice(0, 25), slice(x, x + 32))
        assert (got[part] == plain_flood(vox[part], seeds[part], np.ones_like(vox[part], bool))).all()


def test_spot_detection(v, vox):
    got = array(W.spot_detection(v.vox, v.dims, stencil.structuring_element("box", 1), 160, 140), v.dims)
    p = np.pad(vox, 1, constant_values=-1)
    top = np.max([p[1 + a : p.shape[0] - 1 + a, 1 + b : p.shape[1] - 1 + b, 1 + c : p.shape[2] - 1 + c] for a, b, c in itertools.product((-1, 0, 1), repeat=3)], axis=0)
    marks = pieces((vox == top) & (vox > 160), FULL)
    expected = plain_flood(-vox, marks, vox > 140)
    name, n = np.unique(expected, return_counts=True)
    expected[np.isin(expected, name[n < 3])] = 0
    assert (got == expected).all() and len(np.unique(got)) > 5


def test_separate_sheaths_and_pipeline_2d(v, vox):
    found = pipelines.pipeline_2d(v.vox, v.dims, v.mask_ds)
    norm = (vox - vox.min()) / (vox.max() - vox.min())
    flat = pieces(norm > 0.62, FLAT8)
    good, stats = np.zeros_like(flat), {}
    for z in range(v.dims[0]):
        for name in np.unique(flat[z][flat[z] > 0]):
            y, x = np.nonzero(flat[z] == name)
            if len(y) < 3:
                continue
            low, high = np.linalg.eigvalsh(np.cov(np.array([y, x]), bias=True))
            e = math.sqrt(max(0.0, 1 - low / high))
            if e <= 0.99:
                good[z][flat[z] == name] = name
                stats[z, int(name)] = (len(y), round(e, 5))
    assert (array(found["objects"], v.dims) == good).all()
    rows = found["statistics"].collect()
    assert len(rows) == len(stats)
    assert all(r.area == stats[r.z, r.label][0] and abs(r.eccentricity - stats[r.z, r.label][1]) < 2e-5 for r in rows)
    d = distances(good > 0)
    dataset = array(v.mask_ds.withColumn("label", F.lit(1)), v.dims) > 0
    sheath = (d <= 2.0) & (norm > 0.52) & dataset & (good == 0)
    expected = np.where(sheath, plain_flood(d, good, sheath | (good > 0)), 0)
    got = array(found["sheaths"], v.dims)
    assert (got == expected).all() and (got > 0).sum() > 100
    assert {(r.z, r.label): r.sheath for r in rows} == {(z, n): int((expected[z] == n).sum()) for z, n in stats}
    painted = found["properties"].collect()
    assert len(painted) == int((good > 0).sum()) and all(r.area == stats[r.z, r.label][0] for r in painted)


def test_pipeline_2d_steps(v):
    found = pipelines.pipeline_2d(v.vox.withColumn("value", F.col("value") / 255.0), v.dims, v.mask_ds, steps=("statistics",))
    assert set(found) == {"objects", "statistics"} and found["statistics"].where("sheath IS NOT NULL").isEmpty() and not found["objects"].isEmpty()
    with pytest.raises(ValueError):
        pipelines.pipeline_2d(v.vox, v.dims, v.mask_ds, steps=("sheeths",))


def test_pipeline_3d(v, vox):
    found = pipelines.pipeline_3d(v.vox, v.dims, v.mask_ds)
    objects, nodes, sheaths = (array(found[k], v.dims).astype(np.int64) for k in ("objects", "nodes", "sheaths"))
    top = vox.size
    core = pieces(vox > 158, FULL)
    name, n = np.unique(core[core > 0], return_counts=True)
    big = set(name[n >= 4].tolist())
    from_core = {int(x) for x in np.unique(objects) if 0 < x <= top}
    assert from_core <= big  # a core object stands under its component's name, and all of it does
    for x in from_core:
        assert (objects[core == x] == x).all()
    assert (vox[(objects > 0)] > 140).mean() > 0.8  # the rest filled holes
    assert (objects[nodes > 0] == nodes[nodes > 0]).all()
    assert not (objects[sheaths > 0] > 0).any() and (vox[sheaths > 0] > 140).all()
    dataset = array(v.mask_ds.withColumn("label", F.lit(1)), v.dims) > 0
    assert dataset[sheaths > 0].all()
    d = distances((objects > 0) & (nodes == 0))
    assert (d[sheaths > 0] <= 1.5).all()
    for r in found["statistics"].collect():
        own = objects == r.label
        assert r.n == own.sum() and r.slices == own.any(axis=(1, 2)).sum() and r.nodes == (nodes == r.label).sum() and r.sheath == (sheaths == r.label).sum()
        assert r.source == ("slices" if r.label > top else "core")
        if r.n > r.nodes:
            assert r.g_ratio == pytest.approx(math.sqrt((r.n - r.nodes) / (r.n - r.nodes + r.sheath)), abs=1e-5)
    assert {r.label for r in found["statistics"].collect()} == set(np.unique(objects[objects > 0]).tolist())


def tube(gap, shape=(16, 9, 9)):
    """A bright path of one label in two pieces; the dark valley goes on through the gap."""
    rng = np.random.default_rng(3)
    value = 50 + rng.integers(0, 20, shape).astype(float)
    value[:, 3:6, 3:6] = rng.integers(1, 9, (shape[0], 3, 3))
    label = np.zeros(shape, np.int64)
    label[:5, 3:6, 3:6] = 1
    label[5 + gap : 12, 3:6, 3:6] = 2
    return value, label


def end_box(label, own, last, reach, margin):
    """A label's box beyond one end with its seeds, as (slices, seeds)."""
    z = np.nonzero((label == own).any(axis=(1, 2)))[0]
    tip = int(z.max() if last else z.min())
    y, x = np.nonzero(label[tip] == own)
    a, b = (tip, min(label.shape[0] - 1, tip + reach)) if last else (max(0, tip - reach), tip)
    box = (slice(a, b + 1), slice(max(0, y.min() - margin), y.max() + 1 + margin), slice(max(0, x.min() - margin), x.max() + 1 + margin))
    seeds = np.zeros_like(label[box])
    seeds[tip - a] = np.where(label[box][tip - a] == own, own, -1)
    return box, seeds


def test_bridge_label_gaps(spark):
    value, label = tube(4)
    rows = frame(spark, label).where("label <> 0").select("z", "y", "x", F.lit(7).cast("bigint").alias("label"), F.col("label").alias("piece"))
    got = {(r.z, r.y, r.x) for r in W.bridge_label_gaps(rows, frame(spark, value, "value"), 2).collect()}
    box, seeds = end_box(label, 1, True, 5, 2)
    flooded = plain_flood(value[box], seeds, np.ones_like(seeds, bool)) == 1
    expected = {tuple(int(a + s.start) for a, s in zip(p, box)) for p in np.argwhere(flooded)}
    assert got == {p for p in expected if 4 < p[0] < 9} and len(got) >= 4 * 9


def test_extend_to_border(spark):
    value, label = tube(4)
    label[label == 1] = 0
    got = {(r.z, r.y, r.x) for r in W.extend_to_border(frame(spark, label), frame(spark, value, "value"), label.shape, 5, 2).collect()}
    box, seeds = end_box(label, 2, True, 5, 2)
    flooded = plain_flood(value[box], seeds, np.ones_like(seeds, bool)) == 2
    expected = {tuple(int(a + s.start) for a, s in zip(p, box)) for p in np.argwhere(flooded)}
    assert got == {p for p in expected if not label[p]} and any(p[0] == 15 for p in got)


@pytest.mark.parametrize("gap, joined", [(3, True), (9, False)])
def test_merge_by_watershed(spark, gap, joined):
    value, label = tube(gap, (20, 9, 9))
    if not joined:
        label[label == 2] = 0
        label[15:, 3:6, 3:6] = 2
    got = {r.label: r.new_label for r in W.merge_by_watershed(frame(spark, label), frame(spark, value, "value"), 4, 1, 3, 5).collect()}
    # by hand: what each end's flood covers of the other label, which lies beyond it
    covers = any((plain_flood(value[box], seeds, np.ones_like(seeds, bool)) == own)[label[box] == other].sum() >= 3 for own, other, last in ((1, 2, True), (2, 1, False)) for box, seeds in [end_box(label, own, last, 4, 1)])
    assert covers == joined and (got[1] == got[2]) == joined


def test_merge_by_watershed_broadcasts_no_voxels(spark, tmp_path, monkeypatch):
    """A volume in small files is a large table: joins by voxel have no side that is gathered on the driver."""
    value, label = tube(3, (20, 9, 9))
    frame(spark, label).write.parquet(f"{tmp_path}/label")
    frame(spark, value, "value").write.parquet(f"{tmp_path}/value")
    vol, over = spark.read.parquet(f"{tmp_path}/label"), spark.read.parquet(f"{tmp_path}/value")
    plans, write = [], W.written
    monkeypatch.setattr(W, "written", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    run = lambda: {r.label: r.new_label for r in W.merge_by_watershed(vol, over, 4, 1, 3, 5).collect()}
    got = run()
    assert got[1] == got[2]
    keys = [re.findall(r"input\[", x) for plan in plans for x in re.findall(r"HashedRelationBroadcastMode\(List\((.*)\),", plan)]
    assert keys and all(len(k) < 3 for k in keys)
    # tables of labels are broadcast as long as these are few
    monkeypatch.setattr(W, "FEW_LABELS", 0)
    assert run() == got


def slow_step(u, step, rho, contrast):
    """One step of tensor diffusion, a voxel at a time."""
    shape = u.shape
    clip = lambda p: tuple(min(max(a, 0), n - 1) for a, n in zip(p, shape))
    move = lambda p, a, d: clip(tuple(x + d * (i == a) for i, x in enumerate(p)))

    def smooth(w):
        for a in range(3):
            w = {p: (w[move(p, a, -1)] + 2 * w[p] + w[move(p, a, 1)]) / 4 for p in w}
        return w

    cells = {p: float(u[p]) for p in np.ndindex(shape)}
    s = smooth(cells)
    slope = lambda w, p, a: (w[move(p, a, 1)] - w[move(p, a, -1)]) / 2
    j = {}
    for a in range(3):
        for b in range(3):
            w = {p: slope(s, p, a) * slope(s, p, b) for p in cells}
            for _ in range(rho):
                w = smooth(w)
            j[a, b] = w
    tensor = {}
    for p in cells:
        value, vector = np.linalg.eigh(np.array([[j[a, b][p] for b in range(3)] for a in range(3)]))
        across = 1 - math.exp(-3.31488 / max(value[2] / contrast**2, 1e-12) ** 4)
        tensor[p] = np.eye(3) - (1 - across) * np.outer(vector[:, 2], vector[:, 2])
    out = np.array(u, float)
    for p in cells:
        for a in range(3):
            for d in (-1, 1):
                q = tuple(x + d * (i == a) for i, x in enumerate(p))
                if inside(q, shape):
                    flux = (tensor[p][a, a] + tensor[q][a, a]) / 2 * (cells[q] - cells[p])
                    flux += d * sum((tensor[p][a, b] * slope(cells, p, b) + tensor[q][a, b] * slope(cells, q, b)) / 2 for b in range(3) if b != a)
                    out[p] += step * flux
    return out


def test_diffusion_against_voxels(spark):
    rng = np.random.default_rng(1)
    u = rng.normal(100, 20, (4, 5, 6))
    u[:, :, 3:] += 200
    expected = slow_step(slow_step(u, 0.1, 1, 20.0), 0.1, 1, 20.0)
    assert np.allclose(K.diffuse(u, 0.2, 0.1, 1, 20.0), expected, atol=1e-8)
    whole = array(K.diffusion_smooth(frame(spark, u, "value"), u.shape, u.shape, 0.2, 0.1, 1), u.shape, "value")
    parts = array(K.diffusion_smooth(frame(spark, u, "value"), u.shape, (2, 3, 3), 0.2, 0.1, 1), u.shape, "value")
    assert np.allclose(whole, expected, atol=1e-8) and np.allclose(parts, expected, atol=1e-8)


def test_diffusion_in_blocks_for_any_number_of_steps(spark):
    """Halos smaller and larger than a block, exchanged after one step and after several; the tensor is no identity."""
    rng = np.random.default_rng(3)
    u = rng.normal(100, 20, (3, 21, 26))
    u[:, :, 12:] += 60
    assert np.abs(K.diffusion_tensor(u, 1, 4.0) - np.eye(3)).max() > 0.9
    for steps, every, size in ((1, 4, (2, 6, 7)), (7, 1, (3, 5, 9)), (7, 3, (1, 8, 8))):
        expected = K.diffuse(u, steps * 0.1, 0.1, 1, 4.0)
        got = array(K.diffusion_smooth(frame(spark, u, "value"), u.shape, size, steps * 0.1, 0.1, 1, 4.0, every), u.shape, "value")
        assert np.allclose(got, expected, atol=1e-9)


def test_diffusion_query_smooths_along_edges_only(spark, v, vox):
    """The registered query against the whole volume, and unlike the linear smoothing that it would be without the tensor."""
    got = array(registry.found["diffusion_smooth"](spark, SF), v.dims, "value")
    assert np.abs(got - K.diffuse(vox, 0.6, 0.1, 1.0, 4.0)).max() < 1e-4
    assert np.abs(got - K.diffuse(vox, 0.6, 0.1, 1.0, 1e9)).max() > 1


def test_diffusion_keeps_edges_and_mean():
    rng = np.random.default_rng(2)
    u = rng.normal(0, 5, (6, 16, 16))
    u[:, :, 8:] += 200
    out = K.diffuse(u, 2.0, 0.1, 1, 30.0)
    assert abs(out.mean() - u.mean()) < 1e-9
    assert out[:, :, :7].std() < 0.5 * u[:, :, :7].std()  # noise goes
    assert (out[:, :, 8] - out[:, :, 7]).mean() > 150  # the edge stays
    turned = K.diffuse(u.transpose(2, 0, 1), 2.0, 0.1, 1, 30.0).transpose(1, 2, 0)
    assert np.allclose(out, turned, atol=1e-6)
    assert np.allclose(K.diffuse(np.full((3, 4, 5), 7.0), 1.0, 0.1, 1, 10.0), 7.0)


def test_near_distance_on_an_anisotropic_grid(spark):
    rng = np.random.default_rng(4)
    label = np.where(rng.random((7, 9, 11)) < 0.03, rng.integers(1, 4, (7, 9, 11)), 0)
    size, reach = (3.0, 0.5, 0.7), 2.6
    got = {(r.label, r.z, r.y, r.x): r.value for r in stencil.near_distance(frame(spark, label).where("label <> 0"), label.shape, reach, size).collect()}
    expected = {}
    for own in (1, 2, 3):
        at = np.argwhere(label == own) * size
        for p in np.ndindex(label.shape):
            d = np.sqrt(((np.array(p) * size - at) ** 2).sum(axis=1)).min()
            if d <= reach:
                expected[(own, *map(int, p))] = d
    assert got.keys() == expected.keys() and all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_wide_sheaths(spark):
    """Widths over 10: distances are searched as far as they ask."""
    label = np.ones((3, 31, 31), np.int64)
    label[:, 0, :] = label[:, -1, :] = label[:, :, 0] = label[:, :, -1] = 0
    widths = spark.createDataFrame([(1, 24.0)], "label bigint, width double")
    parts = {(r.z, r.y, r.x): r.part for r in W.inner_compartment(frame(spark, label), widths, label.shape).collect()}
    for (_, y, x), part in parts.items():
        assert part == ("inner" if min(y, x, 30 - y, 30 - x) > 12 else "sheath")
    core = np.zeros((1, 1, 60), np.int64)
    core[0, 0, 0] = 1
    far = {r.x: (r.value, r.near) for r in W.sigmoid_distance(frame(spark, core), widths, core.shape, 0.5).collect()}
    assert len(far) == 60 and all(abs(value - 2 * (1 / (1 + math.exp(-x / 12.0)) - 0.5)) < 1e-9 and near == (x < 36) for x, (value, near) in far.items())


def test_map_labels_in_blocks(spark):
    """A local kernel gives the same in blocks as on whole labels, however large they are."""
    rng = np.random.default_rng(5)
    label = np.zeros((6, 14, 15), np.int64)
    label[:, 2:12, 1:14] = 1
    label[rng.random(label.shape) < 0.2] = 0
    element = stencil.structuring_element("ball", 1)
    kernel = lambda label, mask, lo: K.closing(mask, element)
    rows = lambda df: sorted(map(tuple, df.collect()))
    vol = frame(spark, label)
    assert rows(K.map_labels(vol, kernel, 3, label.shape, block=(4, 5, 4))) == rows(K.map_labels(vol, kernel, 3, label.shape))
    with pytest.raises(ValueError):
        K.map_labels(vol, kernel, 3, block=(4, 5, 4))


def pieces_of(label):
    """Face-connected pieces of each label, as lists of voxels."""
    seen, out = set(), []
    for p in zip(*(a.tolist() for a in np.nonzero(label))):
        if p in seen:
            continue
        seen.add(p)
        piece = [p]
        for q in piece:
            for o in FACES:
                r = tuple(a + b for a, b in zip(q, o))
                if all(0 <= a < n for a, n in zip(r, label.shape)) and r not in seen and label[r] == label[p]:
                    seen.add(r)
                    piece.append(r)
        out.append((int(label[p]), piece))
    return out


def test_join_pieces_leaves_one_piece_a_label(spark):
    rng = np.random.default_rng(12)
    for least in (0, 5):
        label = rng.integers(0, 4, (4, 8, 9)).repeat(2, axis=2)
        got = array(supervoxels.join_pieces(frame(spark, label), label.shape, least), label.shape).astype(int)
        assert ((got > 0) == (label > 0)).all()
        after = pieces_of(got)
        assert len({v for v, _ in after}) == len(after)  # a piece a label
        before = pieces_of(label)
        largest = {v: max((p for w, p in before if w == v), key=lambda p: (len(p), [-x for x in p[0]])) for v in (1, 2, 3)}
        for v, p in largest.items():  # stays where it was
            assert {int(got[q]) for q in p} == {v}
        alone = [p for _, p in after if got[p[0]] > 3]
        for p in alone:  # touches nothing
            assert not any(all(0 <= a + b < n for a, b, n in zip(q, o, got.shape)) and got[tuple(a + b for a, b in zip(q, o))] not in (0, got[q]) for q in p for o in FACES)


def test_join_pieces_takes_the_longest_face(spark):
    label = np.array([[[1, 1, 1, 3, 2, 2], [1, 1, 1, 3, 2, 2], [1, 1, 1, 1, 2, 2], [3, 3, 3, 3, 3, 3]]])
    got = array(supervoxels.join_pieces(frame(spark, label), label.shape), label.shape)
    assert got[0, :2, 3].tolist() == [1, 1] and (got[0, 3] == 3).all()  # three faces with 1, two with 2


def test_supervoxels_with_channels_sigma_and_spacing(spark, v):
    rng = np.random.default_rng(3)
    u = rng.normal(50, 10, (4, 8, 8))
    one = frame(spark, u, "value")
    two = one.withColumn("other", F.col("value") * 0)
    plain = array(supervoxels.supervoxels(one, u.shape, (2, 4, 4), 5.0, 2), u.shape)
    assert (array(supervoxels.supervoxels(two, u.shape, (2, 4, 4), 5.0, 2, channels=("value", "other")), u.shape) == plain).all()
    assert (array(supervoxels.supervoxels(two.withColumn("other", F.col("x") * 100.0), u.shape, (2, 4, 4), 5.0, 2, channels=("value", "other")), u.shape) != plain).any()
    smooth = stencil.gaussian_smooth(one, u.shape, (2.0, 1.0, 1.0), (2.0, 1.0, 1.0))
    expected = array(supervoxels.supervoxels(smooth, u.shape, (2, 4, 4), 5.0, 2, elsize=(2.0, 1.0, 1.0)), u.shape)
    got = array(supervoxels.supervoxels(one, u.shape, (2, 4, 4), 5.0, 2, sigma=(2.0, 1.0, 1.0), elsize=(2.0, 1.0, 1.0)), u.shape)
    assert (got == expected).all()
    rows = registry.found["supervoxels_connected"](spark, SF).collect()
    assert len(rows) > 5 and all(r.pieces == 1 for r in rows) and sum(r.n for r in rows) == v.dims[0] * 25 * 16


def test_supervoxels_cover_a_sparse_mask(spark):
    rng = np.random.default_rng(6)
    value = rng.integers(0, 255, (6, 12, 12)).astype(float)
    vol, mask = frame(spark, value, "value"), frame(spark, (value > 235).astype(int)).where("label = 1")
    got = supervoxels.supervoxels(vol, value.shape, (2, 2, 2), 1.0, 4, mask).collect()
    assert {(r.z, r.y, r.x) for r in got} == {tuple(map(int, p)) for p in np.argwhere(value > 235)}


def rings(spark, n, seed):
    """Two classes on rings around one centre: no line parts them."""
    rng = np.random.default_rng(seed)
    turn, truth = rng.uniform(0, 2 * np.pi, n), rng.integers(0, 2, n)
    r = 20 + 30 * truth + rng.normal(0, 3, n)
    rows = [(i, float(a), float(b), int(t)) for i, (a, b, t) in enumerate(zip(100 + r * np.cos(turn), 80 + r * np.sin(turn), truth))]
    return spark.createDataFrame([*rows, (n, None, 1.0, 1), (n + 1, float("nan"), 1.0, 0)], "label bigint, area double, mean double, truth int")


def test_kernel_classifier_on_two_rings(spark, tmp_path):
    train, test = rings(spark, 600, 1), rings(spark, 400, 2)
    share = lambda model: model.transform(test).where("truth = prediction").count() / 400
    assert share(classify.train_object_classifier(train, ["area", "mean"], "svc")) < 0.75
    model = classify.train_object_classifier(train, ["area", "mean"])
    assert share(model) > 0.95 and len(model.landmarks) <= classify.LANDMARKS
    model.save(spark, f"file://{tmp_path}/model")
    again = classify.KernelModel.load(spark, f"file://{tmp_path}/model")
    key = lambda m: sorted((r.label, r.decision) for r in m.transform(test).collect())
    assert key(again) == key(model)
    # the decision as its formula says it
    x = np.array([[r.area, r.mean] for r in test.orderBy("label").limit(50).collect()]) / again.scale
    d = np.exp(-again.gamma * ((x[:, None] - again.landmarks[None]) ** 2).sum(axis=2)) @ again.weights + again.intercept
    assert np.allclose(d, [v for _, v in key(model)[:50]])
    with pytest.raises(ValueError):
        classify.train_object_classifier(train.where("area IS NULL"), ["area", "mean"])


def test_classifier_and_rules(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(a), float(m), int(a + 2 * m > 150)) for i, (a, m) in enumerate(zip(rng.uniform(0, 100, 300), rng.uniform(0, 100, 300)))]
    data = spark.createDataFrame([*rows, (999, None, 5.0, 0)], "label bigint, area double, mean double, truth int")
    for kind in ("kernel", "svc", "forest"):
        model = classify.train_object_classifier(data, ["area", "mean"], kind)
        got = {r.label: r.inside for r in classify.predict_objects(model, data).collect()}
        assert 999 not in got and sum(got[i] == bool(t) for i, _, _, t in rows) >= 0.93 * len(rows)
        ruled = {r.label: r.inside for r in classify.predict_objects(model, data, bright=90, large=95).collect()}
        assert all(ruled[i] == (False if a > 95 else True if m > 90 else got[i]) for i, a, m, _ in rows)


def test_joint_fit_on_spark(spark):
    """The same transforms whatever the groups that tiles are eliminated in."""
    rng = np.random.default_rng(8)
    true = {t: (0.03 * t, 2.0 * t, -1.0 * t) for t in range(4)}
    rows = []
    for a, b in ((0, 1), (1, 2), (2, 3), (0, 2)):
        for x, y in rng.uniform(-20, 20, (12, 2)).tolist():
            own = []
            for t in (a, b):
                th, tx, ty = true[t]
                own += [math.cos(th) * (x - tx) + math.sin(th) * (y - ty), -math.sin(th) * (x - tx) + math.cos(th) * (y - ty)]
            rows.append((a, b, 1.0, *own))
    matches = spark.createDataFrame(rows, "t1 bigint, t2 bigint, w double, sx double, sy double, dx double, dy double")
    start = spark.createDataFrame([(t, 0.8 * th, 0.8 * x, 0.8 * y) for t, (th, x, y) in true.items()] + [(9, 0.5, 1.0, 2.0)], "tile bigint, theta double, tx double, ty double")
    for group in (256, 2):
        got = {r.tile: (r.theta, r.tx, r.ty) for r in register.optimize_transforms(matches, start, tolerance=1e-6, group=group, widen=2).collect()}
        assert all(got[t] == pytest.approx(true[t], abs=1e-4) for t in true) and got[9] == (0.5, 1.0, 2.0)
    with pytest.raises(RuntimeError):
        register.optimize_transforms(matches, start, rounds=1, tolerance=1e-12)


def test_elimination_equals_a_dense_solve(spark):
    """Levels of groups on a ladder of tiles with cross links, a tile that nothing holds, and one that is fixed."""
    rng = np.random.default_rng(5)
    n, rows = 60, []
    pairs = [(a, a + d) for a in range(n - 4) for d in (1, 2, 3) if rng.random() < 0.8]
    h, g = np.zeros((3 * n, 3 * n)), np.zeros(3 * n)
    for a, b in pairs:
        j = rng.normal(size=(8, 6))
        m, r = j.T @ j, rng.normal(size=6)
        at = np.r_[3 * a : 3 * a + 3, 3 * b : 3 * b + 3]
        h[np.ix_(at, at)] += m
        g[at] += r
        if rng.random() < 0.5:  # pairs the other way round
            a, b, order = b, a, np.r_[3:6, 0:3]
            m, r = m[np.ix_(order, order)], r[order]
        rows.append((a, b, *[float(m[p, q]) for p in range(6) for q in range(p, 6)], *map(float, r)))
    names = [f"h{p}{q} double" for p in range(6) for q in range(p, 6)] + [f"g{p} double" for p in range(6)]
    blocks = spark.createDataFrame(rows, "t1 bigint, t2 bigint, " + ", ".join(names))
    free = np.repeat([t != 7 for t in range(n)], 3)
    expected = np.zeros(3 * n)
    expected[free] = np.linalg.lstsq(h[np.ix_(free, free)], -g[free], rcond=None)[0]
    for group, widen in ((64, 64), (5, 3)):
        got = np.zeros(3 * n)
        for r in register._solved(blocks, 7, n, group, widen).collect():
            got[3 * r.tile : 3 * r.tile + 3] = r.x
        assert np.allclose(got, expected, atol=1e-7)


def test_joint_fit_of_a_long_chain_takes_few_jobs(spark):
    n = 4096
    e = spark.range(n - 1).select(F.col("id").alias("t1"), (F.col("id") + 1).alias("t2"), F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (9.0, 1.0), (2.0, 8.0))])).alias("p"))
    pose = lambda t: (F.col(t) % 16 * 0.02, F.col(t) % 16 * 3.0, -(F.col(t) % 16) * 1.0)
    for i, t in (("s", "t1"), ("d", "t2")):
        th, tx, ty = pose(t)
        px, py = F.col("p.x") - tx, F.col("p.y") - ty
        e = e.withColumns({f"{i}x": F.cos(th) * px + F.sin(th) * py, f"{i}y": -F.sin(th) * px + F.cos(th) * py})
    k = F.col("tile") % 16
    start = spark.range(n).select(F.col("id").alias("tile")).select("tile", (k * 0.0199).alias("theta"), (k * 2.99).alias("tx"), (k * -0.99).alias("ty"))
    before = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    t = register.optimize_transforms(e.select("t1", "t2", F.lit(1.0).alias("w"), "sx", "sy", "dx", "dy"), start, tolerance=1e-5)
    far = t.select(F.max(F.greatest(F.abs(F.col("theta") - k * 0.02), F.abs(F.col("tx") - k * 3.0), F.abs(F.col("ty") + k))).alias("far")).first().far
    jobs = spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs() - before
    assert far < 1e-3 and jobs < 5 * 60


def test_descriptors_in_tiles(spark, monkeypatch):
    rng = np.random.default_rng(9)
    rows = [(g, i, rng.integers(0, 4, 3).astype(float).tolist()) for g in (0, 1) for i in range(60)]
    d = spark.createDataFrame(rows, "group int, id bigint, vec array<double>")
    a, b = d.where("id % 2 = 0"), d.where("id % 2 = 1")
    expected = set()
    for g in (0, 1):
        p = {i: np.array(vec) for h, i, vec in rows if h == g}
        near = lambda i, odd: min(((p[i] - p[j]) @ (p[i] - p[j]), j) for j in p if j % 2 == odd)  # noqa: E731, B023
        expected |= {(i, near(i, 1)[1], round(math.sqrt(near(i, 1)[0]), 9)) for i in p if i % 2 == 0 and near(near(i, 1)[1], 0)[1] == i}
    for tile in (1024, 7):
        monkeypatch.setattr(register, "TILE", tile)
        assert {(r.id_a, r.id_b, round(r.distance, 9)) for r in register.match_descriptors(a, b).collect()} == expected


def test_descriptors_in_clusters_compare_few_pairs(spark):
    """Exact, with repeated vectors and ties, at a tenth of all pairs."""
    rng = np.random.default_rng(10)
    centres = rng.normal(0, 100, (30, 6))
    x = np.round(10 * (centres[rng.integers(0, 30, 1600)] + rng.normal(0, 1, (1600, 6))))  # whole, so that ties are
    x[100:140] = x[:40]
    rows = [(i % 2, i, v) for i, v in enumerate(x.tolist())]
    d = spark.createDataFrame(rows, "group int, id bigint, vec array<double>")
    a, b = d.where("id % 4 < 2"), d.where("id % 4 >= 2")
    compared = 0
    for found, own, other in zip(register.nearest_descriptors(a, b), ((0, 1), (2, 3)), ((2, 3), (0, 1))):
        got = {r.id: (r.other, r.distance) for r in found.collect()}
        compared += found.agg(F.sum("pairs")).first()[0]
        for i in range(1600):
            if i % 4 in own:
                near = [j for j in range(1600) if j % 4 in other and j % 2 == i % 2]
                far = ((x[near] - x[i]) ** 2).sum(axis=1)
                assert got[i] == (near[int(far.argmin())], far.min())
    assert compared < 0.1 * 2 * 2 * 400 * 400
    assert register.match_descriptors(a.limit(0), b).isEmpty() and register.match_descriptors(a, b.limit(0)).isEmpty()


def test_descriptors_leave_python_once(spark, monkeypatch):
    """A row an asked descriptor, whatever the number of cells it visits."""
    rng, tables = np.random.default_rng(12), []
    rows = [(0, i, vec) for i, vec in enumerate(rng.normal(0, 1, (200, 16)).tolist())]
    d = spark.createDataFrame(rows, "group int, id bigint, vec array<double>")
    keep = register.written
    monkeypatch.setattr(register, "written", lambda df, name: tables.append((name, keep(df, name))) or tables[-1][1])
    register.match_descriptors(d.where("id % 2 = 0"), d.where("id % 2 = 1")).count()
    visits = [t for name, t in tables if name == "descriptor-visits"]
    assert len(visits) == 4 and all(t.count() == t.select("id").distinct().count() == 100 for t in visits)
    assert max(t.agg(F.max(F.size("visited"))).first()[0] for t in visits) > 10


def test_crop_opens_only_its_blocks(v, tmp_path):
    from voxelry.operators.project import crop
    from voxelry.sources.volumes import metadata, read_volume, write_volume

    path = f"file://{tmp_path}/vol"
    assert write_volume(v.vox, metadata(v.spark, "vox", (2.0, 1.0, 1.0)), path, (5, 10, 32)) == "WRITTEN"
    vol, meta = read_volume(v.spark, path)
    part = crop(vol, tuple(meta.first().block), z=(6, 9, 1), y=(0, 0, 1), x=(40, 50, 1))
    assert part.count() == 3 * 25 * 10
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bz" in plan.split("PartitionFilters: [")[1].split("]")[0]
    # a slab replaces its blocks; metadata and block size stay
    write_volume(v.vox.where("z < 5").withColumn("value", F.lit(1)), metadata(v.spark, "other"), path, (5, 10, 32))
    vol, meta = read_volume(v.spark, path)
    assert meta.first().elsize[0] == 2.0 and vol.count() == v.vox.count() and vol.where("z < 5 AND value <> 1").isEmpty()
    with pytest.raises(ValueError):
        write_volume(v.vox, metadata(v.spark, "vox"), path, (4, 10, 32))


def test_shared_folder(spark):
    from voxelry.functions import graph

    class Conf:
        get = staticmethod(lambda name, default=None: default)

    class Remote:
        conf = Conf

        class sparkContext:
            master, applicationId = "spark://host:7077", "x"

    with pytest.raises(ValueError):
        graph.shared_dir(Remote)
    t = graph.written(spark.range(3).toDF("a"), "gone")
    assert t.count() == 3
    graph.discard(t, spark.range(1))
    with pytest.raises(Exception, match="."):
        t.count()
