"""Kernels that need a dense neighbourhood: on halo blocks or on a label's bounding box, and what is built on them."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voxelry.functions.graph import discard, written

from .blocks import split_blocks
from .components import complement, components
from .labels import AXES, FACES, Held, forward_map, held, shifted

Triple = tuple[int, int, int]
#: The largest bounding box (voxels) that hole filling gives to one kernel call. Larger labels go through joins, with
#: the same result.
MOST_VOXELS = 1 << 27
#: The largest piece that a flood takes whole; it is about ten seconds' work.
MOST_FLOODED = 1 << 20
#: The most rises of a path that a flood keeps as nested tuples.
MOST_RISES = 32


def dense(p: pd.DataFrame, column: str, fill, lo: np.ndarray, shape: tuple) -> np.ndarray:
    out = np.full(shape, fill, np.asarray(p[column]).dtype if not isinstance(fill, float) else float)
    out[tuple(p[a].to_numpy() - o for a, o in zip(AXES, lo))] = p[column].to_numpy()
    return out


def map_blocks(vol: DataFrame, dims: Triple, size: Triple, margin: Triple, kernel: Callable[[np.ndarray], np.ndarray], out: str = "double", column: str = "value", fill=0, inside: Held = None) -> DataFrame:
    """A kernel on each block with its halo, clipped to the volume; the core comes back as (z, y, x, value), at the voxels
    that the volume holds."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        core0 = np.array([k * s for k, s in zip(key, size)])
        core1 = np.minimum(core0 + size, dims)
        lo, hi = np.maximum(core0 - margin, 0), np.minimum(core1 + margin, dims)
        done = kernel(dense(p, column, fill, lo, tuple(hi - lo)))
        part = done[tuple(slice(a - o, b - o) for a, b, o in zip(core0, core1, lo))]
        z, y, x = np.indices(part.shape)
        return pd.DataFrame({"z": z.ravel() + core0[0], "y": y.ravel() + core0[1], "x": x.ravel() + core0[2], "value": part.ravel()})

    return held(split_blocks(vol.select(*AXES, column), dims, size, margin).groupBy("iz", "iy", "ix").applyInPandas(run, f"z int, y int, x int, value {out}"), inside)


def block_distance(mask: DataFrame, dims: Triple, radius: float, elsize=(1, 1, 1), block: Triple = (32, 128, 128)) -> DataFrame:
    """(z, y, x, value): Euclidean distance to the nearest mask voxel, of the voxels within ``radius`` of one. Blocks with a
    halo of the radius, so that a voxel moves once for each block that it may reach; a task holds one block."""
    steps = [abs(float(e)) for e in elsize]
    reach = tuple(min(n - 1, int(radius / e + 1e-9)) for n, e in zip(dims, steps))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        core0 = np.array([k * s for k, s in zip(key, block)])
        core1 = np.minimum(core0 + block, dims)
        lo, hi = np.maximum(core0 - reach, 0), np.minimum(core1 + reach, dims)
        f = np.full(tuple(hi - lo), np.inf)
        f[tuple(p[a].to_numpy() - o for a, o in zip(AXES, lo))] = 0.0
        for axis in (2, 1, 0):
            g, n = f.copy(), f.shape[axis]
            to, at = np.moveaxis(g, axis, 0), np.moveaxis(f, axis, 0)
            for d in range(1, min(reach[axis], n - 1) + 1):
                far = steps[axis] * steps[axis] * (d * d)
                np.minimum(to[d:], at[:-d] + far, out=to[d:])
                np.minimum(to[:-d], at[d:] + far, out=to[:-d])
            f = g
        value = np.sqrt(f[tuple(slice(a - o, b - o) for a, b, o in zip(core0, core1, lo))])
        z, y, x = np.nonzero(value <= radius)
        return pd.DataFrame({"z": z + core0[0], "y": y + core0[1], "x": x + core0[2], "value": value[z, y, x]})

    return split_blocks(mask.select(*AXES), dims, block, reach).groupBy("iz", "iy", "ix").applyInPandas(run, "z int, y int, x int, value double")


def map_labels(vol: DataFrame, kernel: Callable[[int, np.ndarray, np.ndarray], np.ndarray], margin: int = 0, dims: Triple | None = None, block: Triple | None = None) -> DataFrame:
    """(z, y, x, label): a kernel (label, mask, origin) -> mask on each label's bounding box with a margin.

    With a ``block`` (and ``dims``) a label of any size is done: the kernel gets the label's part of each halo block,
    and the core comes back. That is the same for a kernel that looks no farther than ``margin`` from a voxel; without
    a block one call holds a label's whole box."""
    kind = "z int, y int, x int, label bigint"
    fore = vol.where("label <> 0").select(*AXES, "label")

    def found(label: int, p: pd.DataFrame, lo: np.ndarray, hi: np.ndarray) -> pd.DataFrame:
        mask = np.zeros(tuple(hi - lo), bool)
        mask[tuple(p[a].to_numpy() - o for a, o in zip(AXES, lo))] = True
        z, y, x = np.nonzero(kernel(label, mask, lo))
        return pd.DataFrame({"z": z + lo[0], "y": y + lo[1], "x": x + lo[2], "label": label})

    def whole(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        lo = np.array([p[a].min() - margin for a in AXES])
        hi = np.array([p[a].max() + 1 + margin for a in AXES])
        if dims:
            lo, hi = np.maximum(lo, 0), np.minimum(hi, dims)
        return found(int(key[0]), p, lo, hi)

    def part(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        core0 = np.array([k * s for k, s in zip(key[1:], block)])
        core1 = np.minimum(core0 + block, dims)
        out = found(int(key[0]), p, np.maximum(core0 - margin, 0), np.minimum(core1 + margin, dims))
        return out[np.logical_and.reduce([(out[a] >= c) & (out[a] < d) for a, c, d in zip(AXES, core0, core1)])]

    if block is None:
        return fore.groupBy("label").applyInPandas(whole, kind)
    if dims is None:
        raise ValueError("blocks are cut from a volume of known dims")
    return split_blocks(fore, dims, block, (margin,) * 3).groupBy("label", "iz", "iy", "ix").applyInPandas(part, kind)


def flood(value: np.ndarray, seeds: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Seeded watershed by faces inside a mask: voxels are taken in order of value, then of age; seeds enter in
    ascending linear order, neighbours in the order -z -y -x +x +y +z."""
    label = np.where(mask, seeds, 0).ravel()
    shape, v, ok = value.shape, value.ravel(), mask.ravel()
    strides = (shape[1] * shape[2], shape[2], 1)
    heap = [(v[i], n, i) for n, i in enumerate(np.flatnonzero(label).tolist())]
    heapq.heapify(heap)
    age = len(heap)
    while heap:
        _, _, i = heapq.heappop(heap)
        at = (i // strides[0], i // strides[1] % shape[1], i % shape[2])
        for axis, sign in ((0, -1), (1, -1), (2, -1), (2, 1), (1, 1), (0, 1)):
            if 0 <= at[axis] + sign < shape[axis]:
                j = i + sign * strides[axis]
                if ok[j] and not label[j]:
                    label[j] = label[i]
                    heapq.heappush(heap, (v[j], age, j))
                    age += 1
    return label.reshape(shape)


def seeded_watershed(vol: DataFrame, seeds: DataFrame, dims: Triple, mask: DataFrame | None = None, block: Triple = (64, 256, 256), margin: Triple = (0, 0, 0), invert: bool = False) -> DataFrame:
    """(z, y, x, label) flooded from seeds in order of value (or from the highest down) inside a mask,
    independently per block; relabel_blocks and merge_block_overlap join the blocks."""
    v = vol.select(*AXES, F.col("value").cast("double").alias("value"))
    v = v.join(seeds.where("label <> 0").select(*AXES, F.col("label").alias("_s")), AXES, "left")
    v = v.join(mask.select(*AXES, F.lit(True).alias("_m")), AXES, "left") if mask is not None else v.withColumn("_m", F.lit(True))
    v = v.withColumn("_s", F.coalesce("_s", F.lit(0))).withColumn("_m", F.coalesce("_m", F.lit(False)))

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        lo = np.array([p[a].min() for a in AXES])
        shape = tuple(np.array([p[a].max() + 1 for a in AXES]) - lo)
        value = dense(p, "value", np.inf, lo, shape)
        label = flood(-value if invert else value, dense(p, "_s", 0, lo, shape), dense(p, "_m", False, lo, shape))
        core = np.array([k * s for k, s in zip(key, block)])
        z, y, x = np.nonzero(label)
        got = label[z, y, x]
        out = pd.DataFrame({"z": z + lo[0], "y": y + lo[1], "x": x + lo[2], "label": got})
        return out[np.logical_and.reduce([(out[a] >= c) & (out[a] < c + s) for a, c, s in zip(AXES, core, block)])]

    return split_blocks(v, dims, block, margin).groupBy("iz", "iy", "ix").applyInPandas(run, "z int, y int, x int, label bigint")


class _TooDeep(Exception):
    """A chain has more rises than nested tuples should have."""


def _rise(level: float, steps: float, below: tuple) -> tuple:
    """As a _Way, but compared by tuples, which is faster while chains are short and grows with their square."""
    depth = below[3] + 1 if below else 1
    if depth > MOST_RISES:
        raise _TooDeep
    return level, steps, below, depth


class _Way:
    """What a key was before its path rose to its present level: that level, the voxels taken at it, and the same again
    below it, down to the seed's linear index. Paths share what lies below them, so a way costs one object a rise."""

    __slots__ = ("below", "level", "steps")

    def __init__(self, level: float, steps: float, below: _Way | None):
        self.level, self.steps, self.below = level, steps, below

    def _differ(self, other: _Way) -> tuple[_Way | None, _Way | None]:
        a, b = self, other
        while a is not b and a is not None and b is not None and a.level == b.level and a.steps == b.steps:
            a, b = a.below, b.below
        return a, b

    def __eq__(self, other: object) -> bool:
        a, b = self._differ(other)
        return a is b

    __hash__ = None

    def __lt__(self, other: _Way) -> bool:
        a, b = self._differ(other)
        if a is None or b is None:
            return a is None and b is not None
        return (a.level, a.steps) < (b.level, b.steps)


def _flood_keys(value: np.ndarray, labels: np.ndarray, index: np.ndarray, mask: np.ndarray, sources: list[tuple], deep: bool = False) -> tuple[np.ndarray, Callable[[np.ndarray], list[tuple]]]:
    """flood() of one block of a larger volume, with what comes in from outside it, as labels and a function that gives the
    (chain, steps) of labelled voxels, whose places are the columns of its argument.

    A voxel's key is its place in the order of the flood of the whole volume: the levels its path rose to, the last
    one first, each with the number of voxels taken at it, then the seed's linear index. Keys of different seeds never
    tie, and a longer path never has a smaller key, so blocks agree on keys by exchanging their faces alone.
    ``sources`` are (place, steps, chain, label) of voxels beside the block, places counted in the block. Places are flat
    in a frame one voxel wider, so that neighbours need no bounds; seeds with nothing to flood beside them don't queue.
    What lies below a key is nested tuples, or _Way objects where chains are too ``deep`` for them."""
    size = tuple(n + 2 for n in value.shape)
    strides = (size[1] * size[2], size[2], 1)
    near = [sum(d * s for d, s in zip(o, strides)) for o in FACES]
    wide = lambda a, fill: np.pad(a, 1, constant_values=fill)
    seeded, v = wide(np.where(mask, labels, 0), 0), wide(value.astype(float), np.inf).ravel()
    unlabelled = wide(mask, False) & (seeded == 0)
    beside = np.flatnonzero(_shift_any(unlabelled, np.array(FACES)) & (seeded != 0)).tolist()
    ids, seeded = wide(index, 0).ravel(), seeded.ravel().astype(np.int64)
    free = bytearray(unlabelled.astype(np.uint8).tobytes()) + bytes(strides[0])  # past the end: beyond the last frame
    step_up = _Way if deep else _rise
    ways: dict[bytes, tuple | _Way] = {}

    def read(chain: np.ndarray) -> tuple | _Way:
        name = chain.tobytes()
        if name not in ways:
            way = None if deep else ()
            for level, count in chain.reshape(-1, 2)[::-1].tolist():
                way = step_up(level, count, way)
            ways[name] = way
        return ways[name]

    level_of, taken = v.tolist(), []
    try:
        # numbers first: most comparisons end there
        heap = [(float(v[p]), 1.0, read(np.array([-np.inf, ids[p]])), 0, p, int(seeded[p])) for p in beside]
        for place, steps, chain, own in sources:
            if all(-1 <= a <= n for a, n in zip(place, value.shape)):
                heap.append((float(chain[0]), float(chain[1]), read(chain[2:]), steps, sum((a + 1) * s for a, s in zip(place, strides)), own))
        heapq.heapify(heap)
        while heap:
            top, count, below, steps, p, own = heapq.heappop(heap)
            way = None
            for step in near:
                q = p + step
                if free[q]:
                    free[q] = 0
                    level = level_of[q]
                    if level > top:
                        way = way or step_up(top, count, below)
                        entry = (level, 1.0, way, steps + 1, q, own)
                    elif level == top:
                        entry = (level, count + 1, below, steps + 1, q, own)
                    else:
                        entry = (top, count, below, steps + 1, q, own)
                    taken.append(entry)
                    heapq.heappush(heap, entry)
    except _TooDeep:
        return _flood_keys(value, labels, index, mask, sources, True)
    flooded = np.array([e[4] for e in taken], np.int64)
    got = seeded.copy()
    got[flooded] = np.array([e[5] for e in taken], np.int64)
    order = np.argsort(flooded)

    def written_key(p: int, i: int) -> tuple[list[float], int]:
        if seeded[p]:
            return [float(v[p]), 1.0, -np.inf, float(ids[p])], 0
        level, count, below, steps = taken[i][:4]
        chain = [level, count]
        while below:
            above, number, below = (below.level, below.steps, below.below) if deep else below[:3]
            chain += (above, number)
        return chain, steps

    def keys(places: np.ndarray) -> list[tuple]:
        flat = np.ravel_multi_index(tuple(places + 1), size)
        at = order[np.minimum(np.searchsorted(flooded[order], flat), len(order) - 1)] if len(order) else np.zeros(len(flat), int)
        return [written_key(p, i) for p, i in zip(flat.tolist(), at.tolist())]

    return got.reshape(size)[1:-1, 1:-1, 1:-1], keys


def _flood_listed(index: np.ndarray, value: np.ndarray, seeds: np.ndarray, dims: Triple) -> np.ndarray:
    """flood() of voxels listed by linear index, in ascending order: only what is listed takes memory."""
    n = len(index)
    at = np.stack(np.unravel_index(index, dims))
    beside = np.full((n, 6), -1)
    for k, o in enumerate(FACES):
        to = at + np.array(o)[:, None]
        inside = ((to >= 0) & (to < np.array(dims)[:, None])).all(axis=0)
        there = index + (o[0] * dims[1] + o[1]) * dims[2] + o[2]
        place = np.minimum(np.searchsorted(index, there), n - 1)
        beside[:, k] = np.where(inside & (index[place] == there), place, -1)
    near, v, label = beside.tolist(), value.tolist(), seeds.tolist()
    heap = [(v[i], age, i) for age, i in enumerate(np.flatnonzero(seeds).tolist())]
    heapq.heapify(heap)
    age = len(heap)
    while heap:
        _, _, i = heapq.heappop(heap)
        for j in near[i]:
            if j >= 0 and not label[j]:
                label[j] = label[i]
                heapq.heappush(heap, (v[j], age, j))
                age += 1
    return np.array(label, np.int64)


def whole_watershed(vol: DataFrame, seeds: DataFrame, dims: Triple, block: Triple = (64, 256, 256), invert: bool = False, most: int = MOST_FLOODED) -> DataFrame:
    """(z, y, x, label): flood() of the whole volume from seeds, inside the voxels that ``vol`` has; the result does not
    depend on ``block`` or ``most``.

    Floods of face-connected pieces of that space don't meet. Pieces come from components(), in rounds that grow with the
    logarithm of the blocks they cross. A piece whose seeds have one label is that label's and isn't flooded at all;
    pieces of several labels are flooded whole, some to a task, up to ``most`` voxels a piece; larger ones in blocks."""
    v = vol.select(*AXES, (F.lit(-1.0 if invert else 1.0) * F.col("value").cast("double") + F.lit(0.0)).alias("value"))
    v = v.join(seeds.where("label <> 0").select(*AXES, F.col("label").alias("_s")), AXES, "left").withColumn("_s", F.coalesce("_s", F.lit(0)).cast("bigint"))
    v = written(v, "flood-space")
    pieces = components(v, 6, dims).withColumnRenamed("label", "piece")
    v = written(v.join(pieces, AXES), "flood-pieces")
    own = F.when(F.col("_s") != 0, F.col("_s"))
    kinds = v.groupBy("piece").agg(F.min(own).alias("one"), F.max(own).alias("other"), F.count("*").alias("n")).where("one IS NOT NULL")
    kinds = written(kinds, "flood-kinds")
    single = v.join(kinds.where("one = other").select("piece", "one"), "piece").select(*AXES, F.col("one").alias("label"))
    several = kinds.where("one <> other")
    size = several.agg(F.coalesce(F.sum(F.when(F.col("n") <= most, F.col("n"))), F.lit(0)), F.count(F.when(F.col("n") > most, True))).first()
    bins = 1 + size[0] // max(1, most // 4)

    def together(p: pd.DataFrame) -> pd.DataFrame:
        at = [p[a].to_numpy().astype(np.int64) for a in AXES]
        index = (at[0] * dims[1] + at[1]) * dims[2] + at[2]
        order = np.argsort(index)
        label = _flood_listed(index[order], p.value.to_numpy()[order], p["_s"].to_numpy()[order], dims)
        return pd.DataFrame({**{a: c[order] for a, c in zip(AXES, at)}, "label": label})

    small = v.join(several.where(F.col("n") <= most).select("piece"), "piece").withColumn("bin", F.pmod(F.xxhash64("piece"), F.lit(bins)))
    out = single.unionByName(small.groupBy("bin").applyInPandas(together, "z int, y int, x int, label bigint"))
    if not size[1]:
        return out
    large = v.join(several.where(F.col("n") > most).select("piece"), "piece")
    return out.unionByName(_relayed_watershed(large, dims, block))


def _relayed_watershed(space: DataFrame, dims: Triple, block: Triple) -> DataFrame:
    """flood() of (z, y, x, value, _s) in blocks, which are flooded again as long as an earlier key reaches them over a face;
    only faces move. Rounds grow with the blocks that a voxel's path crosses."""
    keys = ["iz", "iy", "ix"]
    v = written(space.select(*[F.expr(f"CAST({a} div {n} AS INT)").alias(f"i{a}") for a, n in zip(AXES, block)], *AXES, "value", "_s"), "flood-blocks")
    kind = "iz int, iy int, ix int, z int, y int, x int, chain array<double>, steps bigint, label bigint"
    no_rows = v.sparkSession.createDataFrame([], kind)

    def solve(p: pd.DataFrame, came: pd.DataFrame):
        lo = np.array([p[a].min() for a in AXES])
        shape = tuple(np.array([p[a].max() + 1 for a in AXES]) - lo)
        at = np.stack([p[a].to_numpy() for a in AXES]).astype(np.int64)
        index = np.zeros(shape, np.int64)
        index[tuple(at - lo[:, None])] = (at[0] * dims[1] + at[1]) * dims[2] + at[2]
        mask = np.zeros(shape, bool)
        mask[tuple(at - lo[:, None])] = True
        places = zip(*[(came[a] - o).tolist() for a, o in zip(AXES, lo)])
        sources = [(q, int(n), np.asarray(c, float), int(own)) for q, n, c, own in zip(places, came.steps, came.chain, came.label)]
        return lo, *_flood_keys(dense(p, "value", np.inf, lo, shape), dense(p, "_s", 0, lo, shape), index, mask, sources)

    def faces(key: tuple, p: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(p):
            lo, label, found = solve(p, came)
            places = np.stack(np.nonzero(label))
            at = places + lo[:, None]
            for axis in range(3):
                for side in (-1, 1):
                    to = [int(k) + side * (i == axis) for i, k in enumerate(key)]
                    if 0 <= to[axis] * block[axis] < dims[axis]:
                        on = at[axis] == int(key[axis]) * block[axis] + (0 if side < 0 else block[axis] - 1)
                        for q, own, (chain, steps) in zip(at[:, on].T.tolist(), label[tuple(places[:, on])].tolist(), found(places[:, on])):
                            rows.append((*to, *q, chain, steps, own))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in kind.split(", ")])

    def labels(key: tuple, p: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        if not len(p):
            return pd.DataFrame({"z": [], "y": [], "x": [], "label": []})
        lo, label, _ = solve(p, came)
        z, y, x = np.nonzero(label)
        return pd.DataFrame({"z": z + lo[0], "y": y + lo[1], "x": x + lo[2], "label": label[z, y, x]})

    both = lambda active, came: active.groupBy(*keys).cogroup(came.groupBy(*keys))
    grid = v.select(*keys).distinct()
    came, active = no_rows, v
    while True:
        sent = both(active, came.join(active.select(*keys).distinct(), keys, "left_semi")).applyInPandas(faces, kind).join(grid, keys, "left_semi")
        best = F.min(F.struct("chain", "steps", "label")).alias("_k")
        after = written(came.unionByName(sent).groupBy(*keys, *AXES).agg(best).select(*keys, *AXES, "_k.*"), "flood-faces")
        changed = after.join(came, after.columns, "left_anti").select(*keys).distinct()
        if changed.isEmpty():
            return both(v, after).applyInPandas(labels, "z int, y int, x int, label bigint")
        came, active = after, v.join(changed, keys, "left_semi")


def _shift_any(mask: np.ndarray, element: np.ndarray) -> np.ndarray:
    """Binary dilation of a padded array by offsets."""
    out = np.zeros_like(mask)
    for o in element:
        src = tuple(slice(max(0, -d), n - max(0, d)) for d, n in zip(o, mask.shape))
        dst = tuple(slice(max(0, d), n - max(0, -d)) for d, n in zip(o, mask.shape))
        out[dst] |= mask[src]
    return out


def closing(mask: np.ndarray, element: list[Triple]) -> np.ndarray:
    """Binary closing; what lies outside counts as unset."""
    e = np.array(element)
    r = np.abs(e).max(axis=0)
    big = np.pad(mask, [(n, n) for n in r])
    grown = _shift_any(big, e)
    shrunk = ~_shift_any(~np.pad(grown, [(n, n) for n in r], constant_values=True), -e)
    return shrunk[tuple(slice(2 * n, 2 * n + s) for n, s in zip(r, mask.shape))]


def fill(mask: np.ndarray) -> np.ndarray:
    """Mask with its holes: background not face-connected to the outside."""
    free = np.pad(~mask, 1, constant_values=True)
    reach = np.zeros_like(free)
    reach[0] = True
    faces = np.array(FACES)
    while True:
        new = reach | (_shift_any(reach, faces) & free)
        if (new == reach).all():
            return ~reach[1:-1, 1:-1, 1:-1]
        reach = new


def fill_holes_enclosed(vol: DataFrame, dims: Triple, inside: Held = None) -> DataFrame:
    """Face-connected background pieces, except the largest, get the largest label next to them."""
    fore = vol.where("label <> 0").select(*AXES, "label")
    holes = written(components(complement(fore, dims, inside), 6, dims).withColumnRenamed("label", "piece"), "holes")
    top = holes.groupBy("piece").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "piece").limit(1)
    holes = holes.join(top, "piece", "left_anti")
    beside = shifted(fore, FACES).join(holes, AXES).groupBy("piece").agg(F.max("label").alias("label"))
    return fore.unionByName(holes.join(beside, "piece").select(*AXES, "label"))


def _add_free(vol: DataFrame, filled: DataFrame) -> DataFrame:
    """A label's new voxels where nothing else is; the largest label wins."""
    fore = vol.where("label <> 0").select(*AXES, "label")
    new = filled.join(fore.select(*AXES), AXES, "left_anti").groupBy(*AXES).agg(F.max("label").alias("label"))
    return fore.unionByName(new)


def _capped(mask: np.ndarray, lo: np.ndarray, dims: Triple, work: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """With planes at the volume's ends in z treated as filled."""
    low, high = lo[0] == 0, lo[0] + len(mask) == dims[0]
    m = np.concatenate(([np.ones_like(mask[:1])] if low else []) + [mask] + ([np.ones_like(mask[:1])] if high else []))
    return work(m)[int(low) : int(low) + len(mask)]


def _fill_large(fore: DataFrame, box: DataFrame, dims: Triple, element: list[Triple] | None, capped: bool) -> DataFrame:
    """(z, y, x, label): closing and binary fill of labels of any size, by joins and components(); ``box`` has a row a
    label. Boxes are stacked along z, so that boxes that overlap do not meet."""
    tall = dims[0] + 2
    box = written(box.withColumn("slot", F.row_number().over(Window.orderBy("label")) - 1), "large-boxes")  # a row a large label
    span = lambda a: F.explode(F.sequence(f"{a}0", F.col(f"{a}1") - 1)).alias(a)
    flat = box.select("*", span("y")).select("*", span("x"))
    closed = fore.join(box.select("label"), "label", "left_semi").select(*AXES, "label")
    if element:
        if capped:
            for at, z in (("z0 = 0", -1), (f"z1 = {dims[0]}", dims[0])):
                closed = closed.unionByName(flat.where(at).select(F.lit(z).alias("z"), "y", "x", "label"))
        grown = shifted(closed, element).distinct()
        closed = shifted(grown, [(-dz, -dy, -dx) for dz, dy, dx in element]).groupBy(*AXES, "label").agg(F.count("*").alias("n")).where(F.col("n") == len(element))
        closed = closed.join(box, "label").where(" AND ".join(f"{c} >= {c}0 AND {c} < {c}1" for c in AXES)).select(*AXES, "label")
    closed = written(closed, "large-closed")
    free = flat.select("*", span("z")).join(closed, [*AXES, "label"], "left_anti")
    stacked = free.select((F.col("z") + F.col("slot") * tall).cast("int").alias("z"), "y", "x")
    pieces = written(components(stacked, 6, (box.count() * tall, *dims[1:])).withColumnRenamed("label", "piece"), "large-pieces")
    pieces = pieces.withColumn("slot", F.expr(f"CAST(z div {tall} AS INT)")).withColumn("z", F.col("z") - F.col("slot") * tall).join(box, "slot")
    ends = "(z = z0 AND z0 > 0) OR (z = z1 - 1 AND z1 < %d)" % dims[0] if capped else "z = z0 OR z = z1 - 1"
    outside = pieces.where(f"{ends} OR y = y0 OR y = y1 - 1 OR x = x0 OR x = x1 - 1").select("piece").distinct()
    return closed.unionByName(pieces.join(outside, "piece", "left_anti").select(*AXES, "label"))


def _fill_each(vol: DataFrame, dims: Triple, kernel: Callable[[int, np.ndarray, np.ndarray], np.ndarray], margin: int, element: list[Triple] | None, capped: bool) -> DataFrame:
    """A label whose box one kernel call can hold goes there, a larger one through joins; both give the same."""
    fore = vol.where("label <> 0").select(*AXES, "label")
    low = [F.greatest(F.min(a) - margin, F.lit(0)).alias(f"{a}0") for a in AXES]
    high = [F.least(F.max(a) + 1 + margin, F.lit(d)).alias(f"{a}1") for a, d in zip(AXES, dims)]
    size = F.expr(" * ".join(f"CAST({a}1 - {a}0 AS BIGINT)" for a in AXES))
    large = written(fore.groupBy("label").agg(*low, *high).where(size > MOST_VOXELS), "large")
    if large.isEmpty():
        return _add_free(vol, map_labels(vol, kernel, margin, dims))
    small = map_labels(fore.join(large.select("label"), "label", "left_anti"), kernel, margin, dims)
    return _add_free(vol, small.unionByName(_fill_large(fore, large, dims, element, capped).select(*AXES, F.col("label").cast("bigint").alias("label"))))


def fill_holes_closing(vol: DataFrame, dims: Triple, element: list[Triple], capped: bool = False) -> DataFrame:
    """Per label: closing, then binary fill; ``capped`` treats planes beyond the volume's ends as filled."""

    def kernel(label: int, mask: np.ndarray, lo: np.ndarray) -> np.ndarray:
        work = lambda m: fill(closing(m, element))
        return _capped(mask, lo, dims, work) if capped else work(mask)

    return _fill_each(vol, dims, kernel, max(max(map(abs, o)) for o in element), element, capped)


def fill_holes_capped(vol: DataFrame, dims: Triple) -> DataFrame:
    """Binary fill per label, planes beyond the volume's ends treated as filled."""
    return _fill_each(vol, dims, lambda label, mask, lo: _capped(mask, lo, dims, fill), 0, None, True)


def fill_holes_unreachable(vol: DataFrame, dims: Triple, masks: list[DataFrame], block: Triple = (64, 256, 256), inside: Held = None) -> DataFrame:
    """Labels grow into space that can't be reached from the largest free component, for each mask of walls; the
    largest label wins."""
    fore = vol.where("label <> 0").select(*AXES, "label")
    grown = []
    for walls in masks:
        blocked = fore.select(*AXES).unionByName(walls.select(*AXES)).distinct()
        free = written(components(complement(blocked, dims, inside), 6, dims), "free")
        top = free.groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(1)
        space = free.join(top, "label", "left_anti").select(*AXES).unionByName(fore.select(*AXES))
        grown.append(whole_watershed(space.withColumn("value", F.lit(0.0)), fore, dims, block))
    out = grown[0]
    for g in grown[1:]:
        out = out.unionByName(g)
    return out.groupBy(*AXES).agg(F.max("label").alias("label"))


def _smooth(u: np.ndarray) -> np.ndarray:
    """Binomial weights 1 2 1 along every axis, edge voxels repeated."""
    for axis in range(3):
        if u.shape[axis] > 1:
            pad = [(1, 1) if i == axis else (0, 0) for i in range(3)]
            p = np.pad(u, pad, mode="edge")
            part = lambda a, z: p[tuple(slice(a, z) if i == axis else slice(None) for i in range(3))]  # noqa: E731, B023
            u = (part(0, -2) + 2 * u + part(2, None)) / 4
    return u


def _central(u: np.ndarray, axis: int) -> np.ndarray:
    """Central differences, edge voxels repeated."""
    if u.shape[axis] < 2:
        return np.zeros_like(u)
    p = np.pad(u, [(1, 1) if i == axis else (0, 0) for i in range(3)], mode="edge")
    part = lambda a, z: p[tuple(slice(a, z) if i == axis else slice(None) for i in range(3))]
    return (part(2, None) - part(0, -2)) / 2


def diffusion_tensor(u: np.ndarray, rho: float, contrast: float) -> np.ndarray:
    """(z, y, x, 3, 3): the structure tensor of the smoothed volume, averaged ``rho`` times, with its eigenvalues
    replaced: 1 - exp(-3.31488 / (m / contrast^2)^4) across edges, with m its largest eigenvalue, and 1 along them."""
    smooth = _smooth(u)
    g = [_central(smooth, a) for a in range(3)]
    j = np.empty((*u.shape, 3, 3))
    for a in range(3):
        for b in range(a, 3):
            part = g[a] * g[b]
            for _ in range(max(0, round(rho))):
                part = _smooth(part)
            j[..., a, b] = j[..., b, a] = part
    value, vector = np.linalg.eigh(j)
    m = np.maximum(value[..., 2], 0) / contrast**2
    across = 1 - np.exp(-3.31488 / np.maximum(m, 1e-12) ** 4)
    n = vector[..., :, 2]
    return np.eye(3) - (1 - across)[..., None, None] * n[..., :, None] * n[..., None, :]


def diffuse(block: np.ndarray, total: float, step: float, rho: float, contrast: float) -> np.ndarray:
    """Edge-enhancing tensor diffusion, explicit scheme: u changes by the divergence of D grad u. Fluxes stand on the
    faces between voxels, with cross terms from central differences on both sides; none crosses the border, so the
    mean stays."""
    u = block.astype(float)
    for _ in range(max(1, round(total / step))):
        d = diffusion_tensor(u, rho, contrast)
        g = [_central(u, a) for a in range(3)]
        change = np.zeros_like(u)
        for a in range(3):
            if u.shape[a] < 2:
                continue
            low, high = (tuple(s if i == a else slice(None) for i in range(3)) for s in (slice(None, -1), slice(1, None)))
            cross = sum(d[..., a, b] * g[b] for b in range(3) if b != a)
            flux = (d[..., a, a][low] + d[..., a, a][high]) / 2 * np.diff(u, axis=a) + (cross[low] + cross[high]) / 2
            change += np.diff(np.pad(flux, [(1, 1) if i == a else (0, 0) for i in range(3)]), axis=a)
        u = u + step * change
    return u


def diffusion_smooth(vol: DataFrame, dims: Triple, size: Triple, total: float = 1.0, step: float = 0.1, rho: float = 1.0, contrast: float = 20.0, every: int = 4) -> DataFrame:
    """(z, y, x, value): tensor diffusion in blocks, equal to that of the whole volume for any number of steps.

    A step looks 3 + rho voxels far. Blocks are rows of bytes; before every ``every`` steps each sends the blocks around it
    what these look at, so halos don't grow with the steps and what moves is bytes, not voxels."""
    keys, box = ["iz", "iy", "ix"], ["z0", "y0", "x0", "dz", "dy", "dx"]
    steps = max(1, round(total / step))
    halo = (3 + max(0, round(rho))) * min(every, steps)

    def core(key) -> tuple[np.ndarray, np.ndarray]:
        low = np.array(key, np.int64) * size
        return low, np.minimum(low + size, dims)

    def pack(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        low, high = core(key)
        return pd.DataFrame([(*key, dense(p.astype({"value": float}), "value", 0.0, low, tuple(high - low)).tobytes())], columns=[*keys, "data"])

    def send(batches):
        for p in batches:
            rows = []
            for *key, data in p[[*keys, "data"]].itertuples(index=False):
                low, high = core(key)
                own = np.frombuffer(data).reshape(high - low)
                first, last = np.maximum(low - halo, 0) // size, np.minimum(high - 1 + halo, np.array(dims) - 1) // size
                for to in np.ndindex(*(last - first + 1)):
                    near, far = core(first + to)
                    a, b = np.maximum(low, near - halo), np.minimum(high, far + halo)
                    part = own[tuple(slice(x, y) for x, y in zip(a - low, b - low))]
                    rows.append((*map(int, first + to), *map(int, a), *map(int, b - a), part.tobytes()))
            yield pd.DataFrame(rows, columns=[*keys, *box, "data"])

    def advance(count: int):
        def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
            low, high = core(key)
            begin = np.maximum(low - halo, 0)
            u = np.zeros(np.minimum(high + halo, dims) - begin)
            for *place, data in p[[*box, "data"]].itertuples(index=False):
                at, shape = np.array(place[:3]) - begin, place[3:]
                u[tuple(slice(x, x + n) for x, n in zip(at, shape))] = np.frombuffer(data).reshape(shape)
            u = diffuse(u, count * step, step, rho, contrast)
            return pd.DataFrame([(*key, u[tuple(slice(x, y) for x, y in zip(low - begin, high - begin))].tobytes())], columns=[*keys, "data"])

        return run

    def unpack(batches):
        for p in batches:
            for *key, data in p[[*keys, "data"]].itertuples(index=False):
                low, high = core(key)
                at = np.indices(high - low).reshape(3, -1) + low[:, None]
                yield pd.DataFrame({**dict(zip(AXES, at)), "value": np.frombuffer(data)})

    kind, moved = "iz int, iy int, ix int, data binary", "iz int, iy int, ix int, z0 int, y0 int, x0 int, dz int, dy int, dx int, data binary"
    blocks = split_blocks(vol.select(*AXES, F.col("value").cast("double").alias("value")), dims, size, (0, 0, 0))
    state = written(blocks.groupBy(*keys).applyInPandas(pack, kind), "diffusion")
    for done in range(0, steps, every):
        after = written(state.mapInPandas(send, moved).groupBy(*keys).applyInPandas(advance(min(every, steps - done)), kind), "diffusion")
        discard(state)
        state = after
    return state.mapInPandas(unpack, "z int, y int, x int, value double")
