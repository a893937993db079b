"""Registration of overlapping tiles: pairs, matches, rigid models, a joint fit, and blending."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelry.functions.graph import discard, written
from voxelry.functions.ranking import global_rank

#: Neighbouring tiles of a 2 x 2 section by type of overlap (z: the same tile in another section).
CONNECTIVITY = [("z", 0, 0), ("z", 1, 1), ("z", 2, 2), ("z", 3, 3), ("y", 0, 2), ("y", 1, 3), ("x", 0, 1), ("x", 2, 3), ("tlbr", 0, 3), ("trbl", 1, 2)]


#: Descriptors in a block of one side; tiles that the joint fit eliminates in one task.
TILE, GROUP = 1024, 256
#: Pivots of the descriptor index, and descriptors that they are drawn from.
PIVOTS, SAMPLE = 48, 4096


def connectivity(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CONNECTIVITY, "type string, t1 int, t2 int")


def tile_pairs(sections: DataFrame, table: DataFrame, offsets: int) -> DataFrame:
    """(s1, t1, s2, t2, type) within ``offsets`` sections: no self pairs, no reversed duplicates, none past the
    last section. ``sections`` is (s)."""
    s = sections.select(F.col("s").alias("s1"), F.explode(F.sequence(F.lit(0), F.lit(offsets))).alias("o"))
    s = s.withColumn("s2", (F.col("s1") + F.col("o")).cast("int")).join(sections.select(F.col("s").alias("s2")), "s2", "left_semi")
    both = table.unionByName(table.where("t1 <> t2").select("type", F.col("t2").alias("t1"), F.col("t1").alias("t2")))
    p = s.join(F.broadcast(both))  # ten fixed rows, both ways
    p = p.where("NOT (s1 = s2 AND t1 >= t2)")
    return p.select("s1", "t1", "s2", "t2", "type").distinct()


def overlap_regions(pairs: DataFrame, height: int, width: int, overlap: int) -> DataFrame:
    """Crop boxes of both tiles (a_y0 .. b_x1) by pair type, and the shift back of the second."""
    y_low, x_low, o = height - overlap, width - overlap, overlap
    boxes = {
        "z": ((0, height, 0, width), (0, height, 0, width)), "y": ((y_low, height, 0, width), (0, o, 0, width)), "x": ((0, height, x_low, width), (0, height, 0, o)),
        "tlbr": ((y_low, height, x_low, width), (0, o, 0, o)), "trbl": ((y_low, height, 0, o), (0, o, x_low, width)),
    }
    pick = lambda side, i: reduce(lambda c, k: c.when(F.col("type") == k, boxes[k][side][i]), boxes, F)
    names = ("y0", "y1", "x0", "x1")
    out = pairs.withColumns({f"{t}_{n}": pick(side, i).cast("int") for side, t in ((0, "a"), (1, "b")) for i, n in enumerate(names)})
    return out.withColumns({"shift_y": F.col("a_y0") - F.col("b_y0"), "shift_x": F.col("a_x0") - F.col("b_x0")})


def _pivots(vecs: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` pivots of a sample: each next one is farthest from those before."""
    picked = [vecs[0]]
    far = ((vecs - vecs[0]) ** 2).sum(axis=1)
    while len(picked) < most and far.max() > 0:
        picked.append(vecs[int(far.argmax())])
        far = np.minimum(far, ((vecs - picked[-1]) ** 2).sum(axis=1))
    return np.array(picked)


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of rows, component by component, so that equal differences give equal sums."""
    d = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        d += (x[:, c, None] - y[None, :, c]) ** 2
    return d


class _Nearest:
    """Directed nearest neighbours of (group, id, vec) rows among others of their group, by an index of pivots."""

    def __init__(self, group: str, pivots: np.ndarray):
        self.group, self.pivots = group, pivots

    def keyed(self, rows: DataFrame) -> DataFrame:
        """Rows with the nearest pivot, the distance to it, and their place among the rows of group and pivot."""
        pivots = self.pivots

        def key(batches):
            for p in batches:
                if len(p):
                    d = np.sqrt(_apart(np.stack(p.vec.to_list()).astype(float), pivots))
                    yield p.assign(cell=d.argmin(axis=1).astype(np.int32), d=d.min(axis=1))

        out = written(rows.select("group", "id", "vec").mapInPandas(key, f"group {self.group}, id bigint, vec array<double>, cell int, d double"), "descriptors")
        sizes = out.groupBy("group", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("n"))
        return out.join(sizes, ["group", "cell"]).withColumn("sub", F.pmod(F.xxhash64("id"), F.col("n")).cast("int"))

    def visits(self, asked: DataFrame, cells: DataFrame, first: bool) -> DataFrame:
        """A row for each (asked row, cell) to be searched: in the ``first`` step the cell with the least bound, afterwards all
        others whose bound is no more than ``best``. By the triangle inequality nothing of a cell is nearer than its bound.
        Python gives a row an asked row, with the cells' numbers; its vector is copied for each cell after that."""
        pivots, kind = self.pivots, f"group {self.group}, id bigint, vec array<double>, visited array<int>"

        def choose(batches):
            for p in batches:
                for _, own in p.groupby("group", sort=False):
                    cell, low, high = (own[c].iat[0] for c in ("cell", "low", "high"))
                    to = np.sqrt(_apart(np.stack(own.vec.to_list()).astype(float), pivots))[:, cell]
                    bound = np.maximum(0, np.maximum(low - to, to - high))
                    order = np.lexsort((to, bound), axis=-1)
                    if first:
                        visited = [cell[o[:1]] for o in order]
                    else:
                        most = own.best.to_numpy() * (1 + 1e-9) + 1e-9
                        visited = [cell[o[1:]][b[o[1:]] <= m] for o, b, m in zip(order, bound, most)]
                    yield own[["group", "id", "vec"]].assign(visited=visited)

        chosen = written(asked.join(cells, "group").mapInPandas(choose, kind), "descriptor-visits")
        return chosen.select("group", "id", "vec", F.explode("visited").alias("cell"))

    def search(self, visits: DataFrame, stored: DataFrame) -> DataFrame:
        """(group, id, distance, other): the nearest of each visited cell, ties to the smaller id; tiles of bounded size."""
        tile = ["group", "cell", "sub", "part"]
        n = visits.groupBy("group", "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("parts"))
        subs = stored.select("group", "cell", "n").distinct()
        left = visits.join(n, ["group", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).join(subs, ["group", "cell"]).withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
        right = stored.join(n, ["group", "cell"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        right = right.select(*[F.col(c).alias(f"_{c}") for c in tile], F.col("id").alias("other"), F.col("vec").alias("ovec"))

        def nearest(key: tuple, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
            if not len(p) or not len(q):
                return pd.DataFrame({c: [] for c in ("group", "id", "distance", "other", "pairs")})
            q = q.sort_values("other")
            d = _apart(np.stack(p.vec.to_list()).astype(float), np.stack(q.ovec.to_list()).astype(float))
            return pd.DataFrame({"group": key[0], "id": p.id.to_numpy(), "distance": d.min(axis=1), "other": q.other.to_numpy()[d.argmin(axis=1)], "pairs": len(q)})

        kind = f"group {self.group}, id bigint, distance double, other bigint, pairs bigint"
        found = left.select(*tile, "id", "vec").groupBy(*tile).cogroup(right.groupBy(*[f"_{c}" for c in tile])).applyInPandas(nearest, kind)
        return found.groupBy("group", "id").agg(F.min(F.struct("distance", "other")).alias("m"), F.sum("pairs").alias("pairs")).select("group", "id", "m.*", "pairs")

    def nearest(self, asked: DataFrame, stored: DataFrame) -> DataFrame:
        """(group, id, distance, other, pairs) with the squared distance; pairs is how many others were compared."""
        cells = stored.groupBy("group", "cell").agg(F.min("d").alias("low"), F.max("d").alias("high"))
        cells = cells.groupBy("group").agg(F.sort_array(F.collect_list(F.struct("cell", "low", "high"))).alias("c"))  # an entry a pivot at most
        cells = written(cells.select("group", *[F.col(f"c.{c}").alias(c) for c in ("cell", "low", "high")]), "descriptor-cells")
        own = asked.select("group", "id", "vec")
        first = written(self.search(self.visits(own, cells, True), stored), "descriptors-first")
        bounded = own.join(first.select("group", "id", F.sqrt("distance").alias("best")), ["group", "id"])
        found = first.unionByName(self.search(self.visits(bounded, cells, False), stored))
        return found.groupBy("group", "id").agg(F.min(F.struct("distance", "other")).alias("m"), F.sum("pairs").alias("pairs")).select("group", "id", "m.*", "pairs")


def nearest_descriptors(a: DataFrame, b: DataFrame, pivots: int = PIVOTS) -> tuple[DataFrame, DataFrame]:
    """The nearest of ``b`` to each of ``a`` and the nearest of ``a`` to each of ``b`` among (group, id, vec) descriptors of one
    group: (group, id, distance, other, pairs), distances squared, ties to the smaller id.

    Both sides are keyed by the nearest of a few pivots of a sample. A descriptor is compared with one cell of the other side
    first, then with those that may hold a nearer one; on clustered descriptors these are few. Tiles bound what a task
    holds, whatever the size of a group or cell."""
    kind = a.schema["group"].dataType.simpleString()
    a, b = (d.select("group", "id", F.col("vec").cast("array<double>").alias("vec")) for d in (a, b))
    drawn = a.unionByName(b).select("vec").distinct().orderBy(F.xxhash64("vec"), "vec").limit(SAMPLE).collect()
    index = _Nearest(kind, _pivots(np.array([r.vec for r in drawn], float), pivots) if drawn else np.zeros((1, 1)))
    both = index.keyed(a), index.keyed(b)
    return index.nearest(*both), index.nearest(*both[::-1])


def match_descriptors(a: DataFrame, b: DataFrame, max_distance: float | None = None) -> DataFrame:
    """(group, id_a, id_b, distance): mutual nearest neighbours of (group, id, vec) descriptors, ties to the smaller id; found
    by nearest_descriptors(). Only descriptors of one group (an overlap region) are compared."""
    there, back = nearest_descriptors(a, b)
    best = there.select("group", F.col("id").alias("id_a"), F.col("other").alias("id_b"), "distance")
    best = best.join(back.select("group", F.col("id").alias("id_b"), F.col("other").alias("id_a")), ["group", "id_a", "id_b"])
    best = best.withColumn("distance", F.sqrt("distance"))
    return best.where(F.col("distance") <= max_distance) if max_distance is not None else best


def fit_rigid(src: np.ndarray, dst: np.ndarray) -> tuple[float, float, float]:
    """Rotation and shift with the least squared error from src to dst (x, y)."""
    a, b = src - src.mean(0), dst - dst.mean(0)
    theta = np.arctan2((a[:, 0] * b[:, 1] - a[:, 1] * b[:, 0]).sum(), (a * b).sum())
    c, s = np.cos(theta), np.sin(theta)
    t = dst.mean(0) - src.mean(0) @ np.array([[c, s], [-s, c]])
    return float(theta), float(t[0]), float(t[1])


def ransac(src: np.ndarray, dst: np.ndarray, residual: float, trials: int, seed: int) -> tuple[float, float, float, int]:
    """Model of the most inliers under a residual threshold; NaN without two points."""
    if len(src) < 2:
        return float("nan"), float("nan"), float("nan"), 0
    rng, best = np.random.default_rng(seed), np.zeros(len(src), bool)
    for _ in range(min(trials, 1000)):
        pick = rng.choice(len(src), 2, replace=False)
        th, tx, ty = fit_rigid(src[pick], dst[pick])
        c, s = np.cos(th), np.sin(th)
        ok = np.hypot(*(src @ np.array([[c, s], [-s, c]]) + (tx, ty) - dst).T) < residual
        if ok.sum() > best.sum():
            best = ok
    if best.sum() < 2:
        return float("nan"), float("nan"), float("nan"), 0
    return (*fit_rigid(src[best], dst[best]), int(best.sum()))


def ransac_rigid(matches: DataFrame, residual: float = 2.0, trials: int = 300, seed: int = 0) -> DataFrame:
    """(pair_id, theta, tx, ty, inliers) of (pair_id, sx, sy, dx, dy), a group a pair."""

    def run(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["sx", "sy", "dx", "dy"])
        model = ransac(p[["sx", "sy"]].to_numpy(float), p[["dx", "dy"]].to_numpy(float), residual, trials, seed + int(key[0]))
        return pd.DataFrame([[key[0], *model]], columns=["pair_id", "theta", "tx", "ty", "inliers"])

    return matches.groupBy("pair_id").applyInPandas(run, "pair_id bigint, theta double, tx double, ty double, inliers int")


def pair_weights(models: DataFrame, sigma: float) -> DataFrame:
    """Gaussian weight by section distance (ds); 0 for failed models."""
    return models.withColumn("w", F.when(F.isnan("theta") | F.col("theta").isNull(), 0.0).otherwise(F.exp(-(F.col("ds") * F.col("ds")) / (2 * sigma * sigma))))


def audit_pairs(expected: DataFrame, matches: DataFrame, models: DataFrame, least: int) -> DataFrame:
    """(pair_id, state): missing, small or failed pairs."""
    n = matches.groupBy("pair_id").agg(F.count("*").alias("n"))
    j = expected.select("pair_id").join(n, "pair_id", "left").join(models.select("pair_id", "theta"), "pair_id", "left")
    state = F.when(F.col("n").isNull(), "missing").when(F.col("n") < least, "small").when(F.isnan("theta") | F.col("theta").isNull(), "failed")
    return j.select("pair_id", state.alias("state")).where("state IS NOT NULL")


def _apply(x: Column, y: Column, theta: Column, tx: Column, ty: Column) -> tuple[Column, Column]:
    return F.cos(theta) * x - F.sin(theta) * y + tx, F.sin(theta) * x + F.cos(theta) * y + ty


def initial_transforms(models: DataFrame) -> DataFrame:
    """(tile, theta, tx, ty): pair models (src, dst, theta, tx, ty: dst's frame into src's, src < dst) chained to
    tile 0. A tile's chain goes through its smallest source. Chains are halved each round, so rounds grow with the
    logarithm of the longest; tiles without a chain to 0 are left out."""
    best = models.where("src < dst").groupBy("dst").agg(F.min(F.struct("src", "theta", "tx", "ty")).alias("m"))
    t = best.select(F.col("dst").alias("tile"), F.col("m.src").alias("top"), "m.theta", "m.tx", "m.ty")
    while True:
        t = written(t, "chains")
        up = t.select(F.col("tile").alias("top"), F.col("top").alias("over"), *[F.col(c).alias(f"{c}_") for c in ("theta", "tx", "ty")])
        j = t.join(up, "top", "left")
        if j.where("over IS NOT NULL").isEmpty():
            break
        x, y = _apply(F.col("tx"), F.col("ty"), F.col("theta_"), F.col("tx_"), F.col("ty_"))
        new = lambda a, b: F.when(F.col("over").isNull(), F.col(a)).otherwise(b).alias(a)
        t = j.select("tile", F.coalesce("over", "top").alias("top"), new("theta", F.col("theta") + F.col("theta_")), new("tx", x), new("ty", y))
    first = t.sparkSession.createDataFrame([(0, 0.0, 0.0, 0.0)], "tile bigint, theta double, tx double, ty double")
    return first.unionByName(t.where("top = 0").select("tile", "theta", "tx", "ty"))


def _sides(matches: DataFrame, transforms: DataFrame) -> DataFrame:
    """Matches (t1, t2, w, sx, sy, dx, dy) with both tiles' transforms."""
    for i, t in (("1", "t1"), ("2", "t2")):
        matches = matches.join(transforms.select(F.col("tile").alias(t), *[F.col(c).alias(f"{c}{i}") for c in ("theta", "tx", "ty")]), t)
    return matches


def registration_error(matches: DataFrame, transforms: DataFrame) -> DataFrame:
    """One row: the weighted sum of squared distances of matched points under the transforms."""
    j = _sides(matches, transforms)
    ax, ay = _apply(F.col("sx"), F.col("sy"), *[F.col(f"{c}1") for c in ("theta", "tx", "ty")])
    bx, by = _apply(F.col("dx"), F.col("dy"), *[F.col(f"{c}2") for c in ("theta", "tx", "ty")])
    return j.agg(F.coalesce(F.sum(F.col("w") * ((ax - bx) * (ax - bx) + (ay - by) * (ay - by))), F.lit(0.0)).alias("error"))


def _normal_blocks(matches: DataFrame, table: DataFrame) -> DataFrame:
    """(t1, t2, h.., g..) sums of the normal equations over the matches of each tile pair."""
    j = _sides(matches, table)
    ax, ay = _apply(F.col("sx"), F.col("sy"), *[F.col(f"{c}1") for c in ("theta", "tx", "ty")])
    bx, by = _apply(F.col("dx"), F.col("dy"), *[F.col(f"{c}2") for c in ("theta", "tx", "ty")])
    zero, one = F.lit(0.0), F.lit(1.0)
    # residuals rx, ry and their derivatives by (theta, tx, ty) of both tiles
    jx = [F.col("ty1") - ay, one, zero, by - F.col("ty2"), -one, zero]
    jy = [ax - F.col("tx1"), zero, one, F.col("tx2") - bx, zero, -one]
    rx, ry, w = ax - bx, ay - by, F.col("w")
    sums = [F.sum(w * (jx[p] * jx[q] + jy[p] * jy[q])).alias(f"h{p}{q}") for p in range(6) for q in range(p, 6)] + [F.sum(w * (jx[p] * rx + jy[p] * ry)).alias(f"g{p}") for p in range(6)]
    return j.groupBy("t1", "t2").agg(*sums)


def _eliminate(key: tuple, p: pd.DataFrame) -> pd.DataFrame:
    """One group's tiles: those that nothing outside the group touches are solved for in terms of the others, whose
    equations take up what is left of theirs. Rows by kind: 0 blocks (a <= b), 1 tiles touched from outside, 2 right sides;
    3 comes out, the solution for ``tiles``: -(c + k x) with x the steps of ``border``."""
    tiles = np.sort(p.a[p.kind == 2].to_numpy())
    at = {int(t): 3 * i for i, t in enumerate(tiles)}
    h, g = np.zeros((3 * len(tiles), 3 * len(tiles))), np.zeros(3 * len(tiles))
    for a, b, m in p.loc[p.kind == 0, ["a", "b", "m"]].itertuples(index=False):
        i, j, m = at[a], at[b], np.asarray(m).reshape(3, 3)
        h[i : i + 3, j : j + 3] += m
        if a != b:
            h[j : j + 3, i : i + 3] += m.T
    for a, m in p.loc[p.kind == 2, ["a", "m"]].itertuples(index=False):
        g[at[a] : at[a] + 3] += m
    edge = np.isin(tiles, p.a[p.kind == 1].to_numpy())
    out, inn = np.repeat(edge, 3), np.repeat(~edge, 3)
    inverse = np.linalg.pinv(h[np.ix_(inn, inn)], rcond=1e-12, hermitian=True)  # a tile that nothing holds stays
    k, c = inverse @ h[np.ix_(inn, out)], inverse @ g[inn]
    left, right = h[np.ix_(out, out)] - h[np.ix_(out, inn)] @ k, g[out] - h[np.ix_(out, inn)] @ c
    border = tiles[edge]
    rows = [(3, -1, -1, None, tiles[~edge].tolist(), border.tolist(), k.tobytes(), c.tobytes(), int(key[0]))]
    for i, a in enumerate(border.tolist()):
        rows.append((2, a, -1, right[3 * i : 3 * i + 3].tolist(), None, None, None, None, -1))
        for j in range(i, len(border)):
            m = left[3 * i : 3 * i + 3, 3 * j : 3 * j + 3]
            if m.any():
                rows.append((0, a, int(border[j]), m.ravel().tolist(), None, None, None, None, -1))
    return pd.DataFrame(rows, columns=["kind", "a", "b", "m", "tiles", "border", "k", "c", "g"])


def _back(batches):
    """Records with ``x``, the steps of their border in order -> (tile, x)."""
    for p in batches:
        rows = []
        for tiles, k, c, x in p[["tiles", "k", "c", "x"]].itertuples(index=False):
            c, known = np.frombuffer(c), np.concatenate([np.asarray(v) for v in x]) if x is not None and len(x) else np.zeros(0)
            step = -(c + np.frombuffer(k).reshape(len(c), len(known)) @ known) if len(c) else c
            rows += [(int(t), step[3 * i : 3 * i + 3].tolist()) for i, t in enumerate(tiles)]
        yield pd.DataFrame(rows, columns=["tile", "x"])


def _solved(blocks: DataFrame, fixed: int, n: int, group: int, widen: int) -> DataFrame:
    """(tile, x array<double>): the Gauss-Newton step, by elimination in groups of tiles that follow each other. What a level
    of groups leaves, the tiles at their borders, is eliminated in groups ``widen`` times as wide, until one holds all."""
    kind = "kind int, a bigint, b bigint, m array<double>, tiles array<bigint>, border array<bigint>, k binary, c binary, g bigint"
    h = lambda p, q: F.col(f"h{min(p, q)}{max(p, q)}")
    part = lambda a, b, s, z: blocks.select(F.col(a).alias("a"), F.col(b).alias("b"), F.array(*[h(s + p, z + q) for p in range(3) for q in range(3)]).alias("m"))
    turned = F.when(F.col("a") > F.col("b"), F.array(*[F.col("m")[3 * q + p] for p in range(3) for q in range(3)])).otherwise(F.col("m"))
    matrix = reduce(DataFrame.unionByName, [part("t1", "t1", 0, 0), part("t2", "t2", 3, 3), part("t1", "t2", 0, 3)]).where((F.col("a") != fixed) & (F.col("b") != fixed))
    matrix = matrix.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), turned.alias("m")).groupBy("a", "b").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(9)]).alias("m"))
    right = reduce(DataFrame.unionByName, [blocks.select(F.col(t).alias("a"), F.array(*[F.col(f"g{s + p}") for p in range(3)]).alias("m")) for t, s in (("t1", 0), ("t2", 3))])
    right = right.where(F.col("a") != fixed).groupBy("a").agg(F.array(*[F.sum(F.col("m")[i]) for i in range(3)]).alias("m"))
    levels, width = [], group
    while True:
        of = lambda c: F.floor(F.col(c) / width)  # noqa: E731, B023
        row = lambda df, code, g, b, m: df.select(F.lit(code).alias("kind"), g.alias("g"), "a", b.cast("bigint").alias("b"), m.alias("m"))
        none, empty = F.lit(None), F.lit(None).cast("array<double>")
        cross = matrix.where(of("a") != of("b"))
        touched = cross.select("a").unionByName(cross.select(F.col("b").alias("a"))).distinct()
        asked = [row(matrix.where(of("a") == of("b")), 0, of("a"), F.col("b"), F.col("m")), row(touched, 1, of("a"), none, empty), row(right, 2, of("a"), none, F.col("m"))]
        done = written(reduce(DataFrame.unionByName, asked).groupBy("g").applyInPandas(_eliminate, kind), "fit-level")
        levels.append(done)
        if n <= width:
            break
        matrix, right = cross.unionByName(done.where("kind = 0").select("a", "b", "m")), done.where("kind = 2").select("a", "m")
        width *= widen
    steps = None
    for level in reversed(levels):
        records = level.where("kind = 3").select("g", "tiles", "border", "k", "c")
        if steps is None:
            steps = written(records.withColumn("x", F.lit(None).cast("array<array<double>>")).mapInPandas(_back, "tile bigint, x array<double>"), "fit-steps")
            continue
        known = records.select("g", F.posexplode("border").alias("i", "tile")).join(steps, "tile")
        known = known.groupBy("g").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda v: v["x"]).alias("x"))  # a group's border
        steps = steps.unionByName(written(records.join(known, "g", "left").mapInPandas(_back, "tile bigint, x array<double>"), "fit-steps"))
    return steps


def optimize_transforms(matches: DataFrame, transforms: DataFrame, fixed: int = 0, rounds: int = 20, tolerance: float = 1e-9, group: int = GROUP, widen: int = 64) -> DataFrame:
    """Gauss-Newton on the registration error with one tile fixed; raises if it doesn't come to rest in ``rounds``.
    Matches are summed to a normal-equation block a tile pair, and the blocks are solved by nested elimination: ``group``
    tiles that follow each other by number are one task's, then the tiles at the borders of ``widen`` groups, and so on, so
    that Spark jobs grow with the logarithm of the tiles. That is small work if tiles that overlap have near numbers, as
    those of a stack do. A tile without matches stays."""
    names = ("theta", "tx", "ty")
    current = transforms.select(F.col("tile").cast("bigint").alias("tile"), *[F.col(c).cast("double").alias(c) for c in names])
    place = written(global_rank(current.select("tile").distinct(), "tile", name="place"), "fit-places")
    n = place.count()
    own = place.where(F.col("tile") == fixed).first()
    current = written(current, "fit-transforms")
    at = lambda t: place.select(F.col("tile").alias(t), F.col("place").alias(f"p{t}"))
    for _ in range(rounds):
        blocks = _normal_blocks(matches, current).join(at("t1"), "t1").join(at("t2"), "t2").drop("t1", "t2").withColumnsRenamed({"pt1": "t1", "pt2": "t2"})
        blocks = written(blocks, "fit-blocks")
        step = _solved(blocks, own.place if own else -1, n + 1, group, widen).withColumnRenamed("tile", "place").join(place, "place")
        step = step.select("tile", *[F.col("x")[i].alias(f"_{c}") for i, c in enumerate(names)])
        moved = current.join(step, "tile", "left").select("tile", *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0.0))).alias(c) for c in names], F.greatest(*[F.abs(F.coalesce(f"_{c}", F.lit(0.0))) for c in names]).alias("by"))
        moved, before = written(moved, "fit-transforms"), current
        current = moved.drop("by")
        discard(before, blocks)
        if (moved.agg(F.max("by")).first()[0] or 0.0) < tolerance:
            return current
    raise RuntimeError(f"transforms still move after {rounds} rounds")


def rereference_transforms(transforms: DataFrame, tile: int) -> DataFrame:
    """All transforms relative to another tile, which becomes the identity."""
    ref = transforms.where(F.col("tile") == tile).select(F.col("theta").alias("rt"), F.col("tx").alias("rx"), F.col("ty").alias("ry"))  # one row
    j = transforms.crossJoin(F.broadcast(ref))
    dx, dy, c, s = F.col("tx") - F.col("rx"), F.col("ty") - F.col("ry"), F.cos("rt"), F.sin("rt")
    return j.select("tile", (F.col("theta") - F.col("rt")).alias("theta"), (c * dx + s * dy).alias("tx"), (-s * dx + c * dy).alias("ty"))


def canvas_bounds(transforms: DataFrame, height: int, width: int) -> DataFrame:
    """One row: whole bounds x0 x1 y0 y1 of all transformed tile corners."""
    corner = F.explode(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x in (0, width) for y in (0, height)])).alias("c")
    t = transforms.select("*", corner)
    x, y = _apply(F.col("c.x"), F.col("c.y"), F.col("theta"), F.col("tx"), F.col("ty"))
    return t.agg(*[e.cast("int").alias(n) for n, e in (("x0", F.floor(F.min(x))), ("x1", F.ceil(F.max(x))), ("y0", F.floor(F.min(y))), ("y1", F.ceil(F.max(y))))])


def blend_tiles(tiles: DataFrame, transforms: DataFrame, height: int, width: int) -> DataFrame:
    """(y, x, value) of canvas pixels: the tiles (tile, y, x, value) sampled bilinearly through the inverse
    transforms, weighted by the distance to the tile's edge. A tile's pixel is sent to the canvas pixels that it weighs
    in, which lie less than the root of 2 from its place on the canvas, and is summed there; no pixels are joined."""
    c, s = F.col("c"), F.col("s")
    once = transforms.select("tile", F.cos("theta").alias("c"), F.sin("theta").alias("s"), "tx", "ty")
    j = tiles.join(F.broadcast(once), "tile")  # a row an image, so that voxels are spread as they are read
    px, py = c * F.col("x") - s * F.col("y") + F.col("tx"), s * F.col("x") + c * F.col("y") + F.col("ty")
    for at, place in (("cy", py), ("cx", px)):
        low = F.floor(place).cast("int")
        j = j.withColumn(at, F.explode(F.sequence(low - 1, low + 2)))
    dx, dy = F.col("cx") - F.col("tx"), F.col("cy") - F.col("ty")
    j = j.select("cy", "cx", "y", "x", "value", F.round(c * dx + s * dy, 9).alias("u"), F.round(-s * dx + c * dy, 9).alias("v"))
    j = j.where((F.col("u") >= 0) & (F.col("u") <= width - 1) & (F.col("v") >= 0) & (F.col("v") <= height - 1) & (F.abs(F.col("u") - F.col("x")) < 1) & (F.abs(F.col("v") - F.col("y")) < 1))
    edge = F.least(F.col("u"), F.col("v"), F.lit(width - 1) - F.col("u"), F.lit(height - 1) - F.col("v")) + 1
    part = lambda u, x: F.when(x <= u, 1 - (u - x)).otherwise(u - (x - 1))
    w = edge * (part(F.col("u"), F.col("x")) * part(F.col("v"), F.col("y")))
    n = j.select("cy", "cx", "value", w.alias("w")).where("w > 0")
    return n.groupBy(F.col("cy").alias("y"), F.col("cx").alias("x")).agg((F.sum(F.col("w") * F.col("value")) / F.sum("w")).alias("value"))
