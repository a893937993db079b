"""Queries of sections 2.13 to 2.15."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from voxelry.functions.graph import shared_dir, written
from voxelry.operators import classify as K
from voxelry.operators import register as G
from voxelry.operators import regions as R
from voxelry.operators import stats as S
from voxelry.operators.components import components

from .components import FULL, PLANE, cc_sql
from .labels import _BEST, CLOSURE, SLICE_OVERLAP
from .regions import ECC, PROPS, props
from .views import registry
from .watershed import FLAT_SQL, fill_sql, flood_sql

add = registry.add
PI = "3.141592653589793::DOUBLE"
rounded = lambda *names, n=6: [F.round(c, n).alias(c) for c in names]


@add("training_labels", "seg_a mask_ds", "SELECT label, CAST(min((m.z IS NOT NULL)::INT) AS INT) AS truth FROM seg_a s LEFT JOIN mask_ds m USING (z, y, x) WHERE label <> 0 GROUP BY label")
def _(v):
    return K.training_labels(v.seg_a, v.mask_ds)


def _labelled(v):
    return written(props(v).join(K.training_labels(v.seg_a, v.mask_ds), "label"), "training")  # read many times by the fits


@add("train_object_classifier")
def _(v):
    """Accuracy on objects held out of the fit, by kind of classifier."""
    data = _labelled(v)
    held_out = F.pmod(F.xxhash64("label"), F.lit(3)) == 0
    out = []
    for kind in ("kernel", "svc", "forest"):
        model = K.train_object_classifier(data.where(~held_out), ["area", "mean", "extent"], kind)
        out.append(model.transform(data.where(held_out)).groupBy(F.lit(kind).alias("kind")).agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("truth")).cast("int")).alias("accuracy")))
    return out[0].unionByName(out[1]).unionByName(out[2])


@add("predict_objects", "seg_a vox mask_ds", f"""WITH p AS ({PROPS}), t AS (SELECT label, min((m.z IS NOT NULL)::INT) AS truth FROM seg_a s LEFT JOIN mask_ds m USING (z, y, x) WHERE label <> 0 GROUP BY label),
m AS (SELECT max(area) AS ma, max(mean) AS mm, max(extent) AS me FROM p), c AS (SELECT truth, avg(area / ma) AS a, avg(mean / mm) AS b, avg(extent / me) AS e FROM p JOIN t USING (label), m GROUP BY truth),
d AS (SELECT label, area, mean, sum((2 * truth - 1) * exp(-4.0::DOUBLE * (pow(area / ma - a, 2) + pow(mean / mm - b, 2) + pow(extent / me - e, 2)))) AS decision FROM p, m, c GROUP BY label, area, mean)
SELECT label, CASE WHEN area > 350 THEN false WHEN mean > 135 THEN true ELSE decision > 0 END AS inside FROM d""")
def _(v):
    """A kernel model of the two classes' centres, stored and read back, and the rules after it."""
    data, names = _labelled(v), ["area", "mean", "extent"]
    scale = list(data.agg(*[F.max(c) for c in names]).first())
    centres = data.groupBy("truth").agg(*[F.avg(F.col(c) / s).alias(c) for c, s in zip(names, scale)]).orderBy("truth").collect()  # two rows
    model = K.KernelModel(names, scale, 4.0, np.array([[r[c] for c in names] for r in centres]), np.array([2.0 * r.truth - 1 for r in centres]), 0.0)
    path = f"{shared_dir(v.spark)}/classifier-{uuid.uuid4().hex}"
    model.save(v.spark, path)
    return K.predict_objects(K.KernelModel.load(v.spark, path), data, 135, 350)


@add("apply_object_rules", "seg_a vox", f"SELECT label, CASE WHEN area > 350 THEN false WHEN mean > 128.5 THEN true ELSE label % 2 = 1 END AS inside FROM ({PROPS})")
def _(v):
    return K.apply_object_rules(props(v).withColumn("prediction", (F.col("label") % 2).cast("double")), 128.5, 350)


@add("paint_prediction", "seg_a", "SELECT z, y, x, label FROM seg_a WHERE label <> 0 AND label % 3 = 0")
def _(v):
    return K.paint_prediction(v.seg_a, v.seg_a.select("label", (F.col("label") % 3 == 0).alias("inside")).distinct())


_TABLE = "(VALUES " + ", ".join(f"('{t}', {a}, {b})" for t, a, b in G.CONNECTIVITY) + ") t(type, a, b)"
_PAIRS = f"""WITH s AS (SELECT DISTINCT CAST(vec_id // 25 AS INT) AS s FROM embeddings), c AS (SELECT type, a, b FROM {_TABLE} UNION SELECT type, b, a FROM {_TABLE}),
p AS (SELECT DISTINCT l.s AS s1, a AS t1, r.s AS s2, b AS t2, type FROM s l JOIN s r ON r.s - l.s BETWEEN 0 AND 2, c WHERE NOT (l.s = r.s AND a >= b))"""


def _pairs(v):
    sections = v.table("embeddings").select(F.expr("CAST(vec_id div 25 AS INT)").alias("s")).distinct()
    return G.tile_pairs(sections, G.connectivity(v.spark), 2)


@add("tile_pairs", "", _PAIRS + " SELECT * FROM p")
def _(v):
    return _pairs(v)


@add("overlap_regions", "", _PAIRS + """ SELECT s1, t1, s2, t2, type, CAST(CASE WHEN type IN ('y', 'tlbr', 'trbl') THEN 80 ELSE 0 END AS INT) AS a_y0, CAST(CASE WHEN type IN ('x', 'tlbr') THEN 20 ELSE 50 END AS INT) AS b_x1,
  CAST(CASE WHEN type IN ('y', 'tlbr', 'trbl') THEN 80 ELSE 0 END AS INT) AS shift_y, CAST(CASE WHEN type IN ('x', 'tlbr') THEN 30 WHEN type = 'trbl' THEN -30 ELSE 0 END AS INT) AS shift_x FROM p""")
def _(v):
    return G.overlap_regions(_pairs(v), 100, 50, 20).select("s1", "t1", "s2", "t2", "type", "a_y0", "b_x1", "shift_y", "shift_x")


@add("match_descriptors", "", """WITH d AS (SELECT vec_id, label AS g, list_transform(embedding, lambda x: floor(x * 1000)) AS e FROM embeddings),
p AS (SELECT a.g, a.vec_id AS a, b.vec_id AS b, list_sum(list_transform(list_zip(a.e, b.e), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM d a JOIN d b ON a.g = b.g WHERE a.vec_id % 2 = 0 AND b.vec_id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY g, a ORDER BY d, b) AS ra, row_number() OVER (PARTITION BY g, b ORDER BY d, a) AS rb FROM p)
SELECT a AS id_a, b AS id_b, round(sqrt(d), 6) AS distance FROM r WHERE ra = 1 AND rb = 1""")
def _(v):
    d = v.table("embeddings").select(F.col("label").alias("group"), F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(x * 1000).cast("double")).alias("vec"))
    return G.match_descriptors(d.where("id % 2 = 0"), d.where("id % 2 = 1")).select("id_a", "id_b", F.round("distance", 6).alias("distance"))


def _matches(v):
    """Points from two vector elements, fifty a pair, moved by a rotation and shift that depend on the pair; one in seven
    is wrong."""
    e = v.table("embeddings").select(F.expr("vec_id div 50").alias("pair_id"), "vec_id", (F.col("embedding")[0].cast("double") * 100).alias("sx"), (F.col("embedding")[1].cast("double") * 100).alias("sy"))
    k = F.col("pair_id") % 10
    th = k * 0.05
    wrong = F.when(F.col("vec_id") % 7 == 3, 40.0).otherwise(0.0)
    return e.select("pair_id", "sx", "sy", (F.cos(th) * F.col("sx") - F.sin(th) * F.col("sy") + k + wrong).alias("dx"), (F.sin(th) * F.col("sx") + F.cos(th) * F.col("sy") - k).alias("dy"))


@add("ransac_rigid", "", "SELECT p AS pair_id, round(p % 10 * 0.05::DOUBLE, 6) AS theta, round((p % 10)::DOUBLE, 6) AS tx, round(-(p % 10)::DOUBLE, 6) + 0.0 AS ty, n AS inliers FROM (SELECT vec_id // 50 AS p, CAST(count(*) FILTER (vec_id % 7 <> 3) AS INT) AS n FROM embeddings GROUP BY 1)")
def _(v):
    m = G.ransac_rigid(_matches(v), 0.5, 100)
    return m.select("pair_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("theta", "tx", "ty")], "inliers")


@add("pair_weights", "", "SELECT vec_id AS pair_id, CASE WHEN vec_id % 5 = 0 THEN 0.0 ELSE round(exp(-(vec_id % 4) * (vec_id % 4) / 4.5::DOUBLE), 9) END AS w FROM embeddings")
def _(v):
    m = v.table("embeddings").select(F.col("vec_id").alias("pair_id"), (F.col("vec_id") % 4).alias("ds"), F.when(F.col("vec_id") % 5 == 0, float("nan")).otherwise(0.1).alias("theta"))
    return G.pair_weights(m, 1.5).select("pair_id", F.round("w", 9).alias("w"))


@add("audit_pairs", "", "SELECT vec_id AS pair_id, CASE WHEN vec_id % 10 = 0 THEN 'missing' WHEN vec_id % 10 < 4 THEN 'small' ELSE 'failed' END AS state FROM embeddings WHERE vec_id % 10 < 4 OR vec_id % 11 = 0")
def _(v):
    ids = v.table("embeddings").select(F.col("vec_id").alias("pair_id"))
    matches = ids.withColumn("_", F.explode(F.array_repeat(F.lit(1), (F.col("pair_id") % 10).cast("int"))))
    return G.audit_pairs(ids, matches, ids.withColumn("theta", F.when(F.col("pair_id") % 11 == 0, float("nan")).otherwise(0.0)), 4)


@add("initial_transforms", "", """WITH t AS (SELECT DISTINCT vec_id // 25 AS tile FROM embeddings), m AS (SELECT tile, CASE WHEN tile = 0 THEN 0.0 ELSE tile % 4 * 0.1 - 0.12 END::DOUBLE AS theta, CASE WHEN tile = 0 THEN 0.0 ELSE 1.5 + tile % 2 END::DOUBLE AS tx, CASE WHEN tile = 0 THEN 0.0 ELSE -0.5 END::DOUBLE AS ty FROM t),
a AS (SELECT *, sum(theta) OVER (ORDER BY tile) AS turned FROM m), b AS (SELECT *, turned - theta AS before FROM a)
SELECT CAST(tile AS BIGINT) AS tile, round(turned, 6) + 0.0 AS theta, round(sum(cos(before) * tx - sin(before) * ty) OVER (ORDER BY tile), 6) + 0.0 AS tx, round(sum(sin(before) * tx + cos(before) * ty) OVER (ORDER BY tile), 6) + 0.0 AS ty FROM b""")
def _(v):
    """A chain of rotated tiles; models back to a smaller tile don't count."""
    tiles = v.table("embeddings").select(F.expr("vec_id div 25").alias("dst")).distinct().where("dst > 0")
    models = tiles.select((F.col("dst") - 1).alias("src"), "dst", (F.col("dst") % 4 * 0.1 - 0.12).alias("theta"), (1.5 + F.col("dst") % 2).alias("tx"), F.lit(-0.5).alias("ty"))
    back = models.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[F.lit(9.0).alias(c) for c in ("theta", "tx", "ty")])
    t = G.initial_transforms(models.unionByName(back))
    return t.select("tile", *[(F.round(c, 6) + 0.0).alias(c) for c in ("theta", "tx", "ty")])


def _joint(v):
    """Matched points of neighbouring tiles of a chain, fifty a pair, whose true transforms are known; they repeat every
    16 tiles."""
    e = v.table("embeddings").select(F.expr("vec_id div 50").alias("t1"), (F.col("embedding")[0].cast("double") * 50).alias("x"), (F.col("embedding")[1].cast("double") * 50).alias("y"))
    e = e.withColumn("t2", F.col("t1") + 1)
    for i, t in (("s", "t1"), ("d", "t2")):  # a point of the common frame, in each tile's own frame
        k = F.col(t) % 16
        th, px, py = k * 0.02, F.col("x") - k * 3.0, F.col("y") + k * 1.0
        e = e.withColumns({f"{i}x": F.cos(th) * px + F.sin(th) * py, f"{i}y": -F.sin(th) * px + F.cos(th) * py})
    return e.select("t1", "t2", F.lit(1.0).alias("w"), "sx", "sy", "dx", "dy")


def _transforms(v, scale: float):
    tiles = v.table("embeddings").select(F.expr("vec_id div 50").alias("t")).distinct().select(F.explode(F.array("t", F.col("t") + 1)).alias("tile")).distinct()
    k = F.col("tile") % 16
    return tiles.select("tile", (k * 0.02 * scale).alias("theta"), (k * 3.0 * scale).alias("tx"), (k * -1.0 * scale).alias("ty"))


#: Tiles with the factor k of their pose.
_TILES = "(SELECT DISTINCT t + o AS tile, (t + o) % 16 AS k FROM (SELECT DISTINCT vec_id // 50 AS t FROM embeddings), (VALUES (0), (1)) s(o))"


@add("registration_error", "", """WITH e AS (SELECT vec_id // 50 % 16 AS t1, (vec_id // 50 + 1) % 16 AS t2, embedding[1]::DOUBLE * 50 AS x, embedding[2]::DOUBLE * 50 AS y FROM embeddings),
p AS (SELECT *, cos(t1 * 0.02) * (x - t1 * 3.0) + sin(t1 * 0.02) * (y + t1) AS sx, -sin(t1 * 0.02) * (x - t1 * 3.0) + cos(t1 * 0.02) * (y + t1) AS sy, cos(t2 * 0.02) * (x - t2 * 3.0) + sin(t2 * 0.02) * (y + t2) AS dx, -sin(t2 * 0.02) * (x - t2 * 3.0) + cos(t2 * 0.02) * (y + t2) AS dy FROM e)
SELECT round(sum(pow(cos(t1 * 0.01) * sx - sin(t1 * 0.01) * sy + t1 * 1.5 - (cos(t2 * 0.01) * dx - sin(t2 * 0.01) * dy + t2 * 1.5), 2) + pow(sin(t1 * 0.01) * sx + cos(t1 * 0.01) * sy - t1 * 0.5 - (sin(t2 * 0.01) * dx + cos(t2 * 0.01) * dy - t2 * 0.5), 2)), 4) AS error FROM p""")
def _(v):
    return G.registration_error(_joint(v), _transforms(v, 0.5)).select(F.round("error", 4).alias("error"))


@add("optimize_transforms", "", f"SELECT tile, round(k * 0.02::DOUBLE, 5) AS theta, round(k * 3.0::DOUBLE, 4) AS tx, round(k * -1.0::DOUBLE, 4) + 0.0 AS ty FROM {_TILES}")
def _(v):
    t = G.optimize_transforms(_joint(v), _transforms(v, 0.6))
    return t.select("tile", (F.round("theta", 5) + 0.0).alias("theta"), (F.round("tx", 4) + 0.0).alias("tx"), (F.round("ty", 4) + 0.0).alias("ty"))


@add("rereference_transforms", "", f"""SELECT tile, round(k * 0.02 - 0.04::DOUBLE, 6) + 0.0 AS theta,
round(cos(0.04) * (k * 3.0 - 6) + sin(0.04) * (-k + 2), 6) + 0.0 AS tx, round(-sin(0.04) * (k * 3.0 - 6) + cos(0.04) * (-k + 2), 6) + 0.0 AS ty FROM {_TILES}""")
def _(v):
    t = G.rereference_transforms(_transforms(v, 1.0), 2)
    return t.select("tile", *[(F.round(c, 6) + 0.0).alias(c) for c in ("theta", "tx", "ty")])


@add("canvas_bounds", "", f"""WITH t AS (SELECT k AS t FROM {_TILES}), c AS (SELECT cos(t * 0.02) * x - sin(t * 0.02) * y + t * 3.0 AS cx, sin(t * 0.02) * x + cos(t * 0.02) * y - t AS cy FROM t, (VALUES (0), (64)) a(x), (VALUES (0), (25)) b(y))
SELECT CAST(floor(min(cx)) AS INT) AS x0, CAST(ceil(max(cx)) AS INT) AS x1, CAST(floor(min(cy)) AS INT) AS y0, CAST(ceil(max(cy)) AS INT) AS y1 FROM c""")
def _(v):
    return G.canvas_bounds(_transforms(v, 1.0), 25, 64)


@add("blend_tiles", "vox", """WITH t AS (SELECT DISTINCT z AS tile, (z % 3 - 1) * 0.1::DOUBLE AS theta, z * 5.25::DOUBLE AS tx, z * 2.5::DOUBLE AS ty FROM vox),
p AS (SELECT tile, cx, cy, round(cos(theta) * (cx - tx) + sin(theta) * (cy - ty), 9) AS u, round(-sin(theta) * (cx - tx) + cos(theta) * (cy - ty), 9) AS v FROM t, range(80) a(i), range(50) b(j), LATERAL (SELECT CAST(floor(tx) AS INT) - 8 + CAST(i AS INT) AS cx, CAST(floor(ty) AS INT) - 12 + CAST(j AS INT) AS cy)),
q AS (SELECT *, floor(u) AS fu, floor(v) AS fv, least(u, v, 63 - u, 24 - v) + 1 AS edge FROM p WHERE u BETWEEN 0 AND 63 AND v BETWEEN 0 AND 24),
w AS (SELECT tile, cx, cy, edge, CAST(fu AS INT) + k AS x, CAST(fv AS INT) + l AS y, (CASE k WHEN 0 THEN 1 - (u - fu) ELSE u - fu END) * (CASE l WHEN 0 THEN 1 - (v - fv) ELSE v - fv END) AS w FROM q, (VALUES (0), (1)) c(k), (VALUES (0), (1)) d(l))
SELECT cy AS y, cx AS x, round(sum(edge * w * value) / sum(edge * w), 6) AS value FROM w JOIN vox ON vox.z = tile AND vox.y = w.y AND vox.x = w.x WHERE w > 0 GROUP BY 1, 2""")
def _(v):
    """Slices as tiles, turned both ways and shifted by parts of a pixel."""
    tiles = v.vox.select(F.col("z").alias("tile"), "y", "x", "value")
    t = tiles.select("tile").distinct().select("tile", ((F.col("tile") % 3 - 1) * 0.1).alias("theta"), (F.col("tile") * 5.25).alias("tx"), (F.col("tile") * 2.5).alias("ty"))
    return G.blend_tiles(tiles, t, 25, 64).withColumn("value", F.round("value", 6))


_STATS = f"""WITH g AS (SELECT z, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx FROM seg_a WHERE label <> 0 GROUP BY 1, 2), e AS ({ECC.format(v='seg_a')}),
f AS (SELECT l.label, s.z FROM (SELECT DISTINCT label FROM seg_a WHERE label <> 0) l, (SELECT DISTINCT z FROM vox) s)"""


@add("slicewise_stats", "seg_a vox", _STATS + f" SELECT f.z, f.label, area, round(sqrt(area * 4 / {PI}), 6) AS diameter, round(cy, 6) AS cy, round(cx, 6) AS cx, round(eccentricity, 6) AS eccentricity FROM f LEFT JOIN g USING (z, label) LEFT JOIN e USING (z, label)")
def _(v):
    return S.slicewise_stats(v.seg_a).select("z", "label", "area", *rounded("diameter", "cy", "cx", "eccentricity"))


_AREAS = "WITH a AS (SELECT {k} label, count(*) AS ma FROM inner_seg WHERE label <> 0 GROUP BY ALL), f AS (SELECT {k} label, count(*) AS mf FROM outer_seg GROUP BY ALL)"


@add("g_ratio", "inner_seg outer_seg", _AREAS.format(k="") + " SELECT label, round(sqrt(1 - (mf - ma) / mf::DOUBLE), 6) AS g_ratio FROM f JOIN a USING (label)")
def _(v):
    return S.g_ratio(v.inner_seg, v.outer_seg).select("label", *rounded("g_ratio"))


@add("g_ratio_slicewise", "inner_seg outer_seg", _AREAS.format(k="z,") + " SELECT z, label, round(sqrt(1 - (mf - ma) / mf::DOUBLE), 6) AS g_ratio FROM f JOIN a USING (z, label)")
def _(v):
    return S.g_ratio(v.inner_seg, v.outer_seg, True).select("z", "label", *rounded("g_ratio"))


_THICK = _AREAS.format(k="z,") + f""", t AS (SELECT z, label, (sqrt(mf * 4 / {PI}) - sqrt(ma * 4 / {PI})) / 2 AS thickness, sqrt(mf * 4 / {PI}) AS outer_d, sqrt(ma * 4 / {PI}) / sqrt(mf * 4 / {PI}) AS ratio, z > min(z) OVER w AND z < max(z) OVER w AS mid FROM f JOIN a USING (z, label) WINDOW w AS (PARTITION BY label))"""


@add("sheath_thickness", "inner_seg outer_seg", _THICK + " SELECT z, label, round(thickness, 6) AS thickness, round(ratio, 6) AS ratio, mid AND ratio <= 0.99::DOUBLE AS valid FROM t")
def _(v):
    return S.sheath_thickness(v.inner_seg, v.outer_seg).select("z", "label", *rounded("thickness", "ratio"), "valid")


@add("object_variability", "inner_seg outer_seg", _THICK + " SELECT label, round(stddev_samp(thickness) / avg(thickness), 6) AS cv, round(var_samp(thickness), 6) AS variance, round(max(thickness) - min(thickness), 6) AS spread FROM t GROUP BY label")
def _(v):
    return S.object_variability(S.sheath_thickness(v.inner_seg, v.outer_seg), "thickness").select("label", *rounded("cv", "variance", "spread"))


@add("permutation_null", "inner_seg outer_seg", _THICK + """, c AS (SELECT z, label, thickness, row_number() OVER (ORDER BY z, label) AS r, row_number() OVER (ORDER BY md5(concat_ws(',', z, label, 5)), z, label) AS q FROM t WHERE thickness IS NOT NULL),
s AS (SELECT a.label, b.thickness FROM c a JOIN c b ON b.q = a.r)
SELECT label, round(stddev_samp(thickness) / avg(thickness), 6) AS cv, round(var_samp(thickness), 6) AS variance, round(max(thickness) - min(thickness), 6) AS spread FROM s GROUP BY label""")
def _(v):
    return S.permutation_null(S.sheath_thickness(v.inner_seg, v.outer_seg), "thickness", 5).select("label", *rounded("cv", "variance", "spread"))


@add("distribution_summary", "inner_seg outer_seg", _THICK + " SELECT round(avg(thickness), 6) AS mean, round(median(thickness), 6) AS median, round(stddev_samp(thickness), 6) AS std, CAST(count(thickness) AS BIGINT) AS n FROM t")
def _(v):
    return S.distribution_summary(S.sheath_thickness(v.inner_seg, v.outer_seg), "thickness").select(*rounded("mean", "median", "std"), "n")


@add("joint_histogram", "inner_seg outer_seg", _THICK + " SELECT CAST(floor(ln(outer_d) * 8 / ln(20.0::DOUBLE)) AS INT) AS xbin, CAST(floor(ratio * 10) AS INT) AS ybin, CAST(count(*) AS BIGINT) AS n FROM t WHERE outer_d >= 1 AND outer_d < 20 AND ratio >= 0 AND ratio < 1 GROUP BY 1, 2")
def _(v):
    from voxelry.operators.regions import equivalent_diameter

    t = S.sheath_thickness(v.inner_seg, v.outer_seg)
    outer = v.outer_seg.groupBy("z", "label").agg(equivalent_diameter(F.count("*"), 2).alias("do"))
    return S.joint_histogram(t.join(outer, ["z", "label"]), "do", "ratio", (1.0, 20.0, 8), (0.0, 1.0, 10))


@add("log_linear_fit", "inner_seg outer_seg", _THICK + """, m AS (SELECT label, avg(ratio) AS ratio, avg(outer_d) AS outer_d FROM t GROUP BY label)
SELECT 'pooled' AS scope, round(regr_slope(ratio, ln(outer_d)), 6) AS slope, round(regr_intercept(ratio, ln(outer_d)), 6) AS intercept FROM t UNION ALL SELECT 'objects', round(regr_slope(ratio, ln(outer_d)), 6), round(regr_intercept(ratio, ln(outer_d)), 6) FROM m""")
def _(v):
    from voxelry.operators.regions import equivalent_diameter

    t = S.sheath_thickness(v.inner_seg, v.outer_seg)
    outer = v.outer_seg.groupBy("z", "label").agg(equivalent_diameter(F.count("*"), 2).alias("do"))
    return S.log_linear_fit(t.join(outer, ["z", "label"]), "ratio", "do").select("scope", *rounded("slope", "intercept"))


#: Peaks of the area along z: plateaus between lower values, and how far they stand above the higher of the two valleys
#: that part them from something higher. Two of them are never neighbours, so the distance of 2 drops none.
_PEAKS = """WITH v AS (SELECT label, z, count(*) AS v, row_number() OVER (PARTITION BY label ORDER BY z) AS i FROM seg_b WHERE label <> 0 GROUP BY label, z),
e AS (SELECT *, coalesce(v <> lag(v) OVER w, true) AS new FROM v WINDOW w AS (PARTITION BY label ORDER BY i)),
g AS (SELECT *, sum(new::INT) OVER (PARTITION BY label ORDER BY i) AS run FROM e),
r AS (SELECT label, run, v, min(i) AS a, max(i) AS b FROM g GROUP BY label, run, v),
k AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM r WINDOW w AS (PARTITION BY label ORDER BY run)),
p AS (SELECT label, v, (a + b - 2) // 2 + 1 AS i FROM k WHERE before < v AND after < v),
q AS (SELECT p.label, p.i, p.v, (SELECT min(x.v) FROM v x WHERE x.label = p.label AND x.i <= p.i AND x.i > coalesce((SELECT max(y.i) FROM v y WHERE y.label = p.label AND y.i < p.i AND y.v > p.v), 0)) AS lo,
  (SELECT min(x.v) FROM v x WHERE x.label = p.label AND x.i >= p.i AND x.i < coalesce((SELECT min(y.i) FROM v y WHERE y.label = p.label AND y.i > p.i AND y.v > p.v), 1000000)) AS hi FROM p)
SELECT q.label, v.z, q.v::DOUBLE AS value FROM q JOIN v ON v.label = q.label AND v.i = q.i WHERE q.v - greatest(lo, hi) >= 1"""


@add("profile_peaks", "seg_b", _PEAKS)
def _(v):
    return S.profile_peaks(S.slicewise_stats(v.seg_b), "area", 2, 1.0)


_TURNED = """WITH e AS (SELECT vec_id // 50 AS pair_id, vec_id // 50 % 10 AS k, vec_id, embedding[1]::DOUBLE * 100 AS sx, embedding[2]::DOUBLE * 100 AS sy, (vec_id // 50 % 10) * 0.05::DOUBLE AS th FROM embeddings),
m AS (SELECT pair_id, sx, sy, cos(th) * sx - sin(th) * sy + k + CASE WHEN vec_id % 7 = 3 THEN 40 ELSE 0 END AS dx, sin(th) * sx + cos(th) * sy - k AS dy FROM e)"""
_MICRO = ", ".join(f"CAST(round({c} * 1e6::DOUBLE) AS BIGINT)" for c in ("sx", "sy", "dx", "dy"))


@add("sample_matches", "", f"""{_TURNED}
SELECT pair_id, round(sx, 6) AS sx, round(sy, 6) AS sy, round(dx, 6) AS dx, round(dy, 6) AS dy FROM m QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY md5(concat_ws(',', {_MICRO}, 1)), sx, sy, dx, dy) <= 5""")
def _(v):
    return R.sample_matches(_matches(v), 5, 1).select("pair_id", *rounded("sx", "sy", "dx", "dy"))


_NORMAL = "(SELECT z, y, x, (value - (SELECT min(value) FROM vox))::DOUBLE / ((SELECT max(value) FROM vox) - (SELECT min(value) FROM vox))::DOUBLE AS value FROM vox)"
_FLAT_OBJECTS = "WITH RECURSIVE " + cc_sql(f"SELECT z, y, x FROM {_NORMAL} WHERE value > 0.62 AND value <= 1.0", PLANE) + f""", e AS ({ECC.format(v='cc')}), a AS (SELECT z, label, count(*) AS area FROM cc GROUP BY 1, 2)
SELECT z, label, area, round(sqrt(area * 4 / {PI}), 6) AS diameter, round(eccentricity, 6) AS eccentricity, CAST(area * area AS BIGINT) AS painted FROM a JOIN e USING (z, label) WHERE area >= 3 AND eccentricity <= 0.99"""


@add("pipeline_2d_objects", "vox", _FLAT_OBJECTS)
def _(v):
    """The 2D pipeline without sheaths."""
    from voxelry.pipelines import pipeline_2d

    found = pipeline_2d(v.vox, v.dims, v.mask_ds, steps=("normalise", "filter", "properties", "statistics"))
    painted = found["properties"].groupBy("z", "label").agg(F.sum("area").cast("bigint").alias("painted"))
    return found["statistics"].drop("sheath").join(painted, ["z", "label"])


#: Core components that traverse the volume, and slices of the wider mask that are joined beside them.
_TOUCH = """SELECT label, count(*) AS n, count(DISTINCT z) AS slices, (min(z) = 0)::INT + (max(z) = (SELECT dz FROM dims) - 1)::INT + (min(y) = 0 OR max(y) = 24 OR min(x) = 0 OR max(x) = 63)::INT = 2 AS traversing FROM {v} GROUP BY label"""
_JOINED = (
    "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM vox WHERE value > 158", FULL, tag="1") + ", cl AS (" + _TOUCH.format(v="cc1") + "), th AS (SELECT z, y, x, label FROM cc1 JOIN cl USING (label) WHERE n >= 4 AND traversing), "
    + cc_sql("SELECT z, y, x FROM vox ANTI JOIN th USING (z, y, x) WHERE value > 140", PLANE, tag="2") + ", o AS (" + SLICE_OVERLAP.format(v="cc2", m=1) + ")" + _BEST.format(v="cc2", t="0.5::DOUBLE")
    + CLOSURE.replace(" SELECT CAST(a AS BIGINT)", ", mp AS (SELECT CAST(a AS BIGINT)") + """), mg AS (SELECT z, y, x, coalesce(new_label, cc2.label) AS label FROM cc2 LEFT JOIN mp ON mp.label = cc2.label),
j AS (SELECT z, y, x, label FROM th UNION ALL SELECT z, y, x, label + (SELECT dz * dy * dx FROM dims) FROM mg WHERE label IN (SELECT label FROM mg GROUP BY label HAVING count(*) >= 4))
SELECT label, n, slices, traversing FROM (""" + _TOUCH.format(v="j") + ")"
)


@add("pipeline_3d_joined", "vox dims", _JOINED)
def _(v):
    """Objects of the 3D pipeline before holes, nodes and sheaths."""
    from voxelry.operators.labels import classify_traversing
    from voxelry.pipelines import pipeline_3d

    joined = pipeline_3d(v.vox, v.dims, v.mask_ds)["joined"]
    sizes = joined.groupBy("label").agg(F.count("*").alias("n"), F.countDistinct("z").alias("slices"))
    return sizes.join(classify_traversing(joined, v.dims).select("label", "traversing"), "label")


_FLAT_SHEATHS = _FLAT_OBJECTS.replace("""
SELECT z, label, area,""", """, st AS (
SELECT z, label, area,""") + f"""), ob AS (SELECT z, y, x, label FROM cc SEMI JOIN st USING (z, label)),
dx AS (SELECT z, y, CAST(t AS INT) AS x, min((t - x) * (t - x)) AS d FROM ob, range(64) r(t) GROUP BY 1, 2, 3),
dy AS (SELECT z, CAST(t AS INT) AS y, x, min(d + (t - y) * (t - y)) AS d FROM dx, range(25) r(t) GROUP BY 1, 2, 3),
ds AS (SELECT CAST(t AS INT) AS z, y, x, sqrt(min(d + (t - z) * (t - z))) AS d FROM dy, dims, range(dims.dz) r(t) GROUP BY 1, 2, 3),
h AS (SELECT z, y, x FROM ds JOIN {_NORMAL} n USING (z, y, x) JOIN mask_ds USING (z, y, x) ANTI JOIN ob USING (z, y, x) WHERE value > 0.52 AND value <= 1.0 AND d <= 2),
""" + flood_sql("SELECT 0 AS own, z, y, x, d AS value, coalesce(label, 0) AS seed FROM ds LEFT JOIN ob USING (z, y, x) WHERE label IS NOT NULL OR (z, y, x) IN (SELECT (z, y, x) FROM h)") + """,
sh AS (SELECT z, label, count(*) AS sheath FROM fl SEMI JOIN h USING (z, y, x) GROUP BY 1, 2)
SELECT st.*, coalesce(sheath, 0) AS sheath FROM st LEFT JOIN sh USING (z, label)"""


@add("pipeline_2d", "vox mask_ds dims", _FLAT_SHEATHS)
def _(v):
    """Statistics beside what the property volumes hold."""
    from voxelry.pipelines import pipeline_2d

    found = pipeline_2d(v.vox, v.dims, v.mask_ds)
    painted = found["properties"].groupBy("z", "label").agg(F.sum("area").cast("bigint").alias("painted"))
    return found["statistics"].join(painted, ["z", "label"], "left")


_WHOLE_3D = _JOINED[: _JOINED.rindex("\nSELECT label, n")] + ", jz AS (SELECT z, y, x, coalesce(label, 0) AS label FROM vox LEFT JOIN j USING (z, y, x)), ob AS MATERIALIZED (" + fill_sql("SELECT label, z, y, x FROM jz WHERE label <> 0", 0, True).replace("seg_a", "jz") + f"""),
rim AS (SELECT DISTINCT b.z, b.y, b.x, a.label FROM ob a, {FLAT_SQL} o JOIN vox b ON b.z = a.z AND b.y = a.y + dy AND b.x = a.x + dx LEFT JOIN ob c ON c.z = b.z AND c.y = b.y AND c.x = b.x WHERE c.label IS DISTINCT FROM a.label),
bare AS (SELECT r.label, r.z FROM rim r JOIN vox v USING (z, y, x) LEFT JOIN ob USING (z, y, x) GROUP BY r.label, r.z HAVING avg((v.value > 140 OR ob.label IS NOT NULL)::INT) < 0.5),
runs AS (SELECT label, z, count(*) OVER (PARTITION BY label, i) AS n FROM (SELECT *, z - row_number() OVER (PARTITION BY label ORDER BY z) AS i FROM bare)),
node AS (SELECT z, y, x, label FROM ob SEMI JOIN (SELECT * FROM runs WHERE n > 1) USING (label, z)), rest AS (SELECT z, y, x, label FROM ob ANTI JOIN node USING (z, y, x)),
dx AS (SELECT z, y, CAST(t AS INT) AS x, min((t - x) * (t - x)) AS d FROM rest, range(64) r(t) GROUP BY 1, 2, 3),
dy AS (SELECT z, CAST(t AS INT) AS y, x, min(d + (t - y) * (t - y)) AS d FROM dx, range(25) r(t) GROUP BY 1, 2, 3),
ds AS (SELECT CAST(t AS INT) AS z, y, x, sqrt(min(d + (t - z) * (t - z))) AS d FROM dy, dims, range(dims.dz) r(t) GROUP BY 1, 2, 3),
h AS (SELECT z, y, x FROM ds JOIN vox USING (z, y, x) JOIN mask_ds USING (z, y, x) ANTI JOIN ob USING (z, y, x) WHERE value > 140 AND d <= 1.5),
""" + flood_sql("SELECT 0 AS own, z, y, x, d AS value, coalesce(label, 0) AS seed FROM ds LEFT JOIN rest USING (z, y, x) WHERE label IS NOT NULL OR (z, y, x) IN (SELECT (z, y, x) FROM h)", "3") + """,
st AS (""" + _TOUCH.format(v="ob") + """), nn AS (SELECT label, count(*) AS nodes FROM node GROUP BY label), sh AS (SELECT label, count(*) AS sheath FROM fl3 SEMI JOIN h USING (z, y, x) GROUP BY label),
al AS (SELECT st.*, coalesce(nodes, 0) AS nodes, coalesce(sheath, 0) AS sheath FROM st LEFT JOIN nn USING (label) LEFT JOIN sh USING (label))
SELECT label, CASE WHEN label > (SELECT dz * dy * dx FROM dims) THEN 'slices' ELSE 'core' END AS source, n, slices, traversing, nodes, sheath, round(CASE WHEN n > nodes THEN sqrt((n - nodes) / (n - nodes + sheath)) END, 6) AS g_ratio FROM al"""


@add("pipeline_3d", "vox mask_ds dims", _WHOLE_3D)
def _(v):
    from voxelry.pipelines import pipeline_3d

    return pipeline_3d(v.vox, v.dims, v.mask_ds, inside=v.inside)["statistics"]



@add("flagship", "vox", "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM vox WHERE value > 140", "dz = 0") + f""", p AS (SELECT z, label, count(*) AS area, min(y) AS y0, CAST(max(y) + 1 AS INT) AS y1, min(x) AS x0, CAST(max(x) + 1 AS INT) AS x1, avg(y) AS cy, avg(x) AS cx FROM cc GROUP BY z, label)
SELECT z, label, CAST(area AS BIGINT) AS area, y0, y1, x0, x1, round(cy, 6) AS cy, round(cx, 6) AS cx, round(sqrt(area * 4 / {PI}), 6) AS diameter FROM p WHERE area >= 3""")
def flagship(v):
    """Threshold, slice components, region properties and a property filter."""
    c = components(v.vox.where("value > 140"), 8, v.dims)
    box = [f(a).cast("int").alias(f"{a}{i}") if not i else (f(a) + 1).cast("int").alias(f"{a}{i}") for a in ("y", "x") for i, f in ((0, F.min), (1, F.max))]
    p = c.groupBy("z", "label").agg(F.count("*").alias("area"), *box, F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    valid = R.property_filter(p, min_area=3).where("new_label <> 0").select("label")
    p = p.join(valid, "label", "left_semi").withColumn("diameter", R.equivalent_diameter(F.col("area"), 2))
    return p.select("z", "label", "area", "y0", "y1", "x0", "x1", *rounded("cy", "cx", "diameter"))
