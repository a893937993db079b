"""Queries of section 2.11."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.operators import stencil as T
from voxelry.operators.labels import held

from .views import registry

add = registry.add
BOX = T.structuring_element("box", 1)
BOX_SQL = "(SELECT CAST(a - 1 AS INT) AS dz, CAST(b - 1 AS INT) AS dy, CAST(c - 1 AS INT) AS dx FROM range(3) r(a), range(3) s(b), range(3) t(c))"
FACE_SQL = f"(SELECT * FROM {BOX_SQL} WHERE abs(dz) + abs(dy) + abs(dx) = 1)"


@add("structuring_element", "vox", """WITH e(kind, dz, dy, dx) AS (SELECT kind, CAST(a AS INT), CAST(b AS INT), CAST(c AS INT) FROM (VALUES ('diamond'), ('ball'), ('disk')) k(kind), range(-2, 3) r(a), range(-3, 4) s(b), range(-3, 4) t(c)
WHERE CASE kind WHEN 'diamond' THEN abs(a) <= 1 AND abs(a) / 1.0::DOUBLE + abs(b) / 3.0::DOUBLE + abs(c) / 3.0::DOUBLE <= 1 + 1e-9 WHEN 'ball' THEN a * a + b * b + c * c <= 4 ELSE a = 0 AND b * b + c * c <= 9 END)
SELECT kind, v.z, v.y, v.x, CAST(count(*) AS BIGINT) AS n FROM e JOIN (SELECT z, y, x FROM vox WHERE value > 170) m ON true JOIN vox v ON v.z = m.z + dz AND v.y = m.y + dy AND v.x = m.x + dx GROUP BY 1, 2, 3, 4""")
def _(v):
    """Which elements around bright voxels cover a voxel, and how many."""
    bright = v.vox.where("value > 170").select("z", "y", "x")
    out = []
    for kind, radius in (("diamond", (1, 3, 3)), ("ball", 2), ("disk", 3)):
        hit = T._inside(T.shifted(bright, T.structuring_element(kind, radius)), v.dims).groupBy("z", "y", "x").agg(F.count("*").alias("n"))
        out.append(held(hit, v.inside).select(F.lit(kind).alias("kind"), "z", "y", "x", "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])


@add("binary_dilate", "vox", f"SELECT DISTINCT v.z, v.y, v.x FROM vox v JOIN (SELECT CAST(z + dz AS INT) AS z, CAST(y + dy AS INT) AS y, CAST(x + dx AS INT) AS x FROM vox, {BOX_SQL} o WHERE value > 170) m USING (z, y, x)")
def _(v):
    return T.binary_dilate(v.vox.where("value > 170"), BOX, v.dims, v.inside)


@add("binary_erode", "vox", f"""WITH m AS (SELECT z, y, x FROM vox WHERE value > 90)
SELECT m.z, m.y, m.x FROM m, {FACE_SQL} o JOIN m n ON n.z = m.z + dz AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY 1, 2, 3 HAVING count(*) = 6""")
def _(v):
    return T.binary_erode(v.vox.where("value > 90"), [(0, 0, 0), *T.FACES], v.dims)


@add("boundary_mask", "vox mask_ds dims", f"""WITH c AS (SELECT z, y, x FROM vox ANTI JOIN mask_ds USING (z, y, x)), e AS (SELECT m.z, m.y, m.x FROM mask_ds m, (SELECT * FROM {FACE_SQL} WHERE dz = 0) o JOIN mask_ds n ON n.z = m.z AND n.y = m.y + dy AND n.x = m.x + dx GROUP BY 1, 2, 3 HAVING count(*) = 4)
SELECT 'eroded' AS kind, z, y, x FROM e UNION ALL SELECT DISTINCT 'dilated', v.z, v.y, v.x FROM vox v, (SELECT CAST(0 AS INT) AS dz, CAST(0 AS INT) AS dy, CAST(0 AS INT) AS dx UNION ALL SELECT * FROM {FACE_SQL} WHERE dz = 0) o JOIN c ON c.z = v.z AND c.y = v.y + dy AND c.x = v.x + dx WHERE v.z >= 2 AND v.z < (SELECT dz FROM dims) - 2""")
def _(v):
    disk = T.structuring_element("disk", 1)
    eroded, rim = T.boundary_mask(v.mask_ds, v.dims, disk), T.boundary_mask(v.mask_ds, v.dims, disk, False, 2)
    return eroded.select(F.lit("eroded").alias("kind"), "z", "y", "x").unionByName(rim.select(F.lit("dilated").alias("kind"), "z", "y", "x"))


@add("grey_dilate", "seg_a", f"SELECT a.z, a.y, a.x, max(b.label) AS label FROM seg_a a, {BOX_SQL} o JOIN seg_a b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3")
def _(v):
    return T.grey_dilate(v.seg_a, BOX, v.dims, inside=v.inside)


@add("close_labels", "seg_a", f"""WITH d AS (SELECT a.z, a.y, a.x, max(b.label) AS label FROM seg_a a, {BOX_SQL} o JOIN seg_a b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3)
SELECT a.z, a.y, a.x, min(b.label) AS label FROM d a, {BOX_SQL} o JOIN d b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx GROUP BY 1, 2, 3""")
def _(v):
    return T.close_labels(v.seg_a, BOX, v.dims, inside=v.inside)


@add("label_rim_outer", "seg_a", f"SELECT DISTINCT b.z, b.y, b.x, a.label FROM seg_a a, {FACE_SQL} o JOIN seg_a b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.label <> 0 AND b.label <> a.label")
def _(v):
    return T.label_rim(v.seg_a, v.dims, inside=v.inside)


@add("label_rim_inner", "seg_a", f"SELECT a.z, a.y, a.x, a.label FROM seg_a a, {FACE_SQL} o LEFT JOIN seg_a b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND b.label = a.label WHERE a.label <> 0 GROUP BY 1, 2, 3, 4 HAVING count(b.z) < 6")
def _(v):
    return T.label_rim(v.seg_a, v.dims, outer=False)


def _kernel_sql(sigma: float, order: int = 0) -> str:
    return "(VALUES " + ", ".join(f"({o}, {w!r}::DOUBLE)" for o, w in T.gaussian_kernel(sigma, order)) + ")"


def _smooth_sql(src: str, sigma: tuple, orders: tuple = (0, 0, 0)) -> str:
    """Three gathers with mirrored borders."""
    for axis, s, o in zip("zyx", sigma, orders):
        n = {"z": "(SELECT dz FROM dims)", "y": "25", "x": "64"}[axis]
        p = f"(t.{axis} + k.o)"
        mirror = f"CASE WHEN {p} < 0 THEN -1 - {p} WHEN {p} >= {n} THEN 2 * {n} - 1 - {p} ELSE {p} END"
        on = " AND ".join(f"s.{a} = {mirror if a == axis else 't.' + a}" for a in "zyx")
        src = f"(SELECT t.z, t.y, t.x, sum(s.value * k.w) AS value FROM vox t, {_kernel_sql(s, o)} k(o, w), {src} s WHERE {on} GROUP BY 1, 2, 3)"
    return src


@add("gaussian_smooth", "vox dims", f"SELECT z, y, x, round(value, 6) AS value FROM {_smooth_sql('vox', (0.5, 1.0, 1.0))}")
def _(v):
    return T.gaussian_smooth(v.vox, v.dims, (0.5, 1.0, 1.0)).withColumn("value", F.round("value", 6))


@add("difference_of_gaussians", "vox dims", f"SELECT z, y, x, round(a.value - b.value, 6) AS value FROM {_smooth_sql('vox', (0.3, 0.7, 0.7))} a JOIN {_smooth_sql('vox', (0.6, 1.2, 1.2))} b USING (z, y, x)")
def _(v):
    return T.difference_of_gaussians(v.vox, v.dims, (0.3, 0.7, 0.7), (0.6, 1.2, 1.2)).withColumn("value", F.round("value", 6))


@add("gradient_magnitude", "vox dims", "SELECT z, y, x, round(sqrt(sum(value * value)), 5) AS value FROM (" + " UNION ALL ".join(f"SELECT * FROM {_smooth_sql('vox', (0.6, 0.8, 0.8), o)}" for o in ((1, 0, 0), (0, 1, 0), (0, 0, 1))) + ") GROUP BY z, y, x")
def _(v):
    return T.gradient_magnitude(v.vox, v.dims, (0.6, 0.8, 0.8)).withColumn("value", F.round("value", 5))


@add("local_maxima", "vox", f"SELECT a.z, a.y, a.x, a.value FROM vox a, {BOX_SQL} o JOIN vox b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.value > 150 GROUP BY 1, 2, 3, 4 HAVING a.value = max(b.value)")
def _(v):
    return T.local_maxima(v.vox, BOX, v.dims, 150)


@add("separate_touching_labels", "seg_a", f"""WITH h AS (SELECT * FROM {BOX_SQL} WHERE (dz, dy, dx) > (0, 0, 0) AND (dz, dy, dx) <> (1, 1, 1)),
t AS (SELECT DISTINCT a.z, a.y, a.x FROM seg_a a, h JOIN seg_a b ON b.z = a.z - dz AND b.y = a.y - dy AND b.x = a.x - dx WHERE a.label <> 0 AND b.label <> 0 AND a.label <> b.label)
SELECT z, y, x, CAST(CASE WHEN (z, y, x) IN (SELECT z, y, x FROM t) THEN 0 ELSE label END AS BIGINT) AS label FROM seg_a""")
def _(v):
    return T.separate_touching_labels(v.seg_a)


@add("distance_transform", "vox", "SELECT a.z, a.y, a.x, round(sqrt(min(pow((a.z - b.z) * 2.0::DOUBLE, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2))), 6) AS value FROM vox a, vox b WHERE b.value > 172 GROUP BY 1, 2, 3")
def _(v):
    return T.distance_transform(v.vox.where("value > 172"), v.dims, (2.0, 1.0, 1.0), inside=v.inside).withColumn("value", F.round("value", 6))


@add("near_distance", "vox", "SELECT a.z, a.y, a.x, round(sqrt(min(pow((a.z - b.z) * 2.0::DOUBLE, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2))), 6) AS value FROM vox a JOIN vox b ON b.value > 165 AND abs(a.z - b.z) <= 1 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2 WHERE pow((a.z - b.z) * 2, 2) + pow(a.y - b.y, 2) + pow(a.x - b.x, 2) <= 5.29 GROUP BY 1, 2, 3")
def _(v):
    return T.near_distance(v.vox.where("value > 165").select("z", "y", "x"), v.dims, 2.3, (2.0, 1.0, 1.0), v.inside).select("z", "y", "x", F.round("value", 6).alias("value"))


def _snap_sql(most: int) -> str:
    """Rims peeled off one by one; the label without them whose next rim has the steepest mean gradient."""
    steps = ["e0 AS (SELECT z, y, x, label FROM outer_seg WHERE label <> 0)"]
    for k in range(most + 1):
        steps.append(f"r{k} AS (SELECT a.z, a.y, a.x, a.label FROM e{k} a, {FACE_SQL} o LEFT JOIN e{k} b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx AND b.label = a.label GROUP BY 1, 2, 3, 4 HAVING count(b.z) < 6)")
        steps.append(f"e{k + 1} AS (SELECT * FROM e{k} ANTI JOIN r{k} USING (z, y, x, label))")
    rings = " UNION ALL ".join([f"SELECT *, {k} AS ring FROM r{k}" for k in range(most + 1)] + [f"SELECT *, {most + 1} FROM e{most + 1}"])
    return "WITH " + ", ".join(steps) + f""", rings AS ({rings}), g AS (SELECT label, ring, avg(value::DOUBLE) AS g FROM rings JOIN vox USING (z, y, x) WHERE ring <= {most} GROUP BY 1, 2),
best AS (SELECT label, ring FROM g QUALIFY row_number() OVER (PARTITION BY label ORDER BY g DESC, ring) = 1) SELECT z, y, x, label FROM rings JOIN best b USING (label) WHERE rings.ring >= b.ring"""


@add("snap_to_gradient", "outer_seg vox", _snap_sql(3))
def _(v):
    return T.snap_to_gradient(v.outer_seg, v.vox.select("z", "y", "x", F.col("value").cast("double").alias("value")), v.dims, 3)
