"""Queries of section 2.8 and of components in other sections."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from voxelry.operators import components as C
from voxelry.operators import labels as L

from .views import registry

add = registry.add

_NEAR = "(SELECT CAST(a - 1 AS INT) AS dz, CAST(b - 1 AS INT) AS dy, CAST(c - 1 AS INT) AS dx FROM range(3) r(a), range(3) s(b), range(3) t(c) WHERE NOT (a = 1 AND b = 1 AND c = 1))"


def cc_sql(src: str, near: str, within: str = "", base: str = "", tag: str = "") -> str:
    """Recursive labels of the foreground ``src`` (z, y, x[, own]): every voxel's smallest reachable linear index.
    Labels flow only from voxels without a smaller neighbour, so the recursion stays small. ``base`` keeps the voxels
    of several owners at one place apart; ``tag`` tells the tables of two uses in one query apart."""
    same = " AND b.own = a.own" if within else ""
    own = ", own" if within else ""
    aown = ", a.own" if within else ""
    sql = f"""fg AS (SELECT z, y, x{own}, {base}z * 1600 + y * 64 + x + 1 AS i FROM ({src})),
nb AS (SELECT a.i AS i, b.i AS k FROM fg a, {_NEAR} o JOIN fg b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx{same} WHERE {near}),
sd AS (SELECT i FROM fg WHERE i NOT IN (SELECT i FROM nb WHERE k < i)),
rc(s, i) AS (SELECT i, i FROM sd UNION SELECT rc.s, nb.k FROM rc JOIN nb ON nb.i = rc.i),
cc AS (SELECT z, y, x{own}, CAST(l AS BIGINT) AS label FROM fg JOIN (SELECT i, min(s) AS l FROM rc GROUP BY i) USING (i))"""
    return re.sub(r"\b(fg|nb|sd|rc|cc)\b", rf"\g<1>{tag}", sql) if tag else sql


FACE, PLANE, FULL = "abs(dz) + abs(dy) + abs(dx) = 1", "dz = 0", "true"
BRIGHT = "SELECT z, y, x FROM vox WHERE value > 148"


@add("components_3d_labels", "vox", "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM vox WHERE value > 158", FULL) + " SELECT * FROM cc")
def _(v):
    return C.components(v.vox.where("value > 158"), 26, v.dims, block=(8, 10, 16))


@add("components_2d", "vox", "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM vox WHERE value > 140", PLANE) + " SELECT * FROM cc")
def _(v):
    return C.components_2d(v.vox.where("value <= 140"), v.dims, v.inside)


@add("components_3d", "vox dims", "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM vox WHERE value > 158", FULL) + """,
n AS (SELECT label, count(*) AS n FROM cc GROUP BY 1 HAVING count(*) >= 3), r AS (SELECT label, row_number() OVER (ORDER BY label) AS new FROM n WHERE label <> (SELECT label FROM n ORDER BY n DESC, label LIMIT 1))
SELECT z, y, x, new AS label FROM cc JOIN r USING (label)""")
def _(v):
    return C.components_3d(v.vox.where("value <= 158"), v.dims, 3, inside=v.inside)


@add("components_2d_to_3d", "vox", "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM vox WHERE value > 160", FULL) + " SELECT * FROM cc")
def _(v):
    flat = C.components(v.vox.where("value > 160"), 8, v.dims)
    return C.components_2d_to_3d(flat, v.dims)


@add("remove_small_components", "vox", "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM vox WHERE value > 158", FACE) + " SELECT z, y, x, count(*) OVER (PARTITION BY label) >= 4 AS kept FROM cc")
def _(v):
    kept, removed = C.remove_small_components(v.vox.where("value > 158"), 4, 6, v.dims)
    return kept.withColumn("kept", F.lit(True)).unionByName(removed.withColumn("kept", F.lit(False)))


@add("threshold_seeds", "vox", "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM vox WHERE value > 150 AND value <= 190", FACE) + """,
n AS (SELECT label, dense_rank() OVER (ORDER BY label) AS new FROM cc GROUP BY label HAVING count(*) >= 3) SELECT z, y, x, CAST(new AS BIGINT) AS label FROM cc JOIN n USING (label)""")
def _(v):
    from voxelry.operators.watershed import threshold_seeds

    return threshold_seeds(v.vox, v.dims, 150, 190, 3)


#: Pieces of seg_a where it is bright: labels in several parts.
_OWN = "SELECT z, y, x, label AS own FROM seg_a JOIN vox USING (z, y, x) WHERE label <> 0 AND value > 156"


def _bright(v):
    return v.seg_a.where("label <> 0").join(v.vox.where("value > 156"), ["z", "y", "x"], "left_semi")


_SIZES = ", sz AS (SELECT own, label, count(*) AS n FROM cc GROUP BY 1, 2), rk AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY n DESC, label) AS r FROM sz)"


@add("split_disconnected", "seg_a vox", "WITH RECURSIVE " + cc_sql(_OWN, FULL, "own") + _SIZES + """, fr AS (SELECT own, label, (SELECT max(own) FROM cc) + row_number() OVER (ORDER BY own, r) AS new FROM rk WHERE r > 1 AND n > 2)
SELECT z, y, x, CAST(CASE WHEN rk.r = 1 THEN cc.own ELSE coalesce(fr.new, 0) END AS BIGINT) AS label FROM cc JOIN rk USING (own, label) LEFT JOIN fr USING (own, label)""")
def _(v):
    return C.split_disconnected(_bright(v), v.dims, 2)


@add("split_listed_labels", "seg_a vox", "WITH RECURSIVE " + cc_sql(_OWN + " AND label % 4 = 1", FULL, "own") + _SIZES + f""", fr AS (SELECT own, label, (SELECT max(own) FROM ({_OWN})) + row_number() OVER (ORDER BY own, r) AS new FROM rk WHERE r > 1 AND n > 2)
SELECT z, y, x, CAST(CASE WHEN rk.r = 1 THEN cc.own ELSE coalesce(fr.new, 0) END AS BIGINT) AS label FROM cc JOIN rk USING (own, label) LEFT JOIN fr USING (own, label)
UNION ALL SELECT z, y, x, own FROM ({_OWN}) WHERE own % 4 <> 1""")
def _(v):
    b = _bright(v)
    return C.split_disconnected(b, v.dims, 2, b.where("label % 4 = 1"))


@add("disconnected_labels", "seg_a vox", "WITH RECURSIVE " + cc_sql(_OWN, FULL, "own") + " SELECT own AS label, CAST(count(DISTINCT label) AS BIGINT) AS pieces FROM cc GROUP BY own HAVING count(DISTINCT label) > 1")
def _(v):
    return C.disconnected(_bright(v), v.dims)


@add("filter_segments", "seg_a vox", "WITH RECURSIVE " + cc_sql(_OWN, FULL, "own") + _SIZES + " SELECT z, y, x, own AS label FROM cc JOIN rk USING (own, label) WHERE r = 1")
def _(v):
    return C.filter_segments(_bright(v), v.dims, only_largest=True)


@add("merge_connected", "seg_a vox", "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM seg_a JOIN vox USING (z, y, x) WHERE label <> 0 AND value > 156", FACE) + f""",
m AS (SELECT own, cc.label FROM cc JOIN ({_OWN}) o USING (z, y, x)), pr AS (SELECT DISTINCT a.own AS a, b.own AS b FROM m a JOIN m b USING (label)), gr(a, b) AS (SELECT a, b FROM pr UNION SELECT gr.a, pr.b FROM gr JOIN pr ON pr.a = gr.b)
SELECT a AS label, min(b) AS new_label FROM gr GROUP BY a""")
def _(v):
    return L.merge_connected(_bright(v))
