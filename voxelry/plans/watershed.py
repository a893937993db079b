"""Queries of kernels, seeds, watershed, sheaths and nodes."""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import functions as F

from voxelry.functions.graph import written
from voxelry.operators import kernels as K
from voxelry.operators import stencil as T
from voxelry.operators import supervoxels as V
from voxelry.operators import watershed as W
from voxelry.operators.components import components, split_disconnected

from .components import FACE, FULL, cc_sql
from .stencil import BOX_SQL, FACE_SQL
from .views import registry

add = registry.add
BOX = T.structuring_element("box", 1)
FLAT_SQL = f"(SELECT * FROM {FACE_SQL} WHERE dz = 0)"


def holes(v):
    """Tiles with holes where the intensity is low."""
    return v.seg_a


@add("map_blocks", "vox", "SELECT a.z, a.y, a.x, round(sum(b.value) / 3.0::DOUBLE, 6) AS value FROM vox a JOIN vox b ON b.z = a.z AND b.y = a.y AND b.x BETWEEN a.x - 1 AND a.x + 1 WHERE a.x BETWEEN 1 AND 62 GROUP BY 1, 2, 3")
def _(v):
    def mean3(b: np.ndarray) -> np.ndarray:
        p = np.pad(b.astype(float), [(0, 0), (0, 0), (1, 1)])
        return (p[:, :, :-2] + p[:, :, 1:-1] + p[:, :, 2:]) / 3

    return K.map_blocks(v.vox, v.dims, (5, 10, 16), (0, 0, 1), mean3, inside=v.inside).where("x BETWEEN 1 AND 62").withColumn("value", F.round("value", 6))


@add("map_labels", "seg_a vox", "SELECT DISTINCT v.z, v.y, v.x, s.label FROM seg_a s, (VALUES (-1), (0), (1)) o(d) JOIN vox v ON v.z = s.z AND v.y = s.y AND v.x = s.x + d WHERE s.label <> 0")
def _(v):
    """Labels grown along x, in blocks that cut them."""

    def grow(label: int, mask: np.ndarray, lo: np.ndarray) -> np.ndarray:
        out = mask.copy()
        out[:, :, 1:] |= mask[:, :, :-1]
        out[:, :, :-1] |= mask[:, :, 1:]
        return out

    return K.map_labels(v.seg_a, grow, 1, v.dims, block=(4, 9, 13))


@add("diffusion_smooth")
def _(v):
    """At a contrast where the tensor is far from the identity, over more steps than one exchange of halos covers."""
    return K.diffusion_smooth(v.vox, v.dims, (10, 25, 32), 0.6, 0.1, contrast=4.0).withColumn("value", F.round("value", 4))


_BACK = "SELECT z, y, x FROM seg_a WHERE label = 0"
_TOP = "(SELECT label FROM cc GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)"


@add("fill_holes_enclosed", "seg_a", "WITH RECURSIVE " + cc_sql(_BACK, FACE) + f""", h AS (SELECT z, y, x, label AS piece FROM cc WHERE label <> {_TOP}),
m AS (SELECT piece, max(s.label) AS label FROM h, {FACE_SQL} o JOIN seg_a s ON s.z = h.z + dz AND s.y = h.y + dy AND s.x = h.x + dx AND s.label <> 0 GROUP BY piece)
SELECT z, y, x, label FROM seg_a WHERE label <> 0 UNION ALL SELECT z, y, x, label FROM h JOIN m USING (piece)""")
def _(v):
    return K.fill_holes_enclosed(holes(v), v.dims, v.inside)


def fill_sql(closed: str, margin: int, capped: bool) -> str:
    """Each label's box: voxels beside ``closed`` (label, z, y, x) that no face of the box can be reached from, where
    seg_a is free. Ends of the volume don't count as faces in z if ``capped``."""
    ends = "(z = z0 AND z0 > 0) OR (z = z1 - 1 AND z1 < dz)" if capped else "z = z0 OR z = z1 - 1"
    low, high = [f"greatest(min({a}) - {margin}, 0) AS {a}0" for a in "zyx"], [f"least(max({a}) + {1 + margin}, d{a}) AS {a}1" for a in "zyx"]
    box = f"SELECT label, {', '.join(low + high)} FROM seg_a, dims WHERE label <> 0 GROUP BY label, dz, dy, dx"
    cells = "SELECT label, CAST(unnest(generate_series(z0, z1 - 1)) AS INT) AS z, y0, y1, x0, x1 FROM box"
    for a in "yx":
        cells = f"SELECT * EXCLUDE ({a}0, {a}1), CAST(unnest(generate_series({a}0, {a}1 - 1)) AS INT) AS {a} FROM ({cells})"
    src = "SELECT z, y, x, label AS own FROM cells ANTI JOIN closed USING (label, z, y, x)"
    return f"""WITH RECURSIVE closed AS ({closed}), box AS ({box}), cells AS ({cells}), {cc_sql(src, FACE, "own", "own * 10000000 + ")},
outside AS (SELECT DISTINCT cc.label FROM cc JOIN box ON box.label = own, dims WHERE {ends} OR y = y0 OR y = y1 - 1 OR x = x0 OR x = x1 - 1),
filled AS (SELECT z, y, x, own AS label FROM cc WHERE label NOT IN (SELECT label FROM outside) UNION ALL SELECT z, y, x, closed.label FROM closed JOIN box USING (label) WHERE z >= z0 AND z < z1 AND y >= y0 AND y < y1 AND x >= x0 AND x < x1)
SELECT z, y, x, label FROM seg_a WHERE label <> 0 UNION ALL SELECT z, y, x, max(f.label) AS label FROM filled f JOIN (SELECT z, y, x FROM seg_a WHERE label = 0) USING (z, y, x) GROUP BY z, y, x"""


_BALL_SQL = f"(SELECT * FROM {FACE_SQL} UNION ALL SELECT 0, 0, 0)"
_CLOSED = f"""SELECT label, CAST(g.z + dz AS INT) AS z, CAST(g.y + dy AS INT) AS y, CAST(g.x + dx AS INT) AS x FROM (SELECT DISTINCT label, z + dz AS z, y + dy AS y, x + dx AS x FROM seg_a, {_BALL_SQL} a WHERE label <> 0) g, {_BALL_SQL} b GROUP BY 1, 2, 3, 4 HAVING count(*) = 7"""


@add("fill_holes_closing", "seg_a dims", fill_sql(_CLOSED, 1, False))
def _(v):
    return K.fill_holes_closing(holes(v), v.dims, T.structuring_element("ball", 1))


@add("fill_holes_capped", "seg_a dims", fill_sql("SELECT label, z, y, x FROM seg_a WHERE label <> 0", 0, True))
def _(v):
    return K.fill_holes_capped(holes(v), v.dims)


def _reached_sql(walls: str, tag: str) -> str:
    """Free pieces but the largest: a voxel goes to the label that reaches it in the fewest steps, ties to the seed with the
    smaller index."""
    top = f"(SELECT label FROM cc{tag} GROUP BY label ORDER BY count(*) DESC, label LIMIT 1)"
    return cc_sql(f"SELECT z, y, x FROM seg_a WHERE label = 0 AND (z, y, x) NOT IN (SELECT (z, y, x) FROM vox WHERE {walls})", FACE, tag=tag) + f""", sp{tag} AS (SELECT z, y, x FROM cc{tag} WHERE label <> {top}),
w{tag}(z, y, x, d, s) AS (SELECT sp.z, sp.y, sp.x, 1, f.z * 1600 + f.y * 64 + f.x FROM sp{tag} sp, {FACE_SQL} o JOIN seg_a f ON f.z = sp.z + dz AND f.y = sp.y + dy AND f.x = sp.x + dx AND f.label <> 0
  UNION SELECT sp.z, sp.y, sp.x, w.d + 1, w.s FROM w{tag} w, {FACE_SQL} o JOIN sp{tag} sp ON sp.z = w.z + dz AND sp.y = w.y + dy AND sp.x = w.x + dx WHERE w.d < 12),
n{tag} AS (SELECT z, y, x, arg_min(s, d * 100000000 + s) AS s FROM w{tag} GROUP BY 1, 2, 3)"""


_WALLS = ("value BETWEEN 60 AND 95", "z % 5 = 2 AND value < 96")


@add("fill_holes_unreachable", "seg_a vox", "WITH RECURSIVE " + ", ".join(_reached_sql(w, str(i)) for i, w in enumerate(_WALLS)) + """
SELECT z, y, x, label FROM seg_a WHERE label <> 0 UNION ALL SELECT n.z, n.y, n.x, max(f.label) AS label FROM (SELECT * FROM n0 UNION ALL SELECT * FROM n1) n JOIN seg_a f ON f.z * 1600 + f.y * 64 + f.x = n.s GROUP BY 1, 2, 3""")
def _(v):
    """Walls in the background: they cut free space into pieces, and part labels that would meet."""
    return K.fill_holes_unreachable(holes(v), v.dims, [v.vox.where(w) for w in _WALLS], inside=v.inside)


def flood_sql(src: str, tag: str = "") -> str:
    """fl (own, z, y, x, label): the flood of ``src`` (own, z, y, x, value, seed), in which voxels of one owner that share a
    face are neighbours. A voxel has the label of the path with the least key: the levels it rose to, the last one first,
    each with the voxels taken at it, then the seed's place, then its length. ``tag`` tells two floods in one query apart."""
    sql = f"""fv AS (SELECT own, z, y, x, value::DOUBLE AS value, seed, row_number() OVER (ORDER BY own, z, y, x) AS i FROM ({src})),
fn AS (SELECT a.i, b.i AS j, b.value AS v FROM fv a, {FACE_SQL} o JOIN fv b ON b.own = a.own AND b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE b.seed = 0),
fk(i, k, n, label) USING KEY (i) AS (SELECT i, [value, 1, '-infinity'::DOUBLE, i::DOUBLE], 0, seed FROM fv WHERE seed <> 0
  UNION SELECT j, min(c).k AS k, min(c).n AS n, arg_min(from_, c) AS label FROM (
    SELECT fn.j, {{'k': CASE WHEN v > k[1] THEN list_concat([v, 1], k) WHEN v = k[1] THEN list_concat([v, k[2] + 1], k[3:]) ELSE k END, 'n': n + 1}} AS c, label AS from_ FROM fk JOIN fn USING (i)
  ) LEFT JOIN recurring.fk r ON r.i = j WHERE r.i IS NULL OR c < {{'k': r.k, 'n': r.n}} GROUP BY j),
fl AS (SELECT own, z, y, x, CAST(label AS BIGINT) AS label FROM fv JOIN fk USING (i))"""
    return re.sub(r"\b(fv|fn|fk|fl)\b", rf"\g<1>{tag}", sql) if tag else sql


@add("seeded_watershed", "vox", "WITH RECURSIVE " + cc_sql("SELECT z, y, x FROM vox WHERE value > 0 AND value <= 96", FACE) + """, n AS (SELECT label, dense_rank() OVER (ORDER BY label) AS new FROM cc GROUP BY label HAVING count(*) >= 2),
""" + flood_sql("SELECT (v.z // 4 * 4 + v.y // 8) * 4 + v.x // 16 AS own, v.z, v.y, v.x, value, coalesce(new, 0) AS seed FROM vox v LEFT JOIN (SELECT z, y, x, new FROM cc JOIN n USING (label)) s ON s.z = v.z AND s.y = v.y AND s.x = v.x") + " SELECT z, y, x, label FROM fl")
def _(v):
    return K.seeded_watershed(v.vox, W.threshold_seeds(v.vox, v.dims, 0, 96, 2), v.dims, block=(4, 8, 16))


@add("end_slice_seeds", "seg_b", """WITH m AS (SELECT label, max(z) AS tip FROM seg_b WHERE label <> 0 GROUP BY 1),
t AS (SELECT s.label, tip, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM seg_b s JOIN m ON s.label = m.label AND s.z = m.tip GROUP BY 1, 2),
c AS (SELECT t.label, tip, CAST(tip + a AS INT) AS z, CAST(b AS INT) AS y, CAST(c AS INT) AS x FROM t, range(4) r(a), range(40) s(b), range(80) u(c) WHERE b BETWEEN greatest(y0 - 2, 0) AND y1 + 2 AND c BETWEEN greatest(x0 - 2, 0) AND x1 + 2)
SELECT c.label, c.z, c.y, c.x, CAST(CASE WHEN s.label IS NOT NULL AND c.z = tip THEN c.label WHEN c.z = tip THEN -1 ELSE 0 END AS BIGINT) AS seed FROM c LEFT JOIN seg_b s ON s.label = c.label AND s.z = c.z AND s.y = c.y AND s.x = c.x""")
def _(v):
    return W.end_slice_seeds(v.seg_b, "last", 3, 2)


def _merging_round(k: int) -> str:
    """From the labels s<k> and the map m<k> to the next: both ends of each label flooded, its best partner, what they join."""
    flood = flood_sql(f"SELECT c.label * 2 + up AS own, c.z, c.y, c.x, value, CASE WHEN c.z <> tip THEN 0 WHEN s.label IS NULL THEN -1 ELSE c.label END AS seed FROM c{k} c JOIN vox v ON v.z = c.z AND v.y = c.y AND v.x = c.x LEFT JOIN s{k} s ON s.label = c.label AND s.z = c.z AND s.y = c.y AND s.x = c.x", str(k))
    return f"""b{k} AS (SELECT label, min(z) AS z0, max(z) AS z1 FROM s{k} GROUP BY label),
t{k} AS (SELECT label, 0 AS up, z0 AS tip, greatest(z0 - 2, 0) AS a, z0 AS b FROM b{k} UNION ALL SELECT label, 1, z1, z1, z1 + 2 FROM b{k}),
e{k} AS (SELECT s.label, up, tip, a, b, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM s{k} s JOIN t{k} t ON t.label = s.label AND s.z = tip GROUP BY ALL),
c{k} AS (SELECT label, up, tip, CAST(a + i AS INT) AS z, CAST(j AS INT) AS y, CAST(k AS INT) AS x FROM e{k}, range(3) r(i), range(25) q(j), range(64) p(k) WHERE a + i <= b AND j BETWEEN y0 - 1 AND y1 + 1 AND k BETWEEN x0 - 1 AND x1 + 1),
{flood},
h{k} AS (SELECT f.label, s.label AS other, count(*) AS n FROM fl{k} f JOIN s{k} s USING (z, y, x) WHERE f.label = own // 2 AND s.label <> f.label GROUP BY f.own, f.label, s.label HAVING count(*) >= 20),
j{k} AS (SELECT h.label AS a, other AS b FROM h{k} h JOIN b{k} p ON p.label = h.label JOIN b{k} o ON o.label = other WHERE o.z0 > p.z1 OR o.z1 < p.z0 QUALIFY row_number() OVER (PARTITION BY h.label ORDER BY n DESC, other) = 1),
u{k}(a, b) AS (SELECT a, a FROM j{k} UNION SELECT b, b FROM j{k} UNION SELECT u.a, g.b FROM u{k} u JOIN (SELECT a, b FROM j{k} UNION ALL SELECT b, a FROM j{k}) g ON g.a = u.b),
n{k} AS (SELECT a AS label, min(b) AS top FROM u{k} GROUP BY a),
s{k + 1} AS (SELECT z, y, x, coalesce(top, s.label) AS label FROM s{k} s LEFT JOIN n{k} USING (label)),
m{k + 1} AS (SELECT m.label, coalesce(top, new_label) AS new_label FROM m{k} m LEFT JOIN n{k} n ON n.label = new_label)"""


@add("merge_by_watershed", "seg_b vox", "WITH RECURSIVE s0 AS (SELECT * FROM seg_b WHERE label % 2 = 1), m0 AS (SELECT DISTINCT label, label AS new_label FROM s0),\n" + ",\n".join(map(_merging_round, range(4))) + "\nSELECT label, new_label FROM m4")
def _(v):
    """The SQL has four rounds, enough for 10,256 vectors (joins in four); 51,282 take five, and there it stops short of rest."""
    alternate = v.seg_b.withColumn("label", F.when(F.col("label") % 2 == 0, F.lit(0)).otherwise(F.col("label")).cast("bigint"))
    return W.merge_by_watershed(alternate, v.vox, 2, 1, 20, 12)


_CELLS = """c AS (SELECT e.*, CAST(e.a + i AS INT) AS z, CAST(j AS INT) AS y, CAST(k AS INT) AS x FROM e, range(8) r(i), range(25) s(j), range(64) t(k) WHERE e.a + i BETWEEN greatest(e.a, 0) AND e.b AND j BETWEEN y0 - 2 AND y1 + 2 AND k BETWEEN x0 - 2 AND x1 + 2)"""


@add("bridge_label_gaps", "outer_seg vox", """WITH RECURSIVE p AS (SELECT z, y, x, label, label * 2 + (z % 5 > 2)::INT AS piece FROM outer_seg WHERE z % 5 <> 2),
g AS (SELECT label, piece, max(z) AS z1, lead(piece) OVER w AS next, lead(min(z)) OVER w AS until FROM p GROUP BY label, piece WINDOW w AS (PARTITION BY label ORDER BY min(z), piece)),
e AS (SELECT p.label, g.piece, z1 AS a, until AS b, next, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM p JOIN g ON g.piece = p.piece AND p.z = z1 WHERE until > z1 + 1 GROUP BY ALL), """ + _CELLS + ",\n" + flood_sql("SELECT c.piece AS own, c.z, c.y, c.x, value, CASE WHEN c.z > a THEN 0 WHEN p.piece IS NULL THEN -1 ELSE c.piece END AS seed FROM c JOIN vox v ON v.z = c.z AND v.y = c.y AND v.x = c.x LEFT JOIN p ON p.piece = c.piece AND p.z = c.z AND p.y = c.y AND p.x = c.x") + """,
o AS (SELECT e.label, fl.* EXCLUDE (label), a, b, next FROM fl JOIN e ON e.piece = own WHERE fl.label = own)
SELECT label, z, y, x FROM o WHERE z > a AND z < b AND own IN (SELECT own FROM o JOIN p ON p.piece = o.next AND p.z = o.z AND p.y = o.y AND p.x = o.x)""")
def _(v):
    cut = v.outer_seg.where("z % 5 NOT IN (2)").withColumn("piece", (F.col("label") * 2 + (F.col("z") % 5 > 2).cast("int")).cast("bigint"))
    return W.bridge_label_gaps(cut, v.vox, 2)


@add("extend_to_border", "outer_seg vox dims", """WITH RECURSIVE s AS (SELECT o.* FROM outer_seg o, dims WHERE z >= 2 AND z < dz - 2), b AS (SELECT label, min(z) AS z0, max(z) AS z1 FROM s GROUP BY label),
t AS (SELECT label, 0 AS up, z0 AS tip, z0 - 3 AS a, z0 AS b FROM b WHERE z0 > 0 AND z0 <= 3 UNION ALL SELECT label, 1, z1, z1, least(z1 + 3, dz - 1) FROM b, dims WHERE z1 + 1 < dz AND z1 + 1 >= dz - 3),
e AS (SELECT s.label, up, tip, a, b, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM s JOIN t ON t.label = s.label AND s.z = tip GROUP BY ALL), """ + _CELLS + ",\n" + flood_sql("SELECT c.label * 2 + up AS own, c.z, c.y, c.x, value, CASE WHEN c.z <> tip THEN 0 WHEN s.label IS NULL THEN -1 ELSE c.label END AS seed FROM c JOIN vox v ON v.z = c.z AND v.y = c.y AND v.x = c.x LEFT JOIN s ON s.label = c.label AND s.z = c.z AND s.y = c.y AND s.x = c.x") + """
SELECT DISTINCT label, z, y, x FROM fl ANTI JOIN s USING (z, y, x) WHERE label = own // 2""")
def _(v):
    inner = v.outer_seg.where(f"z >= 2 AND z < {v.dims[0] - 2}")
    return W.extend_to_border(inner, v.vox, v.dims, 3, 2)


#: Distance to any object, axis by axis.
_NEAR = """WITH a AS (SELECT z, y, CAST(t AS INT) AS x, min((t - x) * (t - x)) AS d FROM inner_seg, range(64) r(t) WHERE label <> 0 GROUP BY 1, 2, 3),
b AS (SELECT z, CAST(t AS INT) AS y, x, min(d + (t - y) * (t - y)) AS d FROM a, range(25) r(t) GROUP BY 1, 2, 3),
c AS (SELECT CAST(t AS INT) AS z, y, x, sqrt(min(d + 4 * (t - z) * (t - z))) AS d FROM b, dims, range(dims.dz) r(t) GROUP BY 1, 2, 3)"""


@add("sheath_mask", "inner_seg vox mask_ds dims", _NEAR + " SELECT z, y, x FROM c JOIN vox USING (z, y, x) JOIN mask_ds USING (z, y, x) WHERE value > 110 AND d <= 2")
def _(v):
    d = T.distance_transform(v.inner_seg.where("label <> 0").select("z", "y", "x", "label"), v.dims, (2.0, 1.0, 1.0))
    return W.sheath_mask(d, v.vox.where("value > 110"), v.mask_ds, 2.0)


@add("separate_sheaths", "inner_seg vox mask_ds dims", "WITH RECURSIVE" + _NEAR[4:].replace("4 * (t - z)", "(t - z)") + """, h AS (SELECT z, y, x FROM c JOIN vox USING (z, y, x) JOIN mask_ds USING (z, y, x) WHERE value > 60 AND d <= 2.5 AND (z, y, x) NOT IN (SELECT (z, y, x) FROM inner_seg WHERE label <> 0)),
""" + flood_sql("SELECT 0 AS own, c.z, c.y, c.x, d AS value, label AS seed FROM c JOIN inner_seg USING (z, y, x) WHERE label <> 0 OR (c.z, c.y, c.x) IN (SELECT (z, y, x) FROM h)") + " SELECT z, y, x, label FROM fl SEMI JOIN h USING (z, y, x)")
def _(v):
    return W.separate_sheaths(v.inner_seg, v.vox.where("value > 60"), v.mask_ds, v.dims, 2.5)


_OUT = "SELECT z, y, x, label FROM outer_seg"


@add("median_sheath_width", "inner_seg outer_seg", f"""WITH s AS (SELECT o.z, o.y, o.x, o.label FROM outer_seg o JOIN inner_seg i USING (z, y, x) WHERE i.label = 0),
r AS (SELECT s.z, s.y, s.x, s.label FROM s, {FACE_SQL} f LEFT JOIN s t ON t.z = s.z + dz AND t.y = s.y + dy AND t.x = s.x + dx AND t.label = s.label GROUP BY 1, 2, 3, 4 HAVING count(t.z) < 6),
d AS (SELECT r.label, r.z, r.y, r.x, sqrt(min(pow(r.z - i.z, 2) + pow(r.y - i.y, 2) + pow(r.x - i.x, 2))) AS d FROM r JOIN inner_seg i ON i.label = r.label AND abs(i.z - r.z) <= 2 AND abs(i.y - r.y) <= 2 AND abs(i.x - r.x) <= 2
WHERE pow(r.z - i.z, 2) + pow(r.y - i.y, 2) + pow(r.x - i.x, 2) <= 6.25 GROUP BY 1, 2, 3, 4)
SELECT label, round(median(d), 6) AS width FROM d GROUP BY label""")
def _(v):
    sheath = v.outer_seg.join(v.inner_seg.where("label <> 0").select("z", "y", "x"), ["z", "y", "x"], "left_anti")
    return W.sheath_width(v.inner_seg, sheath, v.dims, 2.5).select("label", F.round("width", 6).alias("width"))


#: Squared distances axis by axis, for the objects of each width.
_FAR = """WITH s AS (SELECT 1.0::DOUBLE + label % 3 AS width, z, y, x FROM inner_seg WHERE label <> 0),
a AS (SELECT width, z, y, CAST(t AS INT) AS x, min((t - x) * (t - x)) AS d FROM s, range(64) r(t) GROUP BY 1, 2, 3, 4),
b AS (SELECT width, z, CAST(t AS INT) AS y, x, min(d + (t - y) * (t - y)) AS d FROM a, range(25) r(t) GROUP BY 1, 2, 3, 4),
c AS (SELECT width, CAST(t AS INT) AS z, y, x, sqrt(min(d + (t - z) * (t - z))) AS d FROM b, dims, range(dims.dz) r(t) GROUP BY 1, 2, 3, 4)"""


@add("sigmoid_distance", "inner_seg dims", _FAR + """
SELECT z, y, x, round(least(min(2 * (1 / (1 + exp(-d / (0.5::DOUBLE * width))) - 0.5)), 1), 6) AS value, bool_or(d < 1.5 * width) AS near FROM c GROUP BY 1, 2, 3""")
def _(v):
    widths = v.inner_seg.where("label <> 0").select("label", (F.lit(1.0) + F.col("label") % 3).alias("width")).distinct()
    return W.sigmoid_distance(v.inner_seg, widths, v.dims, 0.5).withColumn("value", F.round("value", 6))


@add("inner_compartment", "outer_seg", f"""WITH r AS (SELECT DISTINCT b.z, b.y, b.x, a.label FROM outer_seg a, {FACE_SQL} o JOIN outer_seg b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE b.label <> a.label),
d AS (SELECT o.z, o.y, o.x, o.label, sqrt(min(pow(o.z - r.z, 2) + pow(o.y - r.y, 2) + pow(o.x - r.x, 2))) AS d FROM outer_seg o JOIN r ON r.label = o.label AND abs(o.z - r.z) <= 3 AND abs(o.y - r.y) <= 3 AND abs(o.x - r.x) <= 3
WHERE pow(o.z - r.z, 2) + pow(o.y - r.y, 2) + pow(o.x - r.x, 2) <= 9 GROUP BY 1, 2, 3, 4)
SELECT o.z, o.y, o.x, o.label, CASE WHEN d IS NULL OR d > (2.0::DOUBLE + o.label % 3) / 2 THEN 'inner' ELSE 'sheath' END AS part FROM outer_seg o LEFT JOIN d USING (z, y, x, label)""")
def _(v):
    widths = v.outer_seg.select("label", (F.lit(2.0) + F.col("label") % 3).alias("width")).distinct()
    return W.inner_compartment(v.outer_seg, widths, v.dims, inside=v.inside)


@add("detect_unsheathed", "outer_seg vox", f"""WITH r AS (SELECT DISTINCT b.z, b.y, b.x, a.label FROM outer_seg a, {FLAT_SQL} o JOIN outer_seg b ON b.z = a.z AND b.y = a.y + dy AND b.x = a.x + dx WHERE b.label <> a.label),
c AS (SELECT label, z FROM r JOIN vox USING (z, y, x) GROUP BY 1, 2 HAVING avg((value > 127)::INT) < 0.5::DOUBLE), i AS (SELECT *, z - row_number() OVER (PARTITION BY label ORDER BY z) AS i FROM c),
n AS (SELECT label, min(z) AS z0, max(z) AS z1 FROM i GROUP BY label, i HAVING count(*) > 1)
SELECT z, y, x, label, EXISTS (SELECT 1 FROM n WHERE n.label = o.label AND o.z BETWEEN z0 AND z1) AS node FROM outer_seg o""")
def _(v):
    nodes, rest = W.detect_unsheathed(v.outer_seg, v.vox.where("value > 127"), v.dims, 0.5, 1, v.inside)
    return nodes.withColumn("node", F.lit(True)).unionByName(rest.withColumn("node", F.lit(False)))


@add("spot_detection", "vox", "WITH RECURSIVE p AS (" + f"SELECT a.z, a.y, a.x FROM vox a, {BOX_SQL} o JOIN vox b ON b.z = a.z + dz AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.value > 160 GROUP BY a.z, a.y, a.x, a.value HAVING a.value = max(b.value)), "
     + cc_sql("SELECT * FROM p", FULL) + ",\n" + flood_sql("SELECT 0 AS own, v.z, v.y, v.x, -value AS value, coalesce(label, 0) AS seed FROM vox v LEFT JOIN cc USING (z, y, x) WHERE value > 140") + """
SELECT z, y, x, label FROM fl WHERE label IN (SELECT label FROM fl GROUP BY label HAVING count(*) >= 3)""")  # fmt: skip
def _(v):
    return W.spot_detection(v.vox, v.dims, BOX, 160, 140)


def _supervoxel_sql(src: str, channels: tuple[str, ...], rounds: int, cell: tuple[int, int, int], compactness: float, grid: tuple[int, int], units: tuple[str, str, str] | None = None) -> str:
    """Rounds of assignment to the nearest centre among those of the 27 cells around a voxel's own; ``grid`` is cells in y and x."""
    at = ", ".join(f"CAST(floor(c{a} / {n}) AS INT) AS g{a}" for a, n in zip("zyx", cell))
    units = units or tuple(f"(1 / {n}.0::DOUBLE)" for n in cell)
    space = " + ".join(f"pow((v.{a} - c.c{a}) * {u}, 2)" for a, u in zip("zyx", units))
    colour = " + ".join(f"pow(v.{c} - c.c{c}, 2)" for c in channels)
    ny, nx = grid
    means = ", ".join(f"avg({a}::DOUBLE) AS c{a}" for a in ("z", "y", "x", *channels))
    cols, centre = ", ".join(channels), ", ".join(f"c{a}" for a in ("z", "y", "x", *channels))
    out = [
        f"v0 AS (SELECT z, y, x, {cols}, z // {cell[0]} AS gz, y // {cell[1]} AS gy, x // {cell[2]} AS gx, (z // {cell[0]} * {ny} + y // {cell[1]}) * {nx} + x // {cell[2]} + 1 AS own FROM ({src}))",
        f"c0 AS (SELECT own AS label, gz, gy, gx, {means} FROM v0 GROUP BY 1, 2, 3, 4)",
    ]
    for k in range(rounds):
        d = f"({space}) * {compactness**2}::DOUBLE + ({colour})"
        near = f"SELECT v.z, v.y, v.x, c.label, {d} AS d FROM v{k} v, near o JOIN c{k} c ON c.gz = v.gz + dz AND c.gy = v.gy + dy AND c.gx = v.gx + dx"
        out.append(f"b{k} AS (SELECT z, y, x, label FROM ({near}) QUALIFY row_number() OVER (PARTITION BY z, y, x ORDER BY d, label) = 1)")
        out.append(f"v{k + 1} AS (SELECT v.z, v.y, v.x, {', '.join('v.' + c for c in channels)}, gz, gy, gx, coalesce(b.label, own) AS own FROM v{k} v LEFT JOIN b{k} b USING (z, y, x))")
        out.append(f"c{k + 1} AS (SELECT label, {centre}, {at} FROM (SELECT own AS label, {means} FROM v{k + 1} GROUP BY own))")
    return f"WITH near AS (SELECT * FROM {BOX_SQL}), {', '.join(out)} SELECT z, y, x, CAST(own AS BIGINT) AS label FROM v{rounds}"


@add("supervoxels", "vox", _supervoxel_sql("SELECT * FROM vox", ("value",), 3, (5, 5, 8), 10.0, (5, 8)))
def _(v):
    return V.supervoxels(v.vox, v.dims, (5, 5, 8), 10.0, 3)


@add("supervoxels_masked", "vox", _supervoxel_sql("SELECT * FROM vox WHERE value > 160", ("value",), 3, (2, 3, 4), 20.0, (9, 16)))
def _(v):
    """In a sparse mask, so that centres leave cells and voxels are left without a centre near them."""
    return V.supervoxels(v.vox, v.dims, (2, 3, 4), 20.0, 3, v.vox.where("value > 160"))


_CHANNELS = ("c0", "c1", "c2", "c3")
_FOUR = "SELECT z, y, x % 16 AS x, " + ", ".join(f"max(CASE WHEN x // 16 = {i} THEN value END) AS {c}" for i, c in enumerate(_CHANNELS)) + " FROM vox GROUP BY 1, 2, 3"
_EDGE = "pow(5 * 5 * 4 * 2.5::DOUBLE, 1.0::DOUBLE / 3)"


def _four(v):
    wide = v.vox.groupBy("z", "y", F.expr("CAST(x % 16 AS INT)").alias("x"))
    return wide.agg(*[F.max(F.when(F.expr("x div 16") == i, F.col("value"))).alias(c) for i, c in enumerate(_CHANNELS)]), (*v.dims[:2], 16)


@add("supervoxels_channels", "vox", _supervoxel_sql(_FOUR, _CHANNELS, 3, (5, 5, 4), 10.0, (5, 4), (f"(2.5::DOUBLE / {_EDGE})", f"(1 / {_EDGE})", f"(1 / {_EDGE})")))
def _(v):
    """Four channels of voxels that are longer along z."""
    vol, dims = _four(v)
    return V.supervoxels(vol, dims, (5, 5, 4), 10.0, 3, channels=_CHANNELS, elsize=(2.5, 1.0, 1.0))


@add("supervoxels_connected")
def _(v):
    """Smoothed, and every label one piece; as a check, the pieces of each label beside its voxels."""
    vol, dims = _four(v)
    out = written(V.supervoxels(vol, dims, (5, 5, 4), 2.0, 3, channels=_CHANNELS, sigma=(1.0, 0.5, 0.5), elsize=(2.5, 1.0, 1.0), connected=True, least=4), "connected")
    pieces = components(out.withColumnRenamed("label", "own"), 6, dims, "own").groupBy(F.col("own").alias("label")).agg(F.countDistinct("label").alias("pieces"))
    return out.groupBy("label").agg(F.count("*").alias("n")).join(pieces, "label")
