"""Queries of sections 2.4, 2.7 and 2.10."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.operators import labels as L

from .views import registry

add = registry.add


@add("forward_map", "seg_a", "SELECT z, y, x, CAST(CASE WHEN label = 0 OR label % 5 = 0 THEN 0 WHEN label % 3 = 0 THEN label + 1000 ELSE label END AS BIGINT) AS label FROM seg_a")
def _(v):
    labels = v.seg_a.select("label").distinct()
    return L.forward_map(v.seg_a, labels.where("label % 3 = 0").withColumn("new_label", F.col("label") + 1000), delete=labels.where("label % 5 = 0"))


for _how, _case in (("add", "CASE WHEN b.label <> 0 THEN b.label ELSE a.label END"), ("subtract", "CASE WHEN b.label = 0 THEN a.label ELSE 0 END"), ("mask", "CASE WHEN b.label <> 0 THEN a.label ELSE 0 END")):

    def _combine(v, how=_how):
        return L.combine_labels(v.seg_a, v.seg_b, how)

    add(f"combine_labels_{_how}", "seg_a seg_b", f"SELECT a.z, a.y, a.x, CAST({_case} AS BIGINT) AS label FROM seg_a a JOIN seg_b b USING (z, y, x)")(_combine)

SLICE_OVERLAP = "SELECT a.z, CAST(b.z - a.z AS INT) AS j, a.label, b.label AS other, CAST(count(*) AS BIGINT) AS n FROM {v} a JOIN {v} b ON a.y = b.y AND a.x = b.x AND b.z - a.z BETWEEN 1 AND {m} WHERE a.label <> 0 AND b.label <> 0 GROUP BY 1, 2, 3, 4"


@add("slice_overlap", "seg_a", SLICE_OVERLAP.format(v="seg_a", m=2))
def _(v):
    return L.slice_overlap(v.seg_a, 3)


@add("delete_labels", "seg_a", "SELECT z, y, x, CAST(CASE WHEN label % 4 = 0 AND label % 8 <> 0 THEN 0 ELSE label END AS BIGINT) AS label FROM seg_a")
def _(v):
    labels = v.seg_a.select("label").distinct()
    return L.delete_labels(v.seg_a, labels.where("label % 4 = 0"), labels.where("label % 8 = 0"))


@add("labels_under_mask", "seg_a vox", "SELECT DISTINCT label FROM seg_a JOIN vox USING (z, y, x) WHERE label <> 0 AND value > 165")
def _(v):
    return L.labels_under_mask(v.seg_a, v.vox.where("value > 165"))


@add("filter_by_slice_presence", "seg_a seg_b", "SELECT z, y, x, CAST(CASE WHEN (z, label) IN (SELECT z, label FROM seg_b WHERE label <> 0) THEN label ELSE 0 END AS BIGINT) AS label FROM seg_a")
def _(v):
    return L.filter_by_slice_presence(v.seg_a, v.seg_b)


@add("change_volume", "seg_a seg_b", "SELECT z, y, x, b.label FROM seg_a a JOIN seg_b b USING (z, y, x) WHERE a.label <> b.label")
def _(v):
    return L.change_volume(v.seg_a, v.seg_b)


@add("merge_label_pairs", "seg_a", "SELECT z, y, x, CAST(CASE WHEN label > 1 AND label % 2 = 0 THEN label - 1 ELSE label END AS BIGINT) AS label FROM seg_a")
def _(v):
    pairs = v.seg_a.where("label > 1 AND label % 2 = 0").select(F.col("label").alias("drop"), (F.col("label") - 1).alias("keep")).distinct()
    return L.merge_label_pairs(v.seg_a, pairs)


@add("split_by_aux_volume", "seg_a seg_b", """WITH i AS (SELECT z, y, x, b.label AS aux FROM seg_a a JOIN seg_b b USING (z, y, x) WHERE a.label % 10 = 1 AND b.label <> 0),
t AS (SELECT aux, aux IN (SELECT label FROM seg_a) AS taken FROM (SELECT DISTINCT aux FROM i)), n AS (SELECT aux, CASE WHEN taken THEN (SELECT max(label) FROM seg_a) + row_number() OVER (PARTITION BY taken ORDER BY aux) ELSE aux END AS new FROM t)
SELECT z, y, x, CAST(coalesce(n.new, a.label) AS BIGINT) AS label FROM seg_a a LEFT JOIN i USING (z, y, x) LEFT JOIN n USING (aux)""")
def _(v):
    return L.split_by_aux_volume(v.seg_a, v.seg_b, v.seg_a.where("label % 10 = 1"))


@add("dissolve_nesting", "seg_a", "SELECT z, y, x, CAST(CASE WHEN label % 6 = 0 AND label > 0 THEN label - 1 ELSE label END AS BIGINT) AS parent, CAST(CASE WHEN label % 6 = 0 AND label > 0 THEN label ELSE 0 END AS BIGINT) AS child FROM seg_a")
def _(v):
    nesting = v.seg_a.where("label % 6 = 0 AND label > 0").select(F.col("label").alias("child"), (F.col("label") - 1).alias("parent")).distinct()
    a, b = L.dissolve_nesting(v.seg_a, nesting)
    return a.withColumnRenamed("label", "parent").join(b.withColumnRenamed("label", "child"), ["z", "y", "x"])


@add("cut_label_ranges", "seg_a", """WITH r AS (SELECT label, min(z) + 1 AS z0, max(z) AS z1 FROM seg_a WHERE label % 3 = 0 AND label > 0 GROUP BY label)
SELECT z, y, x, CAST(CASE WHEN z >= z0 AND z < z1 THEN 0 ELSE a.label END AS BIGINT) AS label FROM seg_a a LEFT JOIN r USING (label)""")
def _(v):
    ranges = v.seg_a.where("label % 3 = 0 AND label > 0").groupBy("label").agg((F.min("z") + 1).alias("z0"), F.max("z").alias("z1"))
    return L.cut_label_ranges(v.seg_a, ranges).select("z", "y", "x", "label")


@add("label_contingency", "seg_a seg_b", "SELECT a.label AS a, b.label AS b, CAST(count(*) AS BIGINT) AS n FROM seg_a a JOIN seg_b b USING (z, y, x) WHERE a.label <> 0 AND b.label <> 0 GROUP BY 1, 2")
def _(v):
    return L.label_contingency(v.seg_a, v.seg_b)


#: Closure of pairs e(a, b): the smallest label that each label reaches.
CLOSURE = """, s AS (SELECT a, b FROM e UNION SELECT b, a FROM e UNION SELECT a, a FROM e UNION SELECT b, b FROM e),
g(a, b) AS (SELECT a, b FROM s UNION SELECT g.a, s.b FROM g JOIN s ON g.b = s.a) SELECT CAST(a AS BIGINT) AS label, CAST(min(b) AS BIGINT) AS new_label FROM g GROUP BY a"""
_BEST = """, z AS (SELECT z, label, count(*) AS n FROM {v} WHERE label <> 0 GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY z, j, label ORDER BY n DESC, other) AS r FROM o),
e AS (SELECT r.label AS a, r.other AS b FROM r JOIN z l ON l.z = r.z AND l.label = r.label JOIN z h ON h.z = r.z + r.j AND h.label = r.other WHERE r.r = 1 AND 2 * r.n >= {t} * (l.n + h.n))"""
#: Slicewise labels that change their names with the slice, so that there is something to merge.
SLICED = "sl AS (SELECT z, y, x, CAST(CASE WHEN label = 0 THEN 0 ELSE label + (z % 5) * 10000 END AS BIGINT) AS label FROM seg_a)"


def sliced(v):
    return v.seg_a.select("z", "y", "x", F.when(F.col("label") == 0, 0).otherwise(F.col("label") + (F.col("z") % 5) * 10000).cast("bigint").alias("label"))


@add("merge_slice_labels", "seg_a", "WITH RECURSIVE " + SLICED + ", o AS (" + SLICE_OVERLAP.format(v="sl", m=1) + ")" + _BEST.format(v="sl", t="0.9::DOUBLE") + CLOSURE)
def _(v):
    return L.merge_slice_labels(sliced(v), 0.9)


@add("merge_end_slices", "seg_a", "WITH RECURSIVE " + SLICED + """, m AS (SELECT label, min(z) AS f, max(z) AS l FROM sl WHERE label <> 0 GROUP BY 1),
t AS (SELECT sl.*, 1 AS j FROM sl JOIN m USING (label) WHERE z = l UNION ALL SELECT sl.*, -1 FROM sl JOIN m USING (label) WHERE z = f),
o AS (SELECT t.z, t.j, t.label, b.label AS other, count(*) AS n FROM t JOIN sl b ON b.z = t.z + t.j AND b.y = t.y AND b.x = t.x WHERE b.label <> 0 GROUP BY 1, 2, 3, 4)""" + _BEST.format(v="sl", t="0.92::DOUBLE") + CLOSURE)
def _(v):
    return L.merge_end_slices(sliced(v), 0.92)


_SHELL = "(SELECT a - 1 AS dz, b - 1 AS dy, c - 1 AS dx FROM range(3) r(a), range(3) s(b), range(3) t(c) WHERE NOT (a = 1 AND b = 1 AND c = 1))"
_TOUCH = f"""sh AS (SELECT DISTINCT label, z + dz AS z, y + dy AS y, x + dx AS x FROM seg_a, {_SHELL} o WHERE label <> 0),
tc AS (SELECT sh.label, b.label AS other, count(*) AS n FROM sh JOIN seg_a b USING (z, y, x) WHERE b.label <> 0 AND b.label <> sh.label GROUP BY 1, 2)"""


@add("merge_touching", "seg_a", "WITH RECURSIVE " + _TOUCH + ", e AS (SELECT label AS a, other AS b FROM tc WHERE n > 62)" + CLOSURE)
def _(v):
    return L.merge_touching(v.seg_a, 62)


@add("assign_supervoxels", "seg_a seg_b", """WITH c AS (SELECT a.label AS a, b.label AS b, count(*) AS n FROM seg_a a JOIN seg_b b USING (z, y, x) WHERE a.label <> 0 AND b.label <> 0 GROUP BY 1, 2),
s AS (SELECT label AS a, count(*) AS size FROM seg_a WHERE label <> 0 GROUP BY 1), r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY n DESC, b) AS r FROM c JOIN s USING (a) WHERE n > 0.25::DOUBLE * size)
SELECT z, y, x, CAST(coalesce(b, 0) AS BIGINT) AS label FROM seg_a LEFT JOIN r ON label = a AND r = 1""")
def _(v):
    return L.assign_supervoxels(v.seg_a, v.seg_b, 0.25)


for _form, _case in (("members", "CASE WHEN label % 3 = 1 THEN label // 3 + 500 ELSE 0 END"), ("deleted", "CASE WHEN label % 3 = 1 THEN 0 ELSE label END"), ("all", "CASE WHEN label % 3 = 1 THEN label // 3 + 500 ELSE label END")):

    def _agglomerate(v, form=_form):
        sets = v.seg_a.where("label % 3 = 1").select("label", F.expr("label div 3 + 500").alias("key")).distinct()
        return L.agglomerate_labelsets(v.seg_a, sets, form)

    add(f"agglomerate_labelsets_{_form}", "seg_a", f"SELECT z, y, x, CAST({_case} AS BIGINT) AS label FROM seg_a")(_agglomerate)


@add("merge_by_shared_supervoxel", "seg_a seg_b", """WITH RECURSIVE c AS (SELECT a.label AS o, b.label AS s, count(*) AS n FROM seg_a a JOIN seg_b b USING (z, y, x) WHERE a.label <> 0 AND b.label <> 0 GROUP BY 1, 2),
m AS (SELECT o, s, min(o) OVER (PARTITION BY s) AS f FROM c WHERE n > 90), e AS (SELECT f AS a, o AS b FROM m)""" + CLOSURE)
def _(v):
    rows = L.label_contingency(v.seg_a, v.seg_b).where("n > 90").select(F.col("a").alias("object"), F.col("b").alias("supervoxel"))
    return L.merge_by_shared_supervoxel(rows)


@add("label_union", "", "WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, 1000000 + l_partkey % 97 * 11 + l_suppkey % 11 AS b FROM lineitem)" + CLOSURE)
def _(v):
    li = v.table("lineitem")
    return L.label_union(li.select(F.col("l_suppkey").cast("bigint").alias("a"), (1000000 + F.col("l_partkey") % 97 * 11 + F.col("l_suppkey") % 11).cast("bigint").alias("b")).distinct())


_CLASSES = """SELECT label, min(z) = 0 AS bottom, max(z) = (SELECT dz FROM dims) - 1 AS top, min(y) = 0 OR max(y) = 24 OR min(x) = 0 OR max(x) = 63 AS side,
count(*) AS n, max(z) - min(z) + 1 AS slices FROM seg_b WHERE label <> 0 GROUP BY label"""


@add("classify_traversing", "seg_b dims", f"WITH c AS ({_CLASSES}) SELECT label, bottom, top, side, bottom::INT + top::INT + side::INT = 2 AS traversing FROM c WHERE n >= 50 AND slices >= 3")
def _(v):
    return L.classify_traversing(v.seg_b, v.dims, 50, 3)


@add("reassign_traversing", "seg_b dims", f"WITH c AS ({_CLASSES}) SELECT label, (bottom::INT + top::INT + side::INT = 2) <> (label % 7 = 0) AS traversing FROM c")
def _(v):
    return L.reassign_traversing(L.classify_traversing(v.seg_b, v.dims).select("label", "traversing"), v.seg_b.where("label % 7 = 0"))


@add("split_compartments", "seg_a seg_b vox", """WITH m AS (SELECT DISTINCT label FROM seg_a JOIN vox USING (z, y, x) WHERE value > 172)
SELECT DISTINCT label, CASE WHEN label IN (SELECT label FROM seg_b WHERE label <> 0) THEN 'b' WHEN label IN (SELECT label FROM m) THEN 'bright' ELSE 'rest' END AS class FROM seg_a WHERE label <> 0""")
def _(v):
    bright = v.seg_a.join(v.vox.where("value > 172"), ["z", "y", "x"], "left_semi")
    return L.split_compartments(v.seg_a, {"b": v.seg_b, "bright": bright})
