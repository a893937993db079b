"""Queries of sections 2.5 and 2.9."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.operators import regions as R

from .views import registry

add = registry.add
rounded = lambda *names: [F.round(n, 6).alias(n) for n in names]
PI = "3.141592653589793::DOUBLE"


@add("unique_labels", "seg_a", "SELECT DISTINCT label FROM seg_a")
def _(v):
    return R.unique_labels(v.seg_a)


@add("max_label", "seg_a", "SELECT max(label) AS max_label FROM seg_a")
def _(v):
    return R.max_label(v.seg_a)


@add("label_sizes", "seg_a", "SELECT label, CAST(count(*) AS BIGINT) AS n FROM seg_a WHERE label <> 0 GROUP BY label")
def _(v):
    return R.label_sizes(v.seg_a)


@add("filter_small_labels", "seg_b", "SELECT z, y, x, CAST(CASE WHEN count(*) OVER (PARTITION BY label) < 200 THEN 0 ELSE label END AS BIGINT) AS label FROM seg_b")
def _(v):
    return R.filter_small_labels(v.seg_b, 200)


@add("region_bbox", "seg_b", "SELECT label, min(z) AS z0, CAST(max(z) + 1 AS INT) AS z1, min(y) AS y0, CAST(max(y) + 1 AS INT) AS y1, min(x) AS x0, CAST(max(x) + 1 AS INT) AS x1 FROM seg_b WHERE label <> 0 GROUP BY label")
def _(v):
    return R.region_bbox(v.seg_b)


@add("region_centroid", "seg_b", "SELECT label, round(avg(z), 6) AS cz, round(avg(y), 6) AS cy, round(avg(x), 6) AS cx FROM seg_b WHERE label <> 0 GROUP BY label")
def _(v):
    return R.region_centroid(v.seg_b).select("label", *rounded("cz", "cy", "cx"))


@add("region_equivalent_diameter", "seg_b", f"SELECT label, round(cbrt(count(*) * 6 / {PI}), 6) AS diameter FROM seg_b WHERE label <> 0 GROUP BY label")
def _(v):
    return R.region_equivalent_diameter(v.seg_b).select("label", *rounded("diameter"))


@add("region_extent", "seg_b", "SELECT label, round(count(*) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1))::DOUBLE, 6) AS extent FROM seg_b WHERE label <> 0 GROUP BY label")
def _(v):
    return R.region_extent(v.seg_b).select("label", *rounded("extent"))


@add("region_intensity", "seg_a vox", "SELECT label, round(avg(value), 6) AS mean, max(value) AS max FROM seg_a JOIN vox USING (z, y, x) WHERE label <> 0 GROUP BY label")
def _(v):
    return R.region_intensity(v.seg_a, v.vox).select("label", *rounded("mean"), "max")


ECC = """SELECT z, label, CASE WHEN (vy + vx) / 2 + q > 1e-12 THEN sqrt(greatest(0.0, 1 - ((vy + vx) / 2 - q) / ((vy + vx) / 2 + q))) ELSE 0.0 END AS eccentricity FROM
(SELECT *, sqrt(((vy - vx) / 2) * ((vy - vx) / 2) + c * c) AS q FROM (SELECT z, label, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS c FROM {v} WHERE label <> 0 GROUP BY z, label))"""


@add("region_eccentricity", "seg_a", f"SELECT z, label, round(eccentricity, 6) AS eccentricity FROM ({ECC.format(v='seg_a')})")
def _(v):
    return R.region_eccentricity(v.seg_a).select("z", "label", *rounded("eccentricity"))


#: Pixels inside the convex hull, column by column: the hull's edge there is the outermost chord between two columns.
_HULL = """WITH c AS (SELECT z, label, x, min(y) AS y0, max(y) AS y1, count(*) AS n FROM seg_a WHERE label <> 0 GROUP BY 1, 2, 3),
p AS (SELECT a.z, a.label, CAST(unnest(generate_series(a.x, b.x)) AS INT) AS x, a.x AS xa, b.x AS xb, a.y0 AS la, b.y0 AS lb, a.y1 AS ha, b.y1 AS hb FROM c a JOIN c b ON b.z = a.z AND b.label = a.label AND b.x >= a.x),
h AS (SELECT z, label, x, max(CASE WHEN xa = xb THEN ha ELSE (ha * (xb - x) + hb * (x - xa)) // (xb - xa) END) AS top,
  min(CASE WHEN xa = xb THEN la ELSE (la * (xb - x) + lb * (x - xa) + (xb - xa) - 1) // (xb - xa) END) AS low FROM p GROUP BY 1, 2, 3)
SELECT z, label, round((SELECT sum(n) FROM c WHERE c.z = h.z AND c.label = h.label) / sum(greatest(top - low + 1, 0))::DOUBLE, 6) AS solidity FROM h GROUP BY z, label"""


@add("region_solidity", "seg_a", _HULL)
def _(v):
    return R.region_solidity(v.seg_a).select("z", "label", *rounded("solidity"))


EULER = """SELECT z, label, CAST(sum(CASE WHEN n = 1 THEN 1 WHEN n = 3 THEN -1 WHEN bits IN (6, 9) THEN -2 ELSE 0 END) / 4 AS INT) AS euler FROM
(SELECT z, label, y - a AS y, x - b AS x, count(*) AS n, sum(CAST(pow(2, a * 2 + b) AS INT)) AS bits FROM {v}, range(2) r(a), range(2) s(b) WHERE label <> 0 GROUP BY 1, 2, 3, 4) GROUP BY z, label"""


@add("region_euler_number", "seg_a", EULER.format(v="seg_a"))
def _(v):
    return R.region_euler_number(v.seg_a)


PROPS = "SELECT label, count(*) AS area, avg(value) AS mean, count(*) / ((max(z) - min(z) + 1) * (max(y) - min(y) + 1) * (max(x) - min(x) + 1))::DOUBLE AS extent FROM seg_a JOIN vox USING (z, y, x) WHERE label <> 0 GROUP BY label"


def props(v):
    i = R.region_intensity(v.seg_a, v.vox)
    return R.label_sizes(v.seg_a).withColumnRenamed("n", "area").join(i, "label").join(R.region_extent(v.seg_a), "label")


@add("property_filter", "seg_a vox", f"SELECT label, CAST(CASE WHEN area >= 100 AND area <= 400 AND mean <= 128 AND extent >= 0.5 THEN label ELSE 0 END AS BIGINT) AS new_label FROM ({PROPS})")
def _(v):
    return R.property_filter(props(v), min_area=100, max_area=400, max_intensity=128, min_extent=0.5)


@add("property_volume", "seg_a", "SELECT z, y, x, CAST(count(*) OVER (PARTITION BY label) AS BIGINT) AS value FROM seg_a WHERE label <> 0")
def _(v):
    return R.property_volume(v.seg_a, R.label_sizes(v.seg_a), "n")


@add("compartment_volumes", "seg_a seg_b mask_ds", """WITH c AS (SELECT 'a' AS compartment, label FROM seg_a UNION ALL SELECT 'b', label FROM seg_b), o AS (SELECT compartment, label, count(*) AS n FROM c WHERE label <> 0 GROUP BY 1, 2)
SELECT compartment, round(sum(n) * 0.5::DOUBLE, 6) AS volume, round(sum(n) / (SELECT count(*) FROM mask_ds)::DOUBLE, 6) AS fraction, round(avg(n) * 0.5::DOUBLE, 6) AS mean, round(stddev_pop(n) * 0.5::DOUBLE, 6) AS std FROM o GROUP BY 1""")
def _(v):
    c = v.seg_a.withColumn("compartment", F.lit("a")).unionByName(v.seg_b.withColumn("compartment", F.lit("b")))
    return R.compartment_volumes(c, v.mask_ds, 0.5).select("compartment", *rounded("volume", "fraction", "mean", "std"))


_SHELL = "(SELECT a - 1 AS dz, b - 1 AS dy, c - 1 AS dx FROM range(3) r(a), range(3) s(b), range(3) t(c) WHERE NOT (a = 1 AND b = 1 AND c = 1))"


@add("boundary_composition", "seg_a vox", f"""WITH sh AS (SELECT DISTINCT label, z + dz AS z, y + dy AS y, x + dx AS x FROM seg_a, {_SHELL} o WHERE label <> 0),
s AS (SELECT sh.label, value FROM sh JOIN vox USING (z, y, x) JOIN seg_a USING (z, y, x) WHERE seg_a.label <> sh.label)
SELECT label, round(avg((value > 140)::INT), 6) AS in_a, round(avg((value < 96)::INT), 6) AS in_b, round(avg((value > 140)::INT) - avg((value < 96)::INT), 6) AS difference FROM s GROUP BY label""")
def _(v):
    return R.boundary_composition(v.seg_a, v.vox.where("value > 140"), v.vox.where("value < 96")).select("label", *rounded("in_a", "in_b", "difference"))


@add("slice_label_sets", "seg_a", "SELECT z, string_agg(label, ',' ORDER BY label) AS labels FROM (SELECT DISTINCT z, label FROM seg_a WHERE label <> 0) GROUP BY z")
def _(v):
    return R.slice_label_sets(v.seg_a).select("z", F.array_join(F.transform("labels", lambda x: x.cast("string")), ",").alias("labels"))


@add("volume_histogram", "vox", "SELECT CASE WHEN value BETWEEN 20 AND 220 THEN CAST(least(floor((value - 20) * 16 / 200), 15) AS INT) END AS bin, CAST(count(*) AS BIGINT) AS n FROM vox GROUP BY 1")
def _(v):
    return R.volume_histogram(v.vox, 20, 220, 16)


@add("relabel_sequential", "seg_a", "SELECT z, y, x, CAST(CASE WHEN label = 0 THEN 0 ELSE 7 + d END AS BIGINT) AS label FROM seg_a LEFT JOIN (SELECT label, dense_rank() OVER (ORDER BY label) AS d FROM (SELECT DISTINCT label FROM seg_a WHERE label <> 0)) USING (label)")
def _(v):
    return R.relabel_sequential(v.seg_a, 7)


@add("shuffle_labels", "seg_a", """WITH d AS (SELECT DISTINCT label FROM seg_a WHERE label <> 0), a AS (SELECT label, row_number() OVER (ORDER BY label) AS r FROM d),
b AS (SELECT label AS new, row_number() OVER (ORDER BY md5(concat_ws(',', label, 3)), label) AS r FROM d) SELECT z, y, x, coalesce(new, s.label) AS label FROM seg_a s LEFT JOIN (SELECT label, new FROM a JOIN b USING (r)) m ON m.label = s.label""")
def _(v):
    return R.shuffle_labels(v.seg_a, 3)


@add("remove_largest", "seg_b", "SELECT z, y, x, CAST(CASE WHEN label = (SELECT label FROM seg_b WHERE label <> 0 GROUP BY label ORDER BY count(*) DESC, label LIMIT 1) THEN 0 ELSE label END AS BIGINT) AS label FROM seg_b")
def _(v):
    return R.remove_largest(v.seg_b)


@add("rank_regions", "seg_b", "SELECT label, CAST(row_number() OVER (ORDER BY count(*) DESC, label) AS INT) AS place FROM seg_b WHERE label <> 0 GROUP BY label")
def _(v):
    return R.rank_regions(v.seg_b)


@add("border_slice", "seg_b", """WITH c AS (SELECT z, label, avg(y) AS cy, avg(x) AS cx, max(z) OVER (PARTITION BY label) AS e FROM seg_b WHERE label <> 0 GROUP BY z, label)
SELECT label, z, round(cy, 6) AS cy, round(cx, 6) AS cx FROM c WHERE z = e""")
def _(v):
    return R.border_slice(v.seg_b, "last").select("label", "z", *rounded("cy", "cx"))


@add("consecutive_runs", "seg_a vox", """WITH s AS (SELECT DISTINCT label, z FROM seg_a JOIN vox USING (z, y, x) WHERE label <> 0 AND value > 160), i AS (SELECT *, z - row_number() OVER (PARTITION BY label ORDER BY z) AS i FROM s)
SELECT label, min(z) AS z0, max(z) AS z1, CAST(count(*) AS BIGINT) AS n FROM i GROUP BY label, i HAVING count(*) > 1""")
def _(v):
    return R.consecutive_runs(v.seg_a.where("label <> 0").join(v.vox.where("value > 160"), ["z", "y", "x"], "left_semi"), 1)


@add("centreline", "seg_b", """WITH c AS (SELECT z, label, avg(y) AS cy, avg(x) AS cx FROM seg_b WHERE label <> 0 GROUP BY 1, 2),
d AS (SELECT label, sqrt(pow((z - lag(z) OVER w) * 2.0::DOUBLE, 2) + pow(cy - lag(cy) OVER w, 2) + pow(cx - lag(cx) OVER w, 2)) AS d FROM c WINDOW w AS (PARTITION BY label ORDER BY z))
SELECT label, round(coalesce(sum(d), 0), 6) AS length, coalesce(max(d), 0) > 2.1::DOUBLE AS gap FROM d GROUP BY label""")
def _(v):
    return R.centreline(v.seg_b, (2.0, 1.0, 1.0), 2.1).select("label", *rounded("length"), "gap")


@add("project_centroid", "seg_b", """WITH c AS (SELECT z, label, avg(y) AS cy, avg(x) AS cx, max(z) OVER (PARTITION BY label) AS l FROM seg_b WHERE label <> 0 GROUP BY z, label),
p AS (SELECT a.label, a.z + 4 AS z, a.cy + 4 * (a.cy - b.cy) / greatest(a.z - b.z, 1) AS cy, a.cx + 4 * (a.cx - b.cx) / greatest(a.z - b.z, 1) AS cx FROM c a JOIN c b ON a.label = b.label AND a.z = a.l AND b.z = a.l - 2)
SELECT label, CAST(z AS INT) AS z, round(cy, 6) AS cy, round(cx, 6) AS cx FROM p""")
def _(v):
    return R.project_centroid(v.seg_b, 3, 4, 5).select("label", "z", *rounded("cy", "cx"))


@add("rasterize_segments", "seg_b", """WITH b AS (SELECT label, min(z) AS z0, max(z) AS z1, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM seg_b WHERE label <> 0 GROUP BY label),
t AS (SELECT *, greatest(z1 - z0, y1 - y0, x1 - x0) AS n, unnest(generate_series(0, greatest(z1 - z0, y1 - y0, x1 - x0))) AS t FROM b)
SELECT DISTINCT label, CAST(floor(z0 + (z1 - z0) * t / greatest(n, 1)::DOUBLE + 0.5) AS INT) AS z, CAST(floor(y0 + (y1 - y0) * t / greatest(n, 1)::DOUBLE + 0.5) AS INT) AS y, CAST(floor(x0 + (x1 - x0) * t / greatest(n, 1)::DOUBLE + 0.5) AS INT) AS x FROM t""")
def _(v):
    b = v.seg_b.where("label <> 0").groupBy("label").agg(*[f(a).alias(f"{a}{i}") for a in ("z", "y", "x") for i, f in ((0, F.min), (1, F.max))])
    return R.rasterize_segments(b)
