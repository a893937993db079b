"""Queries of section 2.3 and of label sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.functions.block_names import format_block_id, parse_block_id
from voxelry.operators import blocks as B
from voxelry.sources import labelsets as L

from .views import registry

add = registry.add
SIZE, MARGIN = (5, 10, 16), (1, 2, 3)

_GRID = """WITH b AS (SELECT CAST(z AS INT) AS iz, CAST(y AS INT) AS iy, CAST(x AS INT) AS ix, dz FROM dims,
  (SELECT unnest(generate_series(0, (SELECT (dz + 4) // 5 - 1 FROM dims))) AS z), (SELECT unnest(generate_series(0, 2)) AS y), (SELECT unnest(generate_series(0, 3)) AS x))
"""


@add("block_grid", "dims", _GRID + """SELECT CAST(iz * 12 + iy * 4 + ix AS INT) AS block_no, CAST(greatest(iz * 5 - 1, 0) AS INT) AS z0, CAST(least(iz * 5 + 6, dz) AS INT) AS z1,
  CAST(greatest(iy * 10 - 2, 0) AS INT) AS y0, CAST(least(iy * 10 + 12, 25) AS INT) AS y1, CAST(greatest(ix * 16 - 3, 0) AS INT) AS x0, CAST(least(ix * 16 + 19, 64) AS INT) AS x1 FROM b""")
def _(v):
    return B.block_grid(v.spark, v.dims, SIZE, MARGIN).select("block_no", "z0", "z1", "y0", "y1", "x0", "x1")


@add("block_id_codec", "dims", _GRID + """SELECT printf('vol_%05d-%05d_%05d-%05d_%05d-%05d', ix * 16, least(ix * 16 + 16, 64), iy * 10, least(iy * 10 + 10, 25), iz * 5, least(iz * 5 + 5, dz)) AS block_id,
  CAST(iz * 5 - 1 AS INT) AS z0, CAST(iy * 10 - 2 AS INT) AS y0, CAST(least(ix * 16 + 16, 64) - 3 AS INT) AS x1 FROM b""")
def _(v):
    g = B.block_grid(v.spark, v.dims, SIZE).select(format_block_id("vol").alias("block_id"))
    return g.withColumns(parse_block_id(F.col("block_id"), (1, 2, 3))).select("block_id", "z0", "y0", "x1")


_SPLIT = """WITH s AS (SELECT v.*, CAST(iz AS INT) AS iz, CAST(iy AS INT) AS iy, CAST(ix AS INT) AS ix FROM {vol} v, dims,
  LATERAL (SELECT unnest([z // 5 - 1, z // 5, z // 5 + 1]) AS iz), (SELECT unnest(generate_series(0, 2)) AS iy), (SELECT unnest(generate_series(0, 3)) AS ix)
  WHERE iz >= 0 AND iz < (dz + 4) // 5 AND z >= iz * 5 - 1 AND z < iz * 5 + 6 AND y >= iy * 10 - 2 AND y < iy * 10 + 12 AND x >= ix * 16 - 3 AND x < ix * 16 + 19)
"""


@add("split_blocks", "vox dims", _SPLIT.format(vol="vox") + "SELECT iz, iy, ix, CAST(count(*) AS BIGINT) AS n, CAST(sum(value) AS BIGINT) AS total FROM s GROUP BY iz, iy, ix")
def _(v):
    s = B.split_blocks(v.vox, v.dims, SIZE, MARGIN)
    return s.groupBy("iz", "iy", "ix").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@add("merge_blocks", "vox", "SELECT * FROM vox")
def _(v):
    return B.merge_blocks(B.split_blocks(v.vox, v.dims, SIZE, MARGIN), SIZE)


@add("relabel_blocks", "seg_a", """WITH b AS (SELECT z // 5 AS iz, y // 10 AS iy, x // 16 AS ix, z, y, x, label FROM seg_a),
l AS (SELECT DISTINCT iz, iy, ix, label FROM b WHERE label <> 0), r AS (SELECT *, row_number() OVER (ORDER BY iz, iy, ix, label) AS new FROM l)
SELECT z, y, x, CAST(coalesce(new, 0) AS BIGINT) AS label FROM b LEFT JOIN r USING (iz, iy, ix, label)""")
def _(v):
    core = B.merge_blocks  # noqa: F841  cores only: margins are zero
    return B.relabel_blocks(B.split_blocks(v.seg_a, v.dims, SIZE, (0, 0, 0))).select("z", "y", "x", "label")


_BEST = """, c AS (SELECT label, other, count(*) AS n FROM p GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY label) AS size FROM c),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, other) AS best FROM t WHERE other <> 0)
SELECT CAST(label AS BIGINT) AS label, CAST(other AS BIGINT) AS new_label FROM r WHERE best = 1 AND n >= {share} * size"""


@add("merge_block_overlap", "seg_b dims", _SPLIT.format(vol="seg_b") + """, u AS (SELECT *, CASE WHEN label = 0 THEN 0 ELSE label * 10000 + iz * 100 + iy * 10 + ix END AS ul, (z // 5 = iz AND y // 10 = iy AND x // 16 = ix) AS core FROM s),
p AS (SELECT a.ul AS label, b.ul AS other FROM u a JOIN u b USING (z, y, x) WHERE a.core AND NOT b.core AND a.ul <> 0 AND (b.iz, b.iy, b.ix) < (a.iz, a.iy, a.ix))""" + _BEST.format(share="0.3::DOUBLE"))
def _(v):
    s = B.split_blocks(v.seg_b, v.dims, SIZE, MARGIN)
    unique = F.when(F.col("label") == 0, 0).otherwise(F.col("label") * 10000 + F.col("iz") * 100 + F.col("iy") * 10 + F.col("ix"))
    return B.merge_block_overlap(s.withColumn("label", unique), SIZE, 0.3)


@add("merge_block_faces", "seg_b", """WITH u AS (SELECT z, y, x, CASE WHEN label = 0 THEN 0 ELSE label * 10000 + (z // 5) * 100 + (y // 10) * 10 + x // 16 END AS label FROM seg_b),
p AS (SELECT a.label, b.label AS other FROM u a JOIN u b ON a.label <> 0 AND (
  (a.z % 5 = 0 AND b.z = a.z - 1 AND b.y = a.y AND b.x = a.x) OR (a.y % 10 = 0 AND b.y = a.y - 1 AND b.z = a.z AND b.x = a.x) OR (a.x % 16 = 0 AND b.x = a.x - 1 AND b.z = a.z AND b.y = a.y))
  WHERE b.z BETWEEN a.z - 1 AND a.z AND b.y BETWEEN a.y - 1 AND a.y AND b.x BETWEEN a.x - 1 AND a.x)""" + _BEST.format(share="0.1::DOUBLE"))
def _(v):
    unique = F.expr("CASE WHEN label = 0 THEN 0 ELSE label * 10000 + (z div 5) * 100 + (y div 10) * 10 + x div 16 END")
    return B.merge_block_faces(v.seg_b.withColumn("label", unique), SIZE)


@add("missing_blocks", "vox dims", _GRID + "SELECT CAST(iz * 12 + iy * 4 + ix AS INT) AS block_no FROM b WHERE (iz, iy, ix) NOT IN (SELECT z // 5, y // 10, x // 16 FROM vox WHERE value > 172)")
def _(v):
    done = v.vox.where("value > 172").select(F.expr("CAST((z div 5) * 12 + (y div 10) * 4 + x div 16 AS INT)").alias("block_no"))
    return B.missing_blocks(B.block_grid(v.spark, v.dims, SIZE).select("block_no"), done)


@add("seed_from_neighbour_faces", "seg_a", """WITH m AS (SELECT z + 1 AS z, y, x, label FROM seg_a WHERE label <> 0 AND z % 5 = 4
UNION ALL SELECT z, y + 1, x, label FROM seg_a WHERE label <> 0 AND y % 10 = 9 UNION ALL SELECT z, y, x + 1, label FROM seg_a WHERE label <> 0 AND x % 16 = 15)
SELECT CAST(z AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, max(label) AS label FROM m GROUP BY z, y, x""")
def _(v):
    return B.seed_from_neighbour_faces(v.seg_a, SIZE).select("z", "y", "x", "label")


@add("downsampled_bounds", "dims", _GRID + "SELECT CAST(iz * 12 + iy * 4 + ix AS INT) AS block_no, CAST(ceil(iz * 5 / 2) AS INT) AS z0, CAST(ceil(least(iy * 10 + 10, 25) / 7) AS INT) AS y1, CAST(ceil(least(ix * 16 + 16, 64) / 7) AS INT) AS x1 FROM b")
def _(v):
    return B.downsampled_bounds(B.block_grid(v.spark, v.dims, SIZE), (2, 7, 7)).select("block_no", "z0", "y1", "x1")


@add("labelsets_text", "seg_a", """WITH s AS (SELECT label % 16 AS key, list_sort(list(DISTINCT label)) AS m FROM seg_a WHERE label <> 0 GROUP BY 1)
SELECT printf('%8d: ', key) || list_aggregate(list_transform(m, lambda x: printf('%8d ', x)), 'string_agg', '') AS line, CAST(len(m) AS INT) AS n FROM s""")
def _(v):
    sets = L.collected(v.seg_a.where("label <> 0").select((F.col("label") % 16).alias("key"), "label"))
    lines = L.format_labelsets(sets)
    return L.parse_labelsets(lines.withColumn("value", F.col("line"))).transform(L.format_labelsets).select("line", F.size(F.split(F.trim(F.split("line", ":")[1]), r"\s+")).alias("n"))
