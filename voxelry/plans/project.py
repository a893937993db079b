"""Queries of sections 2.1 and 2.2."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelry.operators import project as P

from .views import registry

add = registry.add


@add("read_volume", "vox", "SELECT z, CAST(count(*) AS BIGINT) AS n, CAST(sum(value) AS BIGINT) AS total, 0.05::DOUBLE AS elsize FROM vox GROUP BY z")
def _(v):
    from voxelry.sources.volumes import metadata

    meta = metadata(v.spark, "vox", (0.05, 0.0073, 0.0073), "zyx")
    per_slice = v.vox.groupBy("z").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per_slice.crossJoin(F.broadcast(meta.select(F.element_at("elsize", 1).alias("elsize"))))


@add("write_volume", "vox", "SELECT z, y, x, CAST(CASE WHEN z < 3 THEN value + 1000 ELSE value END AS INT) AS value FROM vox")
def _(v):
    """Writes a volume, replaces a slab of it, reads it back."""
    import uuid

    from voxelry.functions.graph import shared_dir
    from voxelry.sources.volumes import metadata, read_volume, write_volume

    path = f"{shared_dir(v.spark)}/volume-{uuid.uuid4().hex}"
    meta = metadata(v.spark, "vox")
    write_volume(v.vox, meta, path, (3, 25, 64))
    write_volume(v.vox.where("z < 3").withColumn("value", F.col("value") + 1000), meta, path, (3, 25, 64))
    return read_volume(v.spark, path)[0].select("z", "y", "x", "value")


@add("tensor_to_voxels", "", "SELECT vec_id, CAST((i - 1) // 16 AS INT) AS r, CAST((i - 1) % 16 AS INT) AS c, embedding[i]::DOUBLE AS value FROM (SELECT vec_id, embedding, unnest(generate_series(1, 64)) AS i FROM embeddings)")
def _(v):
    from voxelry.sources.volumes import tensor_to_voxels

    return tensor_to_voxels(v.table("embeddings").select("vec_id", F.col("embedding").alias("data")), {"r": 4, "c": 16}).select("vec_id", "r", "c", F.col("value").cast("double").alias("value"))


@add("voxels_to_blocks", "vox", """SELECT CAST(z // 5 AS BIGINT) AS iz, CAST(y // 10 AS BIGINT) AS iy, CAST(x // 16 AS BIGINT) AS ix, CAST(count(*) AS BIGINT) AS n, string_agg(value, ',' ORDER BY z, y, x) AS data
FROM vox GROUP BY 1, 2, 3""")
def _(v):
    from voxelry.operators.blocks import voxels_to_blocks

    b = voxels_to_blocks(v.vox, (5, 10, 16))
    return b.select("iz", "iy", "ix", F.size("data").cast("bigint").alias("n"), F.array_join(F.transform("data", lambda s: s["value"].cast("string")), ",").alias("data"))


@add("stats_matrix", "seg_a", "SELECT z, CAST(count(*) FILTER (label % 64 = 1) AS BIGINT) AS \"1\", CAST(count(*) FILTER (label % 64 = 10) AS BIGINT) AS \"10\" FROM seg_a WHERE label <> 0 GROUP BY z")
def _(v):
    from voxelry.sources.volumes import stats_matrix

    s = v.seg_a.where("label <> 0").groupBy("z", (F.col("label") % 64).alias("label")).agg(F.count("*").alias("n"))
    return stats_matrix(s, "n", [1, 10]).na.fill(0)


@add("multiresolution_pyramid", "vox", """SELECT l.level, CAST(least(value // 32, 7) AS INT) AS bin, CAST(count(*) AS BIGINT) AS n
FROM vox, (VALUES (0, 1), (1, 2), (2, 4)) AS l(level, s) WHERE z % s = 0 AND y % s = 0 AND x % s = 0 GROUP BY 1, 2""")
def _(v):
    from voxelry.sources.volumes import pyramid, pyramid_histogram

    return pyramid_histogram(pyramid(v.vox, 3), 0, 256, 8)


@add("volume_metadata", "vox prob seg_b", """WITH m(name, axlab, ez, ey, ex) AS (VALUES ('vox', 'zyx', 0.05::DOUBLE, 0.0073::DOUBLE, 0.0073::DOUBLE), ('prob', 'zyxc', 1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE), ('seg_b', 'zyx', 0.05::DOUBLE, 0.0073::DOUBLE, 0.0073::DOUBLE)),
v AS (SELECT 'vox' AS name, z, y, x FROM vox UNION ALL SELECT 'prob', z, y, x FROM prob UNION ALL SELECT 'seg_b', z, y, x FROM seg_b WHERE label <> 0),
g AS (SELECT name, CAST(count(*) AS BIGINT) AS n, max(z) + 1 AS dz, max(y) + 1 AS dy, max(x) + 1 AS dx FROM v GROUP BY name)
SELECT name, axlab, n, round(dz * ez, 6) AS lz, round(dy * ey, 6) AS ly, round(dx * ex, 6) AS lx, round(n * ez * ey * ex, 9) AS volume FROM g JOIN m USING (name)""")
def _(v):
    """Physical extents and volumes: an element size that is given, one by default, and one copied from another volume."""
    from voxelry.sources.volumes import metadata

    a = metadata(v.spark, "vox", (0.05, 0.0073, 0.0073), "zyx")
    meta = a.unionByName(metadata(v.spark, "prob", None, None, ndim=4)).unionByName(metadata(v.spark, "seg_b", aux=a))
    volumes = [d.select(F.lit(n).alias("name"), "z", "y", "x") for n, d in (("vox", v.vox), ("prob", v.prob), ("seg_b", v.seg_b.where("label <> 0")))]
    g = volumes[0].unionByName(volumes[1]).unionByName(volumes[2]).groupBy("name").agg(F.count("*").alias("n"), *[(F.max(c) + 1).alias(f"d{c}") for c in "zyx"])
    size = [F.element_at("elsize", i) for i in (1, 2, 3)]
    return g.join(F.broadcast(meta), "name").select(
        "name", "axlab", "n", *[F.round(F.col(f"d{c}") * s, 6).alias(f"l{c}") for c, s in zip("zyx", size)], F.round(F.col("n") * size[0] * size[1] * size[2], 9).alias("volume")
    )  # a row a volume


@add("scan_slice_series", "vox", "SELECT z, y, x, value::DOUBLE AS value FROM vox")
def _(v):
    """A volume written as a file a slice and scanned again."""
    import uuid

    from voxelry.functions.graph import shared_dir
    from voxelry.sources.volumes import scan_slice_series, write_slice_series

    folder = f"{shared_dir(v.spark)}/slices-{uuid.uuid4().hex}"
    folder = folder if "://" in folder else f"file://{folder}" if folder.startswith("/") else folder
    write_slice_series(v.vox, folder).count()
    return scan_slice_series(v.spark, folder)


@add("output_guard", "vox", "SELECT 'WRITTEN' AS first, 'CANCELLED' AS second, z, CAST(sum(value) AS BIGINT) AS total FROM vox GROUP BY z")
def _(v):
    """A volume that is there is not written again if it is protected, and replaced if it isn't."""
    import uuid

    from voxelry.functions.graph import shared_dir
    from voxelry.sources.volumes import metadata, read_volume, save_step, write_volume

    path = f"{shared_dir(v.spark)}/guarded-{uuid.uuid4().hex}"
    said = [write_volume(v.vox.withColumn("value", F.col("value") * k), metadata(v.spark, "vox"), path, (8, 25, 64), protective=True) for k in (1, 2)]
    step = save_step(read_volume(v.spark, path)[0].select("z", "y", "x", "value"), path, "raw")
    step = save_step(step.where("z < 0"), path, "raw", protective=True)
    return step.groupBy("z").agg(F.sum("value").alias("total")).select(F.lit(said[0]).alias("first"), F.lit(said[1]).alias("second"), "z", "total")


@add("labelset_files", "seg_a seg_b", "SELECT DISTINCT a.label AS key, b.label FROM seg_a a JOIN seg_b b USING (z, y, x) WHERE a.label <> 0 AND b.label <> 0")
def _(v):
    """The labels of one volume that each label of another meets, written as text and read again."""
    import uuid

    from voxelry.functions.graph import shared_dir
    from voxelry.sources.labelsets import collected, exploded, read_labelsets, write_labelsets

    path = f"{shared_dir(v.spark)}/labelsets-{uuid.uuid4().hex}"
    met = v.seg_a.where("label <> 0").withColumnRenamed("label", "key").join(v.seg_b.where("label <> 0"), ["z", "y", "x"]).select("key", "label")
    write_labelsets(collected(met), path)
    return exploded(read_labelsets(v.spark, path))


@add("scan_annotations", "seg_b", """WITH c AS (SELECT label AS thing, z AS node, z::DOUBLE AS z, round(avg(y), 3) AS y, round(avg(x), 3) AS x, round(sqrt(count(*)), 3) AS radius FROM seg_b WHERE label <> 0 GROUP BY label, seg_b.z)
SELECT thing, node, z, y, x, radius, coalesce(lead(node) OVER (PARTITION BY thing ORDER BY node), -1) AS target FROM c""")
def _(v):
    """Skeletons of the labels, a node a slice and edges between neighbouring slices, through XML files."""
    import uuid

    from pyspark.sql import Window

    from voxelry.functions.graph import shared_dir
    from voxelry.sources.annotations import scan_annotations, write_annotations

    path, offset = f"{shared_dir(v.spark)}/skeletons-{uuid.uuid4().hex}", (3, 5, 7)
    n = v.seg_b.where("label <> 0").groupBy(F.col("label").alias("thing"), F.col("z").cast("bigint").alias("node")).agg(
        F.avg("z").alias("z"), F.round(F.avg("y"), 3).alias("y"), F.round(F.avg("x"), 3).alias("x"), F.round(F.sqrt(F.count("*")), 3).alias("radius"))
    e = n.select("thing", F.col("node").alias("source"), F.lead("node").over(Window.partitionBy("thing").orderBy("node")).alias("target")).where("target IS NOT NULL")
    write_annotations(n, e, path, offset)
    nodes, edges = scan_annotations(v.spark, path, offset)
    out = nodes.join(edges.select("thing", F.col("source").alias("node"), "target"), ["thing", "node"], "left")
    return out.select("thing", F.col("node").cast("int").alias("node"), "z", F.round("y", 3).alias("y"), F.round("x", 3).alias("x"), "radius", F.coalesce(F.col("target").cast("int"), F.lit(-1)).alias("target"))


@add("crop", "vox", "SELECT * FROM vox WHERE z >= 2 AND z < 15 AND (z - 2) % 3 = 0 AND y >= 4 AND y < 20 AND x >= 10 AND (x - 10) % 2 = 0")
def _(v):
    """From a stored volume: blocks that the ranges don't meet aren't opened."""
    import uuid

    from voxelry.functions.graph import shared_dir
    from voxelry.sources.volumes import metadata, read_volume, write_volume

    path = f"{shared_dir(v.spark)}/cropped-{uuid.uuid4().hex}"
    write_volume(v.vox, metadata(v.spark, "vox"), path, (5, 10, 32))
    vol, meta = read_volume(v.spark, path)
    return P.crop(vol, tuple(meta.first().block), z=(2, 15, 3), y=(4, 20, 1), x=(10, 0, 2)).select("z", "y", "x", "value")


@add("take_slice", "vox", "SELECT z, x, value FROM vox WHERE y = 7")
def _(v):
    return P.take_slice(v.vox, "y", 7)


@add("permute_axes", "vox", "SELECT x AS z, z AS y, y AS x, value FROM vox")
def _(v):
    return P.permute_axes(v.vox, ("x", "z", "y"))


@add("squeeze_axis", "prob", "SELECT z, y, x, value FROM prob WHERE c = 0")
def _(v):
    return P.squeeze_axis(v.prob, "c")


@add("flip_axis", "vox", "SELECT z, CAST(24 - y AS INT) AS y, x, value FROM vox")
def _(v):
    return P.flip_axis(v.vox, "y", 25)


@add("cast_volume", "vox", "SELECT z, y, x, CAST(round(least(greatest((value - 50.0::DOUBLE) / 150.0::DOUBLE * 127 + 0, 0.0), 127.0)) AS SMALLINT) AS value FROM vox")
def _(v):
    return P.cast_volume(v.vox, 0, 127, "smallint", (50.0, 200.0))


@add("normalize_minmax", "vox", "SELECT z, y, x, round((value - (SELECT min(value) FROM vox))::DOUBLE / ((SELECT max(value) FROM vox) - (SELECT min(value) FROM vox))::DOUBLE, 9) AS value FROM vox")
def _(v):
    return P.normalize_minmax(v.vox).withColumn("value", F.round("value", 9))


@add("normalize_to_reference_mean", "vox", """WITH d AS (SELECT z, y, x, CAST(z % 3 AS INT) AS d, value FROM vox), m AS (SELECT d, avg(value) AS m FROM d GROUP BY d)
SELECT z, y, x, d.d, round(value * ((SELECT m FROM m WHERE d = 0) / m.m), 6) AS value FROM d JOIN m ON d.d = m.d""")
def _(v):
    d = v.vox.withColumn("d", (F.col("z") % 3).cast("int"))
    return P.normalize_to_reference_mean(d, "d", 0).select("z", "y", "x", "d", F.round("value", 6).alias("value"))


@add("threshold_mask", "vox", "SELECT z, y, x, value > 100 AND value <= 140 AS value FROM vox")
def _(v):
    return P.threshold_mask(v.vox, 100, 140)


@add("threshold_sweep", "prob", "SELECT s.step, z, CAST(count(*) AS BIGINT) AS n FROM prob, (SELECT CAST(unnest(generate_series(1, 9)) AS INT) AS step) s WHERE c = 0 AND value > s.step * 0.1::DOUBLE GROUP BY 1, 2")
def _(v):
    return P.threshold_sweep(v.prob.where("c = 0"), 0.1).groupBy("step", "z").agg(F.count("*").alias("n"))


@add("mask_expression", "vox seg_a", """SELECT v.z, v.y, v.x, ((v.value > 110) OR (a.label % 2 = 1)) <> (NOT (v.value > 150)) AS value
FROM vox v JOIN seg_a a USING (z, y, x)""")
def _(v):
    over = lambda t: P.threshold_mask(v.vox, t, 255)
    odd = v.seg_a.select("z", "y", "x", (F.col("label") % 2 == 1).alias("value"))
    return P.mask_expression(v.vox, [("AND", over(110)), ("OR", odd), ("XOR NOT", over(150))])


@add("exclusion_mask", "mask_ds seg_a vox", "SELECT z, y, x FROM mask_ds JOIN seg_a USING (z, y, x) JOIN vox USING (z, y, x) WHERE label = 0 AND NOT value > 90")
def _(v):
    return P.exclusion_mask(v.mask_ds, v.seg_a, v.vox.where("value > 90"))


@add("class_composite", "vox seg_a", "SELECT v.z, v.y, v.x, CASE WHEN a.label % 3 = 1 THEN 3 WHEN value > 150 THEN 2 WHEN value > 120 THEN 1 ELSE 0 END AS class FROM vox v JOIN seg_a a USING (z, y, x)")
def _(v):
    return P.class_composite(v.vox, [v.vox.where("value > 120"), v.vox.where("value > 150"), v.seg_a.where("label % 3 = 1")])


@add("voxel_to_world", "mask_ds", "SELECT z, y, x, round((z + 10) * 0.05::DOUBLE, 9) AS wz, round((y + 20) * 0.0073::DOUBLE, 9) AS wy, round((x + 30) * 0.0073::DOUBLE, 9) AS wx FROM mask_ds")
def _(v):
    w = P.voxel_to_world(v.mask_ds, (0.05, 0.0073, 0.0073), (10, 20, 30))
    return w.select("z", "y", "x", *[F.round(c, 9).alias(c) for c in ("wz", "wy", "wx")])


@add("affine_transform", "mask_ds", "SELECT z, y, x, z * 2.0::DOUBLE + 5 AS wz, y * 0.5::DOUBLE - x * 0.25::DOUBLE AS wy, y * 0.25::DOUBLE + x * 0.5::DOUBLE + 1 AS wx FROM mask_ds")
def _(v):
    return P.affine(v.mask_ds, [[2.0, 0.0, 0.0, 5.0], [0.0, 0.5, -0.25, 0.0], [0.0, 0.25, 0.5, 1.0]])


@add("strided_subsample", "vox", "SELECT CAST(z // 2 AS INT) AS z, CAST(y // 2 AS INT) AS y, CAST(x // 2 AS INT) AS x, value FROM vox WHERE z % 2 = 0 AND y % 2 = 0 AND x % 2 = 0")
def _(v):
    return P.strided_subsample(v.vox, 2)
