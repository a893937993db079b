import io

import numpy as np

from voxelry.functions.block_names import format_block_id, parse_block_id
from voxelry.sources import annotations, labelsets, volumes
from pyspark.sql import functions as F


def test_slice_series_follows_names(spark, tmp_path):
    for i in (2, 0, 3, 1):
        np.save(tmp_path / f"s{i}.npy", np.full((2, 3), i))
    got = volumes.scan_slice_series(spark, str(tmp_path))
    assert {(r.z, r.value) for r in got.collect()} == {(i, float(i)) for i in range(4)} and got.count() == 24


def test_write_read_and_guard(spark, tmp_path):
    path = f"file://{tmp_path}/v"
    vol = spark.range(24).selectExpr("CAST(id div 12 AS INT) z", "CAST(id div 4 % 3 AS INT) y", "CAST(id % 4 AS INT) x", "id AS value")
    meta = volumes.metadata(spark, "v", (0.05, 1.0, 1.0))
    assert volumes.write_volume(vol, meta, path, (1, 2, 2)) == "WRITTEN"
    assert volumes.write_volume(vol, meta, path, (1, 2, 2), protective=True) == "CANCELLED"
    slab = vol.where("z = 1").withColumn("value", F.col("value") + 100)
    volumes.write_volume(slab, meta, path, (1, 2, 2))
    got, m = volumes.read_volume(spark, path)
    assert got.count() == 24 and got.where("value >= 100").count() == 12 and m.first().axlab == "zyx"
    step = volumes.save_step(vol, f"{path}-out", "first")
    assert volumes.save_step(vol.limit(1), f"{path}-out", "first", protective=True).count() == step.count() == 24


def test_labelsets_round_trip(spark, tmp_path):
    line = spark.createDataFrame([("       5:        5        9 ",)], "value string")
    sets = labelsets.parse_labelsets(line)
    assert sets.first().asDict() == {"key": 5, "members": [5, 9]}
    assert labelsets.format_labelsets(sets).first().line == "       5:        5        9 "
    labelsets.write_labelsets(sets, f"file://{tmp_path}/sets")
    assert labelsets.read_labelsets(spark, f"file://{tmp_path}/sets").collect() == sets.collect()
    assert labelsets.collected(labelsets.exploded(sets)).collect() == sets.collect()


def test_block_names(spark):
    name = F.lit("a_00480-01020_00000-00520_00000-00184")
    r = spark.range(1).select(*[c.alias(k) for k, c in parse_block_id(name).items()])
    assert r.first().asDict() == {"x0": 480, "x1": 1020, "y0": 0, "y1": 520, "z0": 0, "z1": 184}
    assert r.select(format_block_id("a").alias("n")).first().n == "a_00480-01020_00000-00520_00000-00184"


def test_annotations(spark, tmp_path):
    thing = '<thing id="{i}" comment="c"><nodes>{n}</nodes><edges>{e}</edges></thing>'
    node = '<node id="{}" x="{}" y="{}" z="{}" radius="1.5"/>'
    text = "<things>" + thing.format(i=1, n="".join(node.format(k, 10 + k, 20 + k, 5) for k in range(3)), e='<edge source="0" target="1"/>') + thing.format(i=2, n="".join(node.format(k, k + 1, 1, 1) for k in range(3)), e='<edge source="0" target="1"/><edge source="1" target="2"/>') + "</things>"
    (tmp_path / "a.xml").write_text(text)
    nodes, edges = annotations.scan_annotations(spark, str(tmp_path / "a.xml"), (1, 0, 0))
    first = nodes.where("thing = 1 AND node = 0").first()
    assert (first.z, first.y, first.x) == (3.0, 9.0, 19.0) and nodes.count() == 6 and edges.count() == 3


def test_metadata_defaults_and_aux(spark):
    aux = volumes.metadata(spark, "aux", (2.0, 3.0, 4.0), "xyz")
    assert volumes.metadata(spark, "v", aux=aux).first().elsize == [2.0, 3.0, 4.0]
    assert volumes.metadata(spark, "v", ndim=4).first().axlab == "zyxc"
