"""Every registered query of the library against its SQL, on the smallest tables."""

import os

import duckdb
import pandas as pd
import pytest

from voxelry.plans.all import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.execute(f"CREATE VIEW {t[:-8]} AS SELECT * FROM '{SF}/{t}'")
    return c


def rows(df):
    cols = sorted(df.columns)
    clean = [tuple(None if v is None or v is pd.NA or v != v else round(v, 5) + 0.0 if isinstance(v, float) else v for v in r) for r in df[cols].astype(object).itertuples(index=False)]
    return sorted(clean, key=lambda r: [(v is None, v if v is not None else 0) for v in r]), cols


@pytest.mark.parametrize("name", sorted(registry.sql))
def test_query(spark, sql, name):
    got, expected = registry.found[name](spark, SF).toPandas(), sql.execute(registry.sql[name]).df()
    (a, ca), (b, cb) = rows(got), rows(expected)
    assert ca == cb and len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or (u is not None and v is not None and isinstance(u, (int, float)) and abs(u - v) < 1e-4 * (1 + abs(v))) for u, v in zip(x, y)), (x, y)


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


HELD = (
    "binary_dilate", "components_2d", "components_3d", "detect_unsheathed", "difference_of_gaussians", "distance_transform", "expand_blocks", "fill_holes_enclosed", "fill_holes_unreachable",
    "gaussian_smooth", "gradient_magnitude", "grey_dilate", "close_labels", "inner_compartment", "label_rim_outer", "map_blocks", "near_distance", "structuring_element",
)


@pytest.fixture(scope="module", params=["ends early", "lacks lines"])
def ragged(request, tmp_path_factory):
    """A stack whose last slice isn't full, and one that lacks lines further up too."""
    folder = tmp_path_factory.mktemp("ragged")
    gaps = " AND vec_id % 25 <> 11" if request.param == "lacks lines" else ""
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < 132{gaps}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    return str(folder), c


@pytest.mark.parametrize("name", HELD)
def test_results_lie_in_the_voxels_that_a_volume_holds(spark, ragged, name):
    folder, c = ragged
    (a, ca), (b, cb) = rows(registry.found[name](spark, folder).toPandas()), rows(c.execute(registry.sql[name]).df())
    assert ca == cb and len(a) == len(b)
    for x, y in zip(a, b):
        assert all(u == v or abs(u - v) < 1e-4 * (1 + abs(v)) for u, v in zip(x, y)), (x, y)


@pytest.mark.parametrize("name", ["split_blocks", "merge_block_overlap"])
def test_blocks_beyond_the_two_hundredth(spark, tmp_path, name):
    c = duckdb.connect()
    c.execute(f"COPY (SELECT * REPLACE (vec_id + CASE WHEN vec_id < 100 THEN 0 ELSE 25000 END AS vec_id) FROM '{SF}/embeddings.parquet') TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    c.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    assert rows(registry.found[name](spark, str(tmp_path)).toPandas()) == rows(c.execute(registry.sql[name]).df())
