"""Every registered query with SQL must equal DuckDB's result."""

import math
import os

import duckdb
import pandas as pd
import pytest

from plumbline.catalog import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def rows(df):
    def show(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
            return "~"
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    return sorted(tuple(show(v) for v in r) for r in df[sorted(df.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, db, name):
    got, want = QUERIES[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    number = lambda df: df.apply(lambda c: c.astype(float) if pd.api.types.is_numeric_dtype(c) and not pd.api.types.is_bool_dtype(c) else c)
    assert rows(number(got)) == rows(number(want))


#: Queries that SQL can't express, and what their rows must be like; their kernels are tested by value elsewhere.
SHAPES = {
    "d1_analysed": lambda r: abs(r.z_est - r.z_true) < 0.1 and r.n == 256 and 0 < r.n_points <= 1000,
    "e1_point_encoder": lambda r: len(r.embedding) == 256 and any(r.embedding),
    "e4_feature_colours": lambda r: all(0 <= c <= 1 for c in (r.r, r.g, r.b)),
    "m7_meshes": lambda r: (r.n_faces == 0) == (r.n_vertices == 0) and r.n_faces <= 200,
    "p12_marched": lambda r: 1.9 < r.marched < 3.6 and 1.9 < r.rings < 3.6 and (r.depth == 0 or r.marched == r.rings == r.depth),
    "p13_restored_frames": lambda r: 1.9 < r.depth < 3.2,
    "p13_restored_pixels": lambda r: 1.9 < r.depth < 3.2,
    "p25_robust_lift": lambda r: r.z_min <= r.z_max and 0 < r.inlier_ratio <= 1 and len(r.vertices) == 24,
    "p36_frames": lambda r: r.category in r.query_text and len(r.bbox_2d) == 4 and 2 <= r.bleed <= 5,
}


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_rows(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows and all(SHAPES[name](r) for r in rows)
    assert sorted(map(str, rows)) == sorted(map(str, QUERIES[name](spark, SF).collect()))


def test_restored_frames_equal_the_kernel(spark):
    """Both forms of the restored depth, row by row, against the plain kernel on the same pixels."""
    import numpy as np

    from plumbline import catalog
    from plumbline.operators import raster as R

    images = {}
    for r in catalog.px(spark, SF).collect():
        images.setdefault(r.frame_id, {})[r.v, r.u] = r.depth
    dense = {(r.frame_id, r.i): r.depth for r in QUERIES["p13_restored_frames"](spark, SF).collect()}
    tiled = {(r.frame_id, r.v, r.u): r.depth for r in QUERIES["p13_restored_pixels"](spark, SF).collect()}
    for f, cells in images.items():
        image = np.zeros((1 + max(v for v, _ in cells), 1 + max(u for _, u in cells)))
        for at, d in cells.items():
            image[at] = d
        want = R.restore_kernel(image)
        assert all(abs(dense[f, v * image.shape[1] + u] - want[v, u]) < 2e-5 and abs(tiled[f, v, u] - want[v, u]) < 2e-5 for v, u in cells)
    assert len(dense) == len(tiled) == sum(map(len, images.values()))


def test_entry_without_llm(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries()) and set(SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
