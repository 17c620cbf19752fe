"""Frames of a camera, dealt out so finely that some tasks hold only rays that miss the grid, against their SQL."""

import duckdb
import pytest

import __spark_entry__
from voxlake.operators import rays

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def dealt_finely(monkeypatch):
    made = rays.camera_rays
    monkeypatch.setattr(rays, "camera_rays", lambda *a, **k: made(*a, **k).repartitionByRange(24, "ray_id"))


@pytest.mark.parametrize("name", ["ambient_occlusion", "path_traced_frame", "surface_colors", "camera_first_hits", "shaded_frame", "tool_overlay"])
def test_tasks_without_a_ray_in_the_grid(spark, dealt_finely, name):
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    con.sql(f"create view supplier as select * from '{SMALL}/supplier.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[columns].astype(object).values.tolist()))
    assert len(got) and rows(got) == rows(want)
