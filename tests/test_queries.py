"""A few registered queries against their SQL, and the contract's shape."""

import duckdb
import pytest

import __spark_entry__

SMALL = "/root/testdata/sf0.001"


def test_contract():
    names = set(__spark_entry__.queries())
    assert names and set(__spark_entry__.oracle_sql()) <= names


@pytest.mark.parametrize("name", ["voxel_scan", "leaf_masks", "dag_levels", "member_lookup", "exposed_faces_6", "ray_first_hit", "rle_blocks", "undo_redo"])
def test_against_sql(spark, name):
    got = __spark_entry__.queries()[name](spark, SMALL).toPandas()
    con = duckdb.connect()
    for table in ("lineitem", "events", "supplier"):
        con.sql(f"create view {table} as select * from '{SMALL}/{table}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda f: sorted(map(tuple, f[columns].astype(object).values.tolist()))
    assert rows(got) == rows(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
