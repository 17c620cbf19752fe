"""The cost of an optimal code, also where rare symbols need more bits than the code tables allow."""

import duckdb

import __spark_entry__
from voxlake.functions import huffman


def answers(spark, at, rows):
    """The query's row and the SQL's over a lineitem of these cells."""
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    got = __spark_entry__.queries()["huffman_cost"](spark, str(at)).select("symbols", "bits").first()
    con = duckdb.connect()
    con.sql(f"create view lineitem as select * from '{at}/lineitem.parquet/*.parquet'")
    return tuple(got), con.sql(f"select symbols, bits from ({__spark_entry__.oracle_sql()['huffman_cost']})").fetchall()[0]


def test_codes_longer_than_the_limit(spark, tmp_path):
    counts = [1, 1]
    while len(counts) < 20:
        counts.append(counts[-1] + counts[-2])
    cells, tile = [], 0
    for symbol, n in enumerate(counts, 1):  # leaves with a voxel in each block that the symbol's bits name
        for tile in range(tile, tile + n):
            corner = [tile % 64 * 4, tile // 64 % 64 * 4, tile // 4096 * 4]
            cells += [tuple(c + 2 * (b >> a & 1) for a, c in enumerate(corner)) for b in range(8) if symbol >> b & 1]
        tile += 1
    assert max(huffman.code_lengths(counts)) > 16
    got, want = answers(spark, tmp_path, cells)
    assert got == want and got == (20, sum(n * k for n, k in zip(counts, huffman.code_lengths(counts), strict=True)))


def test_one_symbol_and_none(spark, tmp_path):
    got, want = answers(spark, tmp_path / "one", [(0, 0, 0), (8, 0, 0), (16, 4, 0)])
    assert got == want == (1, 3)
    got, want = answers(spark, tmp_path / "none", [])
    assert got == want == (0, 0)
