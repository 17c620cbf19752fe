"""Queries take every row of their tables: brute force over a fixture with ids of any size."""

import random

import numpy as np
import pytest

import __spark_entry__
from voxlake.plans import catalog_more
from voxlake.plans.catalog import R

EVENTS = [*range(10), *range(490, 520), *range(3990, 4020), 99_999, 250_000]
SUPPLIERS = [*range(1, 60), 977]


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """(folder, voxels) of a small lineitem, events and supplier."""
    at, r = tmp_path_factory.mktemp("whole"), random.Random(5)
    near = [(e % R + r.randrange(5), e * 7 % R + r.randrange(5), e * 13 % 100 + r.randrange(5)) for e in EVENTS[::2]]
    under = [(e * 3 % R, e * 11 % R, r.randrange(R)) for e in EVENTS[::3] for _ in range(3)]
    lines = near + under + [tuple(r.randrange(2000) for _ in range(3)) for _ in range(2000)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{at}/lineitem.parquet")
    spark.createDataFrame([(e,) for e in EVENTS], "event_id long").write.parquet(f"{at}/events.parquet")
    spark.createDataFrame([(s,) for s in SUPPLIERS], "s_suppkey long").write.parquet(f"{at}/supplier.parquet")
    return str(at), {tuple(v % R for v in line) for line in lines}


def rows(spark, made, name):
    return __spark_entry__.queries()[name](spark, made[0]).collect()


def test_every_event_is_a_box(spark, made):
    want = {}
    for e in EVENTS:
        low = (e % R, e * 7 % R, e * 13 % 100)
        want[e] = not any(all(a <= c < a + 5 for a, c in zip(low, v, strict=True)) for v in made[1])
    assert len(set(want.values())) == 2
    got = rows(spark, made, "region_empty")
    assert len(got) == len(EVENTS) and {g.box_id: g.is_empty for g in got} == want


def test_every_event_is_a_ray(spark, made):
    column = {}
    for x, y, z in made[1]:
        column[x, y] = min(z, column.get((x, y), R))
    want = {e: column.get((e * 3 % R, e * 11 % R)) for e in EVENTS}
    assert {z is None for z in want.values()} == {True, False}
    hits = {e: (e * 3 % R, e * 11 % R, z) for e, z in want.items() if z is not None}
    first = rows(spark, made, "ray_first_hit")
    assert len(first) == len(hits) and {h.ray_id: (h.x, h.y, h.z) for h in first} == hits
    assert all(h.axis == 2 and h.t == h.z + 10 for h in first)
    seen = rows(spark, made, "ray_any_hit")
    assert len(seen) == len(EVENTS) and {h.ray_id: h.hit for h in seen} == {e: e in hits for e in EVENTS}
    picked = rows(spark, made, "ray_pick")
    assert len(picked) == len(hits) and {h.ray_id: (h.x, h.y, h.z, h.ax, h.ay, h.az) for h in picked} == {e: (x, y, z, x, y, z - 1) for e, (x, y, z) in hits.items()}


def test_every_supplier_is_a_mesh(spark, made):
    meshes = catalog_more.triangles(spark, made[0]).groupBy("mesh").count().collect()
    assert {m["mesh"]: m["count"] for m in meshes} == dict.fromkeys(SUPPLIERS, 8)
    middle = np.stack(np.meshgrid(*[np.arange(64) + 0.5] * 3, indexing="ij"))
    odd = np.zeros((64, 64, 64), dtype=bool)
    for s in SUPPLIERS:
        centre = np.array([s * k % 48 + 8.25 for k in (7, 13, 29)])[:, None, None, None]
        odd ^= np.abs(middle - centre).sum(axis=0) < s % 5 + 2.6
    got = [(v.x, v.y, v.z) for v in rows(spark, made, "solid_fill")]
    assert len(got) == odd.sum() and set(got) == {tuple(c) for c in np.argwhere(odd).tolist()}
