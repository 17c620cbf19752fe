"""Transform DAGs, their 16-bit words, ranks, and the smaller helpers against plain Python."""

import random
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from voxlake.functions import bounds, hashes
from voxlake.functions import symmetries as s
from voxlake.operators import attributes, dag as dags, encode, octree, recorder, symmetric, transform, transform16, translation, voxelize

DEPTH = 4


def cells_of(df):
    return sorted((r.x, r.y, r.z) for r in df.collect())


@pytest.fixture(scope="module")
def scene(spark):
    """Copies of a shape, shifted, mirrored and cropped by cube borders, and loose voxels."""
    r = random.Random(8)
    shape = [tuple(r.randrange(6) for _ in range(3)) for _ in range(40)]
    cells = set()
    for _ in range(8):
        at, flip = [r.randrange(11) for _ in range(3)], [r.random() < 0.4 for _ in range(3)]
        for p in shape:
            q = tuple(a + (5 - v if f else v) for a, v, f in zip(at, p, flip, strict=True))
            if max(q) < 16:
                cells.add(q)
    cells |= {tuple(r.randrange(16) for _ in range(3)) for _ in range(30)}
    dag = dags.Dag(spark.createDataFrame(sorted(cells), "x long, y long, z long"), DEPTH)
    return sorted(cells), dag


@pytest.fixture(scope="module")
def built(scene):
    return transform.TransformDag(symmetric.SymmetricDag(scene[1], symmetric.GROUPS["all"]), symmetric.GROUPS["mirror"])


def test_translated_round_trip(scene, built):
    assert cells_of(built.voxels()) == scene[0]
    rows = {r.level: r for r in built.counts().collect()}
    assert sum(r.shifted for r in rows.values()) > 0
    assert all(rows[k].nodes <= scene[1].nodes[k].count() for k in rows)


def test_words_round_trip(spark, scene, built, tmp_path):
    made = transform16.Transform16.of(built)
    made.write(str(tmp_path / "t16"))
    back = transform16.Transform16.read(spark, str(tmp_path / "t16"))
    assert cells_of(back.voxels()) == scene[0]
    r = random.Random(2)
    asked = sorted(set(scene[0][::5]) | {tuple(r.randrange(-1, 18) for _ in range(3)) for _ in range(200)})
    queries = spark.createDataFrame(asked, "x int, y int, z int")
    for found in (built.members(queries), back.members(queries)):
        assert {(q.x, q.y, q.z): q.found for q in found.collect()} == {q: q in set(scene[0]) for q in asked}
    sizes = {x.level: x for x in made.sizes().collect()}
    words = {x.level: x for x in made.nodes.groupBy("level").agg(F.sum(F.size("words")).alias("n"), F.count("*").alias("k")).collect()}
    assert all(sizes[k].node_words == words[k].n and sizes[k].nodes == words[k].k for k in words)
    for k in range(3, DEPTH + 1):
        rows = made.nodes.where(F.col("level") == k).orderBy("start").collect()
        assert [x.start for x in rows] == np.concatenate(([0], np.cumsum([len(x.words) for x in rows])[:-1])).tolist()


def test_table_decisions_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(transform16, "NEAR_SLOTS", 40)
    r = random.Random(1)
    rows = [(i, r.randrange(48), 0, 0, 0, r.choice([1, 2, 3, 4, 5, 6, 9, 30]), 1, r.choice([2, 2, 3, 3, 4])) for i in range(400)]
    table = spark.createDataFrame(rows, "child long, g int, tx int, ty int, tz int, refs long, pointer long, words int")
    got = {x.child: (x.slot, x.stored_words) for x in transform16.table_decisions(table).collect()}
    want, slots = {}, 0
    for child, *_, refs, _, words in sorted(rows, key=lambda x: (-x[5], x[0], x[1])):
        cost = 1 if slots < 40 else 2
        if words > 3 or refs * cost + 4 < refs * words:
            want[child], slots = (slots, cost), slots + 1
        else:
            want[child] = (None, words)
    assert slots > 40 and got == want


@pytest.mark.parametrize(("side", "group"), [(4, list(range(48))), (8, [0])])
def test_best_parents_by_brute_force(spark, side, group):
    r = np.random.default_rng(side)
    grids = [r.random((side,) * 3) < p for p in (0.02, 0.05, 0.1, 0.3) for _ in range(5)]
    for _ in range(12):
        base = translation.transformed_grid(grids[int(r.integers(5, 20))], int(r.choice(group)))
        grids.append(translation.shifted_grid(base, tuple(int(v) for v in r.integers(-side // 2, side // 2 + 1, 3))))
    distinct = {translation.packed(g): g for g in grids if g.any()}
    items = list(distinct.items())
    table = spark.createDataFrame([(i, side, bytearray(c)) for i, (c, _) in enumerate(items)], "id long, side int, cells binary")
    got = {x.child: tuple(x)[1:] for x in translation.best_parents(table, side, group).collect()}
    span = range(-side + 1, side)
    want = {}
    for i, (_, p) in enumerate(items):
        for g in group:
            turned = translation.transformed_grid(p, g)
            for t in ((x, y, z) for x in span for y in span for z in span):
                child = translation.packed(translation.shifted_grid(turned, t))
                if child in distinct:
                    key = (-int(p.sum()), i, sum(map(abs, t)), g, *t)
                    want[child] = min(want.get(child, key), key)
    assert got == {i: (want[c][1], want[c][3], *want[c][4:]) for i, (c, _) in enumerate(items)}
    assert any(v[0] != k for k, v in got.items())


def test_turned_shifts(spark):
    grid = np.zeros((8, 8, 8), dtype=bool)
    grid[3, 4, 2] = grid[4, 4, 5] = True
    rows = spark.createDataFrame([(g,) for g in range(48)], "g int").withColumns({"a": F.lit(1), "b": F.lit(-2), "c": F.lit(2)})
    for x in rows.select("g", *[t.alias(n) for t, n in zip(transform.turned(F.col("g"), [F.col("a"), F.col("b"), F.col("c")]), "xyz", strict=True)]).collect():
        first = translation.transformed_grid(translation.shifted_grid(grid, (1, -2, 2)), x.g)
        assert (first == translation.shifted_grid(translation.transformed_grid(grid, x.g), (x.x, x.y, x.z))).all()
    assert s.N == 48


def test_ranked(spark):
    r = random.Random(3)
    rows = [(r.randrange(3), r.randrange(50), i) for i in range(500)]
    got = {(x.g, x.v, x.i): x["rank"] for x in dags.ranked(spark.createDataFrame(rows, "g int, v int, i int"), "g", [F.desc("v"), F.asc("i")]).collect()}
    for g in range(3):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))
        assert [got[x] for x in own] == list(range(len(own)))


def test_garbage_and_words(scene, spark):
    cells, dag = scene
    assert dag.garbage(dag.nodes[DEPTH], DEPTH).count() == 0
    assert dag.garbage(dag.nodes[DEPTH].limit(0), DEPTH).count() == sum(dag.nodes[k].count() for k in dag.nodes)
    queries = spark.createDataFrame(cells[::7] + [(0, 15, 0), (40, 1, 1)], "x int, y int, z int")
    words = encode.no_transform16(dag)
    assert {(q.x, q.y, q.z): q.found for q in encode.members16(words, queries, DEPTH).collect()} == {(q.x, q.y, q.z): (q.x, q.y, q.z) in set(cells) for q in queries.collect()}


def test_attributes(spark, scene):
    cells = scene[0]
    rows = [(*c, (c[0] * 7 + c[2]) % 5) for c in cells]
    v = spark.createDataFrame(rows, "x long, y long, z long, material int")
    leaves = attributes.packed(v)
    assert sorted(map(tuple, attributes.unpacked(leaves).collect())) == rows
    asked = spark.createDataFrame([(1, 2, 3), (31, 31, 31), *cells[:20]], "x long, y long, z long")
    held = {r[:3]: r[3] for r in rows}
    assert all(q.material == held.get((q.x, q.y, q.z)) for q in attributes.looked_up(asked, leaves).collect())
    assert cells_of(octree.voxels_of_leaves(attributes.binarised(leaves, lambda x: x > 2))) == [r[:3] for r in rows if r[3] > 2]
    assert cells_of(octree.voxels_of_leaves(attributes.stripped(leaves))) == cells
    assert sum(r.uses for r in attributes.deduplicated(leaves).collect()) == leaves.count()
    for mode in attributes.DEBUG_MODES:
        assert attributes.debug_colors(v, mode, 32).where("color between 0 and 16777215").count() == len(cells)


def test_hashes(spark):
    def fmix(h):
        h = (h ^ h >> 16) * 0x85EBCA6B & 0xFFFFFFFF
        h = (h ^ h >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
        return h ^ h >> 16

    values = [0, 1, 2, 0xFFFFFFFF, 123456789, 0x80000000]
    rows = spark.createDataFrame([(v,) for v in values], "v long")
    assert [r.h for r in rows.select(hashes.finalized(F.col("v")).alias("h")).collect()] == [fmix(v) for v in values]
    a, b = (rows.repartition(n).agg(*hashes.checksum(F.col("v"), F.col("v") + 1)).first() for n in (1, 4))
    assert a == b and a.n == len(values)


def test_bounds(spark):
    r = np.random.default_rng(0)
    p = np.sort(r.normal(size=(50, 2, 3)), axis=1)
    q = np.sort(r.normal(size=(50, 2, 3)), axis=1)
    m = r.normal(size=(3, 4))
    rows = [(i, *map(float, a.ravel()), *map(float, b.ravel())) for i, (a, b) in enumerate(zip(p, q, strict=True))]
    columns = [f"{k}{a}{e}" for k in "pq" for e in (0, 1) for a in "xyz"]
    table = spark.createDataFrame(rows, "i int, " + ", ".join(f"{c} double" for c in columns))
    got = table.select("i", bounds.overlap("p", "q").alias("o"), bounds.contains("p", "q").alias("c"), bounds.area("p").alias("area"), F.struct(*bounds.union("p", "q")).alias("u"), F.struct(*bounds.transformed(m.tolist(), "p")).alias("t"), F.struct(*bounds.intersection("p", "q")).alias("n")).collect()
    for x in got:
        a, b = p[x.i], q[x.i]
        assert x.o == bool(((a[0] < b[1]) & (b[0] < a[1])).all()) and x.c == bool(((a[0] <= b[0]) & (b[1] <= a[1])).all())
        e = a[1] - a[0]
        assert abs(x.area - 2 * (e[0] * e[1] + e[1] * e[2] + e[2] * e[0])) < 1e-9
        corners = np.array([[a[i][0], a[j][1], a[k][2]] for i in (0, 1) for j in (0, 1) for k in (0, 1)]) @ m[:, :3].T + m[:, 3]
        assert np.allclose([x.t.x0, x.t.y0, x.t.z0, x.t.x1, x.t.y1, x.t.z1], [*corners.min(axis=0), *corners.max(axis=0)])
        assert np.allclose([x.u.x0, x.u.z1], [min(a[0][0], b[0][0]), max(a[1][2], b[1][2])]) and x.n.x1 >= x.n.x0


def test_recorder(spark, tmp_path):
    made = recorder.Recorder(spark)
    for i in range(4):
        made.report("edit", i + 1)
        if i % 2:
            made.report("merge", 10)
        made.next_frame()
    sums = {r.name: r for r in recorder.summed(made.table()).collect()}
    assert (sums["edit"].total, sums["edit"].n, sums["merge"].average) == (10.0, 4, 10.0)
    recorder.write_csv(made.table(), ["edit", "merge"], str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv")).orderBy("frame").collect()
    assert [(r.frame, r.edit, r.merge) for r in back] == [("0", "1.0", None), ("1", "2.0", "10.0"), ("2", "3.0", None), ("3", "4.0", "10.0")]
    recorder.write_json(made.table(), str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 6


def test_two_passes_find_the_same_voxels(spark):
    r = np.random.default_rng(7)
    rows = [tuple(map(float, t)) for t in r.uniform(0, 64, size=(30, 9))]
    table = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in voxelize.CORNERS))
    one, two = (Counter(map(tuple, voxelize.surface(table, 64, two_pass=t).collect())) for t in (False, True))
    assert one == two
