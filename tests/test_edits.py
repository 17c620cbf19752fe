"""Replays and copies against plain Python."""

import math
import random

import numpy as np
import pytest

from voxlake.operators import edits
from voxlake.sources import replay
from voxlake.streaming import edits as streams

R = 32


def voxels(spark, cells):
    return spark.createDataFrame(sorted(cells), "x long, y long, z long")


def cells_of(df):
    return {(r.x, r.y, r.z) for r in df.collect()}


def parsed(spark, lines):
    return replay.parse(spark.createDataFrame(list(enumerate(lines)), "seq long, line string"))


def ball(c, r):
    gap = lambda v, a: max(0, a - v, v - a - 1)
    return {(x, y, z) for x in range(R) for y in range(R) for z in range(R) if sum(gap(v, a) ** 2 for v, a in zip(c, (x, y, z), strict=True)) < r * r}


def cube(c, r):
    return {(x, y, z) for x in range(R) for y in range(R) for z in range(R) if all(a + 1 > v - r and a < v + r for v, a in zip(c, (x, y, z), strict=True))}


@pytest.fixture(scope="module")
def some():
    r = random.Random(3)
    return {tuple(r.randrange(R) for _ in range(3)) for _ in range(1500)}


def test_a_copy_reads_at_the_source_and_writes_about_the_target(spark):
    store = edits.replay(voxels(spark, [(10, 10, 10), (30, 30, 30)]), parsed(spark, ["EditCopy,10,10,10,0,0,0,20,0,0,2"]), 64)
    assert cells_of(store.voxels()) == {(10, 10, 10), (30, 30, 30), (30, 10, 10)}


def test_replay_against_plain_python(spark, some):
    lines = ["EditSphere,10,10,10,5,true,7", "EditCube,20.5,20,9,4,FALSE", "SetLocation,1,2,3", "EditCopy,10,10,10,8,8,8,20,20,20,4", "EndFrame", "EditPaint,10,10,10,3,1,0,0,9", "Undo", "EndFrame", "SetRotation,0,0,0", "Redo"]
    store = edits.replay(voxels(spark, some), parsed(spark, lines), R)
    want = dict.fromkeys(some, 0) | dict.fromkeys(ball((10, 10, 10), 5), 7)
    want = {c: m for c, m in want.items() if c not in cube((20.5, 20, 9), 4)}
    read = {c: tuple(v - 20 + 8 for v in c) for c in cube((22, 22, 22), 4)}
    want |= {c: want[s] for c, s in read.items() if s in want and c not in want}
    assert store.at == 4 and len(store.log) == 4
    assert {(r.x, r.y, r.z): r.material for r in store.voxels(3).collect()} == want
    painted = {c: 9 if c in ball((10, 10, 10), 3) else m for c, m in want.items()}
    assert {(r.x, r.y, r.z): r.material for r in store.voxels().collect()} == painted
    rows = {r.version: (r.changed_leaves, r.changed_materials) for r in store.summary().collect()}
    assert set(rows) == set(range(5)) and rows[4] == (0, sum(painted[c] != want[c] for c in want))
    kept = store.collected()
    assert {(r.x, r.y, r.z): r.material for r in kept.voxels().collect()} == painted and not kept.log


def test_fill_stays_in_its_box(spark):
    wall = {(x, y, z) for x in range(4, 13) for y in range(4, 13) for z in range(4, 13) if 4 in (x, y, z) or 12 in (x, y, z)}
    store = edits.replay(voxels(spark, wall), parsed(spark, ["EditFill,8,8,8,6"]), R)
    assert cells_of(store.voxels()) == {(x, y, z) for x in range(4, 13) for y in range(4, 13) for z in range(4, 13)}
    open_ = edits.replay(voxels(spark, [(0, 0, 0)]), parsed(spark, ["EditFill,1,1,1,2"]), R)
    assert cells_of(open_.voxels()) == {(x, y, z) for x in range(3) for y in range(3) for z in range(3)}


def test_faults_and_unknown_edits_are_refused(spark, some):
    for line in ("EditSphere,1,2,3", "Nope,1", "EditCopy,1,2"):
        with pytest.raises(ValueError, match="fault"):
            edits.replay(voxels(spark, some), parsed(spark, ["EditCube,1,1,1,2,true", line]), R)
    with pytest.raises(ValueError, match="no edit"):
        edits.apply_edit(voxels(spark, some), {"action": "melt"}, R)


@pytest.mark.parametrize(("matrix", "period"), [([0, -2, 0, 2, 0, 0, 0, 0, 2], None), (None, 5.0), ([1, 0, 0, 0, 0.5, 0, 0, 0, 1], 7.0)])
def test_copy_transformed(spark, some, matrix, period):
    source, dest, centre, radius = (10.0, 11.0, 12.0), (18.0, 16.0, 15.0), (11.0, 11.0, 12.0), 4.0
    m = np.array(matrix or np.eye(3), float).reshape(3, 3)
    middle = np.array(dest) + m @ (np.array(centre) - np.array(source))
    want = set(some)
    for c in cube(tuple(middle), radius * np.abs(m.sum(axis=1)).max()):
        d = np.array(c, float) - dest
        if period:
            a = d[1] / period
            d = np.array([d[0] * math.cos(a) - d[2] * math.sin(a), d[1], d[0] * math.sin(a) + d[2] * math.cos(a)])
        s = np.linalg.inv(m) @ d + source
        if (s >= 0).all() and tuple(np.floor(s).astype(int)) in some:
            want.add(c)
    got = cells_of(edits.copy_transformed(voxels(spark, some), source, dest, centre, radius, R, matrix, period))
    assert len(want) > len(some) and got == want


def test_noise_is_a_share_of_the_ball(spark, some):
    v = voxels(spark, some)
    a, b = (cells_of(edits.noise_sphere(df, (16, 16, 16), 8, R, seed=5)) for df in (v, v.repartition(7)))
    added = a - some
    inside = cells_of(edits.sphere_voxels(spark, (16, 16, 16), 8, R)) - some
    assert a == b and added < inside and 0.4 < len(added) / len(inside) < 0.6


def test_edit_log_as_a_stream(spark, some, tmp_path):
    log, states = tmp_path / "log", tmp_path / "states"
    log.mkdir()
    schema = "seq long, line string"
    wall = voxels(spark, some)
    for batch, lines in enumerate((["EditSphere,10,10,10,5,true,7"], ["EditCube,20,20,9,4,false"], ["EditPaint,10,10,10,3,1,0,0,9"])):
        spark.createDataFrame([(batch * 10 + i, x) for i, x in enumerate(lines)], schema).coalesce(1).write.mode("append").json(str(log))
        stream = spark.readStream.schema(schema).json(str(log))
        # a query begun anew from its checkpoint each time, as after a failure
        query = streams.follow(stream, wall, R, str(states), str(tmp_path / "checkpoint"), replay.parse)
        query.processAllAvailable()
        query.stop()
    want = dict.fromkeys(some, 0) | dict.fromkeys(ball((10, 10, 10), 5), 7)
    want = {c: 9 if c in ball((10, 10, 10), 3) else m for c, m in want.items() if c not in cube((20, 20, 9), 4)}
    assert {(r.x, r.y, r.z): r.material for r in streams.newest(spark, str(states)).collect()} == want


def test_streaming_leaves_and_activity(spark, some, tmp_path):
    from pyspark.sql import functions as F

    spark.createDataFrame(sorted(some), "x long, y long, z long").repartition(3).write.parquet(str(tmp_path / "v"))
    stream = spark.readStream.schema("x long, y long, z long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "v"))
    query = streams.streaming_leaves(stream).writeStream.outputMode("complete").format("memory").queryName("leaf_stream").start()
    query.processAllAvailable()
    query.stop()
    bits = spark.table("leaf_stream").select(F.sum(F.bit_count("lo") + F.bit_count("hi"))).first()[0]
    assert bits == len(some)
    times = spark.createDataFrame([(i, "sphere" if i % 3 else "box") for i in range(40)], "m int, action string").select(F.timestamp_seconds(F.col("m") * 60).alias("ts"), "action")
    times.coalesce(1).write.parquet(str(tmp_path / "t"))
    query = streams.windowed_activity(spark.readStream.schema(times.schema).parquet(str(tmp_path / "t"))).writeStream.outputMode("complete").format("memory").queryName("activity").start()
    query.processAllAvailable()
    query.stop()
    assert sum(r.n for r in spark.table("activity").collect()) == 40
