"""A replay deals its sets out: none is collected on the driver for a broadcast, whatever its files' size."""

from voxlake.operators import edits
from voxlake.sources import replay

LINES = ["EditSphere,10,10,10,5,true,7", "EditCube,20,20,9,4,false", "Undo", "Redo", "EditCopy,10,10,10,8,8,8,20,20,20,4", "EditPaint,10,10,10,3,1,0,0,9", "EditFill,25,25,25,3"]


def test_no_join_of_a_replay_broadcasts_a_set(spark, monkeypatch):
    plans, kept = [], edits.stored

    def recorded(df, name, *rest):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return kept(df, name, *rest)

    monkeypatch.setattr(edits, "stored", recorded)
    cells = [(i * 7 % 32, i * 11 % 32, i * 13 % 32) for i in range(400)]
    log = replay.parse(spark.createDataFrame(list(enumerate(LINES)), "seq long, line string"))
    store = edits.replay(spark.createDataFrame(cells, "x long, y long, z long").distinct(), log, 32)
    plans.append(("state", store.voxels()._jdf.queryExecution().executedPlan().toString()))
    assert {"replay", "version", "version-materials", "free", "reached", "state"} <= {name for name, _ in plans}
    assert [name for name, plan in plans if "BroadcastHashJoin" in plan] == []
    assert sum("SortMergeJoin" in plan for _, plan in plans) > 5
