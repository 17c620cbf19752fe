"""The three end-to-end plans: voxelize and compress, encode with statistics, replay."""

from pyspark.sql import DataFrame, functions as F

from voxlake.operators import edits, encode, voxelize
from voxlake.operators.dag import Dag
from voxlake.operators.symmetric import GROUPS, SymmetricDag
from voxlake.operators.transform import TransformDag
from voxlake.operators.transform16 import Transform16


def voxelized(triangles: DataFrame, depth: int, solid: bool = False, conservative: bool = True) -> Dag:
    """A mesh's DAG at 2^depth a side."""
    fitted = voxelize.normalised(triangles, 1 << depth)
    return Dag(voxelize.solid(fitted, 1 << depth) if solid else voxelize.surface(fitted, 1 << depth, conservative), depth)


def encoded_report(dag: Dag, group: str = "all") -> DataFrame:
    """(form, level, bytes): sizes of the tree, the DAG, the symmetric DAG and the transform DAG in 16-bit words."""
    sym = SymmetricDag(dag, GROUPS[group])
    forms = (("svo32", encode.svo32_sizes(dag)), ("svdag32", encode.svdag32_sizes(dag)), ("ssvdag32", encode.ssvdag32_sizes(sym)), ("transform16", Transform16.of(TransformDag(sym)).sizes()))
    out = None
    for name, sizes in forms:
        rows = sizes.select(F.lit(name).alias("form"), "level", "bytes")
        out = rows if out is None else out.unionByName(rows)
    return out


def write_statistics(report: DataFrame, path: str) -> None:
    """The report as one JSON lines folder."""
    report.coalesce(1).write.mode("overwrite").json(path)


def replayed(voxels: DataFrame, log: DataFrame, resolution: int) -> DataFrame:
    """(version, changed_leaves, changed_materials) of a replay."""
    return edits.replay(voxels, log, resolution).summary()
