"""Octree files: ``.svo`` (levels of eight-child nodes and leaf masks) and ``.svdag`` words.

A file is one binary record (Spark's ``binaryFile``); nodes come out as rows.  Writers
number the nodes with Spark and stream one level after another to the file.
"""

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from voxlake.functions import morton as m
from voxlake.operators.dag import Dag, running_start
from voxlake.operators.octree import voxels_of_leaves
from voxlake.schema import CHILDREN
from voxlake.storage import stored

# fixed values: the .svo format's magic number, version and empty child
MAGIC, VERSION, EMPTY = 72198382, 2, 0xFFFFFFFF
NODES = "path string, level int, id long, " + ", ".join(f"{c} long" for c in CHILDREN) + ", lo long, hi long"


def _rows(path: str, level: int, nodes: np.ndarray) -> pd.DataFrame:
    kids = np.where(nodes == EMPTY, -1, nodes.astype(np.int64))
    return pd.DataFrame({"path": path, "level": np.int32(level), "id": np.arange(len(nodes))} | {c: kids[:, i] for i, c in enumerate(CHILDREN)} | {"lo": 0, "hi": 0})


def _leaf_rows(path: str, masks: np.ndarray) -> pd.DataFrame:
    none = np.full(len(masks), -1, dtype=np.int64)
    return pd.DataFrame({"path": path, "level": np.int32(2), "id": np.arange(len(masks))} | {c: none for c in CHILDREN} | {"lo": (masks & np.uint64(0xFFFFFFFF)).astype(np.int64), "hi": (masks >> np.uint64(32)).astype(np.int64)})


def parse_svo(path: str, raw: bytes) -> Iterator[pd.DataFrame]:
    magic, version, levels = struct.unpack_from("<IIQ", raw)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError(f"{path} is not a version {VERSION} structure file")
    at = 16
    for level in range(levels):
        (n,) = struct.unpack_from("<Q", raw, at)
        at += 8
        if n:
            yield _rows(path, level, np.frombuffer(raw, "<u4", 8 * n, at).reshape(n, 8))
        at += 32 * n
    (n,) = struct.unpack_from("<Q", raw, at)
    yield _leaf_rows(path, np.frombuffer(raw, "<u8", n, at + 8))


def parse_svdag(path: str, raw: bytes) -> Iterator[pd.DataFrame]:
    """Words to levels: distinct word offsets of a level are its nodes, found level by level."""
    levels, _, _, n = struct.unpack_from("<IIII", raw, 28)
    words = np.frombuffer(raw, "<u4", n, 44)
    at = np.array([0], dtype=np.int64)
    for level in range(levels, 1, -1):
        mask = words[at] & 0xFF
        bits = (mask[:, None] >> np.arange(8)) & 1
        # children stand in falling order of their slot
        place = at[:, None] + np.cumsum(bits[:, ::-1], axis=1)[:, ::-1]
        child = np.where(bits == 1, words[np.minimum(place, n - 1)].astype(np.int64), -1)
        if level == 2:
            masks = np.where(child >= 0, words[np.maximum(child, 0)], 0).astype(np.uint64)
            yield _leaf_rows(path, (masks << (8 * np.arange(8, dtype=np.uint64))).sum(axis=1, dtype=np.uint64))
            return
        below = np.unique(child[child >= 0])
        yield _rows(path, level, np.where(child >= 0, np.searchsorted(below, child), EMPTY))
        at = below


def read_structures(spark: SparkSession, path: str) -> DataFrame:
    """(path, level, id, c0..c7, lo, hi) of .svo and .svdag files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for name, raw in zip(f["path"], f["content"], strict=True):
                yield from (parse_svdag if name.endswith(".svdag") else parse_svo)(name, bytes(raw))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, NODES)


def structure_voxels(nodes: DataFrame, root: int) -> DataFrame:
    """(x, y, z) of one file's nodes: from the root down, a join a level."""
    nodes = stored(nodes, "structure")
    now = nodes.where((F.col("level") == root) & (F.col("id") == 0)).select(F.lit(0).cast("long").alias("key"), *CHILDREN)
    for level in range(root, 2, -1):
        kids = now.select("key", F.posexplode(F.array(*CHILDREN)).alias("slot", "child")).where("child >= 0").select(m.descend("key", "slot").alias("key"), "child")
        here = nodes.where(F.col("level") == level - 1).select(F.col("id").alias("child"), *CHILDREN, "lo", "hi")
        now = kids.join(here, "child")
    return voxels_of_leaves(now.select(F.col("key").alias("tile"), "lo", "hi"))


def _numbered(dag: Dag) -> dict[int, DataFrame]:
    """By level (id, number): gapless numbers in order of id; the root is 0."""
    one = F.lit(1).cast("long").alias("one")
    return {k: stored(running_start(n.select(F.lit(k).alias("level"), "id", one), "level", "id", "one", "number").select("id", "number"), "numbers") for k, n in dag.nodes.items()}


def _numbered_children(dag: Dag, level: int, numbers: dict[int, DataFrame]) -> DataFrame:
    below = numbers[level - 1].select(F.col("id").alias("child"), F.col("number").alias("to"))
    edges = dag.edges(level).join(below, "child").join(numbers[level].select(F.col("id").alias("parent"), "number"), "parent")
    kids = [F.coalesce(F.max(F.when(F.col("slot") == i, F.col("to"))), F.lit(EMPTY)).alias(c) for i, c in enumerate(CHILDREN)]
    return edges.groupBy("number").agg(*kids).orderBy("number")


def write_svo(dag: Dag, path: str) -> int:
    """Write the DAG to a local .svo file; returns its bytes."""
    numbers = _numbered(dag)
    with open(path, "wb") as out:
        out.write(struct.pack("<IIQ", MAGIC, VERSION, dag.root + 1))
        for level in range(dag.root + 1):
            n = numbers[level].count() if level > 2 else 0
            out.write(struct.pack("<Q", n))
            if n:
                for row in _numbered_children(dag, level, numbers).toLocalIterator():
                    out.write(struct.pack("<8I", *row[1:]))
        out.write(struct.pack("<Q", numbers[2].count()))
        for row in dag.nodes[2].join(numbers[2], "id").orderBy("number").select("lo", "hi").toLocalIterator():
            out.write(struct.pack("<II", *row))
        out.write(struct.pack("<III", 1 << dag.root, dag.root, 1))
        return out.tell()


def write_svdag(dag: Dag, path: str, bounds: tuple[tuple, tuple] = ((0, 0, 0), (1, 1, 1))) -> int:
    """Write the DAG as .svdag words; the distinct 2x2x2 masks (255 at most) are the last words."""
    blocks = dag.nodes[2].select("id", *[b.alias(f"c{i}") for i, b in enumerate(m.block_bytes())])
    used = sorted(r[0] for r in blocks.select(F.explode(F.array(*CHILDREN)).alias("b")).where("b > 0").distinct().collect())
    masks = F.create_map(*[F.lit(x) for i, b in enumerate(used) for x in (b, i)]) if used else F.create_map(F.lit(0), F.lit(0))
    leaf_edges = blocks.select(F.col("id").alias("parent"), F.posexplode(F.array(*CHILDREN)).alias("slot", "b")).where("b > 0").select("parent", "slot", F.element_at(masks, F.col("b")).cast("long").alias("to"))
    sizes = {k: stored(running_start((dag.edges(k) if k > 2 else leaf_edges).groupBy(F.col("parent").alias("id")).agg((F.count("*") + 1).alias("n")).withColumn("level", F.lit(k)), "level", "id", "n"), "svdag") for k in range(2, dag.root + 1)}
    base, at, nodes = {}, 0, len(used)
    for k in range(dag.root, 1, -1):
        base[k] = at
        total, count = sizes[k].agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        at, nodes = at + total, nodes + count
    base[1] = at
    lower, upper = bounds
    side = max(b - a for a, b in zip(lower, upper, strict=True))
    with open(path, "wb") as out:
        out.write(struct.pack("<7f4I", *lower, *upper, side, dag.root, nodes, base[1], at + len(used)))
        for k in range(dag.root, 1, -1):
            if k > 2:
                to = sizes[k - 1].select(F.col("id").alias("child"), (F.col("start") + base[k - 1]).alias("to"))
                edges = dag.edges(k).join(to, "child").select("parent", "slot", "to")
            else:
                edges = leaf_edges.withColumn("to", F.col("to") + base[1])
            kids = edges.groupBy("parent").agg(F.sort_array(F.collect_list(F.struct("slot", "to")), asc=False).alias("kids"))
            for row in kids.orderBy("parent").toLocalIterator():
                out.write(struct.pack(f"<{1 + len(row.kids)}I", sum(1 << x.slot for x in row.kids), *(x.to for x in row.kids)))
        out.write(struct.pack(f"<{len(used)}I", *used))
        return out.tell()
