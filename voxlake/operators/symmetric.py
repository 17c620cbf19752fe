"""DAGs up to symmetry: nodes equal under mirrors and axis orders share one canonical node.

Every distinct node tries the transforms of the group: slots permute, each child
reference (canonical id, transform) becomes (id, least transform of the child's
stabiliser coset), and the least such tuple is the node's key.  Equal keys are one
class, so one grouping replaces a probe of every transform against a table.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.functions import symmetries as s
from voxlake.functions.morton import block_bytes
from voxlake.operators.dag import Dag
from voxlake.storage import stored

#: Transforms of a study, by name.
GROUPS = {"identity": [0], "mirror": list(range(8)), "axes": [8 * i for i in range(6)], "all": list(range(48))}


def mask_classes(spark: SparkSession) -> DataFrame:
    """(mask, canonical, stabiliser) of all 2x2x2 masks under the 48 transforms."""
    return spark.createDataFrame(s.canonical_masks(), "mask int, canonical int, stabiliser int")


def class_counts(spark: SparkSession) -> DataFrame:
    """(study, classes) of 2x2x2 masks: mirrors, axis orders, all 48, and all 8! slot orders."""
    rows = [(n, len({c for _, c, _ in s.canonical_masks(g)})) for n, g in GROUPS.items()]
    return spark.createDataFrame([*rows, ("slots", len({bin(x).count("1") for x in range(256)}))], "study string, classes int")


def _halves(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return lo.astype(np.uint64) | hi.astype(np.uint64) << np.uint64(32)


def canonical_leaves(leaf: DataFrame, group: list[int]) -> DataFrame:
    """(id, lo, hi) to (id, key, g, stabiliser): least image of the mask, the transform from it, and what fixes it."""
    images = s.leaf_bits()[group].astype(np.uint64)
    inverse = s.inverses()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            masks = _halves(f.lo.to_numpy(), f.hi.to_numpy())
            bits = (masks[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            every = np.stack([(bits << im).sum(axis=1, dtype=np.uint64) for im in images], axis=1) if len(f) else np.zeros((0, len(group)), np.uint64)
            best = every.argmin(axis=1) if len(f) else np.zeros(0, int)
            key = every[np.arange(len(f)), best]
            # transforms h with h(key) = key, as a bit set of 48
            again = (key[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            fixed = np.zeros(len(f), dtype=np.int64)
            for g, im in zip(group, images, strict=True):
                fixed |= ((again << im).sum(axis=1, dtype=np.uint64) == key).astype(np.int64) << g
            yield pd.DataFrame({"id": f["id"], "key": [f"{k:016x}" for k in key.tolist()], "g": inverse[np.array(group)[best]] if len(f) else [], "stabiliser": fixed})

    return leaf.select("id", "lo", "hi").mapInPandas(run, "id long, key string, g int, stabiliser long")


def canonical_nodes(nodes: DataFrame, group: list[int]) -> DataFrame:
    """(id, kids array<struct<cid, g, stabiliser>>) to (id, key, g, stabiliser), as ``canonical_leaves``."""
    slots, compose, inverse = s.slots(), s.composed(), s.inverses()

    def least(u: int, fixed: int) -> int:
        return min(int(compose[u][h]) for h in group if fixed >> h & 1)

    cache: dict[tuple[int, int], int] = {}

    def rep(u: int, fixed: int) -> int:
        if (u, fixed) not in cache:
            cache[u, fixed] = least(u, fixed)
        return cache[u, fixed]

    def image(kids: list[tuple], h: int) -> tuple:
        out = [(-1, 0)] * 8
        for i, (cid, g, fixed) in enumerate(kids):
            if cid >= 0:
                out[slots[h][i]] = (cid, rep(int(compose[h][g]), fixed))
        return tuple(out)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for node, kids in zip(f["id"], f["kids"], strict=True):
                kids = [(k["cid"], k["g"], k["stabiliser"]) for k in kids]
                images = {h: image(kids, h) for h in group}
                h = min(group, key=lambda g: (images[g], g))
                key = images[h]
                fixed = sum(1 << int(compose[g][inverse[h]]) for g in group if images[g] == key)
                rows.append((node, "|".join(f"{c}.{g}" for c, g in key), int(inverse[h]), fixed))
            yield pd.DataFrame(rows, columns=["id", "key", "g", "stabiliser"])

    return nodes.mapInPandas(run, "id long, key string, g int, stabiliser long")


def conjugated(fixed: str, g: str) -> Column:
    """The bit set of g s g^-1 for s in a bit set of transforms."""

    @F.pandas_udf("long")
    def run(bits: pd.Series, by: pd.Series) -> pd.Series:
        compose, inverse = s.composed(), s.inverses()
        known: dict[tuple[int, int], int] = {}

        def one(b: int, h: int) -> int:
            if (b, h) not in known:
                known[b, h] = sum(1 << int(compose[h][compose[x][inverse[h]]]) for x in range(s.N) if b >> x & 1)
            return known[b, h]

        return pd.Series([one(b, h) for b, h in zip(bits.tolist(), by.tolist(), strict=True)], dtype="int64")

    return run(fixed, g)


class SymmetricDag:
    """``classes[level]``: (id, cid, g, stabiliser): node id = g applied to node cid, which ``stabiliser`` fixes.

    Keys are turned to the class's least node: g is relative to it.
    """

    def __init__(self, dag: Dag, group: list[int]):
        self.dag, self.group = dag, group
        self.classes: dict[int, DataFrame] = {}
        for level in range(2, dag.root + 1):
            if level == 2:
                keyed = canonical_leaves(dag.nodes[2], group)
            else:
                below = self.classes[level - 1].select(F.col("id").alias("child"), "cid", "g", "stabiliser")
                kids = dag.edges(level).join(below, "child").groupBy("parent").agg(
                    F.map_from_entries(F.collect_list(F.struct("slot", F.struct("cid", "g", "stabiliser")))).alias("kids")
                )
                none = F.struct(F.lit(-1).cast("long").alias("cid"), F.lit(0).alias("g"), F.lit(0).cast("long").alias("stabiliser"))
                each = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.coalesce(F.try_element_at("kids", i), none))
                keyed = canonical_nodes(kids.select(F.col("parent").alias("id"), each.alias("kids")), group)
            keyed = stored(keyed, "canonical")
            first = keyed.groupBy("key").agg(F.min_by(F.struct("id", "g", "stabiliser"), "id").alias("rep"))
            first = first.select("key", F.col("rep.id").alias("cid"), F.col("rep.g").alias("h"), conjugated("rep.stabiliser", "rep.g").alias("stabiliser"))
            relative = s.compose(F.col("g"), s.invert(F.col("h"))).alias("g")
            self.classes[level] = stored(keyed.drop("stabiliser").join(first, "key").select("id", "cid", relative, "stabiliser"), "classes")

    def counts(self) -> DataFrame:
        """(level, dag_nodes, classes)."""
        out = None
        for level, c in self.classes.items():
            row = c.agg(F.count("*").alias("dag_nodes"), F.sum(F.when(F.col("id") == F.col("cid"), 1).otherwise(0)).alias("classes")).select(F.lit(level).alias("level"), "dag_nodes", "classes")
            out = row if out is None else out.unionByName(row)
        return out

    def edges(self, level: int) -> DataFrame:
        """(parent, slot, child, g) of the canonical nodes of ``level``: child and its transform."""
        kept = self.classes[level].where("id = cid").select(F.col("id").alias("parent"))
        below = self.classes[level - 1].select(F.col("id").alias("child"), F.col("cid"), F.col("g"))
        return self.dag.edges(level).join(kept, "parent", "left_semi").join(below, "child").select("parent", "slot", F.col("cid").alias("child"), "g")


def slot_order_classes(dag: Dag) -> DataFrame:
    """(level, classes) when children may stand in any of 8! orders: a node is the bag of its children's classes."""
    leaf = dag.nodes[2].select("id", F.concat_ws(",", F.sort_array(F.transform(F.array(*block_bytes()), F.bit_count))).alias("key"))
    out, now = None, leaf
    for level in range(2, dag.root + 1):
        if level > 2:
            below = now.select(F.col("id").alias("child"), "cid")
            bag = dag.edges(level).join(below, "child").groupBy("parent").agg(F.concat_ws(",", F.sort_array(F.collect_list("cid"))).alias("key"))
            now = bag.select(F.col("parent").alias("id"), "key")
        first = now.groupBy("key").agg(F.min("id").alias("cid"))
        now = stored(now.join(first, "key").select("id", "cid"), "slot-classes")
        row = now.agg(F.count_distinct("cid").alias("classes")).select(F.lit(level).alias("level"), "classes")
        out = row if out is None else out.unionByName(row)
    return out
