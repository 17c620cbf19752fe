"""Transform DAGs: canonical nodes whose pointers carry a mirror, an axis order and a shift.

The symmetric classes come first.  Then, from the root down, the nodes of levels up to
``MOST_LEVEL`` that are still referenced are flattened to grids, a node that is a crop of
another's shifted grid gives way to it, and what only it referred to is referenced no
more, so that it is not there when the level below is searched.

A pointer (child, g, tx, ty, tz) stands for the child's content under transform g, then
shifted, then cropped to the child's cube.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions import morton as m
from voxlake.functions import symmetries as s
from voxlake.operators import translation
from voxlake.operators.symmetric import SymmetricDag
from voxlake.storage import discard, stored

MOST_LEVEL = 4
POINTER = ["child", "g", "tx", "ty", "tz"]


def turned(g: Column, t: list[Column]) -> list[Column]:
    """A shift under the linear part of a transform."""
    axis = lambda i: F.element_at(F.array(*[F.lit(s.ORDERS[k >> 3][i]) for k in range(s.N)]), (g + 1).cast("int"))
    part = lambda i: F.element_at(F.array(*t), (axis(i) + 1).cast("int"))
    return [F.when(F.shiftright(g, i).bitwiseAND(F.lit(1)) == 1, -part(i)).otherwise(part(i)) for i in range(3)]


class TransformDag:
    """``edges[level]``: (parent, slot, child, g, tx, ty, tz) of the nodes that are left; level is the parent's.

    ``leaves``: (id, lo, hi) of the leaves that are left; ``root``: (child, g), the root's pointer.
    """

    def __init__(self, sym: SymmetricDag, group: list[int] | None = None, most_level: int = MOST_LEVEL):
        self.depth = sym.dag.root
        self.root = sym.classes[self.depth].select(F.col("cid").alias("child"), "g")
        self.edges: dict[int, DataFrame] = {}
        kept = self.root.select(F.col("child").alias("id"))
        zero = [F.lit(0).alias(t) for t in ("tx", "ty", "tz")]
        for level in range(self.depth, 2, -1):
            edges = sym.edges(level).join(kept, F.col("parent") == F.col("id"), "left_semi").select("parent", "slot", "child", "g", *zero)
            if level - 1 <= most_level:
                edges = stored(edges, "untranslated")
                used = edges.select(F.col("child").alias("id")).distinct()
                grids = translation.flattened(sym.dag, level - 1).join(used, "id", "left_semi")
                best = translation.best_parents(grids, 1 << (level - 1), group or [0])
                moved = stored(translation.mapping(stored(best, "best")), "mapping").withColumnsRenamed({"g": "mg", "tx": "mx", "ty": "my", "tz": "mz"})
                shift = turned(F.col("g"), [F.col("mx"), F.col("my"), F.col("mz")])
                both = edges.join(moved, "child")
                after = both.select("parent", "slot", F.col("target").alias("child"), s.compose(F.col("g"), F.col("mg")).cast("int").alias("g"), *[t.cast("int").alias(n) for t, n in zip(shift, ("tx", "ty", "tz"), strict=True)])
                self.edges[level] = stored(after, "edges")
                discard(edges)
            else:
                self.edges[level] = stored(edges, "edges")
            kept = self.edges[level].select(F.col("child").alias("id")).distinct()
        self.leaves = stored(sym.dag.nodes[2].join(kept, "id", "left_semi").select("id", "lo", "hi"), "leaves")

    def all_edges(self) -> DataFrame:
        return reduce(DataFrame.unionByName, (e.withColumn("level", F.lit(k)) for k, e in self.edges.items()))

    def counts(self) -> DataFrame:
        """(level, nodes, shifted): nodes that are left, and pointers to them that shift."""
        out = self.leaves.agg(F.count("*").alias("nodes")).select(F.lit(2).alias("level"), "nodes")
        for level, e in self.edges.items():
            out = out.unionByName(e.agg(F.count_distinct("parent").alias("nodes")).select(F.lit(level).alias("level"), "nodes"))
        moved = self.all_edges().groupBy((F.col("level") - 1).alias("level")).agg(F.sum(F.when((F.col("tx") != 0) | (F.col("ty") != 0) | (F.col("tz") != 0), 1).otherwise(0)).alias("shifted"))
        return out.join(moved, "level", "left").select("level", "nodes", F.coalesce("shifted", F.lit(0)).alias("shifted"))

    def _followed(self, state: DataFrame, level: int) -> DataFrame:
        return state.join(self.edges[level].withColumnsRenamed({"parent": "node", "g": "cg"}), "node")

    def voxels(self) -> DataFrame:
        """(x, y, z), unfolded from the root down."""
        return unfolded(self.root.select(F.col("child").alias("node"), "g"), self.depth, self._followed, self.leaves.withColumnRenamed("id", "node"))

    def members(self, queries: DataFrame) -> DataFrame:
        """``queries`` (x, y, z) with ``found``."""
        return found_in(queries, self.root.select(F.col("child").alias("node"), "g"), self.depth, self._followed, self.leaves.withColumnRenamed("id", "node"))


def found_in(queries: DataFrame, root: DataFrame, depth: int, followed, leaves: DataFrame) -> DataFrame:
    """``queries`` (x, y, z) with ``found``, by descent from a root pointer (node, g), a join a level.

    A row's state is its node, that node's transform and where its content's low corner
    lies; the place in the content, turned back, names the child to follow.  A place that
    a shift has moved out of the content is empty.
    """
    own = queries.columns
    keyed = stored(queries.withColumn("_q", F.monotonically_increasing_id()), "queries")
    start = keyed.crossJoin(F.broadcast(root.select("node", "g").limit(1)))  # the root is one row
    inside = reduce(Column.__and__, ((F.col(a) >= 0) & (F.col(a) < (1 << depth)) for a in "xyz"))
    state = start.where(inside).select("_q", "node", "g", *[F.col(a).cast("int").alias(f"v{a}") for a in "xyz"])
    for level in range(depth, 2, -1):
        half = 1 << (level - 1)
        at = _turned_back(F.col("g"), [F.col(f"v{a}") for a in "xyz"], 2 * half)
        want = sum((F.when(c >= half, 1 << i).otherwise(0) for i, c in enumerate(at)), F.lit(0))
        kids = followed(state.withColumn("want", want), level).where("slot = want")
        shift = turned(F.col("g"), [F.col(t) for t in ("tx", "ty", "tz")])
        local = [F.pmod(F.col(f"v{a}"), F.lit(half)) - t for a, t in zip("xyz", shift, strict=True)]
        state = kids.select("_q", F.col("child").alias("node"), s.compose(F.col("g"), F.col("cg")).cast("int").alias("g"), *[c.cast("int").alias(f"v{a}") for c, a in zip(local, "xyz", strict=True)])
        state = state.where(reduce(Column.__and__, ((F.col(f"v{a}") >= 0) & (F.col(f"v{a}") < half) for a in "xyz")))
    at = _turned_back(F.col("g"), [F.col(f"v{a}") for a in "xyz"], 4)
    bit = sum((F.shiftright(c.cast("int"), k).bitwiseAND(F.lit(1)) * (1 << 3 * k + i) for i, c in enumerate(at) for k in (0, 1)), F.lit(0))
    hit = state.withColumn("bit", bit).join(leaves, "node").where(m.has_bit(F.col("bit"))).select("_q", F.lit(True).alias("found"))
    return keyed.join(hit, "_q", "left").select(*own, F.coalesce("found", F.lit(False)).alias("found"))


def _turned_back(g: Column, v: list[Column], side: int) -> list[Column]:
    """A place in a cube of ``side`` under a transform, back in the content."""
    u = F.array(*[F.when(F.shiftright(g, i).bitwiseAND(F.lit(1)) == 1, side - 1 - c).otherwise(c) for i, c in enumerate(v)])
    axis = lambda a: F.element_at(F.array(*[F.lit(s.ORDERS[k >> 3].index(a)) for k in range(s.N)]), (g + 1).cast("int"))
    return [F.element_at(u, (axis(a) + 1).cast("int")) for a in range(3)]


def unfolded(root: DataFrame, depth: int, followed, leaves: DataFrame) -> DataFrame:
    """(x, y, z) under a root pointer (node, g).

    ``followed(state, level)`` joins a level's pointers: rows of ``state`` with slot, child, cg, tx,
    ty and tz.  A row of the state is a node's occurrence: its transform, the place of its
    content's low corner, and the box of the cubes that crop it, which shifts may leave.
    """
    state = root.select("node", "g", *[F.lit(0).alias(f"o{a}") for a in "xyz"], *[F.lit(0).alias(f"l{a}") for a in "xyz"], *[F.lit(1 << depth).alias(f"h{a}") for a in "xyz"])
    slots = F.array(*[F.lit(int(x)) for x in s.slots().ravel()])
    for level in range(depth, 2, -1):
        half = 1 << (level - 1)
        kids = followed(state, level)
        at = F.element_at(slots, (F.col("g") * 8 + F.col("slot") + 1).cast("int"))
        corner = [F.col(f"o{a}") + F.shiftright(at, i).bitwiseAND(F.lit(1)) * half for i, a in enumerate("xyz")]
        shift = turned(F.col("g"), [F.col(t) for t in ("tx", "ty", "tz")])
        state = kids.select(
            F.col("child").alias("node"), s.compose(F.col("g"), F.col("cg")).cast("int").alias("g"),
            *[(c + t).cast("int").alias(f"o{a}") for c, t, a in zip(corner, shift, "xyz", strict=True)],
            *[F.greatest(F.col(f"l{a}"), c).cast("int").alias(f"l{a}") for c, a in zip(corner, "xyz", strict=True)],
            *[F.least(F.col(f"h{a}"), c + half).cast("int").alias(f"h{a}") for c, a in zip(corner, "xyz", strict=True)],
        )
    bits = state.join(leaves, "node").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(m.has_bit(F.col("bit")))
    table = F.array(*[F.lit(int(x)) for x in s.leaf_bits().ravel()])
    to = F.element_at(table, (F.col("g") * 64 + F.col("bit") + 1).cast("int"))
    place = [(F.col(f"o{a}") + F.shiftright(to, i).bitwiseAND(F.lit(1)) + F.shiftright(to, 3 + i).bitwiseAND(F.lit(1)) * 2) for i, a in enumerate("xyz")]
    inside = reduce(Column.__and__, ((c >= F.col(f"l{a}")) & (c < F.col(f"h{a}")) for c, a in zip(place, "xyz", strict=True)))
    return bits.where(inside).select(*[c.cast("long").alias(a) for c, a in zip(place, "xyz", strict=True)])
