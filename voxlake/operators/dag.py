"""Octree to DAG: equal subtrees share one id, level by level.

A node's content is its eight child ids (a leaf's is its mask); equal contents get the
least key among them as id, the analogue of first occurrence.  The id table is joined
back on the content, so a content that most nodes share is a skewed join that Spark
splits, where a window over it would be one task.  Levels are written to shared
storage: each feeds its own grouping and the next level.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxlake.functions import morton as m
from voxlake.operators.octree import leaves, parents
from voxlake.schema import CHILDREN
from voxlake.storage import discard, stored


def identified(nodes: DataFrame, content: list[str], key: str = "morton") -> DataFrame:
    """``nodes`` with ``id``: the least key of equal contents."""
    first = nodes.groupBy(*content).agg(F.min(key).alias("id"))
    return nodes.join(first, content)


class Dag:
    """Levels of a DAG; ``tree[level]`` has (morton, id), ``nodes[level]`` (id, content)."""

    def __init__(self, voxels: DataFrame, root: int):
        self.root = root
        leaf = stored(identified(leaves(voxels), ["lo", "hi"], "tile"), "leaves")
        self.tree = {2: leaf.select(F.col("tile").alias("morton"), "id")}
        self.nodes = {2: leaf.where("tile = id").select("id", "lo", "hi")}
        for level in range(3, root + 1):
            made = stored(identified(parents(self.tree[level - 1]), CHILDREN), f"level{level}")
            self.tree[level] = made.select("morton", "id")
            self.nodes[level] = made.where("morton = id").select("id", *CHILDREN)

    def edges(self, level: int) -> DataFrame:
        """(parent, slot, child) of the distinct nodes of ``level``."""
        each = F.posexplode(F.array(*CHILDREN)).alias("slot", "child")
        return self.nodes[level].select(F.col("id").alias("parent"), each).where("child >= 0")

    def all_edges(self) -> DataFrame:
        """(level, parent, slot, child); level is the parent's."""
        return reduce(DataFrame.unionByName, (self.edges(k).withColumn("level", F.lit(k)) for k in range(3, self.root + 1)))

    def masks(self, level: int) -> DataFrame:
        return self.nodes[level].select("id", m.child_mask(CHILDREN).alias("mask"))

    # --- counts -------------------------------------------------------------------

    def level_counts(self) -> DataFrame:
        """(level, tree_nodes, dag_nodes)."""
        each = (self.tree[k].agg(F.count("*").alias("tree_nodes"), F.sum(F.when(F.col("morton") == F.col("id"), 1).otherwise(0)).alias("dag_nodes")).withColumn("level", F.lit(k)) for k in self.tree)
        return reduce(DataFrame.unionByName, each).select("level", "tree_nodes", "dag_nodes")

    def statistics(self) -> DataFrame:
        """(level, tree_nodes, dag_nodes, children, saved_percent)."""
        children = self.all_edges().groupBy("level").agg(F.count("*").alias("children"))
        counts = self.level_counts().join(children, "level", "left")
        saved = F.round(100.0 * (1 - F.col("dag_nodes") / F.col("tree_nodes")), 6)
        return counts.select("level", "tree_nodes", "dag_nodes", F.coalesce("children", F.lit(0)).alias("children"), saved.alias("saved_percent"))

    def child_histogram(self) -> DataFrame:
        """(level, n_children, n_nodes)."""
        each = (self.masks(k).select(F.lit(k).alias("level"), F.bit_count("mask").cast("long").alias("n_children")) for k in range(3, self.root + 1))
        return reduce(DataFrame.unionByName, each).groupBy("level", "n_children").agg(F.count("*").alias("n_nodes"))

    def multiplicity(self) -> dict[int, DataFrame]:
        """By level (id, n): how often each node occurs in the tree, from the root down."""
        out = {self.root: self.nodes[self.root].select("id", F.lit(1).cast("long").alias("n"))}
        for level in range(self.root, 2, -1):
            down = self.edges(level).join(out[level], F.col("parent") == F.col("id")).groupBy(F.col("child").alias("id")).agg(F.sum("n").alias("n"))
            out[level - 1] = stored(down, "multiplicity")
        return out

    def voxel_count(self) -> DataFrame:
        """(voxels,): leaf populations by multiplicity."""
        n = self.nodes[2].join(self.multiplicity()[2], "id")
        return n.agg(F.coalesce(F.sum(m.popcount() * F.col("n")), F.lit(0)).cast("long").alias("voxels"))

    def subtree_counts(self) -> dict[int, DataFrame]:
        """By level (id, voxels): voxels under each distinct node, from the leaves up."""
        out = {2: self.nodes[2].select("id", m.popcount().alias("voxels"))}
        for level in range(3, self.root + 1):
            below = out[level - 1].select(F.col("id").alias("child"), "voxels")
            out[level] = stored(self.edges(level).join(below, "child").groupBy(F.col("parent").alias("id")).agg(F.sum("voxels").alias("voxels")), "subtrees")
        return out

    def reference_counts(self) -> DataFrame:
        """(level, child, refs): references to each distinct child; level is the child's."""
        return self.all_edges().groupBy((F.col("level") - 1).alias("level"), "child").agg(F.count("*").alias("refs"))

    def reference_ranks(self) -> DataFrame:
        """(level, child, refs, rank): by falling references, then id."""
        return ranked(self.reference_counts(), "level", [F.desc("refs"), F.asc("child")], "rank").select("level", "child", "refs", "rank")

    def live(self, roots: DataFrame, level: int) -> dict[int, DataFrame]:
        """By level (id,): the nodes that ``roots`` (id) of ``level`` reach; a garbage collection keeps these."""
        out = {level: stored(roots.select("id").distinct(), "live")}
        for k in range(level, 2, -1):
            used = self.edges(k).join(out[k], F.col("parent") == F.col("id"), "left_semi").select(F.col("child").alias("id")).distinct()
            out[k - 1] = stored(used, "live")
        return out

    def garbage(self, roots: DataFrame, level: int) -> DataFrame:
        """(level, id): nodes up to ``level`` that ``roots`` do not reach."""
        live = self.live(roots, level)
        return reduce(DataFrame.unionByName, (self.nodes[k].select("id").join(live[k], "id", "left_anti").select(F.lit(k).alias("level"), "id") for k in live))

    def orphans(self, live: DataFrame, level: int) -> DataFrame:
        """Nodes of ``level`` - 1 that no node in ``live`` (id) of ``level`` refers to."""
        used = self.edges(level).join(live, F.col("parent") == F.col("id"), "left_semi").select("child").distinct()
        return self.nodes[level - 1].join(used, F.col("id") == F.col("child"), "left_anti")

    def word_offsets(self) -> DataFrame:
        """(level, id, words, start): a node is a mask word and a word for each child; leaves are two words."""
        inner = [self.masks(k).select(F.lit(k).alias("level"), "id", (1 + F.bit_count("mask")).cast("long").alias("words")) for k in range(3, self.root + 1)]
        leaf = self.nodes[2].select(F.lit(2).alias("level"), "id", F.lit(2).cast("long").alias("words"))
        return running_start(reduce(DataFrame.unionByName, inner, leaf), "level", "id", "words")

    def members(self, queries: DataFrame) -> DataFrame:
        """``queries`` (x, y, z) with ``found``, by descent from the root, a join a level."""
        state = queries.withColumns({"_m": m.morton3(), "_at": F.lit(None).cast("long")})
        top = self.nodes[self.root].select(F.col("id").alias("_root"))
        state = state.crossJoin(F.broadcast(top.limit(1))).withColumn("_at", F.col("_root")).drop("_root")  # the root is one row
        for level in range(self.root, 2, -1):
            kids = self.nodes[level].select(F.col("id").alias("_id"), F.array(*CHILDREN).alias("_kids"))
            slot = F.pmod(m.ascend("_m", level - 1), F.lit(8)).cast("int")
            state = state.join(kids, F.col("_at") == F.col("_id"), "left").withColumn("_at", F.coalesce(F.element_at("_kids", slot + 1), F.lit(-1).cast("long"))).drop("_id", "_kids")
        last = self.nodes[2].select(F.col("id").alias("_id"), "lo", "hi")
        bit = F.pmod(F.col("_m"), F.lit(64))
        found = F.coalesce(m.has_bit(bit) & (m.ascend("_m", self.root) == 0), F.lit(False))
        return state.join(last, F.col("_at") == F.col("_id"), "left").select(*queries.columns, found.alias("found"))


def running_start(rows: DataFrame, group: str, key: str, size: str, out: str = "start") -> DataFrame:
    """``rows`` with the exclusive running sum of ``size`` by ``key`` in each group, in two levels.

    Keys (longs) are cut into ranges of 2^18; their sums are summed first.
    """
    part = rows.withColumn("_part", F.shiftright(key, 18))
    sums = part.groupBy(group, "_part").agg(F.sum(size).alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("_run", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = W.partitionBy(group, "_part").orderBy(key).rowsBetween(W.unboundedPreceding, -1)
    return part.join(sums, [group, "_part"]).select(*rows.columns, (F.col("_run") + F.coalesce(F.sum(size).over(inside), F.lit(0))).cast("long").alias(out))


def ranked(rows: DataFrame, group: str, order: list[Column], out: str = "rank") -> DataFrame:
    """``rows`` with their place (from 0) in ``order`` within each group.

    Rows are dealt by ranges of (group, order), ranges are counted, and rows are ranked
    inside their range, so no group is one task.  ``order`` must tell rows apart.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored twice: dealing by ranges reads its input twice, and ranges must stay as counted
    first = stored(rows, "unranked")
    dealt = stored(first.repartitionByRange(n, F.col(group), *order).withColumn("_part", F.spark_partition_id()), "dealt")
    counts = dealt.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.row_number().over(W.partitionBy(group, "_part").orderBy(*order)) - 1
    discard(first)
    return dealt.join(counts, [group, "_part"]).select(*rows.columns, place.cast("long").alias(out))


def depth_first_rank(voxels: DataFrame) -> DataFrame:
    """(x, y, z, rank): a voxel's place in depth-first order, which is that of its Morton key."""
    keyed = voxels.select("x", "y", "z", m.morton3().alias("_m"), F.lit(1).alias("_g"), F.lit(1).cast("long").alias("_one"))
    return running_start(keyed, "_g", "_m", "_one", "rank").select("x", "y", "z", "rank")
