"""Compact encodings of DAGs: sizes, pointer layouts, word streams and their decoding.

Sizes come from aggregations over distinct nodes.  Word streams are packed in Arrow
batches, from nodes whose offsets are running sums; decoding joins down the levels.
"""

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxlake.functions import symmetries
from voxlake.functions import morton as m
from voxlake.operators.dag import Dag, running_start
from voxlake.operators.symmetric import SymmetricDag
from voxlake.schema import CHILDREN
from voxlake.storage import stored

#: Bits of a word.
WORD = 16


# --- 32-bit words -----------------------------------------------------------------

def svdag32_sizes(dag: Dag) -> DataFrame:
    """(level, nodes, words, bytes): a mask word and a word a child; a leaf is two words."""
    words = dag.word_offsets().groupBy("level").agg(F.count("*").alias("nodes"), F.sum("words").alias("words"))
    return words.select("level", "nodes", "words", (F.col("words") * 4).alias("bytes"))


def svo32_sizes(dag: Dag) -> DataFrame:
    """(level, nodes, words, bytes) of the tree: a word a node (first child and mask), two a leaf."""
    counts = dag.level_counts().select("level", F.col("tree_nodes").alias("nodes"))
    words = counts.withColumn("words", F.when(F.col("level") == 2, 2).otherwise(1) * F.col("nodes"))
    return words.select("level", "nodes", "words", (F.col("words") * 4).alias("bytes"))


def ssvdag32_sizes(sym: SymmetricDag) -> DataFrame:
    """As ``svdag32_sizes`` for canonical nodes: mirror bits share the pointer's word."""
    out = [sym.classes[2].where("id = cid").agg(F.count("*").alias("nodes")).select(F.lit(2).alias("level"), "nodes", (F.col("nodes") * 2).alias("words"))]
    for level in range(3, sym.dag.root + 1):
        edges = sym.edges(level).groupBy("parent").agg((F.count("*") + 1).alias("w"))
        out.append(edges.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("w"), F.lit(0)).alias("words")).select(F.lit(level).alias("level"), "nodes", "words"))
    return reduce(DataFrame.unionByName, out).select("level", "nodes", "words", (F.col("words") * 4).alias("bytes"))


def svdag32_words(dag: Dag) -> DataFrame:
    """(level, id, start, words array<long>): every node's words; a child is its start within its level."""
    offsets = stored(dag.word_offsets(), "offsets")
    leaf = dag.nodes[2].join(offsets.where("level = 2"), "id").select("level", "id", "start", F.array("lo", "hi").alias("words"))
    starts = offsets.select((F.col("level") + 1).alias("level"), F.col("id").alias("child"), F.col("start").alias("at"))
    edges = dag.all_edges().join(starts, ["level", "child"])
    kids = edges.groupBy("level", F.col("parent").alias("id")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1), F.col("slot"))).alias("mask"), F.sort_array(F.collect_list(F.struct("slot", "at"))).alias("kids")
    )
    inner = kids.join(offsets, ["level", "id"]).select("level", "id", "start", F.concat(F.array(F.col("mask").cast("long")), F.transform("kids", lambda k: k["at"])).alias("words"))
    return leaf.unionByName(inner)


def svdag32_members(words: DataFrame, queries: DataFrame, root: int) -> DataFrame:
    """``queries`` (x, y, z) with ``found``, reading the word form: a join a level on word starts."""
    state = queries.withColumns({"_m": m.morton3(), "_at": F.lit(0).cast("long")})
    for level in range(root, 2, -1):
        here = words.where(F.col("level") == level).select(F.col("start").alias("_s"), F.col("words").alias("_w"))
        slot = F.pmod(m.ascend("_m", level - 1), F.lit(8)).cast("int")
        mask = F.element_at("_w", 1)
        before = F.bit_count(mask.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), slot) - 1))
        there = F.call_function("shiftright", mask, slot).bitwiseAND(F.lit(1).cast("long")) == 1
        state = state.join(here, F.col("_at") == F.col("_s"), "left").withColumn("_at", F.when(there, F.try_element_at("_w", (before + 2).cast("int")))).drop("_s", "_w")
    leaf = words.where("level = 2").select(F.col("start").alias("_s"), F.element_at("words", 1).alias("lo"), F.element_at("words", 2).alias("hi"))
    bit = F.pmod(F.col("_m"), F.lit(64))
    found = F.coalesce(m.has_bit(bit) & (m.ascend("_m", root) == 0), F.lit(False))
    return state.join(leaf, F.col("_at") == F.col("_s"), "left").select(*queries.columns, found.alias("found"))


# --- 16-bit words -----------------------------------------------------------------

def header_word(lengths: list[int]) -> int:
    """Two bits a child: the words of its pointer, 0 for none."""
    return sum(n << 2 * i for i, n in enumerate(lengths))


def header_children(header: int) -> list[tuple[int, int, int]]:
    """(slot, words, offset after the header) of the children that are."""
    out, at = [], 1
    for slot in range(8):
        n = header >> 2 * slot & 3
        if n:
            out.append((slot, n, at))
            at += n
    return out


def no_transform16(dag: Dag) -> DataFrame:
    """(level, id, start, words array<int>): nodes in 16-bit words without transforms.

    A header, and for each child its start in the level below, in as many words as it
    takes; leaves are four words.  A level's widths depend on the starts of the level
    below only, so levels go bottom-up.
    """
    parts = lambda c, n: [F.shiftright(c, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int") for i in range(n)]
    leaf = dag.nodes[2].select(F.lit(2).alias("level"), "id", F.array(*parts(F.col("lo"), 2), *parts(F.col("hi"), 2)).alias("words"), F.lit(4).cast("long").alias("n"))
    done = [stored(running_start(leaf, "level", "id", "n"), "words16")]

    def packed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for node, kids in zip(f["id"], f["kids"], strict=True):
                lengths, words = [0] * 8, []
                for k in kids:
                    at = int(k["at"])
                    n = max(1, -(-at.bit_length() // WORD))
                    lengths[k["slot"]] = n
                    words += [at >> WORD * i & 0xFFFF for i in range(n)]
                rows.append((node, [header_word(lengths), *words]))
            yield pd.DataFrame(rows, columns=["id", "words"])

    for level in range(3, dag.root + 1):
        below = done[-1].select(F.col("id").alias("child"), F.col("start").alias("at"))
        kids = dag.edges(level).join(below, "child").groupBy(F.col("parent").alias("id")).agg(F.sort_array(F.collect_list(F.struct("slot", "at"))).alias("kids"))
        made = kids.mapInPandas(packed, "id long, words array<int>")
        made = made.select(F.lit(level).alias("level"), "id", "words", F.size("words").cast("long").alias("n"))
        done.append(stored(running_start(made, "level", "id", "n"), "words16"))
    return reduce(DataFrame.unionByName, done).select("level", "id", "start", "words")


def word_size_report(words: DataFrame, word_bytes: int) -> DataFrame:
    """(level, nodes, words, bytes) of a word form: what a byte-counting sink would see."""
    sums = words.groupBy("level").agg(F.count("*").alias("nodes"), F.sum(F.size("words")).alias("words"))
    return sums.select("level", "nodes", "words", (F.col("words") * word_bytes).alias("bytes"))


def decoded16(words: DataFrame, root: int) -> DataFrame:
    """Voxels (x, y, z) of ``no_transform16``, read from the root down: the round trip."""
    now = words.where(F.col("level") == root).select(F.lit(0).cast("long").alias("morton"), "words")

    def children(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for key, w in zip(f["morton"], f["words"], strict=True):
                for slot, n, at in header_children(int(w[0])):
                    rows.append((key << 3 | slot, sum(int(w[at + i]) << WORD * i for i in range(n))))
            yield pd.DataFrame(rows, columns=["morton", "at"]).astype("int64")

    for level in range(root, 2, -1):
        kids = now.mapInPandas(children, "morton long, at long")
        below = words.where(F.col("level") == level - 1).select(F.col("start").alias("at"), "words")
        now = kids.join(below, "at").select("morton", "words")
    half = lambda i: F.element_at("words", i + 1).cast("long") + F.element_at("words", i + 2).cast("long") * 65536
    from voxlake.operators.octree import voxels_of_leaves

    return voxels_of_leaves(now.select(F.col("morton").alias("tile"), half(0).alias("lo"), half(2).alias("hi")))


def members16(words: DataFrame, queries: DataFrame, root: int) -> DataFrame:
    """``queries`` (x, y, z) with ``found``, reading ``no_transform16``: a join a level on word starts."""
    state = queries.withColumns({"_m": m.morton3(), "_at": F.lit(0).cast("long")})
    header = F.element_at("_w", 1)
    for level in range(root, 2, -1):
        here = words.where(F.col("level") == level).select(F.col("start").alias("_s"), F.col("words").alias("_w"))
        state = state.withColumn("_slot", F.pmod(m.ascend("_m", level - 1), F.lit(8)).cast("int")).join(here, F.col("_at") == F.col("_s"), "left")
        # words of the children up to the slot's own, two bits each, by the even and odd bits of the header
        below = lambda n: header.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.col("_slot") * 2).cast("int")) - 1).bitwiseAND(F.lit(n))  # noqa: B023, E731
        state = state.withColumns({"_k": F.call_function("shiftright", header, (F.col("_slot") * 2).cast("int")).bitwiseAND(F.lit(3)), "_from": (F.bit_count(below(0x5555)) + 2 * F.bit_count(below(0xAAAA)) + 2).cast("int")})
        part = lambda j: F.when(F.col("_k") > j, F.element_at("_w", F.col("_from") + j).cast("long") * (1 << WORD * j)).otherwise(0)  # noqa: B023, E731
        state = state.withColumn("_at", F.when(F.col("_k") > 0, part(0) + part(1) + part(2))).drop("_s", "_w", "_slot", "_k", "_from")
    half = lambda i: F.element_at("words", i + 1).cast("long") + F.element_at("words", i + 2).cast("long") * 65536
    leaf = words.where("level = 2").select(F.col("start").alias("_s"), half(0).alias("lo"), half(2).alias("hi"))
    found = F.coalesce(m.has_bit(F.pmod(F.col("_m"), F.lit(64))) & (m.ascend("_m", root) == 0), F.lit(False))
    return state.join(leaf, F.col("_at") == F.col("_s"), "left").select(*queries.columns, found.alias("found"))


def svo32_words(dag: Dag) -> DataFrame:
    """(level, morton, place, first, mask) of the tree: a node's place in Morton order within its level, its first
    child's place in the level below, and its child mask; a leaf has its mask's halves (first: low, mask: high)."""
    out, below = [], None
    for level in range(2, dag.root + 1):
        nodes = dag.tree[level].select(F.lit(0).alias("_g"), "morton", F.lit(1).cast("long").alias("_one"))
        placed = stored(running_start(nodes, "_g", "morton", "_one", "place").select("morton", "place"), "places")
        if level == 2:
            held = dag.tree[2].join(dag.nodes[2], "id").select("morton", F.col("lo").alias("first"), F.col("hi").alias("mask"))
        else:
            slot = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod("morton", F.lit(8)).cast("int"))
            held = below.groupBy(F.shiftright("morton", 3).alias("morton")).agg(F.min("place").alias("first"), F.bit_or(slot).alias("mask"))
        out.append(placed.join(held, "morton").select(F.lit(level).alias("level"), "morton", "place", "first", "mask"))
        below = placed
    return reduce(DataFrame.unionByName, out)


def symmetric_voxels(sym: SymmetricDag) -> DataFrame:
    """Voxels (x, y, z) of the canonical nodes, unfolding transforms from the root down: the round trip."""
    root = sym.dag.root
    now = sym.classes[root].select(F.lit(0).cast("long").alias("morton"), "cid", "g")
    slots = F.array(*[F.lit(int(x)) for x in symmetries.slots().ravel()])
    for level in range(root, 2, -1):
        kids = now.join(sym.edges(level).select(F.col("parent").alias("cid"), "slot", "child", F.col("g").alias("cg")), "cid")
        at = F.element_at(slots, (F.col("g") * 8 + F.col("slot") + 1).cast("int"))
        now = kids.select((F.col("morton") * 8 + at).alias("morton"), F.col("child").alias("cid"), symmetries.compose(F.col("g"), F.col("cg")).alias("g"))
    leaf = sym.dag.nodes[2].select(F.col("id").alias("cid"), "lo", "hi")
    bits = now.join(leaf, "cid").withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(63)))).where(m.has_bit(F.col("bit")))
    table = F.array(*[F.lit(int(x)) for x in symmetries.leaf_bits().ravel()])
    key = F.shiftleft("morton", 6).bitwiseOR(F.element_at(table, (F.col("g") * 64 + F.col("bit") + 1).cast("int")).cast("long"))
    return bits.select(key.alias("m")).select(*[c.alias(n) for c, n in zip(m.unmorton3("m"), "xyz", strict=True)])
