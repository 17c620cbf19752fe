"""Voxel sets, leaves and octree levels.

Level 0 is a voxel, level 2 a 4x4x4 leaf, level L a cube of 2^L; a node's key is its
Morton key, its parent's key the same shifted by three bits, so building levels needs
aggregations and no joins.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions import morton as m
from voxlake.schema import CHILDREN


def cells_from(table: DataFrame, x: str, y: str, z: str, resolution: int) -> DataFrame:
    """(x, y, z) of three integer columns, each modulo ``resolution``; enough where leaves follow, as masks take a voxel once."""
    cut = lambda c, n: F.pmod(F.col(c).cast("long"), F.lit(resolution)).alias(n)
    return table.select(cut(x, "x"), cut(y, "y"), cut(z, "z"))


def voxels_from(table: DataFrame, x: str, y: str, z: str, resolution: int) -> DataFrame:
    """Distinct ``cells_from``."""
    return cells_from(table, x, y, z, resolution).distinct()


def with_morton(voxels: DataFrame) -> DataFrame:
    return voxels.withColumn("morton", m.morton3())


def leaves(voxels: DataFrame) -> DataFrame:
    """(tile, lo, hi): the occupancy mask of every leaf."""
    key = m.morton3()
    lo, hi = m.lo_hi(F.pmod(F.col("m"), F.lit(64)))
    return voxels.select(key.alias("m")).select(m.ascend("m", 2).alias("tile"), lo.alias("lo"), hi.alias("hi")).groupBy("tile").agg(
        F.bit_or("lo").alias("lo"), F.bit_or("hi").alias("hi")
    )


def voxels_of_leaves(leaf: DataFrame) -> DataFrame:
    """(x, y, z) of the set bits."""
    bits = leaf.select("tile", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"), "lo", "hi").where(m.has_bit(F.col("bit")))
    key = F.shiftleft("tile", 6).bitwiseOR(F.col("bit").cast("long"))
    return bits.select(key.alias("morton")).select(*[c.alias(n) for c, n in zip(m.unmorton3(), "xyz", strict=True)])


def level_keys(leaf: DataFrame, root: int) -> DataFrame:
    """(level, morton, mask): every node of levels 3 to ``root`` with its child mask.

    Each leaf names its ancestors once; the distinct children are counted before the
    parents are formed, so the shuffles carry keys only.
    """
    up = leaf.select(F.explode(F.sequence(F.lit(2), F.lit(root - 1))).alias("child_level"), "tile")
    shift = ((F.col("child_level") - 2) * 3).cast("int")
    children = up.select("child_level", F.call_function("shiftright", F.col("tile"), shift).alias("child")).distinct()
    bit = F.call_function("shiftleft", F.lit(1), F.pmod(F.col("child"), F.lit(8)).cast("int"))
    return children.groupBy((F.col("child_level") + 1).alias("level"), F.shiftright("child", 3).alias("morton")).agg(F.bit_or(bit).alias("mask"))


def level_counts(leaf: DataFrame, root: int) -> DataFrame:
    """(level, nodes), leaves included."""
    inner = level_keys(leaf, root).groupBy("level").agg(F.count("*").alias("nodes"))
    return leaf.agg(F.count("*").alias("nodes")).select(F.lit(2).alias("level"), "nodes").unionByName(inner)


def parents(children: DataFrame, key: str = "morton", value: str = "id") -> DataFrame:
    """(morton, c0..c7) from a level's (key, value) rows; a missing child is -1."""
    slot = F.pmod(F.col(key), F.lit(8))
    return children.groupBy(F.shiftright(key, 3).alias("morton")).agg(
        *[F.coalesce(F.max(F.when(slot == i, F.col(value))), F.lit(-1).cast("long")).alias(c) for i, c in enumerate(CHILDREN)]
    )


def downsample(voxels: DataFrame, steps: int = 1) -> DataFrame:
    """Any-child-set reduction by 2^steps."""
    return voxels.select(*[F.shiftright(c, steps).alias(c) for c in "xyz"]).distinct()


def upsample(voxels: DataFrame) -> DataFrame:
    """Each voxel as its eight children."""
    eight = voxels.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(7))))
    return eight.select(*[(F.col(c) * 2 + F.shiftright("s", i).bitwiseAND(F.lit(1))).alias(c) for i, c in enumerate("xyz")])


def pyramid(voxels: DataFrame, levels: int) -> DataFrame:
    """(level, x, y, z) for levels 0 to ``levels``."""
    steps = voxels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    return steps.select("level", *[F.call_function("shiftright", F.col(c), F.col("level")).alias(c) for c in "xyz"]).distinct()


def bounds(points: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    return points.agg(*[f(c).alias(f"{n}_{c}") for n, f in (("min", F.min), ("max", F.max)) for c in columns])


def members(queries: DataFrame, voxels: DataFrame) -> DataFrame:
    """``queries`` with ``found``: a bit test in the query's leaf."""
    q = queries.withColumn("_m", m.morton3())
    hit = q.join(leaves(voxels), m.ascend("_m", 2) == F.col("tile"), "left")
    found = F.coalesce(m.has_bit(F.pmod(F.col("_m"), F.lit(64))), F.lit(False))
    return hit.select(*[q[c] for c in queries.columns], found.alias("found"))


def member_levels(queries: DataFrame, voxels: DataFrame, level: str = "level") -> DataFrame:
    """``queries`` (x, y, z, level) with ``found``: whether the node of that level is there."""
    present = pyramid(voxels, 21).select(F.col("level").alias("_l"), *[F.col(c).alias(f"_{c}") for c in "xyz"])
    at = [F.call_function("shiftright", F.col(c), F.col(level)) == F.col(f"_{c}") for c in "xyz"]
    joined = queries.join(present, reduce(Column.__and__, at, F.col(level) == F.col("_l")), "left")
    return joined.select(*queries.columns, F.col("_l").isNotNull().alias("found"))


# --- regions ----------------------------------------------------------------------

def in_box(lower: tuple, upper: tuple) -> Column:
    """Inside, upper end excluded."""
    return reduce(Column.__and__, (F.col(c).between(F.lit(a), F.lit(b - 1)) for c, a, b in zip("xyz", lower, upper, strict=True)))


def in_sphere(centre: tuple, radius: float) -> Column:
    square = sum(((F.col(c) + 0.5 - a) * (F.col(c) + 0.5 - a) for c, a in zip("xyz", centre, strict=True)), F.lit(0.0))
    return square < radius * radius


def tile_ranges(lower: tuple, upper: tuple, depth: int, most: int = 64) -> list[tuple[int, int]]:
    """Morton ranges [a, b) of leaf tiles that cover a box, for pruning a table sorted by tile."""
    out: list[tuple[int, int]] = []
    queue = [((0, 0, 0), depth - 2)]
    lo, hi = [a >> 2 for a in lower], [(b - 1) >> 2 for b in upper]
    done: list[tuple[tuple, int]] = []
    while queue:
        at, level = queue.pop(0)
        size = 1 << level
        if any(a + size <= l or a > h for a, l, h in zip(at, lo, hi, strict=True)):  # noqa: E741
            continue
        inside = all(a >= l and a + size - 1 <= h for a, l, h in zip(at, lo, hi, strict=True))  # noqa: E741
        if inside or level == 0 or len(done) + len(queue) >= most:
            done.append((at, level))
            continue
        queue += [(tuple(a + (size // 2 if s >> i & 1 else 0) for i, a in enumerate(at)), level - 1) for s in range(8)]
    key = lambda p: sum((v >> b & 1) << (3 * b + i) for i, v in enumerate(p) for b in range(21))
    for a, b in sorted((key(at), key(at) + (1 << 3 * level)) for at, level in done):
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def leaves_in_box(leaf: DataFrame, lower: tuple, upper: tuple, depth: int) -> DataFrame:
    """Leaves whose tiles may meet the box; the ranges reach the scan as pushed filters."""
    ranges = tile_ranges(lower, upper, depth)
    return leaf.where(reduce(Column.__or__, ((F.col("tile") >= a) & (F.col("tile") < b) for a, b in ranges), F.lit(False)))


def boxes_empty(boxes: DataFrame, voxels: DataFrame) -> DataFrame:
    """(box_id, is_empty) for boxes (box_id, x0, y0, z0, x1, y1, z1), ends excluded, along leaf cells.

    Each box names the cells of 16 voxels it meets, so the join is on cells.
    """
    cell = lambda c: F.shiftright(c, 4)
    cells = boxes
    for c in "xyz":
        cells = cells.withColumn(f"c{c}", F.explode(F.sequence(cell(f"{c}0"), F.shiftright(F.col(f"{c}1") - 1, 4))))
    inside = [(F.col(c) >= F.col(f"{c}0")) & (F.col(c) < F.col(f"{c}1")) for c in "xyz"]
    near = voxels.select("x", "y", "z", *[cell(c).alias(f"c{c}") for c in "xyz"])
    hit = cells.join(near, ["cx", "cy", "cz"]).where(reduce(Column.__and__, inside)).select("box_id").distinct()
    return boxes.select("box_id").join(hit.withColumn("hit", F.lit(True)), "box_id", "left").select("box_id", F.col("hit").isNull().alias("is_empty"))


def full_leaves(leaf: DataFrame) -> DataFrame:
    return leaf.where(m.popcount() == 64)


def homogeneous_leaves(voxels: DataFrame) -> DataFrame:
    """(tile, material): leaves whose 64 voxels all hold one material."""
    tiles = voxels.groupBy(m.ascend(m.morton3(), 2).alias("tile")).agg(F.count("*").alias("n"), F.min("material").alias("material"), F.max("material").alias("other"))
    return tiles.where("n = 64 and material = other").select("tile", "material")


def read_region(voxels: DataFrame, lower: tuple, upper: tuple):
    """A dense boolean array of a small box, [x, y, z]."""
    import numpy as np

    shape = tuple(b - a for a, b in zip(lower, upper, strict=True))
    if np.prod(shape) > 1 << 24:
        raise ValueError("a region is read out up to 2^24 voxels")
    out = np.zeros(shape, dtype=bool)
    got = voxels.where(in_box(lower, upper)).select("x", "y", "z").toPandas().to_numpy()
    if len(got):
        out[tuple((got - np.array(lower)).T)] = True
    return out
