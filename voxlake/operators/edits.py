"""Edits of voxel sets, versions with undo and redo, and the replay of an edit log.

An edit touches a region, so it splits a set into what the region can't change and the
rest; versions share the untouched leaves.  A versioned store is append-only: each
version names the leaves it replaced (tile and mask, an empty mask for a removed leaf),
and a state is the last entry of each tile on the version's path.
"""

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from math import ceil, floor

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from voxlake.functions import morton as m
from voxlake.operators.octree import in_box, in_sphere, leaves, voxels_of_leaves
from voxlake.storage import discard, stored


# --- set operations ---------------------------------------------------------------

def dealt(rows: DataFrame) -> DataFrame:
    """``rows`` for a join that deals both sides out by key.

    Spark judges a side by its file or by the rows before an explode, which a voxel set
    exceeds many times; it would collect such a set on the driver to broadcast it.
    """
    return rows.hint("merge")


def box_voxels(spark: SparkSession, lower: tuple, upper: tuple) -> DataFrame:
    """All voxels of a box, upper end excluded."""
    x = spark.range(lower[0], upper[0]).select(F.col("id").alias("x"))
    for c, a, b in (("y", lower[1], upper[1]), ("z", lower[2], upper[2])):
        x = x.withColumn(c, F.explode(F.sequence(F.lit(a).cast("long"), F.lit(b - 1).cast("long")))) if b > a else x.withColumn(c, F.lit(a).cast("long")).limit(0)
    return x.select("x", "y", "z")


def sphere_voxels(spark: SparkSession, centre: tuple, radius: float, resolution: int) -> DataFrame:
    lower = tuple(max(0, int(c - radius)) for c in centre)
    upper = tuple(min(resolution, int(c + radius) + 1) for c in centre)
    return box_voxels(spark, lower, upper).where(in_sphere(centre, radius))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y", "z").unionByName(b.select("x", "y", "z")).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("x", "y", "z").join(b.select("x", "y", "z"), ["x", "y", "z"], "left_anti")


def graft(base: DataFrame, part: DataFrame, at: tuple) -> DataFrame:
    """Union with ``part`` moved to ``at``."""
    return union(base, part.select(*[(F.col(c) + a).alias(c) for c, a in zip("xyz", at, strict=True)]))


def level_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Cells (level, x, y, z) of pyramid ``a`` that pyramid ``b`` lacks, though it has their parents."""
    up = b.select((F.col("level") - 1).alias("level"), *[F.col(c).alias(f"p{c}") for c in "xyz"])
    kept = a.join(b, ["level", "x", "y", "z"], "left_anti").select("level", "x", "y", "z", *[F.shiftright(c, 1).alias(f"p{c}") for c in "xyz"])
    return kept.join(up, ["level", "px", "py", "pz"], "left_semi").select("level", "x", "y", "z")


def add_region(voxels: DataFrame, region: DataFrame) -> DataFrame:
    return union(voxels, region)


def remove_where(voxels: DataFrame, inside: Column) -> DataFrame:
    return voxels.where(~inside)


def copy_box(voxels: DataFrame, lower: tuple, upper: tuple, to: tuple, resolution: int) -> DataFrame:
    """The box's voxels again, its lower corner at ``to``; what falls outside the grid is dropped."""
    moved = voxels.where(in_box(lower, upper)).select(*[(F.col(c) + (t - a)).alias(c) for c, a, t in zip("xyz", lower, to, strict=True)])
    return union(voxels, moved.where(in_box((0, 0, 0), (resolution,) * 3)))


def touched_by_box(centre: tuple, radius: float) -> Column:
    """Voxels (x, y, z) whose cube shares volume with a cube about ``centre``."""
    return reduce(Column.__and__, ((F.col(c) + 1 > v - radius) & (F.col(c) < v + radius) for c, v in zip("xyz", map(float, centre), strict=True)))


def touched_by_sphere(centre: tuple, radius: float) -> Column:
    """Voxels (x, y, z) whose cube reaches into a sphere."""
    gaps = [F.greatest(F.lit(0.0), F.col(c) - v, v - (F.col(c) + 1)) for c, v in zip("xyz", map(float, centre), strict=True)]
    return sum((g * g for g in gaps), F.lit(0.0)) < radius * radius


def cells_about(spark: SparkSession, centre: tuple, radius: float, resolution: int) -> DataFrame:
    """(x, y, z) of the grid's voxels that a cube about ``centre`` touches."""
    lower = tuple(max(0, floor(v - radius)) for v in centre)
    upper = tuple(max(a, min(resolution, ceil(v + radius))) for a, v in zip(lower, centre, strict=True))
    return box_voxels(spark, lower, upper)


def copy_transformed(
    voxels: DataFrame, source: tuple, dest: tuple, centre: tuple, radius: float, resolution: int, matrix: list[float] | None = None, swirl_period: float | None = None
) -> DataFrame:
    """``voxels`` and, in the empty cells of a cube, what lies at the cells' images under the copy.

    The cube's centre is that of ``centre`` under the copy, dest + M (centre - source), its
    radius grows with the matrix (nine numbers by rows).  A cell p reads the voxel at
    source + M^-1 S (p - dest), where S turns about y by height / ``swirl_period``.  Every cell
    looks its voxel up (an equi join), so nothing is missed by rounding; other columns
    (material) come from the voxel read.
    """
    turn = np.array(matrix or np.eye(3), dtype=float).reshape(3, 3)
    back = np.linalg.inv(turn)
    middle = tuple(float(d) for d in np.array(dest, float) + turn @ (np.array(centre, float) - np.array(source, float)))
    reach = float(radius) * float(np.abs(turn.sum(axis=1)).max())
    cells = cells_about(voxels.sparkSession, middle, reach, resolution).where(touched_by_box(middle, reach))
    d = [F.col(c) - float(v) for c, v in zip("xyz", dest, strict=True)]
    if swirl_period:
        angle = d[1] / float(swirl_period)
        d = [d[0] * F.cos(angle) - d[2] * F.sin(angle), d[1], d[0] * F.sin(angle) + d[2] * F.cos(angle)]
    at = [sum((float(back[i, j]) * d[j] for j in range(3)), F.lit(0.0)) + float(source[i]) for i in range(3)]
    looked = cells.select("x", "y", "z", *[v.alias(f"_s{c}") for c, v in zip("xyz", at, strict=True)]).where("_sx >= 0 and _sy >= 0 and _sz >= 0")
    looked = looked.select("x", "y", "z", *[F.floor(f"_s{c}").cast("long").alias(f"_s{c}") for c in "xyz"])
    rest = [c for c in voxels.columns if c not in ("x", "y", "z")]
    found = looked.join(dealt(voxels.select(*[F.col(c).alias(f"_s{c}") for c in "xyz"], *rest)), ["_sx", "_sy", "_sz"]).select("x", "y", "z", *rest)
    return voxels.unionByName(found.join(dealt(voxels.select("x", "y", "z")), ["x", "y", "z"], "left_anti"))


OFFSETS_26 = [(i, j, k) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) != (0, 0, 0)]
OFFSETS_6 = [o for o in OFFSETS_26 if sum(map(abs, o)) == 1]


def _offset_rows(voxels: DataFrame, offsets: list[tuple]) -> DataFrame:
    o = F.explode(F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"o{c}") for c, v in zip("xyz", at, strict=True)]) for at in offsets])).alias("o")
    return voxels.select("x", "y", "z", o)


def neighbour_counts(voxels: DataFrame, offsets: list[tuple] = OFFSETS_26) -> DataFrame:
    """(x, y, z, neighbours) of every voxel: each voxel votes for its neighbours' places."""
    votes = _offset_rows(voxels, offsets).select(*[(F.col(c) + F.col(f"o.o{c}")).alias(c) for c in "xyz"], F.lit(1).alias("v"), F.lit(0).alias("own"))
    own = voxels.select("x", "y", "z", F.lit(0).alias("v"), F.lit(1).alias("own"))
    sums = votes.unionByName(own).groupBy("x", "y", "z").agg(F.sum("v").cast("long").alias("neighbours"), F.max("own").alias("own"))
    return sums.where("own = 1").drop("own")


def erode(voxels: DataFrame, least: int) -> DataFrame:
    """Voxels with ``least`` of 26 neighbours or more."""
    return neighbour_counts(voxels).where(F.col("neighbours") >= least).select("x", "y", "z")


def exposed_faces(voxels: DataFrame) -> DataFrame:
    """(x, y, z, nx, ny, nz): faces whose neighbour voxel is empty."""
    faces = _offset_rows(voxels, OFFSETS_6).select("x", "y", "z", *[F.col(f"o.o{c}").cast("int").alias(f"n{c}") for c in "xyz"])
    there = voxels.select(*[F.col(c).alias(f"t{c}") for c in "xyz"])
    near = [F.col(c) + F.col(f"n{c}") == F.col(f"t{c}") for c in "xyz"]
    return faces.join(there, near, "left_anti")


def flood_cells(voxels: DataFrame, seed: tuple, lower: tuple, upper: tuple) -> DataFrame:
    """(x, y, z): the seed and the empty cells of a box that 6-neighbour steps reach from it.

    The empty cells of every row along x, y and z are cut into runs first.  A sweep takes
    the whole run of each cell that was reached, along each axis in turn, so an open space
    is full after one, and a winding one after as many sweeps as its way has turns.
    """
    spark = voxels.sparkSession
    if not all(a <= v < b for a, v, b in zip(lower, seed, upper, strict=True)):
        return spark.createDataFrame([], "x long, y long, z long")
    first = spark.createDataFrame([tuple(map(int, seed))], "x long, y long, z long")
    solid = voxels.where(in_box(lower, upper)).select("x", "y", "z").join(first, ["x", "y", "z"], "left_anti")
    free = box_voxels(spark, lower, upper).join(dealt(solid), ["x", "y", "z"], "left_anti")
    rows = {"x": ["y", "z"], "y": ["x", "z"], "z": ["x", "y"]}
    for a, others in rows.items():
        free = free.withColumn(f"run_{a}", F.col(a) - F.row_number().over(W.partitionBy(*others).orderBy(a)))
    free = stored(free, "free")
    reached, before, n = stored(free.join(first, ["x", "y", "z"], "left_semi"), "reached"), 0, 1
    while n != before:
        after = reached
        for a, others in rows.items():
            after = free.join(dealt(after.select(*others, f"run_{a}").distinct()), [*others, f"run_{a}"], "left_semi")
        after = stored(after, "reached")
        discard(reached)
        reached, before, n = after, n, after.count()
    discard(free)
    return reached.select("x", "y", "z")


def flood_fill(voxels: DataFrame, seed: tuple, lower: tuple, upper: tuple) -> DataFrame:
    """``voxels`` and the empty cells of a box that 6-neighbour steps reach from an empty ``seed``."""
    start = voxels.where(in_box(seed, tuple(v + 1 for v in seed)))
    return voxels.select("x", "y", "z") if not start.isEmpty() else union(voxels, flood_cells(voxels, seed, lower, upper))


def noise_sphere(voxels: DataFrame, centre: tuple, radius: float, resolution: int, seed: int = 0, add: bool = True, share: float = 0.5) -> DataFrame:
    """A sphere edit of a hashed share of its voxels, equal on every run and partitioning."""
    ball = sphere_voxels(voxels.sparkSession, centre, radius, resolution)
    uniform = F.pmod(F.xxhash64(F.lit(seed), "x", "y", "z"), F.lit(1 << 20)) / float(1 << 20)
    chosen = ball.where(uniform < share)
    return union(voxels, chosen) if add else difference(voxels, chosen)


def paint(voxels: DataFrame, centre: tuple, radius: float, material: int) -> DataFrame:
    """``voxels`` (x, y, z, material) with the material of a sphere replaced."""
    return voxels.withColumn("material", F.when(in_sphere(centre, radius), F.lit(material)).otherwise(F.col("material")))


# --- level-wise edits -------------------------------------------------------------

def classify_nodes(nodes: DataFrame, level: Column, inside: Callable[[Column, Column], Column], outside: Callable[[Column, Column], Column]) -> Column:
    """``fill``, ``keep`` or ``subdivide`` of nodes (x, y, z lower corners) against a region.

    ``inside(corner struct, size)`` and ``outside`` are the region's full-cover and no-overlap tests.
    """
    size = F.call_function("shiftleft", F.lit(1), level)
    at = F.struct("x", "y", "z")
    return F.when(outside(at, size), "keep").when(inside(at, size), "fill").otherwise("subdivide")


def box_region(lower: tuple, upper: tuple):
    """(inside, outside) tests of a box for ``classify_nodes``."""

    def inside(at: Column, size: Column) -> Column:
        out = F.lit(True)
        for c, a, b in zip("xyz", lower, upper, strict=True):
            out = out & (at[c] >= a) & (at[c] + size <= b)
        return out

    def outside(at: Column, size: Column) -> Column:
        out = F.lit(False)
        for c, a, b in zip("xyz", lower, upper, strict=True):
            out = out | (at[c] >= b) | (at[c] + size <= a)
        return out

    return inside, outside


def sphere_region(centre: tuple, radius: float):
    """(inside, outside) tests of a sphere of voxel centres."""

    def distances(at: Column, size: Column):
        near, far = F.lit(0.0), F.lit(0.0)
        for c, v in zip("xyz", centre, strict=True):
            lo, hi = at[c] + 0.5 - v, at[c] + size - 0.5 - v
            gap = F.greatest(lo, -hi, F.lit(0.0))
            reach = F.greatest(F.abs(lo), F.abs(hi))
            near, far = near + gap * gap, far + reach * reach
        return near, far

    return (lambda at, size: distances(at, size)[1] < radius * radius), (lambda at, size: distances(at, size)[0] >= radius * radius)


def expand_edit(spark: SparkSession, root: int, region, stop: int = 2) -> DataFrame:
    """(level, x, y, z, verdict): the nodes an edit decides, from the root down to level ``stop``."""
    inside, outside = region
    level_nodes = spark.createDataFrame([(0, 0, 0)], "x long, y long, z long")
    out = None
    for level in range(root, stop - 1, -1):
        judged = level_nodes.withColumn("level", F.lit(level)).withColumn("verdict", classify_nodes(level_nodes, F.lit(level), inside, outside))
        judged = stored(judged, "edit-level")
        settled = judged if level == stop else judged.where("verdict <> 'subdivide'")
        out = settled if out is None else out.unionByName(settled)
        if level == stop:
            break
        half = 1 << (level - 1)
        split = judged.where("verdict = 'subdivide'").withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(7))))
        level_nodes = split.select(*[(F.col(c) + F.shiftright("s", i).bitwiseAND(F.lit(1)) * half).alias(c) for i, c in enumerate("xyz")])
    return out.select("level", "x", "y", "z", "verdict")


def new_items(items: DataFrame, known: DataFrame, content: list[str]) -> DataFrame:
    """Distinct contents of ``items`` that ``known`` lacks (find or insert: what is inserted)."""
    return items.select(*content).distinct().join(known.select(*content), content, "left_anti")


# --- versions ---------------------------------------------------------------------

@dataclass
class Versions:
    """An append-only store of edits with undo and redo: leaves, and materials where voxels have them.

    A version keeps the leaves it changed and the materials it changed (of voxels that are
    new or painted); a state is the last entry of each on the version's path.
    """

    base: DataFrame
    log: list[DataFrame] = field(default_factory=list)
    at: int = 0
    materials: DataFrame | None = None
    painted: list[DataFrame] = field(default_factory=list)

    @classmethod
    def of(cls, voxels: DataFrame) -> "Versions":
        has = "material" in voxels.columns
        return cls(stored(leaves(voxels), "version-base"), materials=stored(voxels.select("x", "y", "z", "material"), "version-materials") if has else None)

    def _last(self, base: DataFrame, log: list[DataFrame], key: list[str], values: list[str]) -> DataFrame:
        if not log:
            return base
        rows = reduce(DataFrame.unionByName, (part.withColumn("version", F.lit(i)) for i, part in enumerate([base, *log])))
        return rows.groupBy(*key).agg(F.max_by(F.struct(*values), "version").alias("v")).select(*key, "v.*")

    def state(self, version: int | None = None) -> DataFrame:
        """(tile, lo, hi) of a version (the current one by default)."""
        n = self.at if version is None else version
        return self._last(self.base, self.log[:n], ["tile"], ["lo", "hi"]).where("lo <> 0 or hi <> 0")

    def voxels(self, version: int | None = None) -> DataFrame:
        """(x, y, z) and, where there are materials, material."""
        n = self.at if version is None else version
        found = voxels_of_leaves(self.state(n))
        if self.materials is None:
            return found
        return found.join(dealt(self._last(self.materials, self.painted[:n], ["x", "y", "z"], ["material"])), ["x", "y", "z"])

    def commit(self, edited: DataFrame, now: DataFrame | None = None) -> int:
        """Record in what the voxel set ``edited`` differs (from ``now``, the current voxels, if they are at hand); drops what was undone."""
        new, old = leaves(edited), self.state() if now is None else leaves(now)
        both = new.select("tile", F.struct("lo", "hi").alias("n")).join(old.select("tile", F.struct("lo", "hi").alias("o")), "tile", "full")
        changed = both.where(~F.col("n").eqNullSafe(F.col("o"))).select("tile", F.coalesce("n.lo", F.lit(0).cast("long")).alias("lo"), F.coalesce("n.hi", F.lit(0).cast("long")).alias("hi"))
        if self.materials is not None:
            before = (self.voxels() if now is None else now).withColumnRenamed("material", "was")
            colors = edited.select("x", "y", "z", "material").join(dealt(before), ["x", "y", "z"], "left").where(~F.col("material").eqNullSafe(F.col("was")))
            self.painted = [*self.painted[: self.at], stored(colors.drop("was"), "version-materials")]
        self.log = [*self.log[: self.at], stored(changed, "version")]
        self.at += 1
        return self.at

    def undo(self) -> int:
        self.at = max(0, self.at - 1)
        return self.at

    def redo(self) -> int:
        self.at = min(len(self.log), self.at + 1)
        return self.at

    def collected(self) -> "Versions":
        """Only what the current version reaches."""
        return Versions(stored(self.state(), "version-base"), materials=None if self.materials is None else stored(self.voxels(), "version-materials"))

    def summary(self) -> DataFrame:
        """(version, changed_leaves, changed_materials) of the log; version 0 is the base."""
        out = None
        for i, part in enumerate([self.base, *self.log]):
            colors = None if self.materials is None else [self.materials, *self.painted][i]
            row = part.agg(F.count("*").alias("changed_leaves")).select(F.lit(i).alias("version"), "changed_leaves")
            row = row.withColumn("changed_materials", F.lit(0).cast("long")) if colors is None else row.crossJoin(F.broadcast(colors.agg(F.count("*").alias("changed_materials"))))
            out = row if out is None else out.unionByName(row)
        return out


def check_leaves(state: DataFrame) -> DataFrame:
    """(tile, fault): leaves that are empty, repeated or out of range."""
    bad = state.groupBy("tile").agg(F.count("*").alias("n"), F.max(m.popcount()).alias("bits"), F.min(F.least("lo", "hi")).alias("least"), F.max(F.greatest("lo", "hi")).alias("most"))
    fault = F.when(F.col("n") > 1, "repeated").when(F.col("bits") == 0, "empty").when((F.col("least") < 0) | (F.col("most") >= 1 << 32), "range")
    return bad.select("tile", fault.alias("fault")).where("fault is not null")


# --- replay -----------------------------------------------------------------------

#: Actions that change the voxel set.
EDITS = ("sphere", "box", "copy", "fill", "paint", "erode")


def apply_edit(voxels: DataFrame, e: dict, resolution: int, scale: float = 1.0) -> DataFrame:
    """One edit on voxels (x, y, z, material); coordinates are multiplied by ``scale``.

    A region holds the voxels whose cube it touches.  Added and painted voxels take the
    edit's material, also where a voxel was; filled ones take 0 unless the edit has one.
    """
    spark = voxels.sparkSession
    p = lambda *names: tuple(float(e.get(n) or 0.0) * scale for n in names)
    kind, centre, radius = e["action"], p("x", "y", "z"), float(e.get("radius") or 0.0) * scale
    material = F.lit(int(e.get("material") or 0)).alias("material")
    if kind == "copy":
        period = e["period"] if e.get("swirl") else None
        return copy_transformed(voxels, p("sx", "sy", "sz"), p("dx", "dy", "dz"), centre, radius, resolution, e.get("matrix"), period)
    if kind == "fill":
        lower = tuple(floor(v - radius) for v in centre)
        side = 2 * ceil(radius)
        box = tuple(max(0, a) for a in lower), tuple(min(resolution, a + side) for a in lower)
        cells = flood_cells(voxels, tuple(a + side // 2 for a in lower), *box)
        return voxels.unionByName(cells.join(dealt(voxels.select("x", "y", "z")), ["x", "y", "z"], "left_anti").withColumn("material", material))
    inside = (touched_by_box if kind == "box" else touched_by_sphere)(centre, radius)
    if kind == "paint":
        return voxels.withColumn("material", F.when(inside, material).otherwise(F.col("material")))
    if kind == "erode":
        counts = neighbour_counts(voxels).where(F.col("neighbours") >= (e.get("min_neighbors") or 14))
        return voxels.where(~inside).unionByName(voxels.where(inside).join(dealt(counts.select("x", "y", "z")), ["x", "y", "z"], "left_semi"))
    if kind not in EDITS:
        raise ValueError(f"{kind!r} is no edit")
    rest = voxels.where(~inside)
    return rest.unionByName(cells_about(spark, centre, radius, resolution).where(inside).withColumn("material", material)) if e.get("add") else rest


def replay(voxels: DataFrame, edits: DataFrame, resolution: int, scale: float = 1.0) -> Versions:
    """Apply an ordered edit log: a version an edit; ``undo`` and ``redo`` move in the versions, other actions change nothing.

    The log is a list of commands, read to the driver a row at a time; the sets stay in
    Spark.  A row with a fault stops the replay before anything is applied.  Voxels
    without materials have material 0.
    """
    if "fault" in edits.columns:
        bad = edits.where("fault is not null").orderBy("seq").select("seq", "action", "fault").first()
        if bad is not None:
            raise ValueError(f"row {bad['seq']} of the log ({bad['action']}) has a fault: {bad['fault']}")
    now = stored(voxels if "material" in voxels.columns else voxels.withColumn("material", F.lit(0)), "replay")
    versions = Versions.of(now)
    for row in edits.orderBy("seq").toLocalIterator():
        e = row.asDict()
        if e["action"] in ("undo", "redo"):
            getattr(versions, e["action"])()
            after = stored(versions.voxels(), "replay")
        elif e["action"] in EDITS:
            after = stored(apply_edit(now, e, resolution, scale), "replay")
            versions.commit(after, now)
        else:
            continue
        discard(now)
        now = after
    discard(now)
    return versions


def voxel_window(voxels: DataFrame) -> DataFrame:
    """(x, y, z, gap): distance along x to the previous voxel of the row, null for the first."""
    return voxels.withColumn("gap", F.col("x") - F.lag("x").over(W.partitionBy("y", "z").orderBy("x")))
