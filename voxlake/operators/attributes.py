"""Values on voxels: packed by rank within their leaf, looked up, mapped, and as colours.

A leaf keeps its mask and an array of its voxels' values in order of their bits, so a value
stands at the rank of its bit, and no key is kept for a voxel.
"""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions import hashes
from voxlake.functions import morton as m


def packed(voxels: DataFrame, value: str = "material") -> DataFrame:
    """(tile, lo, hi, values) of (x, y, z, value); repeated voxels take their least value."""
    one = voxels.groupBy("x", "y", "z").agg(F.min(value).alias("v"))
    keyed = one.select(m.morton3().alias("_m"), "v").select(m.ascend("_m", 2).alias("tile"), F.pmod("_m", F.lit(64)).alias("bit"), "v")
    lo, hi = m.lo_hi(F.col("bit"))
    kids = keyed.withColumns({"lo": lo, "hi": hi}).groupBy("tile").agg(F.bit_or("lo").alias("lo"), F.bit_or("hi").alias("hi"), F.sort_array(F.collect_list(F.struct("bit", "v"))).alias("vs"))  # 64 at most
    return kids.select("tile", "lo", "hi", F.transform("vs", lambda x: x.v).alias("values"))


def unpacked(leaves: DataFrame, value: str = "material") -> DataFrame:
    """(x, y, z, value) of packed leaves."""
    bits = leaves.select("tile", "lo", "hi", "values", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit")).where(m.has_bit(F.col("bit")))
    key = F.shiftleft("tile", 6).bitwiseOR(F.col("bit").cast("long"))
    held = F.element_at("values", (m.rank(F.col("bit")) + 1).cast("int"))
    return bits.select(key.alias("morton"), held.alias(value)).select(*[c.alias(n) for c, n in zip(m.unmorton3(), "xyz", strict=True)], value)


def looked_up(queries: DataFrame, leaves: DataFrame, value: str = "material") -> DataFrame:
    """``queries`` (x, y, z) with the voxel's value, null where none is."""
    q = queries.withColumn("_m", m.morton3())
    bit = F.pmod(F.col("_m"), F.lit(64))
    both = q.join(leaves, m.ascend("_m", 2) == F.col("tile"), "left")
    return both.select(*[q[c] for c in queries.columns], F.when(m.has_bit(bit), F.element_at("values", (m.rank(bit) + 1).cast("int"))).alias(value))


def mapped(leaves: DataFrame, f: Callable[[Column], Column]) -> DataFrame:
    """Every value under ``f``; masks stay."""
    return leaves.withColumn("values", F.transform("values", f))


def stripped(leaves: DataFrame) -> DataFrame:
    """Leaves without their values."""
    return leaves.select("tile", "lo", "hi")


def binarised(leaves: DataFrame, holds: Callable[[Column], Column]) -> DataFrame:
    """(tile, lo, hi): the voxels whose value satisfies ``holds``; leaves without any go."""
    found = unpacked(leaves, "_v").where(holds(F.col("_v")))
    from voxlake.operators.octree import leaves as leaves_of

    return leaves_of(found.select("x", "y", "z"))


def deduplicated(leaves: DataFrame) -> DataFrame:
    """(lo, hi, values, id, uses): leaves equal in mask and values share the least tile as id."""
    return leaves.groupBy("lo", "hi", "values").agg(F.min("tile").alias("id"), F.count("*").alias("uses"))


# --- surfaces ---------------------------------------------------------------------

def face_of(nx: Column, ny: Column, nz: Column) -> Column:
    """0 to 5: -x, +x, -y, +y, -z, +z."""
    return F.when(nx != 0, F.when(nx > 0, 1).otherwise(0)).when(ny != 0, F.when(ny > 0, 3).otherwise(2)).otherwise(F.when(nz > 0, 5).otherwise(4))


def surface_colors(points: DataFrame, materials: DataFrame, faces: DataFrame) -> DataFrame:
    """``points`` (x, y, z, nx, ny, nz) with material and the colour (r, g, b) of its face there.

    ``faces`` has (material, face, r, g, b); a face without a colour is white.
    """
    held = looked_up(points.withColumn("face", face_of(F.col("nx"), F.col("ny"), F.col("nz"))), materials)
    both = held.join(faces, ["material", "face"], "left")
    return both.select(*points.columns, "material", *[F.coalesce(F.col(c), F.lit(1.0)).alias(c) for c in "rgb"])


#: Colourings of voxels for looking at a structure.
DEBUG_MODES = ("index", "position", "tree", "depth", "material")


def debug_colors(voxels: DataFrame, mode: str, resolution: int) -> DataFrame:
    """(x, y, z, color): a 24-bit colour by the voxel's place, its leaf, its depth or its material."""
    if mode not in DEBUG_MODES:
        raise ValueError(f"modes are {', '.join(DEBUG_MODES)}")
    scaled = lambda c: F.floor(F.col(c) * 255 / max(1, resolution - 1)).cast("long")
    key = m.morton3()
    by = {
        "index": lambda: hashes.finalized(hashes.word(key)).bitwiseAND(F.lit(0xFFFFFF)),
        "position": lambda: scaled("x") + scaled("y") * 256 + scaled("z") * 65536,
        "tree": lambda: hashes.finalized(hashes.word(m.ascend(key, 2))).bitwiseAND(F.lit(0xFFFFFF)),
        "depth": lambda: scaled("z") * 0x010101,
        "material": lambda: hashes.finalized(hashes.word(F.col("material"))).bitwiseAND(F.lit(0xFFFFFF)),
    }
    return voxels.select("x", "y", "z", by[mode]().alias("color"))
