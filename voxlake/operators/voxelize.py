"""Triangles to voxels: surfaces by exact box tests, solids by parity.

A triangle names the coarse tiles its box meets; tiles are dealt out, so a large
triangle is many tasks' work, and a tile's candidates are tested in batches.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

CORNERS = [f"{p}{a}" for p in "abc" for a in "xyz"]
EPSILON = 1e-6
#: Voxels a side of a tile.
TILE = 16


def valid_triangles(triangles: DataFrame) -> DataFrame:
    """Without null, repeated or collinear corners."""
    u = [F.col(f"b{a}") - F.col(f"a{a}") for a in "xyz"]
    v = [F.col(f"c{a}") - F.col(f"a{a}") for a in "xyz"]
    cross = [u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0]]
    return triangles.where(sum((c * c for c in cross), F.lit(0.0)) > 0)


def normalised(triangles: DataFrame, resolution: int) -> DataFrame:
    """Scaled by the longest side and moved, so that all corners lie in [0, resolution]."""
    box = triangles.agg(*[F.min(F.least(*[F.col(f"{p}{a}") for p in "abc"])).alias(f"lo_{a}") for a in "xyz"], *[F.max(F.greatest(*[F.col(f"{p}{a}") for p in "abc"])).alias(f"hi_{a}") for a in "xyz"])
    side = F.greatest(*[F.col(f"hi_{a}") - F.col(f"lo_{a}") for a in "xyz"])
    box = box.withColumn("scale", F.when(side > 0, resolution / side).otherwise(1.0))
    both = triangles.crossJoin(F.broadcast(box))  # one row
    return both.select(*[c for c in triangles.columns if c not in CORNERS], *[((F.col(f"{p}{a}") - F.col(f"lo_{a}")) * F.col("scale")).alias(f"{p}{a}") for p in "abc" for a in "xyz"])


def _span(axis: str, resolution: int, size: int = 1) -> tuple[Column, Column]:
    of = [F.col(f"{p}{axis}") for p in "abc"]
    clip = lambda v: F.least(F.lit(resolution - 1), F.greatest(F.lit(0), F.floor(v))).cast("int")
    return F.floor(clip(F.least(*of) - EPSILON) / size).cast("int"), F.floor(clip(F.greatest(*of) + EPSILON) / size).cast("int")


def tiles_of(triangles: DataFrame, resolution: int, tile: int = TILE) -> DataFrame:
    """Triangles by each coarse tile their box meets; triangles wholly outside the grid are dropped."""
    inside = F.lit(True)
    for a in "xyz":
        of = [F.col(f"{p}{a}") for p in "abc"]
        inside = inside & (F.greatest(*of) >= 0) & (F.least(*of) <= resolution)
    out = triangles.where(inside)
    for a in "xyz":
        out = out.withColumn(f"t{a}", F.explode(F.sequence(*_span(a, resolution, tile))))
    return out


def overlaps(lower: np.ndarray, tri: np.ndarray, conservative: bool = True) -> np.ndarray:
    """Whether unit cubes at ``lower`` (n, 3) meet triangles (n, 3, 3).

    Conservative: the whole cube, by separating axes.  Otherwise the cube's thin form: the
    plane passes between the cube's nearest and farthest face centres, and the projections
    hold the cube's centre cross (6-separating).
    """
    v = tri - (lower + 0.5)[:, None, :]
    e = np.roll(v, -1, axis=1) - v
    normal = np.cross(e[:, 0], e[:, 1])
    reach = (np.abs(normal).sum(axis=1) if conservative else np.abs(normal).max(axis=1)) * 0.5
    ok = np.abs((normal * v[:, 0]).sum(axis=1)) <= reach + EPSILON
    ok &= (v.min(axis=1) <= 0.5 + EPSILON).all(axis=1) & (v.max(axis=1) >= -0.5 - EPSILON).all(axis=1)
    for axis in range(3):
        i, j = (axis + 1) % 3, (axis + 2) % 3
        sign = np.where(normal[:, axis] < 0, -1.0, 1.0)
        for k in range(3):
            n = np.stack([-e[:, k, j], e[:, k, i]], axis=1) * sign[:, None]
            reach = (np.abs(n).sum(axis=1) if conservative else np.abs(n).max(axis=1)) * 0.5
            ok &= -(n[:, 0] * v[:, k, i] + n[:, 1] * v[:, k, j]) + reach >= -EPSILON
    return ok


def surface(triangles: DataFrame, resolution: int, conservative: bool = True, two_pass: bool = False) -> DataFrame:
    """(x, y, z) of the voxels that triangles (in voxel units) meet.

    With ``two_pass`` a triangle's tiles are tested first, and only those that it meets
    are searched: a large slanted triangle's box has many tiles that it does not meet.
    """
    tiled = tiles_of(valid_triangles(triangles), resolution)
    if two_pass:
        tiled = _met(tiled)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            tri = f[CORNERS].to_numpy(dtype=np.float64).reshape(-1, 3, 3)
            low = f[["tx", "ty", "tz"]].to_numpy(dtype=np.int64) * TILE
            first = np.maximum(low, np.floor(tri.min(axis=1) - EPSILON).astype(np.int64))
            last = np.minimum(np.minimum(low + TILE - 1, resolution - 1), np.floor(tri.max(axis=1) + EPSILON).astype(np.int64))
            size = np.maximum(0, last - first + 1)
            count = size.prod(axis=1)
            for at in range(0, len(f), 256):  # a tile has TILE^3 candidates at most
                c = count[at : at + 256]
                own = np.repeat(np.arange(at, at + len(c)), c)
                inside = np.arange(len(own)) - np.repeat(np.cumsum(c) - c, c)
                s = size[own]
                cell = first[own] + np.stack([inside % s[:, 0], inside // s[:, 0] % s[:, 1], inside // (s[:, 0] * s[:, 1])], axis=1) if len(own) else np.zeros((0, 3), int)
                hit = cell[overlaps(cell.astype(np.float64), tri[own], conservative)] if len(own) else cell
                if len(hit):
                    yield pd.DataFrame(np.unique(hit, axis=0), columns=list("xyz"))

    return tiled.select(*CORNERS, "tx", "ty", "tz").mapInPandas(run, "x long, y long, z long").distinct()


def _met(tiled: DataFrame) -> DataFrame:
    """The rows of ``tiles_of`` whose tile's cube the triangle meets."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            tri = f[CORNERS].to_numpy(dtype=np.float64).reshape(-1, 3, 3) / TILE
            yield f[overlaps(f[["tx", "ty", "tz"]].to_numpy(dtype=np.float64), tri)] if len(f) else f

    return tiled.select(*CORNERS, "tx", "ty", "tz").mapInPandas(run, tiled.select(*CORNERS, "tx", "ty", "tz").schema)


def coarse_tiles(triangles: DataFrame, resolution: int, tile: int = TILE) -> DataFrame:
    """(x, y, z) of the tiles that the surface meets: the first of two passes."""
    scaled = triangles.select(*[(F.col(c) / tile).alias(c) for c in CORNERS])
    return surface(scaled, -(-resolution // tile), conservative=True)


def crossings(triangles: DataFrame, resolution: int) -> DataFrame:
    """(x, y, z): cells from which on a row's inside flips, once a crossing.

    Along x at each row's centre (y + 1/2, z + 1/2); an edge belongs to one of the two
    triangles that share it by the sign of its direction, so closed meshes flip evenly.
    """
    rows = valid_triangles(triangles)
    for a in "yz":
        of = [F.col(f"{p}{a}") for p in "abc"]
        first = F.greatest(F.lit(0), F.ceil(F.least(*of) - 0.5)).cast("int")
        last = F.least(F.lit(resolution - 1), F.floor(F.greatest(*of) - 0.5)).cast("int")
        rows = rows.where(first <= last).withColumn(a, F.explode(F.sequence(first, last)))
    py, pz = F.col("y") + 0.5, F.col("z") + 0.5

    def side(p: str, q: str) -> Column:
        return (F.col(f"{q}y") - F.col(f"{p}y")) * (pz - F.col(f"{p}z")) - (F.col(f"{q}z") - F.col(f"{p}z")) * (py - F.col(f"{p}y"))

    def owned(p: str, q: str) -> Column:
        dy, dz = F.col(f"{q}y") - F.col(f"{p}y"), F.col(f"{q}z") - F.col(f"{p}z")
        return (dz > 0) | ((dz == 0) & (dy < 0))

    area = (F.col("by") - F.col("ay")) * (F.col("cz") - F.col("az")) - (F.col("bz") - F.col("az")) * (F.col("cy") - F.col("ay"))
    test = lambda s: F.lit(True) if s is None else s
    ahead, behind = test(None), test(None)
    for p, q in (("a", "b"), ("b", "c"), ("c", "a")):
        w = side(p, q)
        ahead = ahead & ((w > 0) | ((w == 0) & owned(p, q)))
        behind = behind & ((w < 0) | ((w == 0) & owned(q, p)))
    inside = F.when(area > 0, ahead).when(area < 0, behind).otherwise(False)
    wa, wb, wc = side("b", "c") / area, side("c", "a") / area, side("a", "b") / area
    hit = wa * F.col("ax") + wb * F.col("bx") + wc * F.col("cx")
    cut = rows.where(area != 0).where(inside).select(F.greatest(F.lit(0), F.ceil(hit - 0.5)).cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("z").cast("long").alias("z"))
    return cut.where(F.col("x") < resolution)


def parity_fill(flips: DataFrame, resolution: int) -> DataFrame:
    """(x, y, z) of the cells inside: between an odd flip and the next of its row (or the grid's end)."""
    odd = flips.groupBy("x", "y", "z").agg((F.count("*") % 2).alias("odd")).where("odd = 1")
    row = W.partitionBy("y", "z").orderBy("x")
    spans = odd.select("x", "y", "z", F.row_number().over(row).alias("n"), F.lead("x", 1, resolution).over(row).alias("next")).where("n % 2 = 1")
    return spans.select(F.explode(F.sequence("x", F.col("next") - 1)).alias("x"), "y", "z")


def solid(triangles: DataFrame, resolution: int) -> DataFrame:
    """(x, y, z) of the voxels whose centres a closed mesh holds."""
    return parity_fill(crossings(triangles, resolution), resolution)


def faces_mesh(faces: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vertices, quads) of exposed faces: four corners a face, shared by place.

    vertices (vx, vy, vz); quads (x, y, z, nx, ny, nz, corners array<struct>), corners in order round the face.
    """
    axis = F.when(F.col("nx") != 0, 0).when(F.col("ny") != 0, 1).otherwise(2)
    out = []
    for a in range(3):
        b, c = (a + 1) % 3, (a + 2) % 3
        high = F.col(f"n{'xyz'[a]}") > 0
        corners = []
        for s, t in ((0, 0), (1, 0), (1, 1), (0, 1)):
            off = {a: F.when(high, 1).otherwise(0), b: F.when(high, s).otherwise(t), c: F.when(high, t).otherwise(s)}
            corners.append(F.struct(*[(F.col("xyz"[k]) + off[k]).cast("long").alias(f"v{'xyz'[k]}") for k in range(3)]))
        out.append(faces.where(axis == a).select("x", "y", "z", "nx", "ny", "nz", F.array(*corners).alias("corners")))
    quads = out[0].unionByName(out[1]).unionByName(out[2])
    return quads.select(F.explode("corners").alias("v")).select("v.*").distinct(), quads


def closest_barycentric(p: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Barycentric weights of the nearest point of triangle (a, b, c) to ``p`` within its plane, clamped to the triangle."""
    v0 = [F.col(f"b{a}") - F.col(f"a{a}") for a in "xyz"]
    v1 = [F.col(f"c{a}") - F.col(f"a{a}") for a in "xyz"]
    v2 = [x - F.col(f"a{a}") for x, a in zip(p, "xyz", strict=True)]
    dot = lambda u, v: sum((i * j for i, j in zip(u, v, strict=True)), F.lit(0.0))
    d00, d01, d11, d20, d21 = dot(v0, v0), dot(v0, v1), dot(v1, v1), dot(v2, v0), dot(v2, v1)
    scale = d00 * d11 - d01 * d01
    v = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (d11 * d20 - d01 * d21) / scale))
    w = F.greatest(F.lit(0.0), F.least(F.lit(1.0) - v, (d00 * d21 - d01 * d20) / scale))
    return F.lit(1.0) - v - w, v, w
