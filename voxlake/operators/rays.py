"""Ray queries: first hit, any hit, occlusion, shadows, shading and path tracing.

Rays and voxels meet by tile: a ray walks the tiles it crosses, tiles are equi-joined with
the leaves' 4x4x4 masks that are there, and the exact entry distances decide, the least by
ray.  No structure is broadcast, so scenes and ray sets of any size are dealt out by tile.
A ray's way is walked in two parts, a short one first: in a dense scene most rays end there,
and only the others walk on.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from voxlake.functions import morton as m
from voxlake.operators.octree import leaves
from voxlake.storage import stored

_RAY = ["ox", "oy", "oz", "dx", "dy", "dz", "tmin", "tmax"]


def _tiles_walked(size: int, resolution: int, part: tuple[float, float]):
    """A mapper from rays to (ray, tile) rows: the cells of ``size`` that a ray crosses, by distance steps between cell faces.

    ``part`` is the stretch of its way that a ray walks, in voxels from where it enters the
    grid; the rows' tmin and tmax are those of the stretch.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for at in range(0, len(f), 512):
                rays = f.iloc[at : at + 512]
                o = rays[["ox", "oy", "oz"]].to_numpy(dtype=np.float64)
                d = rays[["dx", "dy", "dz"]].to_numpy(dtype=np.float64)
                t0, t1 = _clip(o, d, rays["tmin"].to_numpy(dtype=np.float64), rays["tmax"].to_numpy(dtype=np.float64), 0.0, float(resolution))
                a_unit = 1 / np.maximum(np.linalg.norm(d, axis=1), 1e-300)
                t0, t1 = t0 + part[0] * a_unit, np.minimum(t1, t0 + part[1] * a_unit)
                live = np.flatnonzero(t0 <= t1)
                planes = np.arange(0, resolution + size, size, dtype=np.float64)
                with np.errstate(divide="ignore", invalid="ignore"):
                    ts = (planes[None, None, :] - o[live][:, :, None]) / d[live][:, :, None]
                ts = np.where(np.isfinite(ts), ts, np.inf).reshape(len(live), 3 * len(planes))
                ts = np.clip(ts, t0[live][:, None], t1[live][:, None])
                ts = np.sort(np.concatenate([t0[live][:, None], ts, t1[live][:, None]], axis=1), axis=1)
                lo, hi = ts[:, :-1], ts[:, 1:]
                step = hi > lo + 1e-12
                step[:, 0] |= ~step.any(axis=1)
                r, k = np.nonzero(step)
                mid = (lo[r, k] + hi[r, k]) / 2
                cell = np.floor((o[live][r] + d[live][r] * mid[:, None]) / size).astype(np.int64)
                ok = ((cell >= 0) & (cell < -(-resolution // size))).all(axis=1)
                rows = np.unique(np.column_stack([live[r][ok], cell[ok]]), axis=0) if ok.any() else np.zeros((0, 4), int)
                made = rays.iloc[rows[:, 0]][["ray_id", *_RAY]].reset_index(drop=True)
                out.append(made.assign(tmin=t0[rows[:, 0]], tmax=t1[rows[:, 0]], cx=rows[:, 1], cy=rows[:, 2], cz=rows[:, 3]))
            if out:
                yield pd.concat(out)

    return run


def _clip(o, d, t0, t1, lower, upper):
    with np.errstate(divide="ignore", invalid="ignore"):
        a, b = (lower - o) / d, (upper - o) / d
    flat = d == 0
    near = np.where(flat, np.where((o >= lower) & (o <= upper), -np.inf, np.inf), np.minimum(a, b))
    far = np.where(flat, np.where((o >= lower) & (o <= upper), np.inf, -np.inf), np.maximum(a, b))
    return np.maximum(t0, near.max(axis=1)), np.minimum(t1, far.min(axis=1))


def _entries(tiles: DataFrame, leaf: DataFrame) -> DataFrame:
    """(ray_id, x, y, z, t, axis): the nearest voxels a ray enters, one at least of all tiles that a batch holds of it."""
    leaf = leaf.select(F.col("tile").alias("_tile"), "lo", "hi")
    at = m.morton3("cx", "cy", "cz")
    met = tiles.withColumn("_key", at).join(leaf, F.col("_key") == F.col("_tile"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.arange(64)
        local = np.stack([sum((bits >> 3 * k + a & 1) << k for k in (0, 1)) for a in range(3)], axis=1)
        for f in frames:
            for begin in range(0, len(f), 2048):
                p = f.iloc[begin : begin + 2048]
                mask = p["lo"].to_numpy(np.uint64) | p["hi"].to_numpy(np.uint64) << np.uint64(32)
                r, b = np.nonzero((mask[:, None] >> bits.astype(np.uint64)) & np.uint64(1))
                cell = p[["cx", "cy", "cz"]].to_numpy(np.int64)[r] * 4 + local[b]
                o, d = p[["ox", "oy", "oz"]].to_numpy(float)[r], p[["dx", "dy", "dz"]].to_numpy(float)[r]
                lo, hi = cell.astype(float), cell + 1.0
                with np.errstate(divide="ignore", invalid="ignore"):
                    a, c = (lo - o) / d, (hi - o) / d
                flat = d == 0
                within = (o >= lo) & (o < hi)
                near = np.where(flat, np.where(within, -np.inf, np.inf), np.minimum(a, c))
                far = np.where(flat, np.where(within, np.inf, -np.inf), np.maximum(a, c))
                t0 = np.maximum(near.max(axis=1), p["tmin"].to_numpy(float)[r])
                t1 = np.minimum(far.min(axis=1), p["tmax"].to_numpy(float)[r])
                ok = t0 < t1
                axis = near.argmax(axis=1)
                ray, cell, t0, axis = p["ray_id"].to_numpy()[r][ok], cell[ok], t0[ok], axis[ok]
                order = np.lexsort((cell[:, 2], cell[:, 1], cell[:, 0], t0, ray))
                best = order[np.concatenate(([True], ray[order][1:] != ray[order][:-1]))] if len(order) else order
                yield pd.DataFrame({"ray_id": ray[best], "x": cell[best, 0], "y": cell[best, 1], "z": cell[best, 2], "t": t0[best], "axis": axis[best].astype(np.int32)})

    return met.select("ray_id", *_RAY, "cx", "cy", "cz", "lo", "hi").mapInPandas(run, "ray_id long, x long, y long, z long, t double, axis int")


def crossed_tiles(rays: DataFrame, resolution: int, size: int = 4, part: tuple[float, float] = (0.0, float("inf"))) -> DataFrame:
    return rays.select("ray_id", *_RAY).mapInPandas(_tiles_walked(size, resolution, part), "ray_id long, " + ", ".join(f"{c} double" for c in _RAY) + ", cx long, cy long, cz long")


#: Of a grid's side, the part of their way that all rays walk first.
FIRST = 1 / 8


def first_hits(rays: DataFrame, voxels: DataFrame, resolution: int) -> DataFrame:
    """(ray_id, x, y, z, axis, t) of the nearest voxel; rays without one have no row."""
    leaf = stored(leaves(voxels), "ray-leaves")
    near = resolution * FIRST

    def hits(live: DataFrame, part: tuple[float, float]) -> DataFrame:
        best = _entries(crossed_tiles(live, resolution, part=part), leaf).groupBy("ray_id").agg(F.min(F.struct("t", "x", "y", "z", "axis")).alias("h"))
        return best.select("ray_id", "h.x", "h.y", "h.z", "h.axis", "h.t")

    soon = stored(hits(rays, (0.0, near)), "ray-hits")
    return soon.unionByName(hits(rays.join(soon.select("ray_id"), "ray_id", "left_anti"), (near, float("inf"))))


def any_hits(rays: DataFrame, voxels: DataFrame, resolution: int) -> DataFrame:
    """(ray_id, hit) of every ray."""
    hit = first_hits(rays, voxels, resolution).select("ray_id").withColumn("hit", F.lit(True))
    return rays.select("ray_id").join(hit, "ray_id", "left").select("ray_id", F.coalesce("hit", F.lit(False)).alias("hit"))


def camera_frame(eye: tuple, target: tuple, fov: float = 60.0) -> tuple[list[float], list[float], list[float], float]:
    """Right, up and forward of a pinhole camera, and half the height of its image at distance one."""
    eye_, at = np.array(eye, float), np.array(target, float)
    w = (at - eye_) / np.linalg.norm(at - eye_)
    up = np.array([0.0, 1.0, 0.0]) if abs(w[1]) < 0.99 else np.array([1.0, 0.0, 0.0])
    u = np.cross(w, up) / np.linalg.norm(np.cross(w, up))
    return u.tolist(), np.cross(u, w).tolist(), w.tolist(), float(np.tan(np.radians(fov) / 2))


def camera_rays(spark, width: int, height: int, eye: tuple, target: tuple, fov: float = 60.0, far: float = 1e6) -> DataFrame:
    """Primary rays of a pinhole camera, ray_id by row of pixels."""
    u, v, w, half = camera_frame(eye, target, fov)
    px = ((F.col("id") % width) + 0.5) / width * 2 - 1
    py = 1 - (F.floor(F.col("id") / width) + 0.5) / height * 2
    d = [F.lit(w[i]) + px * (u[i] * half * width / height) + py * (v[i] * half) for i in range(3)]
    n = F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])
    return spark.range(width * height).select(
        F.col("id").alias("ray_id"), *[F.lit(float(e)).alias(f"o{a}") for e, a in zip(eye, "xyz", strict=True)], *[(c / n).alias(f"d{a}") for c, a in zip(d, "xyz", strict=True)], F.lit(0.0).alias("tmin"), F.lit(float(far)).alias("tmax")
    )


def hit_points(rays: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits with position (px..), face normal (nx..) and the ray's direction."""
    both = hits.join(rays.select("ray_id", "ox", "oy", "oz", "dx", "dy", "dz"), "ray_id")
    normal = [F.when(F.col("axis") == i, -F.signum(f"d{a}")).otherwise(0.0).alias(f"n{a}") for i, a in enumerate("xyz")]
    return both.select(*hits.columns, "dx", "dy", "dz", *[(F.col(f"o{a}") + F.col("t") * F.col(f"d{a}")).alias(f"p{a}") for a in "xyz"], *normal)


# fixed values: step and output multiplier of the 32-bit permuted congruential generator
PCG_STEP, PCG_ADD, PCG_OUT = 747796405, 2891336453, 277803737
_WORD = (1 << 32) - 1


def _pcg(x: Column) -> Column:
    """One step and permutation of a 32-bit number, in a long."""
    cut = lambda v: v.bitwiseAND(F.lit(_WORD))
    state = cut(cut(x) * PCG_STEP + PCG_ADD)
    word = cut(F.call_function("shiftright", state, (F.shiftright(state, 28) + 4).cast("int")).bitwiseXOR(state) * PCG_OUT)
    return F.shiftright(word, 22).bitwiseXOR(word)


def uniform(seed: int, *keys: str) -> Column:
    """A number in [0, 1) by the generator over the keys' low and high halves: equal on every run and partitioning."""
    halves = [h for k in keys for h in (F.col(k).cast("long").bitwiseAND(F.lit(_WORD)), F.shiftright(F.col(k).cast("long"), 32).bitwiseAND(F.lit(_WORD)))]
    return F.aggregate(F.array(*halves), F.lit(seed).cast("long"), lambda h, k: _pcg(h + k)) / float(1 << 32)


def hemisphere(u: Column, v: Column, normal: tuple[Column, Column, Column], cosine: bool = True) -> list[Column]:
    """Directions about axis-parallel normals, cosine-weighted or uniform."""
    up = F.sqrt(F.lit(1.0) - u) if cosine else u
    across = F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - up * up))
    a, b = across * F.cos(v * 6.283185307179586), across * F.sin(v * 6.283185307179586)
    n = normal
    return [F.when(n[0] != 0, n[0] * up).otherwise(a), F.when(n[1] != 0, n[1] * up).when(n[0] != 0, a).otherwise(b), F.when(n[2] != 0, n[2] * up).otherwise(b)]


def ambient_occlusion(points: DataFrame, voxels: DataFrame, resolution: int, samples: int = 8, reach: float = 32.0, seed: int = 1) -> DataFrame:
    """(ray_id, visibility): share of a point's sample rays that meet nothing within ``reach``."""
    s = points.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))
    n = tuple(F.col(f"n{a}") for a in "xyz")
    d = hemisphere(uniform(seed, "ray_id", "sample"), uniform(seed + 1, "ray_id", "sample"), n)
    shot = s.select(
        (F.col("ray_id") * samples + F.col("sample")).alias("ray_id"), *[(F.col(f"p{a}") + F.col(f"n{a}") * 1e-3).alias(f"o{a}") for a in "xyz"], *[c.alias(f"d{a}") for c, a in zip(d, "xyz", strict=True)], F.lit(0.0).alias("tmin"), F.lit(float(reach)).alias("tmax")
    )
    hit = any_hits(shot, voxels, resolution)
    return hit.groupBy(F.floor(F.col("ray_id") / samples).alias("ray_id")).agg(F.avg(F.when(F.col("hit"), 0.0).otherwise(1.0)).alias("visibility"))


def shadows(points: DataFrame, voxels: DataFrame, resolution: int, sun: tuple) -> DataFrame:
    """(ray_id, lit): whether a point sees the sun's direction."""
    shot = points.select("ray_id", *[(F.col(f"p{a}") + F.col(f"n{a}") * 1e-3).alias(f"o{a}") for a in "xyz"], *[F.lit(float(v)).alias(f"d{a}") for v, a in zip(sun, "xyz", strict=True)], F.lit(0.0).alias("tmin"), F.lit(1e6).alias("tmax"))
    return any_hits(shot, voxels, resolution).select("ray_id", (~F.col("hit")).alias("lit"))


def shade(points: DataFrame, lit: DataFrame, visible: DataFrame, sun: tuple, fog: float = 0.0) -> DataFrame:
    """(ray_id, light): sun and sky by facing, shadow and visibility, and fog by distance."""
    facing = F.greatest(F.lit(0.0), sum((F.col(f"n{a}") * float(v) for v, a in zip(sun, "xyz", strict=True)), F.lit(0.0)))
    both = points.join(lit, "ray_id").join(visible, "ray_id")
    light = 0.7 * F.when(F.col("lit"), facing).otherwise(0.0) + 0.3 * F.col("visibility")
    return both.select("ray_id", (light * F.exp(-fog * F.col("t")) + (1 - F.exp(-fog * F.col("t")))).alias("light"))


def path_trace(rays: DataFrame, voxels: DataFrame, resolution: int, bounces: int = 2, albedo: float = 0.7, sky: float = 1.0, seed: int = 3) -> DataFrame:
    """(ray_id, light): diffuse paths; each round intersects, then keeps the paths that hit (a wavefront).

    A round's rays and hits are stored, so later rounds compute neither again.
    """
    live = rays.withColumn("weight", F.lit(1.0))
    out = rays.select("ray_id", F.lit(0.0).alias("light"))
    for k in range(bounces + 1):
        hit = stored(first_hits(live, voxels, resolution), "path-hits")
        missed = live.join(hit.select("ray_id"), "ray_id", "left_anti").select("ray_id", (F.col("weight") * sky).alias("light"))
        out = out.unionByName(missed)
        if k < bounces:
            p = hit_points(live, hit).join(live.select("ray_id", "weight"), "ray_id")
            d = hemisphere(uniform(seed + 2 * k, "ray_id"), uniform(seed + 2 * k + 1, "ray_id"), tuple(F.col(f"n{a}") for a in "xyz"))
            live = stored(p.select("ray_id", *[(F.col(f"p{a}") + F.col(f"n{a}") * 1e-3).alias(f"o{a}") for a in "xyz"], *[c.alias(f"d{a}") for c, a in zip(d, "xyz", strict=True)], F.lit(0.0).alias("tmin"), F.lit(1e6).alias("tmax"), (F.col("weight") * albedo).alias("weight")), "path-rays")
    return out.groupBy("ray_id").agg(F.sum("light").alias("light"))


def picked(rays: DataFrame, voxels: DataFrame, resolution: int) -> DataFrame:
    """First hits with the empty neighbour (ax, ay, az) across the face that was entered."""
    p = hit_points(rays, first_hits(rays, voxels, resolution))
    return p.select("ray_id", "x", "y", "z", *[(F.col(a) + F.col(f"n{a}").cast("long")).alias(f"a{a}") for a in "xyz"])


def tool_strength(centre: tuple, radius: float, cube: bool = False) -> Column:
    """Overlay strength of a tool at (px, py, pz): 1 inside, falling to 0 at twice the radius."""
    d = [F.abs(F.col(f"p{a}") - c) for a, c in zip("xyz", centre, strict=True)]
    far = F.greatest(*d) if cube else F.sqrt(sum((x * x for x in d), F.lit(0.0)))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2.0 - far / radius))
