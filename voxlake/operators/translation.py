"""Items that are crops of shifted items: dedup by translation.

``out[v] = in[v - t]``, voxels that fall outside are dropped; so "a can rebuild b" is
directional.  A shift crops a parent on one side of each axis; seen from the octant of
those sides, the child is the parent's part from the shift's cell to the far corner.  A
running hash over each axis gives that part's signature for every cell at once, the
child's own is that of its whole grid, and the two are joined.  Only the least parent of
a signature is joined, parents in order of falling population, then id, so a signature
that all parents share (one voxel) is an aggregate, not a product.  The parent's rows are
dropped at once where a bitmap of fixed size holds no child's signature.

Each child's best parent (itself at least) is verified by rebuilding the child; should two
contents ever share a signature, the child stands for itself.  A child whose best parent
is not kept itself resolves one step only: kept are items without another parent, and
items that are someone's parent.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxlake.functions import symmetries as s
from voxlake.operators.dag import ranked
from voxlake.storage import stored

#: Salt of the signature hash, and the 64-bit words that it is taken in.
MIX, _WHOLE = 0x9E3779B97F4A7C15, (1 << 64) - 1
#: An odd multiplier an axis.  They are drawn, as multiples of one number by small ones let sums of different cells agree.
AXES = [int(k) | 1 for k in np.random.default_rng(MIX).integers(1 << 62, 1 << 63, size=3)]


def grids_of_leaves(leaf: DataFrame) -> DataFrame:
    """(id, side, cells binary): 4x4x4 grids of (id, lo, hi); cells are z, y, x rows of bits, packed."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "side": np.int32(4), "cells": [packed(leaf_grid(int(a), int(b))) for a, b in zip(f["lo"], f["hi"], strict=True)]})

    return leaf.select("id", "lo", "hi").mapInPandas(run, "id long, side int, cells binary")


def leaf_grid(lo: int, hi: int) -> np.ndarray:
    mask = lo | hi << 32
    out = np.zeros((4, 4, 4), dtype=bool)  # [x, y, z]
    for b in range(64):
        if mask >> b & 1:
            out[tuple(sum((b >> 3 * k + i & 1) << k for k in (0, 1)) for i in range(3))] = True
    return out


def packed(grid: np.ndarray) -> bytes:
    return np.packbits(grid.transpose(2, 1, 0).ravel(), bitorder="little").tobytes()


def unpacked(cells: bytes, side: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(cells, np.uint8), bitorder="little")[: side**3].reshape(side, side, side).transpose(2, 1, 0).astype(bool)


def grid_of_children(kids: list[np.ndarray | None]) -> np.ndarray:
    """A node's dense grid from its eight children's."""
    side = next(k.shape[0] for k in kids if k is not None)
    out = np.zeros((2 * side,) * 3, dtype=bool)
    for i, k in enumerate(kids):
        if k is not None:
            x, y, z = (side * (i >> a & 1) for a in range(3))
            out[x : x + side, y : y + side, z : z + side] = k
    return out


def children_of_grid(grid: np.ndarray) -> list[np.ndarray | None]:
    """The eight child grids; None for an empty one."""
    side = grid.shape[0] // 2
    parts = []
    for i in range(8):
        x, y, z = (side * (i >> a & 1) for a in range(3))
        part = grid[x : x + side, y : y + side, z : z + side]
        parts.append(part if part.any() else None)
    return parts


def flattened(dag, level: int) -> DataFrame:
    """(id, side, cells) of the distinct nodes of ``level`` (at most 4, 16 voxels a side): joins down, then grids."""
    if level == 2:
        return grids_of_leaves(dag.nodes[2])
    if level > 4:
        raise ValueError("grids are flattened up to level 4")
    below = flattened(dag, level - 1).select(F.col("id").alias("child"), "side", "cells")
    kids = dag.edges(level).join(below, "child").groupBy(F.col("parent").alias("id")).agg(F.first("side").alias("side"), F.collect_list(F.struct("slot", "cells")).alias("kids"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            cells = []
            for side, own in zip(f["side"], f["kids"], strict=True):
                grids = [None] * 8
                for k in own:
                    grids[k["slot"]] = unpacked(k["cells"], side)
                cells.append(packed(grid_of_children(grids)))
            yield pd.DataFrame({"id": f["id"], "side": f["side"] * 2, "cells": cells})

    return kids.mapInPandas(run, "id long, side int, cells binary")


def transformed_grid(grid: np.ndarray, g: int) -> np.ndarray:
    """Axes in order, then mirrors."""
    out = grid.transpose(s.ORDERS[g >> 3])
    for a in range(3):
        if g >> a & 1:
            out = np.flip(out, a)
    return out


def shifted_grid(grid: np.ndarray, t: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros_like(grid)
    n = grid.shape[0]
    to = tuple(slice(max(0, v), min(n, n + v)) for v in t)
    come = tuple(slice(max(0, -v), min(n, n - v)) for v in t)
    out[to] = grid[come]
    return out


def suffix_signatures(grids: np.ndarray) -> np.ndarray:
    """Of (n, side, side, side) grids, the hash of the box from each voxel to the far corner; 0 where that is empty.

    The running hash of an axis is a polynomial in the distance from the voxel, so equal
    contents seen from two voxels hash alike, whatever lies behind them.
    """
    h = grids.astype(np.uint64)
    for axis, k in enumerate(map(np.uint64, AXES), 1):
        h = np.moveaxis(h, axis, 0).copy()
        for i in range(h.shape[0] - 2, -1, -1):
            h[i] = h[i] + k * h[i + 1]
        h = np.moveaxis(h, 0, axis)
    return h


def _views(cells: list[bytes], side: int, orders: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(axis order, flips, signatures of all grids so turned)."""
    grids = np.stack([unpacked(c, side) for c in cells])
    for order in orders:
        turned = grids.transpose(0, *(1 + a for a in s.ORDERS[order]))
        for flips in range(8):
            view = turned
            for a in range(3):
                if flips >> a & 1:
                    view = np.flip(view, a + 1)
            yield order, flips, suffix_signatures(view)


def _keyed(signatures: np.ndarray, octant: int) -> np.ndarray:
    """Signatures with their octant mixed in, as signed longs."""
    return ((signatures ^ np.uint64(MIX * (octant + 1) & _WHOLE)) * np.uint64(MIX)).view(np.int64)


#: Bits of the bitmap of children's signatures.
BITMAP = 1 << 26


def _places(keys: np.ndarray) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - 26)).astype(np.int64)


def child_signatures(grids: DataFrame, side: int) -> DataFrame:
    """(id, octant, signature) of whole grids, eight rows an item."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if len(f):
                yield pd.concat([pd.DataFrame({"id": f["id"], "octant": np.int32(o), "signature": _keyed(sig[:, 0, 0, 0].copy(), o)}) for _, o, sig in _views(f["cells"].tolist(), side, [0])])

    return grids.mapInPandas(run, "id long, octant int, signature long")


def _bitmap(children: DataFrame) -> bytes:
    """A bit for every value of the signatures' leading bits; 8 MB at any size."""
    word = F.floor(F.expr("shiftrightunsigned(signature, 38)") / 64).cast("int").alias("word")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.expr("shiftrightunsigned(signature, 38)"), F.lit(64)).cast("int")).alias("bit")
    out = np.zeros(BITMAP // 64, dtype=np.int64)
    for part in children.select(word, bit).groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        out[part["word"]] = part["bits"]
    return out.tobytes()


def parent_rows(grids: DataFrame, side: int, group: list[int], wanted: bytes) -> DataFrame:
    """(signature, octant, n, parent, g, tx, ty, tz) of the shifted crops whose signatures ``wanted`` may hold.

    Mirrors only change which octant a view is seen from, so an axis order's eight views
    serve all its mirrors.
    """
    orders = sorted({g >> 3 for g in group})
    mirrors = {o: [g & 7 for g in group if g >> 3 == o] for o in orders}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.unpackbits(np.frombuffer(wanted, np.uint8), bitorder="little").astype(bool)
        for whole in frames:
            for at in range(0, len(whole), 256):
                f = whole.iloc[at : at + 256]
                ids = f["id"].to_numpy()
                n = np.array([int(np.unpackbits(np.frombuffer(c, np.uint8)).sum()) for c in f["cells"]], dtype=np.int32)
                for order, flips, sig in _views(f["cells"].tolist(), side, orders):
                    flat = sig.reshape(len(f), -1)
                    for mirror in mirrors[order]:
                        octant = flips ^ mirror
                        keys = _keyed(flat.ravel(), octant)
                        hit = np.flatnonzero(bits[_places(keys)] & (flat.ravel() != 0))
                        item, cell = hit // side**3, hit % side**3
                        q = np.stack([cell // side**2, cell // side % side, cell % side], axis=1)
                        t = np.where([octant >> a & 1 for a in range(3)], q, -q).astype(np.int32)
                        yield pd.DataFrame({"signature": keys[hit], "octant": np.int32(octant), "n": n[item], "parent": ids[item], "g": np.int32(order << 3 | mirror), "tx": t[:, 0], "ty": t[:, 1], "tz": t[:, 2]})

    return grids.mapInPandas(run, "signature long, octant int, n int, parent long, g int, tx int, ty int, tz int")


def verified(pairs: DataFrame, grids: DataFrame, side: int) -> DataFrame:
    """The pairs, with a child whose parent, transformed and shifted, is another grid standing for itself."""
    both = pairs.join(grids.select(F.col("id").alias("child"), F.col("cells").alias("want")), "child").join(grids.select(F.col("id").alias("parent"), F.col("cells").alias("have")), "parent")
    columns = ["child", "parent", "g", "tx", "ty", "tz"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            bad = np.array([
                packed(shifted_grid(transformed_grid(unpacked(have, side), g), (x, y, z))) != bytes(want)
                for have, want, g, x, y, z in zip(f["have"], f["want"], f["g"], f["tx"], f["ty"], f["tz"], strict=True)
            ], dtype=bool)
            out = f[columns].copy()
            out.loc[bad, "parent"] = out.loc[bad, "child"]
            out.loc[bad, ["g", "tx", "ty", "tz"]] = 0
            yield out

    return both.mapInPandas(run, "child long, parent long, g int, tx int, ty int, tz int")


def best_parents(grids: DataFrame, side: int, group: list[int] | None = None) -> DataFrame:
    """(child, parent, g, tx, ty, tz): every item's least parent that rebuilds it."""
    grids = stored(grids, "grids")
    children = stored(child_signatures(grids, side), "signatures")
    far = F.abs("tx") + F.abs("ty") + F.abs("tz")
    order = F.struct((-F.col("n")).alias("n"), "parent", far.alias("far"), "g", "tx", "ty", "tz")
    least = parent_rows(grids, side, group or [0], _bitmap(children)).groupBy("signature", "octant").agg(F.min(order).alias("best"))
    best = children.join(least, ["signature", "octant"]).groupBy(F.col("id").alias("child")).agg(F.min("best").alias("best"))
    return verified(best.select("child", "best.parent", "best.g", "best.tx", "best.ty", "best.tz"), grids, side)


def kept_items(best: DataFrame) -> DataFrame:
    """(id,): items whose best parent is themselves, and items that are someone's parent."""
    own = best.where("child = parent").select(F.col("child").alias("id"))
    return own.unionByName(best.where("child <> parent").select(F.col("parent").alias("id"))).distinct()


def mapping(best: DataFrame) -> DataFrame:
    """(child, target, g, tx, ty, tz): a kept item stands for itself, another for its best parent."""
    kept = kept_items(best).withColumn("kept", F.lit(True))
    both = best.join(kept, best.child == kept.id, "left")
    stay = F.col("kept").isNotNull()
    return both.select("child", F.when(stay, F.col("child")).otherwise(F.col("parent")).alias("target"), *[F.when(stay, 0).otherwise(F.col(c)).alias(c) for c in ("g", "tx", "ty", "tz")])


def by_population(grids: DataFrame) -> DataFrame:
    """(id, n, place): items by falling population, then id."""
    @F.pandas_udf("int")
    def population(cells: pd.Series) -> pd.Series:
        return cells.map(lambda c: int(np.unpackbits(np.frombuffer(c, np.uint8)).sum())).astype("int32")

    rows = grids.select(F.lit(0).alias("_g"), "id", population("cells").alias("n"))
    return ranked(rows, "_g", [F.desc("n"), F.asc("id")], "place").drop("_g")
