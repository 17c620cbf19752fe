"""The 48 mirrors and axis orders: tables and mask expressions.

A transform permutes axes, then mirrors: out axis i comes from in axis order[i], and is
flipped if bit i of the mirror mask is set.  Its number is mirror | order << 3.
"""

from functools import cache, reduce
from itertools import permutations
from math import factorial

import numpy as np
from pyspark.sql import Column, functions as F

ORDERS = list(permutations(range(3)))
N = 48


@cache
def slots() -> np.ndarray:
    """(48, 8): where each child slot goes."""
    out = np.zeros((N, 8), dtype=np.int64)
    for g in range(N):
        order = ORDERS[g >> 3]
        for s in range(8):
            out[g, s] = sum((s >> order[i] & 1) << i for i in range(3)) ^ (g & 7)
    return out


@cache
def numbers() -> dict[tuple, int]:
    return {tuple(row): g for g, row in enumerate(slots().tolist())}


@cache
def composed() -> np.ndarray:
    """(48, 48): [a, b] is a after b."""
    p = slots()
    return np.array([[numbers()[tuple(p[a][p[b]].tolist())] for b in range(N)] for a in range(N)])


@cache
def inverses() -> np.ndarray:
    return np.array([int(np.flatnonzero(composed()[g] == 0)[0]) for g in range(N)])


@cache
def mask_images() -> np.ndarray:
    """(48, 256): a 2x2x2 mask under each transform."""
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([(bits << slots()[g]).sum(axis=1) for g in range(N)])


@cache
def leaf_bits() -> np.ndarray:
    """(48, 64): where each Morton bit of a 4x4x4 leaf goes."""
    p = slots()
    at = np.arange(64)
    return np.stack([p[g][at >> 3] << 3 | p[g][at & 7] for g in range(N)])


def canonical_masks(group: list[int] | None = None) -> list[tuple[int, int, int]]:
    """(mask, least image, number of transforms that fix the mask) for all 256 masks."""
    images = mask_images()[range(N) if group is None else group]
    return [(m, int(images[:, m].min()), int((images[:, m] == m).sum())) for m in range(256)]


def mask_table() -> Column:
    """A constant array of 48 * 256 images, by g * 256 + mask."""
    return F.array(*[F.lit(int(x)) for x in mask_images().ravel()])


def transformed_mask(mask: Column, g: int) -> Column:
    """An 8-bit mask under one transform, as shifts."""
    one = lambda s: F.shiftleft(F.shiftright(mask.cast("int"), s).bitwiseAND(F.lit(1)), int(slots()[g][s]))
    return reduce(Column.bitwiseOR, (one(s) for s in range(8)))


def compose(a: Column, b: Column) -> Column:
    """Number of ``a`` after ``b``, by the 48 x 48 table."""
    table = F.array(*[F.lit(int(x)) for x in composed().ravel()])
    return F.element_at(table, (a * N + b + 1).cast("int"))


def invert(g: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(x)) for x in inverses()]), (g + 1).cast("int"))


# --- pointers ---------------------------------------------------------------------

# fixed values: fields of a 64-bit transform pointer, low bits first
HANDLE_BITS, MIRROR_BITS, ORDER_BITS, SHIFT_BITS = 37, 3, 6, 6


def encode_pointer(handle: int, g: int, shift: tuple[int, int, int]) -> int:
    """Handle, mirror, three 2-bit axes and three biased 6-bit shifts in 64 bits (as unsigned)."""
    order = ORDERS[g >> 3]
    out = handle | (g & 7) << HANDLE_BITS
    at = HANDLE_BITS + MIRROR_BITS
    for i in range(3):
        out |= order[i] << (at + 2 * i)
    for i in range(3):
        out |= (shift[i] + (1 << SHIFT_BITS - 1)) << (at + ORDER_BITS + SHIFT_BITS * i)
    return out


def decode_pointer(raw: int) -> tuple[int, int, tuple[int, int, int]]:
    at = HANDLE_BITS + MIRROR_BITS
    order = tuple(raw >> (at + 2 * i) & 3 for i in range(3))
    shift = tuple((raw >> (at + ORDER_BITS + SHIFT_BITS * i) & (1 << SHIFT_BITS) - 1) - (1 << SHIFT_BITS - 1) for i in range(3))
    return raw & (1 << HANDLE_BITS) - 1, ORDERS.index(order) << 3 | raw >> HANDLE_BITS & 7, shift


def pointer_columns(handle: Column, g: Column, tx: Column, ty: Column, tz: Column) -> Column:
    """``encode_pointer`` as an expression (a signed long with the same bits)."""
    axes = F.element_at(F.array(*[F.lit(sum(a << 2 * i for i, a in enumerate(o))) for o in ORDERS]), (F.shiftright(g, 3) + 1).cast("int"))
    at = HANDLE_BITS + MIRROR_BITS
    parts = [handle.cast("long"), F.shiftleft(g.bitwiseAND(F.lit(7)).cast("long"), HANDLE_BITS), F.shiftleft(axes.cast("long"), at)]
    parts += [F.shiftleft((t + 32).cast("long"), at + ORDER_BITS + SHIFT_BITS * i) for i, t in enumerate((tx, ty, tz))]
    return reduce(Column.bitwiseOR, parts)


def ranked_pointer(handle: int, g: int, shift: tuple[int, int, int]) -> int:
    """A pointer whose numeric order prefers low handles, then few and small shifts, then low transforms."""
    magnitude = 0
    for t in shift:
        magnitude = magnitude << 6 | (abs(t) << 1 | (t < 0))
    return (handle << 18 | magnitude) << 6 | g


def permutation_rank(order: list[int]) -> int:
    """Place of a permutation among all of its length, in lexicographic order."""
    out = 0
    for i, v in enumerate(order):
        out += sum(w < v for w in order[i + 1 :]) * factorial(len(order) - 1 - i)
    return out


def permutation_at(rank: int, n: int) -> list[int]:
    left, out = list(range(n)), []
    for i in range(n, 0, -1):
        at, rank = divmod(rank, factorial(i - 1))
        out.append(left.pop(at))
    return out
