"""Morton keys, child slots and 4x4x4 masks as Column expressions.

Bit order: x is bit 0, y bit 1, z bit 2 of every triple; a level-2 leaf is 64 voxels,
kept as two 32-bit halves (``lo``, ``hi``) in longs, so that no sign bit is ever set.
"""

from functools import reduce

from pyspark.sql import Column, functions as F



def _spread(v: int, step: int) -> int:
    return sum((v >> i & 1) << step * i for i in range(v.bit_length()))


# Spread and gather go by constant arrays: an expression that refers to its input twice a
# step would double with every step.
SPREAD3, SPREAD2 = ([_spread(v, n) for v in range(256)] for n in (3, 2))
GATHER3 = [sum((v >> 3 * i & 1) << i for i in range(3)) for v in range(0o111 + 1)]


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _and(x: Column, mask: int) -> Column:
    return x.bitwiseAND(F.lit(mask).cast("long"))


def _looked(table: list[int], at: Column) -> Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in table]), at.cast("int"))


def _bytes(table: list[int], x, step: int, n: int) -> Column:
    parts = (F.shiftleft(_looked(table, _and(F.shiftright(_c(x).cast("long"), 8 * i), 0xFF)), 8 * step * i) for i in range(n))
    return reduce(Column.bitwiseOR, parts)


def spread3(x) -> Column:
    """Bits of a coordinate under 2^21, every third place."""
    return _and(_bytes(SPREAD3, x, 3, 3), 0x1249249249249249)


def gather3(m) -> Column:
    parts = (F.shiftleft(_looked(GATHER3, _and(F.shiftright(_c(m), 9 * i), 0o111)), 3 * i) for i in range(7))
    return reduce(Column.bitwiseOR, parts)


def morton3(x="x", y="y", z="z") -> Column:
    """Key of a voxel with coordinates under 2^21."""
    return spread3(x).bitwiseOR(F.shiftleft(spread3(y), 1)).bitwiseOR(F.shiftleft(spread3(z), 2))


def unmorton3(m="morton") -> tuple[Column, Column, Column]:
    return tuple(gather3(F.shiftright(_c(m), i)) for i in range(3))


def morton2(x="x", y="y") -> Column:
    spread = lambda v: _bytes(SPREAD2, v, 2, 4)
    return spread(x).bitwiseOR(F.shiftleft(spread(y), 1))


def child_slot(level: int, x="x", y="y", z="z") -> Column:
    """Which child of its level-``level + 1`` node a voxel is in."""
    bit = lambda v, s: F.shiftleft(_and(F.shiftright(_c(v).cast("long"), level), 1), s)
    return (bit(x, 0) + bit(y, 1) + bit(z, 2)).cast("int")


def ascend(key, levels: int = 1) -> Column:
    return F.shiftright(_c(key), 3 * levels)


def descend(key, slot) -> Column:
    return F.shiftleft(_c(key), 3).bitwiseOR(_c(slot).cast("long"))


def reversed_slots(key, levels: int) -> Column:
    """A key in the other bit order (x highest in each triple), and back."""
    part = lambda i, a, b: F.shiftleft(_and(F.shiftright(_c(key), 3 * i + a), 1), 3 * i + b)
    return reduce(Column.bitwiseOR, (part(i, a, b) for i in range(levels) for a, b in ((0, 2), (1, 1), (2, 0))))


def lo_hi(bit: Column) -> tuple[Column, Column]:
    """Halves of the mask with one bit set, of 0 to 63."""
    one = F.lit(1).cast("long")
    at = F.pmod(bit, F.lit(32)).cast("int")
    shifted = F.call_function("shiftleft", one, at)
    return F.when(bit < 32, shifted).otherwise(0).cast("long"), F.when(bit >= 32, shifted).otherwise(0).cast("long")


def has_bit(bit: Column, lo="lo", hi="hi") -> Column:
    half = F.when(bit < 32, _c(lo)).otherwise(_c(hi))
    return _and(F.call_function("shiftright", half, F.pmod(bit, F.lit(32)).cast("int")), 1) == 1


def popcount(lo="lo", hi="hi") -> Column:
    return (F.bit_count(_c(lo)) + F.bit_count(_c(hi))).cast("long")


def rank(bit: Column, lo="lo", hi="hi") -> Column:
    """Set bits below ``bit``."""
    below = lambda half, n: F.bit_count(half.bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1))
    return (below(_c(lo), F.least(bit, F.lit(32))) + below(_c(hi), F.greatest(bit - 32, F.lit(0)))).cast("long")


def nth_set_bit(mask, n) -> Column:
    """Place of the n-th set bit (from 0) of an 8-bit mask; null if there are fewer."""
    mask, n = _c(mask), _c(n)
    hits = F.filter(F.sequence(F.lit(0), F.lit(7)), lambda i: _and(F.call_function("shiftright", mask.cast("long"), i), 1) == 1)
    return F.try_element_at(hits, (n + 1).cast("int")).cast("int")


def child_mask(children: list[str]) -> Column:
    """Bit i set where child i is."""
    return sum((F.when(F.col(c).isNotNull() & (F.col(c) >= 0), 1 << i).otherwise(0) for i, c in enumerate(children)), F.lit(0)).cast("int")


def block_bytes(lo="lo", hi="hi") -> list[Column]:
    """The eight 2x2x2 blocks of a leaf, as bytes (Morton order keeps a block's bits together)."""
    half = [_c(lo), _c(hi)]
    return [_and(F.shiftright(half[i // 4], 8 * (i % 4)), 0xFF).cast("int") for i in range(8)]


def block_mask(lo="lo", hi="hi") -> Column:
    """Bit i set where block i holds a voxel."""
    return sum((F.when(b > 0, 1 << i).otherwise(0) for i, b in enumerate(block_bytes(lo, hi))), F.lit(0)).cast("int")


#: For each place of a 4x4x4 grid in z, y, x row order, its Morton bit.
ROW_TO_MORTON = [sum(((v >> b & 1) << (3 * b + a)) for a, v in enumerate((i & 3, i >> 2 & 3, i >> 4)) for b in (0, 1)) for i in range(64)]


def reordered(order: list[int], lo="lo", hi="hi") -> tuple[Column, Column]:
    """Halves of a mask whose bit ``order[i]`` is bit i of the given mask."""
    out = [F.lit(0).cast("long"), F.lit(0).cast("long")]
    for i, to in enumerate(order):
        bit = _and(F.shiftright(_c(lo) if i < 32 else _c(hi), i % 32), 1)
        out[to // 32] = out[to // 32].bitwiseOR(F.shiftleft(bit, to % 32))
    return out[0], out[1]
