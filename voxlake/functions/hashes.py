"""32-bit hash helpers as Column expressions, in longs."""

from functools import reduce

from pyspark.sql import Column, functions as F

WORD = (1 << 32) - 1
# fixed values: the finalizer's multipliers and the golden-ratio constant of combining
FINAL = (0x85EBCA6B, 0xC2B2AE35)
GOLDEN = 0x9E3779B9


def word(x: Column) -> Column:
    return x.cast("long").bitwiseAND(F.lit(WORD))


def times(x: Column, k: int) -> Column:
    """Product modulo 2^32; by halves, as a whole product may leave a long."""
    low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
    return word(low * k + F.shiftleft(word(high * k).bitwiseAND(F.lit(0xFFFF)), 16))


def finalized(x: Column) -> Column:
    """The 32-bit murmur finalizer."""
    for shift, k in ((16, FINAL[0]), (13, FINAL[1])):
        x = times(x.bitwiseXOR(F.shiftright(x, shift)), k)
    return x.bitwiseXOR(F.shiftright(x, 16))


def combined(seed: Column, x: Column) -> Column:
    """A seed with one more hash folded in."""
    return seed.bitwiseXOR(word(x + GOLDEN + word(F.shiftleft(seed, 6)) + F.shiftright(seed, 2)))


def of_values(*values: Column) -> Column:
    """Hash of a row's whole numbers, in order; by a fold, so that the expression stays short."""
    return F.aggregate(F.array(*[word(v) for v in values]), F.lit(0).cast("long"), lambda h, v: combined(h, finalized(v)))


def checksum(*values: Column) -> list[Column]:
    """Aggregates (n, xor, sum) of rows' hashes: the same for any order of the rows."""
    h = of_values(*values)
    return [F.count("*").alias("n"), F.coalesce(F.bit_xor(h), F.lit(0)).alias("xor"), F.coalesce(F.sum(h), F.lit(0)).alias("sum")]


def rotated(x: Column, n: int) -> Column:
    return word(F.shiftleft(x, n)).bitwiseOR(F.shiftright(x, 32 - n))


def folded(values: list[Column]) -> Column:
    return reduce(combined, values, F.lit(0).cast("long"))
