"""Axis-parallel boxes as Column expressions; a box is columns x0, y0, z0, x1, y1, z1 with a prefix."""

from functools import reduce

from pyspark.sql import Column, functions as F


def low(p: str = "") -> list[Column]:
    return [F.col(f"{p}{a}0") for a in "xyz"]


def high(p: str = "") -> list[Column]:
    return [F.col(f"{p}{a}1") for a in "xyz"]


def centre(p: str = "") -> list[Column]:
    return [(a + b) / 2 for a, b in zip(low(p), high(p), strict=True)]


def extent(p: str = "") -> list[Column]:
    return [b - a for a, b in zip(low(p), high(p), strict=True)]


def area(p: str = "") -> Column:
    """Of the surface."""
    x, y, z = extent(p)
    return 2 * (x * y + y * z + z * x)


def volume(p: str = "") -> Column:
    return reduce(Column.__mul__, extent(p))


def overlap(p: str, q: str) -> Column:
    """Whether two boxes share volume."""
    return reduce(Column.__and__, ((a < d) & (c < b) for a, b, c, d in zip(low(p), high(p), low(q), high(q), strict=True)))


def contains(p: str, q: str) -> Column:
    return reduce(Column.__and__, ((a <= c) & (d <= b) for a, b, c, d in zip(low(p), high(p), low(q), high(q), strict=True)))


def intersection(p: str, q: str) -> list[Column]:
    """The shared box's six columns; its upper ends are not below its lower ones."""
    lower = [F.greatest(a, c) for a, c in zip(low(p), low(q), strict=True)]
    upper = [F.greatest(l, F.least(b, d)) for l, b, d in zip(lower, high(p), high(q), strict=True)]  # noqa: E741
    return [c.alias(f"{a}{i}") for i, ends in enumerate((lower, upper)) for c, a in zip(ends, "xyz", strict=True)]


def union(p: str, q: str) -> list[Column]:
    ends = ([F.least(a, c) for a, c in zip(low(p), low(q), strict=True)], [F.greatest(b, d) for b, d in zip(high(p), high(q), strict=True)])
    return [c.alias(f"{a}{i}") for i, e in enumerate(ends) for c, a in zip(e, "xyz", strict=True)]


def transformed(matrix: list[list[float]], p: str = "") -> list[Column]:
    """The box of a box under a 3x4 matrix (rows): each term takes the end that its sign asks for."""
    out = []
    for i, least in ((0, True), (1, False)):
        for a, row in zip("xyz", matrix, strict=True):
            terms = [float(k) * F.col(f"{p}{b}{(0 if k >= 0 else 1) if least else (1 if k >= 0 else 0)}") for k, b in zip(row[:3], "xyz", strict=True)]
            out.append(sum(terms, F.lit(float(row[3]))).alias(f"{a}{i}"))
    return out
