"""Colour conversions as Column expressions; channels are 0 to 1 unless said."""

from pyspark.sql import Column, functions as F

Rgb = tuple[Column, Column, Column]

# fixed values: standard colour matrices, white point and curve constants
XYZ = ((0.4124, 0.3576, 0.1805), (0.2126, 0.7152, 0.0722), (0.0193, 0.1192, 0.9505))
WHITE = (95.0489, 100.0, 108.8840)
LUMA, U_MOST, V_MOST = (0.299, 0.587, 0.114), 0.436, 0.615
ACES = (2.51, 0.03, 2.43, 0.59, 0.14)
#: (red, green, blue) field widths of packed colours, red lowest.
RGB565, RGB888, RGB101210 = (5, 6, 5), (8, 8, 8), (10, 12, 10)


def clamped(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))


def packed(rgb: Rgb, widths=RGB888) -> Column:
    """Truncating; as a long."""
    out, at = F.lit(0).cast("long"), 0
    for c, n in zip(rgb, widths, strict=True):
        out = out + F.shiftleft(F.floor(clamped(c) * ((1 << n) - 1)).cast("long"), at)
        at += n
    return out


def unpacked(word: Column, widths=RGB888) -> Rgb:
    out, at = [], 0
    for n in widths:
        out.append(F.shiftright(word, at).bitwiseAND(F.lit((1 << n) - 1).cast("long")) / float((1 << n) - 1))
        at += n
    return tuple(out)


def weight(value: Column, bits: int) -> Column:
    return value / float((1 << bits) - 1)


def lerp(a: Rgb, b: Rgb, t: Column) -> Rgb:
    return tuple(x + (y - x) * t for x, y in zip(a, b, strict=True))


def to_linear(c: Column) -> Column:
    return F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))


def to_srgb(c: Column) -> Column:
    return F.when(c <= 0.0031308, c * 12.92).otherwise(F.pow(F.abs(c), F.lit(1 / 2.4)) * 1.055 - 0.055)


def to_linear_rough(c: Column) -> Column:
    return F.pow(c, F.lit(2.2))


def to_srgb_rough(c: Column) -> Column:
    return F.pow(c, F.lit(1 / 2.2))


def xyz(rgb: Rgb) -> Rgb:
    lin = [to_linear(c) * 100.0 for c in rgb]
    return tuple(sum((c * k for c, k in zip(lin, row, strict=True)), F.lit(0.0)) for row in XYZ)


def lab(rgb: Rgb) -> Rgb:
    f = lambda c: F.when(c > 0.008856, F.pow(c, F.lit(1 / 3))).otherwise(7.787 * c + 16.0 / 116.0)
    x, y, z = (f(c / w) for c, w in zip(xyz(rgb), WHITE, strict=True))
    return 116.0 * y - 16.0, 500.0 * (x - y), 200.0 * (y - z)


def yuv(rgb: Rgb) -> Rgb:
    y = sum((c * k for c, k in zip(rgb, LUMA, strict=True)), F.lit(0.0))
    return y, U_MOST * (rgb[2] - y) / (1 - LUMA[2]), V_MOST * (rgb[0] - y) / (1 - LUMA[0])


def filmic(c: Column) -> Column:
    a, b, k, d, e = ACES
    return clamped(c * (a * c + b) / (c * (k * c + d) + e))


def distance2(a: Rgb, b: Rgb) -> Column:
    return sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))


def error(a: Rgb, b: Rgb) -> Column:
    return F.sqrt(distance2(a, b))


def sun_and_sky(d: Rgb, sun: tuple[float, float, float]) -> Column:
    """Brightness of a sky direction: a gradient by height and a disc about the sun."""
    toward = sum((c * s for c, s in zip(d, sun, strict=True)), F.lit(0.0))
    return 0.5 + 0.5 * F.greatest(F.lit(0.0), d[1]) + F.when(toward > 0.9995, 10.0).otherwise(0.0)
