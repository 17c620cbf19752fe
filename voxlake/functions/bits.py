"""Bit fields of words and variable-width bit streams."""

from pyspark.sql import Column, functions as F


def extract(word: Column, at: int, width: int) -> Column:
    return F.shiftright(word, at).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def insert(word: Column, value: Column, at: int, width: int) -> Column:
    keep = ~(((1 << width) - 1) << at) & (1 << 63) - 1
    return word.bitwiseAND(F.lit(keep).cast("long")).bitwiseOR(F.shiftleft(value.cast("long"), at))


class BitWriter:
    """Values of any width, first bit lowest, to little-endian bytes."""

    def __init__(self):
        self.value, self.n = 0, 0

    def append(self, value: int, width: int) -> "BitWriter":
        if value >> width:
            raise ValueError("value is wider than its field")
        self.value |= value << self.n
        self.n += width
        return self

    def extend(self, other: "BitWriter") -> "BitWriter":
        self.value |= other.value << self.n
        self.n += other.n
        return self

    def to_bytes(self, word: int = 1) -> bytes:
        size = -(-self.n // (8 * word)) * word
        return self.value.to_bytes(size, "little")


class BitReader:
    def __init__(self, raw: bytes, n: int | None = None):
        self.value, self.n, self.at = int.from_bytes(raw, "little"), 8 * len(raw) if n is None else n, 0

    def read(self, width: int) -> int:
        if self.at + width > self.n:
            raise EOFError("read past the end")
        out = self.value >> self.at & (1 << width) - 1
        self.at += width
        return out

    def skip(self, width: int) -> None:
        self.at += width

    def peek(self, width: int) -> int:
        return self.value >> self.at & (1 << width) - 1
