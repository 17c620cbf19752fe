"""Huffman code lengths, length-limited and plain, canonical codes and decode tables.

Alphabets are a few hundred symbols, so this is driver-side Python.
"""

import heapq

from pyspark.sql import DataFrame, SparkSession


def code_lengths(frequencies: list[int]) -> list[int]:
    """Plain Huffman code lengths; zero frequencies get no code (0)."""
    live = [(f, i, [i]) for i, f in enumerate(frequencies) if f > 0]
    out = [0] * len(frequencies)
    if len(live) == 1:
        out[live[0][1]] = 1
        return out
    heapq.heapify(live)
    while len(live) > 1:
        a, b = heapq.heappop(live), heapq.heappop(live)
        for i in a[2] + b[2]:
            out[i] += 1
        heapq.heappush(live, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return out


def limited_lengths(frequencies: list[int], most: int) -> list[int]:
    """Optimal lengths of at most ``most`` bits, by package-merge: the 2n - 2 cheapest packages."""
    symbols = sorted((f, i) for i, f in enumerate(frequencies) if f > 0)
    out = [0] * len(frequencies)
    if len(symbols) <= 1:
        for _, i in symbols:
            out[i] = 1
        return out
    if len(symbols) > 1 << most:
        raise ValueError("too many symbols for the length")
    coins = [(f, (i,)) for f, i in symbols]
    row = coins
    for _ in range(most - 1):
        pairs = [(a[0] + b[0], a[1] + b[1]) for a, b in zip(row[::2], row[1::2], strict=False)]
        row = sorted(coins + pairs, key=lambda x: x[0])
    for _, held in row[: 2 * len(symbols) - 2]:
        for i in held:
            out[i] += 1
    return out


def code_words(lengths: list[int]) -> list[str]:
    """Canonical codes as bit strings: by length, then symbol."""
    out, code, before = [""] * len(lengths), 0, 0
    for n, i in sorted((n, i) for i, n in enumerate(lengths) if n):
        code <<= n - before
        out[i], before = f"{code:0{n}b}", n
        code += 1
    return out


def kraft(lengths: list[int]) -> float:
    return sum(2.0**-n for n in lengths if n)


def reversed_bits(code: str) -> int:
    """The code as a number whose lowest bit is the code's first."""
    return int(code[::-1], 2) if code else 0


class DecodeTable:
    """From the next bits (first bit lowest) to (symbol, bits used)."""

    def __init__(self, codes: list[str]):
        self.width = max(map(len, codes), default=0)
        self.table = [(-1, 0)] * (1 << self.width)
        for symbol, code in enumerate(codes):
            if code:
                for tail in range(1 << self.width - len(code)):
                    self.table[reversed_bits(code) | tail << len(code)] = (symbol, len(code))

    def decode(self, bits: int) -> tuple[int, int]:
        return self.table[bits & (1 << self.width) - 1]


def code_table(spark: SparkSession, counts: DataFrame, symbol: str, count: str, most: int | None = 16) -> DataFrame:
    """(symbol, count, length, code) of a small table of counts; ``most`` limits the lengths, None doesn't."""
    rows = [(r[0], r[1]) for r in counts.select(symbol, count).orderBy(symbol).collect()]
    lengths = code_lengths([n for _, n in rows]) if most is None else limited_lengths([n for _, n in rows], most)
    made = [(s, n, k, c) for (s, n), k, c in zip(rows, lengths, code_words(lengths), strict=True)]
    return spark.createDataFrame(made, f"{symbol} {counts.schema[symbol].dataType.simpleString()}, {count} long, length int, code string")
