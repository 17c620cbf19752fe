"""Pieces of DuckDB SQL for hashes that it lacks, by its own arithmetic: CRC-32 and XXH64."""


def crc32(text: str) -> str:
    """CRC-32 of a string's UTF-8 bytes in DuckDB, four bits at a time, low ones of a byte first."""
    table = []
    for n in range(16):
        for _ in range(4):
            n = n >> 1 ^ 0xEDB88320 * (n & 1)
        table.append(n)
    digits = f"string_split(hex(encode({text})), '')"
    low_first = f"list_transform(range(length(hex(encode({text})))), lambda i: strpos('0123456789ABCDEF', d[CAST(xor(i, 1) AS BIGINT) + 1]) - 1)"
    each = f"list_reduce([4294967295] || {low_first}, lambda c, x: CAST(xor(c >> 4, {table}[CAST((xor(c, x) & 15) AS BIGINT) + 1]) AS BIGINT))"
    return f"(SELECT CAST(xor({each}, 4294967295) AS BIGINT) FROM (SELECT {digits} AS d))"


# fixed values: the hash's five primes
_XXH = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def xxh64(text: str, source: str, seed: int = 42) -> str:
    """(text, h): XXH64 of the UTF-8 bytes of ``text``, by 128-bit arithmetic in DuckDB, of a table's rows."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in _XXH)
    whole = "18446744073709551616::UHUGEINT"
    mod = lambda x: f"(({x}) % {whole})"
    turn = lambda x, r: f"(({x}) * {1 << r}::UHUGEINT % {whole} + ({x}) // {1 << 64 - r}::UHUGEINT)"
    mixed = lambda h, x: f"CAST(xor(CAST({h} AS UBIGINT), CAST({x} AS UBIGINT)) AS UHUGEINT)"
    lane = lambda at, n: "(" + " + ".join(f"b[{at} + {i + 1}] * {1 << 8 * i}::UHUGEINT" for i in range(n)) + ")"
    round_ = lambda acc, x: mod(f"{turn(mod(f'{acc} + {x} * {p2}'), 31)} * {p1}")
    start = [(seed + _XXH[0] + _XXH[1]) % 2**64, (seed + _XXH[1]) % 2**64, seed, (seed - _XXH[0]) % 2**64]
    steps = []
    # the four sums over stripes of 32 bytes
    for k in range(4):
        steps.append(f"list_reduce([{start[k]}::UHUGEINT] || list_transform(range(n // 32), lambda i: {lane(f'i * 32 + {8 * k}', 8)}), lambda a, x: {round_('a', 'x')}) AS v{k}")
    joined = mod(" + ".join(turn(f"v{k}", r) for k, r in enumerate((1, 7, 12, 18))))
    merged = joined
    for k in range(4):
        merged = mod(f"{mixed(merged, round_('0::UHUGEINT', f'v{k}'))} * {p1} + {p4}") if k else mod(f"{mixed('j', round_('0::UHUGEINT', 'v0'))} * {p1} + {p4}")
        steps.append(f"{merged} AS m{k}")
        merged = f"m{k}"
    eight = f"list_reduce([h0] || list_transform(range((n % 32) // 8), lambda i: {lane('n // 32 * 32 + i * 8', 8)}), lambda a, x: {mod(f'''{turn(mixed('a', round_('0::UHUGEINT', 'x')), 27)} * {p1} + {p4}''')})"
    four = f"CASE WHEN n % 8 >= 4 THEN {mod(f'''{turn(mixed('h1', mod(f'{lane('n // 8 * 8', 4)} * {p1}')), 23)} * {p2} + {p3}''')} ELSE h1 END"
    one = f"list_reduce([h2] || list_transform(range(n % 4), lambda i: CAST(b[n // 4 * 4 + i + 1] AS UHUGEINT)), lambda a, x: {mod(f'''{turn(mixed('a', mod(f'x * {p5}')), 11)} * {p1}''')})"
    last = [("h4", mod(f"{mixed('h3', f'h3 // {1 << 33}::UHUGEINT')} * {p2}")), ("h5", mod(f"{mixed('h4', f'h4 // {1 << 29}::UHUGEINT')} * {p3}")), ("h", mixed("h5", f"h5 // {1 << 32}::UHUGEINT"))]
    pairs = "list_transform(range(octet_length(encode(t))), lambda i: CAST((strpos('0123456789ABCDEF', d[2 * i + 1]) - 1) * 16 + strpos('0123456789ABCDEF', d[2 * i + 2]) - 1 AS UHUGEINT))"
    ctes = [
        f"x0 AS (SELECT DISTINCT {text} AS t, string_split(hex(encode({text})), '') AS d FROM {source})",
        f"x1 AS (SELECT t, CAST(octet_length(encode(t)) AS BIGINT) AS n, {pairs} AS b FROM x0)",
        f"x2 AS (SELECT t, n, b, {', '.join(steps[:1] + [x for x in steps if ' AS v' in x][1:])} FROM x1)",
        f"x3 AS (SELECT *, {joined} AS j FROM x2)",
    ]
    for k in range(4):
        ctes.append(f"y{k} AS (SELECT *, {[x for x in steps if x.endswith(f' AS m{k}')][0]} FROM {'x3' if k == 0 else f'y{k - 1}'})")
    ctes += [
        f"x4 AS (SELECT t, n, b, {mod(f'''CASE WHEN n >= 32 THEN m3 ELSE {seed + _XXH[4]}::UHUGEINT END + CAST(n AS UHUGEINT)''')} AS h0 FROM y3)",
        f"x5 AS (SELECT t, n, b, {eight} AS h1 FROM x4)",
        f"x6 AS (SELECT t, n, b, {four} AS h2 FROM x5)",
        f"x7 AS (SELECT t, {one} AS h3 FROM x6)",
        f"x8 AS (SELECT t, {last[0][1]} AS h4 FROM x7)",
        f"x9 AS (SELECT t, {last[1][1]} AS h5 FROM x8)",
        f"hashed AS (SELECT t, CAST({last[2][1]} AS UBIGINT) AS h FROM x9)",
    ]
    return ",\n".join(ctes)
