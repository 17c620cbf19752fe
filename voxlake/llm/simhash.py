"""SimHash near-duplicates, compared as vertical bit planes.

Fingerprints: over the hashes of a text's word shingles, a bit is 1 if more than half
of them set it.  Fingerprints that differ in few bits link.  Distinct fingerprints are
dealt to tables by the bits of some of their bands, so that linked ones agree on all
bits of one table's bands at least (pigeonhole); the number of tables follows from the
number of fingerprints alone.  A task turns what it gets into bit planes (bit b of 64
fingerprints in a word), adds plane after plane into two-bit carry-save counters with
a sticky overflow, and leaves a block once every pair in it has overflowed.  A bucket
above ``CHUNK`` is cut into chunks and every pair of chunks is a unit of its own.  Each
unit hands on a spanning forest of its links, and the links' components give the groups.

Defined cases: a null text, or one without words, has fingerprint zero and links like
any other; fewer words than a shingle form one; rows without doc_id take part, and a
group's id is its smallest doc_id (null if it has none); repeated rows share a group;
an empty table gives an empty result; other columns are not read.
"""

from itertools import combinations
from math import comb

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from voxlake.llm.common import as_bytes, discard, map_arrow, n_partitions, stored
from voxlake.llm.components import connected_components

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Most fingerprints on one side of a compared unit.
CHUNK = 4096
#: Groups up to this size are compared by shifting whole planes.
SHIFTED = 64
#: Fingerprints of a bucket that the tables aim at when fingerprints spread evenly.
AIM = 16
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)
#: For a byte, its eight bits in the eight byte lanes of a word.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def shingle_hashes(text: bytes | None, k: int = SHINGLE) -> list[int]:
    words = text.lower().split() if text else []  # for bytes: A-Z only, and the six ASCII spaces
    if not words:
        return []
    h = xxhash.xxh64_intdigest
    if len(words) <= k:
        return [h(b" ".join(words), SEED)]
    join = b" ".join
    return [h(join(x), SEED) for x in zip(*[words[i:] for i in range(k)], strict=False)]


def fingerprints(texts: list[bytes | None], k: int = SHINGLE) -> np.ndarray:
    """Majority bits of each text's shingle hashes (uint64)."""
    hashes, counts = [], []
    for t in texts:
        own = np.array(shingle_hashes(t, k), dtype=np.uint64)
        counts.append(len(own))
        hashes.append(own)
    out = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if not len(some):
        return out
    every = np.concatenate(hashes)
    n = np.asarray(counts, dtype=np.int64)[some]
    starts = np.concatenate(([0], np.cumsum(n)[:-1]))
    parts = -(-n // 255)  # byte lanes hold sums of 255 rows at most
    first = np.concatenate(([0], np.cumsum(parts)[:-1]))
    cut = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for byte, column in enumerate(every.view(np.uint8).reshape(-1, 8).T):
        lanes = np.add.reduceat(_LANES[column], cut).view(np.uint8).reshape(-1, 8).astype(np.int64)
        sums = np.add.reduceat(lanes, first, axis=0)
        bits = (2 * sums > n[:, None]).astype(np.uint64)
        out[some] |= (bits << (np.arange(8, dtype=np.uint64) + np.uint64(8 * byte))).sum(axis=1, dtype=np.uint64)
    return out


def fingerprint_table(documents: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp, mark): a row for each row of ``documents``; fp is the fingerprint as a signed long, mark the text's hash."""
    return map_arrow(
        documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"), _mark()),
        lambda b: {"doc_id": b["doc_id"], "fp": fingerprints(b["text"].to_pylist(), k).view(np.int64), "mark": b["mark"]},
        "doc_id long, fp long, mark long",
    )


def _mark() -> Column:
    return F.xxhash64(F.col("text").cast("string")).alias("mark")


def bands_for(n: int, radius: int = RADIUS) -> list[int]:
    """Bit masks of the tables for ``n`` distinct fingerprints."""
    for extra in range(1, 5):
        bands, kept = radius + extra, extra
        edges = [64 * i // bands for i in range(bands + 1)]
        if n <= AIM << (64 * kept // bands):
            break
    masks = [sum(1 << b for b in range(edges[i], edges[i + 1])) for i in range(bands)]
    tables = [sum(x) for x in combinations(masks, kept)]
    assert len(tables) == comb(bands, kept)
    return tables


def planes_of(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit b of fingerprint i is bit i % 64 of word i // 64 of plane b."""
    bits = np.unpackbits(fps.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return _packed(bits.T)


def _packed(bits: np.ndarray) -> np.ndarray:
    n = bits.shape[-1]
    pad = -n % 64
    if pad:
        bits = np.concatenate([bits, np.zeros((*bits.shape[:-1], pad), dtype=bits.dtype)], axis=-1)
    return np.ascontiguousarray(np.packbits(bits, axis=-1, bitorder="little")).view(np.uint64)


def within(planes, others, over: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Packed mask of the pairs at distance ``radius`` (under 4) or less; ``over``: pairs to leave out.

    ``planes(b)`` and ``others(b)`` give words of bit b for the two sides.
    """
    ones, twos = np.zeros_like(over), np.zeros_like(over)
    for b in range(64):
        x = planes(b) ^ others(b)
        carry = ones & x
        ones ^= x
        over |= twos & carry
        twos ^= carry
        if b % 4 == 3 and (over == _FULL).all():
            return np.zeros_like(over)
    close = ~over
    if radius < 3:
        close &= ~twos if radius < 2 else ~(twos & ones)
    if radius < 1:
        close &= ~ones
    return close


class Forest:
    """Union-find over local numbers that keeps whole label arrays."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        a, b = self.label[u], self.label[v]
        while len(a := a[(differ := a != b)]):
            b = b[differ]
            hi, lo = np.maximum(a, b), np.minimum(a, b)
            to = np.arange(len(self.label))
            np.minimum.at(to, hi, lo)
            while (to != (jump := to[to])).any():
                to = jump
            self.label = to[self.label]
            a, b = to[a], to[b]


def linked(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among fingerprints of equal ``group`` (sorted; a group with side 1 links across sides)."""
    n = len(fps)
    if not n:
        return fps, fps
    forest = Forest(n)
    starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    sizes = np.diff(np.concatenate((starts, [n])))
    crossed = np.maximum.reduceat(side, starts) > 0
    small = (sizes <= SHIFTED) & ~crossed
    live = np.flatnonzero(np.repeat(small & (sizes > 1), sizes))
    left = np.repeat(sizes, sizes)
    shift = 1
    while len(live):
        own, mine = fps[live], group[live]
        planes = planes_of(own)
        most = int(left[live].max())
        for d in range(shift, min(2 * shift, most)):
            same = np.zeros(len(live), dtype=np.uint8)
            same[: len(live) - d] = mine[d:] == mine[:-d]

            def moved(b, d=d, planes=planes):
                p = planes[b]
                up = np.zeros_like(p)
                up[:-1] = p[1:]
                return (p >> np.uint64(d)) | (up << np.uint64(64 - d)) if d < 64 else up

            close = within(lambda b, p=planes: p[b], moved, ~_packed(same), radius)
            if close.any():
                at = np.flatnonzero(np.unpackbits(close.view(np.uint8), bitorder="little"))
                forest.link(live[at], live[at + d])
        shift *= 2
        live = live[left[live] > shift]
    for start, size, cross in zip(starts[~small], sizes[~small], crossed[~small], strict=True):
        which = np.arange(start, start + size)
        a, b = (which[side[which] == 0], which[side[which] == 1]) if cross else (which, which)
        if not len(a) or not len(b):
            continue
        planes = planes_of(fps[b])
        out = ~_packed(np.ones(len(b), dtype=np.uint8))
        for at in range(0, len(a), 256):
            some = a[at : at + 256]
            wanted = np.where((fps[some][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), _FULL, np.uint64(0))
            close = within(lambda k, p=planes: p[k][None, :], lambda k, w=wanted: w[:, k][:, None], np.repeat(out[None, :], len(some), axis=0), radius)
            if close.any():
                i, j = np.nonzero(np.unpackbits(close.view(np.uint8), axis=1, bitorder="little"))
                forest.link(some[i], b[j])
    moved = np.flatnonzero(forest.label != np.arange(n))
    return fps[moved], fps[forest.label[moved]]


def fingerprint_links(distinct: DataFrame, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(a, b): links that connect all of ``distinct`` (column fp) within ``radius`` bits."""
    spark = distinct.sparkSession
    masks = bands_for(distinct.count(), radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = distinct.select(
        "fp", F.explode(F.array(*[F.struct(F.lit(t).alias("tbl"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("key")) for t, m in enumerate(signed)])).alias("k")
    ).select("fp", "k.tbl", "k.key")
    hot = keyed.groupBy("tbl", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk)
    hot = hot.select("tbl", "key", F.ceil(F.col("n") / F.lit(chunk / 2)).cast("int").alias("parts"))
    units = keyed.join(hot, ["tbl", "key"], "left").withColumn("mine", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")))
    units = units.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).select(
        "tbl", "key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side"), "fp"
    )
    unit = ["tbl", "key", "i", "j"]
    # a chunk with itself has side 0 only; of two chunks the later has side 1
    dealt = units.repartition(n_partitions(spark), *unit).sortWithinPartitions(*unit, "side", "fp")
    schema = StructType.fromDDL("a long, b long")

    def run(batches):
        import pyarrow as pa

        held: list[np.ndarray] = []
        rows = 0

        def flush(last: bool):
            nonlocal held, rows
            table = np.concatenate(held, axis=1)
            change = np.concatenate(([True], (table[:4, 1:] != table[:4, :-1]).any(axis=0)))
            cut = table.shape[1] if last else int(np.flatnonzero(change)[-1])
            held, rows = [table[:, cut:]], table.shape[1] - cut
            if cut:
                a, b = linked(np.ascontiguousarray(table[5, :cut]).view(np.uint64), np.cumsum(change[:cut]), table[4, :cut], radius)
                return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])
            return None

        for batch in batches:
            held.append(np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(6)]))
            rows += batch.num_rows
            if rows >= 1 << 16 and (out := flush(False)) is not None:
                yield out
        if rows and (out := flush(True)) is not None:
            yield out

    return dealt.mapInArrow(run, schema)


def _grouped(documents: DataFrame, k: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The fingerprint table, and (fp, first, root): each fingerprint's least doc_id and component."""
    prints = stored(fingerprint_table(documents, k), "fingerprints")
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    roots = connected_components(fingerprint_links(distinct.select("fp"), radius))
    return prints, distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id): a row for each document."""
    prints, rooted = _grouped(documents, k, radius)
    named = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    by_print = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(by_print, "fp").select("doc_id", "fp", "component_id")


def keep_one(documents: DataFrame, k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row of each group: of its smallest doc_id, the text of the least hash (of rows alike in both, one).

    An id on texts of several groups stands for each of them.  Rows without an id stay.
    """
    from pyspark.sql import Window as W

    prints, rooted = _grouped(documents, k, radius)
    known = prints.where("doc_id is not null").join(rooted.select("fp", "root"), "fp")
    kept = known.groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("kept")).select(F.col("kept.doc_id").alias("_vx_kept"), F.col("kept.mark").alias("_vx_kept_mark"))
    marked = documents.withColumn("_vx_mark", _mark())
    rows = marked.join(kept, (F.col("doc_id") == F.col("_vx_kept")) & (F.col("_vx_mark") == F.col("_vx_kept_mark")), "left_semi")
    order = W.partitionBy("doc_id", "_vx_mark").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in documents.columns]))
    once = rows.withColumn("_vx_copy", F.row_number().over(order)).where("_vx_copy = 1").drop("_vx_copy", "_vx_mark")
    return once.unionByName(documents.where(F.col("doc_id").isNull()))
