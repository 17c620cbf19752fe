"""Benchmark decontamination by a broadcast set of hashed word windows.

Benchmark items become windows of 13 normalised words (an item of fewer words, but
some, is one window).  The windows are hashed into sorted arrays, whose size is
checked before they are broadcast; a larger benchmark is taken in blocks of bounded
size, each scanned against all documents.  A task maps its documents' words to ids
of the benchmark's vocabulary, hashes every position whose next words are all known,
looks the hashes up and verifies each hit word by word.

Defined cases: a null or empty text has no words and no hits; an item without words
has no window; an item without id marks hits but is not listed; equal item texts are
all listed; repeated document rows are judged row by row; an empty table gives an
empty result; other columns of ``documents`` pass through untouched.
"""

import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from voxlake.llm.common import WORD_BYTES, as_bytes, map_arrow, stored

#: Words in a window.
WINDOW = 13
#: UTF-8 bytes of benchmark text that one broadcast may hold.
BLOCK_BYTES = 32 << 20
WORD_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
FOUND = "struct<n_words:bigint,n_hit:bigint,hit_spans:array<struct<first:int,after:int>>,item_ids:array<bigint>>"


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


class WindowSet:
    """Distinct windows of a block of the benchmark, by length, as hash-sorted arrays."""

    def __init__(self, items: list[tuple[int | None, bytes | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[int, dict[tuple, set]] = {}
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            if not ids:
                continue
            k = min(window, len(ids))
            for at in range(len(ids) - k + 1):
                owners = found.setdefault(k, {}).setdefault(tuple(ids[at : at + k]), set())
                if item is not None:
                    owners.add(item)
        self.by_length = {}
        for k, windows in found.items():
            grams = np.array(list(windows), dtype=np.int64).reshape(-1, k)
            owners = [sorted(x) for x in windows.values()]
            seed = 1
            while True:  # multipliers under which the stored windows do not collide
                random = np.random.default_rng(seed)
                mix = random.integers(1, 1 << 63, size=k, dtype=np.uint64) | np.uint64(1)
                hashes = self.hashed(grams, mix)
                if len(np.unique(hashes)) == len(hashes):
                    break
                seed += 1
            order = np.argsort(hashes)
            self.by_length[k] = (mix, hashes[order], grams[order], [owners[i] for i in order])

    @staticmethod
    def hashed(grams: np.ndarray, mix: np.ndarray) -> np.ndarray:
        return ((grams.astype(np.uint64) + np.uint64(1)) * mix).sum(axis=1, dtype=np.uint64)

    def scan(self, texts: list[bytes | None]) -> tuple[list[int], list[list[tuple[int, int]]], list[list[int]]]:
        """Per text: number of words, hit word ranges (merged, in order), items that occur."""
        words = [words_of(t) for t in texts]
        counts = [len(w) for w in words]
        get = self.vocabulary.get
        total = sum(counts) + len(counts)
        ids = np.fromiter(
            chain.from_iterable(chain(map(get, w, repeat(-1)), (-1,)) for w in words), dtype=np.int64, count=total
        )  # an unknown id ends every text, so that no window spans two
        starts = np.zeros(len(counts) + 1, dtype=np.int64)
        np.cumsum(np.asarray(counts, dtype=np.int64) + 1, out=starts[1:])
        spans: list[list[tuple[int, int]]] = [[] for _ in texts]
        items: list[set[int]] = [set() for _ in texts]
        if not total:
            return counts, spans, [[] for _ in texts]
        at = np.arange(total)
        ahead = np.where(ids < 0, at, total)
        ahead = np.minimum.accumulate(ahead[::-1])[::-1] - at  # known words from here on
        edges = np.zeros(total + 1, dtype=np.int64)
        any_hit = False
        for k, (mix, hashes, grams, owners) in self.by_length.items():
            place = np.flatnonzero(ahead >= k)
            if not len(place):
                continue
            sums = np.zeros(len(place), dtype=np.uint64)
            for j in range(k):
                sums += (ids[place + j].astype(np.uint64) + np.uint64(1)) * mix[j]
            where = np.minimum(np.searchsorted(hashes, sums), len(hashes) - 1)
            same = hashes[where] == sums
            place, where = place[same], where[same]
            if not len(place):
                continue
            true = (ids[place[:, None] + np.arange(k)] == grams[where]).all(axis=1)
            place, where = place[true], where[true]
            any_hit = any_hit or len(place) > 0
            np.add.at(edges, place, 1)
            np.add.at(edges, place + k, -1)
            for doc, gram in set(zip((np.searchsorted(starts, place, side="right") - 1).tolist(), where.tolist(), strict=True)):
                items[doc].update(owners[gram])
        if any_hit:
            hit = np.cumsum(edges) > 0
            change = np.flatnonzero(np.diff(np.concatenate(([False], hit[:-1], [False])).astype(np.int8)))
            for a, b in zip(change[::2].tolist(), change[1::2].tolist(), strict=True):
                doc = int(np.searchsorted(starts, a, side="right") - 1)
                spans[doc].append((a - int(starts[doc]), b - int(starts[doc])))
        return counts, spans, [sorted(x) for x in items]


def merged(old: list[tuple[int, int]], new: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, b in sorted([*old, *new]):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def without_words(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """``text`` without the hit words and what stands between them."""
    places = [m.span() for m in WORD_RUN.finditer(text)]
    out, at = [], 0
    for a, b in spans:
        out.append(text[at : places[a][0]])
        at = places[b - 1][1]
    return b"".join([*out, text[at:]])


def blocks_of(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple[int | None, bytes | None]]]:
    """The benchmark's items, in lists of at most about ``block_bytes`` bytes, read one at a time."""
    size = benchmark.select(F.sum(F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)) + 16)).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    for k in range(n):
        mine = benchmark if n == 1 else benchmark.where(F.pmod(F.xxhash64(F.col("text").cast("string")), F.lit(n)) == k)
        yield [(r[0], bytes(r[1]) if r[1] is not None else None) for r in mine.select("item_id", as_bytes().alias("t")).collect()]


def contamination(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``documents`` (all by default) plus a struct ``contamination``.

    Its fields: n_words, n_hit, hit_spans (ranges of word numbers, merged), item_ids.
    """
    spark = documents.sparkSession
    columns = documents.columns if columns is None else columns
    kept = documents.select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), as_bytes().alias("text"), F.lit(None).cast(FOUND).alias("found")
    )
    for k, items in enumerate(blocks_of(benchmark, block_bytes)):
        windows = spark.sparkContext.broadcast(WindowSet(items, window))

        def scan(batch, windows=windows):
            texts = batch["text"].to_pylist()
            counts, spans, owners = windows.value.scan(texts)
            found = []
            for n, s, o, old in zip(counts, spans, owners, batch["found"].to_pylist(), strict=True):
                if old is not None:
                    s = merged([(x["first"], x["after"]) for x in old["hit_spans"]], s)
                    o = sorted({*old["item_ids"], *o})
                found.append({"n_words": n, "n_hit": sum(b - a for a, b in s), "hit_spans": [{"first": a, "after": b} for a, b in s], "item_ids": o})
            return {"row": batch["row"], "text": batch["text"], "found": found}

        kept = map_arrow(stored(kept, "decontaminate") if k else kept, scan, kept.schema)
    return kept.select("row.*", F.col("found").alias("contamination"))


def is_contaminated(found: str = "contamination"):
    """The contract's rule: some hit, and at least a twentieth of the words."""
    return (F.col(f"{found}.n_hit") > 0) & (F.col(f"{found}.n_hit") * 20 >= F.col(f"{found}.n_words"))


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """``documents`` without contaminated rows, or (``remove="spans"``) without the hit spans."""
    columns = documents.columns
    found = "contamination"
    while found in columns:
        found = f"_{found}"
    judged = contamination(documents, benchmark, **options)
    judged = judged.toDF(*columns, found)
    if remove == "documents":
        return judged.where(~is_contaminated(found)).select(*[F.col(f"`{c}`") for c in columns])

    @F.pandas_udf("binary")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else without_words(bytes(t), [(x["first"], x["after"]) for x in s])
            for t, s in zip(texts, spans, strict=True)
        ])

    kept = F.decode(cut(F.col("text").cast("string").cast("binary"), F.col(f"{found}.hit_spans")), "utf-8")
    return judged.withColumn("text", kept).select(*[F.col(f"`{c}`") for c in columns])
