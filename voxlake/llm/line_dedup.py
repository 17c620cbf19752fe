"""Line dedup: later copies of repeated runs of lines go.

The corpus is a sequence of line ids, document after document by doc_id.  A run of
lines within one document that holds ``LEAST_WORDS`` words or more, and stands at an
earlier place too, is a copy; every line of a copy is removed.

Suffixes are grouped by distributed prefix doubling: round k names the interval of
suffixes that share their first 2^k lines, from two intervals of the round before
(lines [0, 2^k-1) and [2^k-1, 2^k)).  An interval is named by its earliest suffix, not
by its rank among sorted ones, as nothing here needs the order of intervals; intervals
of one suffix (no repeat) leave the table.  A maximal repeated run is the prefix shared
by an interval's suffixes.  Its lines are those covered by two kinds of windows in it:
the shortest that reaches the least words from a line on, and the shortest that reaches
it up to a line.  So only prefixes of those lengths are looked up, each as two
overlapping intervals of one round, and rounds end at the longest window.

Every round is a few aggregations with partial minima and joins by Spark's choice; a
very common line is a skewed join key, which Spark splits.

Runs under ``LEAST_WORDS`` words stay (1 removes every later copy of any line); lines are
compared by their 128-bit hashes, whole lines as they are.

Defined cases: a null or empty text is one empty line; a document without id comes first;
rows equal in id and text (by its 64-bit hash) are one document, and keep equal lines; within a document, later copies of its own runs go as well; an empty table
gives an empty result; other columns pass through ``deduplicated`` untouched.
"""

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxlake.llm.common import as_bytes, discard, map_arrow, stored

LEAST_WORDS = 50


def line_table(texts: list[bytes | None], least: int = LEAST_WORDS) -> dict[str, list]:
    """Of every line: text's number, place, 128-bit hash, and the lengths of its two windows (0: none)."""
    out = {n: [] for n in ("text", "line", "a", "b", "ahead", "back")}
    for i, t in enumerate(texts):
        lines = (t or b"").split(b"\n")
        n = len(lines)
        words = np.concatenate(([0], np.cumsum([len(x.split()) for x in lines])))
        hashes = np.frombuffer(b"".join(xxhash.xxh3_128_digest(x) for x in lines), dtype=">i8").astype(np.int64)
        at = np.arange(n)
        end = np.searchsorted(words, words[:-1] + least)  # first end that reaches the least
        begin = np.searchsorted(words, words[1:] - least, side="right") - 1
        out["text"].append(np.full(n, i))
        out["line"].append(at)
        out["a"].append(hashes[::2])
        out["b"].append(hashes[1::2])
        out["ahead"].append(np.where(end <= n, end - at, 0))
        out["back"].append(np.where(words[1:] >= least, at + 1 - begin, 0))
    return {k: np.concatenate(v) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _lines(documents: DataFrame, least: int) -> DataFrame:
    def run(batch):
        texts = batch["text"].to_pylist()
        made = line_table(texts, least)
        keys = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts], dtype=np.uint64).view(np.int64)
        which = made.pop("text")
        return made | {"doc_id": batch["doc_id"].take(which), "mark": keys[which]}

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))
    return map_arrow(rows, run, "doc_id long, mark long, line int, a long, b long, ahead int, back int")


def _place(x: str = "", line: str = "line") -> Column:
    return F.struct(F.col(f"{x}doc_id").alias("doc_id"), F.col(f"{x}mark").alias("mark"), F.col(f"{x}{line}").alias("line"))


def _same_document(a: str, b: str) -> Column:
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.mark") == F.col(f"{b}.mark"))


def _repeated(rows: DataFrame, key: list[str]) -> DataFrame:
    """(key, name): keys at two places or more, and the earliest."""
    place = _place()
    return rows.groupBy(*key).agg(F.min(place).alias("name"), F.max(place).alias("latest")).where("name <> latest").drop("latest")


def removed_lines(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, mark, first, after): line ranges to remove; ``mark`` is the text's hash (xxh3_64, signed)."""
    lines = stored(_lines(documents, least), "lines")
    names = lines.join(_repeated(lines, ["a", "b"]), ["a", "b"]).select("doc_id", "mark", "line", "name", "ahead", "back")
    names = stored(names.dropDuplicates(["doc_id", "mark", "line"]), "line-names")
    discard(lines)
    ahead = names.where("ahead > 0").select("doc_id", "mark", F.col("line").alias("first"), F.col("ahead").alias("m"))
    back = names.where("back > 0").select("doc_id", "mark", (F.col("line") - F.col("back") + 1).alias("first"), F.col("back").alias("m"))
    windows = stored(ahead.unionByName(back).distinct().withColumn("k", F.floor(F.log2("m") + 1e-9).cast("int")), "windows")
    rounds = windows.agg(F.max("k")).first()[0]
    now = names.select("doc_id", "mark", "line", "name")
    found = []
    for k in range(0 if rounds is None else rounds + 1):
        mine = windows.where(F.col("k") == k)
        x = mine.alias("w").join(now.alias("x"), _same_document("w", "x") & (F.col("w.first") == F.col("x.line")))
        x = x.select("w.doc_id", "w.mark", "w.first", "w.m", F.col("x.name").alias("n1"), (F.col("w.first") + F.col("w.m") - (1 << k)).alias("second"))
        y = x.alias("x").join(now.alias("y"), _same_document("x", "y") & (F.col("x.second") == F.col("y.line")))
        y = y.select("x.doc_id", "x.mark", F.col("x.first").alias("line"), "x.m", "x.n1", F.col("y.name").alias("n2"))
        later = y.join(_repeated(y, ["m", "n1", "n2"]), ["m", "n1", "n2"]).where(_place() > F.col("name"))
        found.append(stored(later.select("doc_id", "mark", F.col("line").alias("first"), (F.col("line") + F.col("m")).alias("after")), "copies"))
        if k < rounds:
            half = 1 << k
            pair = now.alias("x").join(now.alias("y"), _same_document("x", "y") & (F.col("x.line") + half == F.col("y.line")))
            pair = pair.select("x.doc_id", "x.mark", "x.line", F.col("x.name").alias("n1"), F.col("y.name").alias("n2"))
            now = stored(pair.join(_repeated(pair, ["n1", "n2"]), ["n1", "n2"]).select("doc_id", "mark", "line", "name"), "line-names")
    spark = documents.sparkSession
    out = spark.createDataFrame([], "doc_id long, mark long, first int, after int")
    for part in found:
        out = out.unionByName(part)
    return out


def decisions(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, mark, removed): the line numbers to remove, of documents with any.

    A document's overlapping ranges are merged before their lines are listed.
    """
    ranges = removed_lines(documents, least).distinct()
    earlier = W.partitionBy("doc_id", "mark").orderBy("first", "after").rowsBetween(W.unboundedPreceding, -1)
    begins = F.coalesce((F.col("first") > F.max("after").over(earlier)).cast("int"), F.lit(1))
    upto = W.partitionBy("doc_id", "mark").orderBy("first", "after").rowsBetween(W.unboundedPreceding, W.currentRow)
    islands = ranges.withColumn("begins", begins).withColumn("island", F.sum("begins").over(upto))
    merged = islands.groupBy("doc_id", "mark", "island").agg(F.min("first").alias("first"), F.max("after").alias("after"))
    per = merged.groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("first", "after"))).alias("ranges"))
    return per.select("doc_id", "mark", F.flatten(F.transform("ranges", lambda r: F.sequence(r["first"], r["after"] - 1))).alias("removed"))


def _marked(documents: DataFrame, columns: list[str]) -> DataFrame:
    def run(batch):
        texts = batch["text"].to_pylist()
        marks = np.array([xxhash.xxh3_64_intdigest(t or b"") for t in texts], dtype=np.uint64).view(np.int64)
        return {"row": batch["row"], "mark": marks, "n_lines": [(t or b"").count(b"\n") + 1 for t in texts]}

    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), as_bytes().alias("text"))
    return map_arrow(rows, run, rows.select("row").withColumns({"mark": F.lit(0).cast("long"), "n_lines": F.lit(0).cast("long")}).schema)


def judged(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, n_lines, n_removed, removed): a row a document."""
    rows = _marked(documents, ["doc_id"]).select(F.col("row.doc_id").cast("long").alias("doc_id"), "mark", "n_lines")
    found = decisions(documents, least)
    both = rows.alias("r").join(found.alias("f"), _same_document("r", "f"), "left")
    removed = F.coalesce("f.removed", F.array().cast("array<int>"))
    return both.select("r.doc_id", "r.n_lines", F.size(removed).cast("long").alias("n_removed"), removed.alias("removed"))


def deduplicated(documents: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """``documents`` with the copies' lines cut out of their texts."""
    rows = _marked(documents, documents.columns)
    found = decisions(documents, least)
    both = rows.alias("r").join(found.alias("f"), F.col("r.row.doc_id").cast("long").eqNullSafe(F.col("f.doc_id")) & (F.col("r.mark") == F.col("f.mark")), "left")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, removed: pd.Series) -> pd.Series:
        def one(text, gone):
            if gone is None:
                return text
            gone = set(gone)
            return "\n".join(x for i, x in enumerate((text or "").split("\n")) if i not in gone)

        return pd.Series([one(t, g) for t, g in zip(texts, removed, strict=True)])

    both = both.select("r.row", cut(F.col("r.row.text"), F.col("f.removed")).alias("text"))
    return both.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in documents.columns])
