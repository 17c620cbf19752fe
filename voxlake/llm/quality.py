"""Quality rules: fixed rules first, then robust multivariate outliers.

Statistics of every whole text become a transformed vector.  The location and scatter of
least covariance determinant are estimated on all rows that pass the fixed rules, for each
(language, source), each language, and all rows:

* three robust starts, all about the coordinate medians: the median absolute deviations
  alone, the correlation of wrapped values (tanh of the deviations), and the spatial signs;
* concentration: keep the h = floor(SUPPORT * rows + (P + 1) / 2) rows of least distance
  and estimate on them, until no group's determinant falls by more than ``SETTLED``
  (or ``MOST_STEPS``); the start of least determinant wins (in a group of some dozen rows this
  may be a minimum near the least, as from any few starts);
* the scatter is multiplied by the consistency factor of its share of rows and by the
  small-sample factor, rows within the ``REWEIGHTED`` quantile are estimated once more,
  with that quantile's consistency factor;
* every estimate is pooled with its parent's (language, then all rows) as if the parent
  gave ``PRIOR_ROWS`` more rows, so small groups pass smoothly to their parent's estimate;
* standard deviations are floored, so that a statistic that is nearly constant rejects
  nothing for a small step.

Rows whose squared distance is beyond the chi-square's upper ``LEVEL`` are rejected.  The
level is far below the usual 2.5 %: the statistics have heavier tails than a normal's, and
a filter over 10^9 rows should lose about one normal row, not 25 million.

A step is one aggregation: moments by bin of distance, with partial sums; the bin in which
the h-th row lies counts by the share that h needs of it.  No group's rows meet in a task;
the estimates are a row a group, joined back by Spark's choice of join.

Defined cases: a null or empty text has no words, so the fixed rule fails it; null
languages and sources are groups; a group of few rows leans on its parents, and where the
whole table has under ``CUTOFF`` rows no distance can exceed it by itself; repeated rows
count each; an empty table gives an empty result; other columns are not read; a doc_id
that is no whole number is an error (ANSI).
"""

from math import exp, lgamma, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxlake.llm.common import as_bytes, discard, map_arrow, stored

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED = 20  # per cent of words in repeated windows
SUPPORT = 0.5
#: Rows' worth of a parent's estimate in its child's.
PRIOR_ROWS = 50
REWEIGHTED = 0.975
LEVEL = 1e-9
#: Change of a log determinant that counts as settled, and the most steps.
SETTLED, MOST_STEPS = 1e-3, 30
#: Bins a unit of log2(1 + squared distance), and of a statistic for its median.
BINS, FINE = 32, 256
#: Names of the transformed statistics, in order, with the least standard deviation that counts; for
#: repeated words, which the fixed rule already bounds, a factor of e.
FEATURES = (("f_words", 0.5), ("f_chars", 0.25), ("f_symbols", 0.5), ("f_lines", 0.5), ("f_repeats", 1.0))
NAMES = [f for f, _ in FEATURES]
FLOOR = np.array([x for _, x in FEATURES])
P = len(FEATURES)


def chi2_cdf(x: float, degrees: int) -> float:
    """By the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, y = degrees / 2, x / 2
    term = total = exp(a * log(y) - y - lgamma(a + 1))
    n = 1
    while term > 1e-17 * total:
        term *= y / (a + n)
        total += term
        n += 1
    return min(1.0, total)


def chi2_quantile(share: float, degrees: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, degrees) < share else (low, mid)
    return (low + high) / 2


CUTOFF = chi2_quantile(1 - LEVEL, P)
NEAR = chi2_quantile(REWEIGHTED, P)


def consistency(share: float) -> float:
    """Factor for the scatter of the ``share`` of normal rows that lie nearest."""
    if share >= 1:
        return 1.0
    return share / chi2_cdf(chi2_quantile(share, P), P + 2)


def small_sample(n: float) -> float:
    """Factor for the scatter of the nearest half of ``n`` rows (Pison, Van Aelst and Willems, 2002)."""
    # fixed values: that paper's fit for half of the rows, (a, b, k) a column
    fit = ((-1.42764571687802, 1.26263336932151, 2), (-1.06141115981725, 1.28907991440387, 3))
    (y1, x1), (y2, x2) = ((log(-a / P**b), -log(k * P * P)) for a, b, k in fit)
    slope = (y1 - y2) / (x1 - x2)
    return 1 / (1 - exp(y1 - slope * x1) / max(n, 4.0 * P) ** slope)


def statistics(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of whole texts."""
    out = {n: np.zeros(len(texts), dtype=np.int64) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    for i, t in enumerate(texts):
        if not t:
            continue
        words = t.split()
        out["n_words"][i] = len(words)
        out["word_chars"][i] = len(t.translate(None, SPACES).decode())
        out["n_symbols"][i] = len(t) - len(t.translate(None, SYMBOLS))
        lines = [x for x in t.split(b"\n") if x and not x.isspace()]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        out["n_repeat_words"][i] = repeated_words(words)
    return out


def repeated_words(words: list[bytes], k: int = WINDOW) -> int:
    """Words that lie in a window of ``k`` words found twice or more in the text."""
    n = len(words) - k + 1
    if n < 2:
        return 0
    names: dict[bytes, int] = {}
    number = names.setdefault
    ids = np.array([number(w, len(names)) for w in words], dtype=np.uint64)
    if len(names) == len(words):
        return 0
    # pairs of windows of length j, named exactly: (name of length j - 1, next word)
    window = ids[: n + k - 1]
    size = np.uint64(len(names) + 1)
    for j in range(1, k):
        key = window[: len(ids) - j] * size + ids[j:]
        window = np.unique(key, return_inverse=True)[1].astype(np.uint64) if j < k - 1 else key
        size_now = int(window.max()) + 1 if j < k - 1 else 0
        if j < k - 1 and size_now == len(window):
            return 0
    _, where, counts = np.unique(window, return_inverse=True, return_counts=True)
    twice = counts[where] > 1
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + k, -1)
    return int((np.cumsum(edges)[:-1] > 0).sum())


def features() -> list[Column]:
    per = lambda c: F.log1p(F.col(c) * 1000.0 / F.greatest(F.col("n_words"), F.lit(1)))
    return [
        F.log1p(F.col("n_words").cast("double")).alias("f_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))).alias("f_chars"),
        per("n_symbols").alias("f_symbols"),
        F.log1p(F.col("n_dup_lines").cast("double")).alias("f_lines"),
        per("n_repeat_words").alias("f_repeats"),
    ]


def fails_rules() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED)


_PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
_SUMS = [f"s{i}" for i in range(P)] + [f"q{i}{j}" for i, j in _PAIRS]
_MEAN, _COV, _INVERSE = [f"m{i}" for i in range(P)], [f"c{i}{j}" for i, j in _PAIRS], [f"w{i}{j}" for i, j in _PAIRS]
KEYS = ["level", "lang", "source"]
_KEYS = "level int, lang string, source string"
_doubles = lambda names: ", ".join(f"{x} double" for x in names)
_ESTIMATE = f"{_KEYS}, start int, n double, rows double, logdet double, {_doubles(_MEAN + _COV + _INVERSE)}"


# --- on the estimates, a row a group ------------------------------------------------

def _matrix(row: dict, prefix: str) -> np.ndarray:
    out = np.zeros((P, P))
    for i, j in _PAIRS:
        out[i, j] = out[j, i] = row[f"{prefix}{i}{j}"]
    return out


def floored(cov: np.ndarray) -> np.ndarray:
    return cov + np.diag(np.maximum(0.0, FLOOR**2 - np.diag(cov))) + 1e-9 * np.eye(P)


def _estimated(row: dict, start: int, n: float, rows: float, mean: np.ndarray, cov: np.ndarray) -> list:
    whole = floored(cov)
    inverse = np.linalg.inv(whole)
    flat = lambda m: [float(m[i, j]) for i, j in _PAIRS]
    return [row["level"], row["lang"], row["source"], start, n, rows, float(np.linalg.slogdet(whole)[1]), *map(float, mean), *flat(cov), *flat(inverse)]


def _by_row(table: DataFrame, function) -> DataFrame:
    """``function`` gives lists by ``_ESTIMATE`` of each row (a dict); tables of a row a group."""

    def run(frames):
        for f in frames:
            yield pd.DataFrame([x for row in f.to_dict("records") for x in function(row)], columns=[c.split()[0] for c in _ESTIMATE.split(", ")])

    return table.mapInPandas(run, _ESTIMATE)


def _text(row: dict) -> dict:
    return row | {k: None if row[k] is None or row[k] != row[k] else row[k] for k in ("lang", "source")}


def _moments_of(row: dict) -> tuple[float, np.ndarray, np.ndarray]:
    n = max(row["n"], 1e-9)
    mean = np.array([row[f"s{i}"] for i in range(P)]) / n
    return row["n"], mean, _matrix(row, "q") / n - np.outer(mean, mean)


def _started(row: dict) -> list[list]:
    """The three starts of a group, from its medians, deviations, wrapped values and signs."""
    row = _text(row)
    centre, scale = np.array([row[m] for m in _MEAN]), np.array([row[f"d{i}"] for i in range(P)])
    n = max(row["n"], 1)
    t = np.array([row[f"s{i}"] for i in range(P)]) / n
    wrapped = _matrix(row, "q") / n - np.outer(t, t) + 1e-6 * np.eye(P)
    spread = np.sqrt(np.diag(wrapped))
    signs = _matrix(row, "u") / n * P + 1e-3 * np.eye(P)
    shapes = (np.eye(P), wrapped / np.outer(spread, spread), signs)
    return [_estimated(row, k, float(n), float(n), centre, np.outer(scale, scale) * shape) for k, shape in enumerate(shapes)]


def _fitted(row: dict) -> list[list]:
    row = _text(row)
    return [_estimated(row, row["start"], *(lambda n, mean, cov: (n, row["rows"], mean, cov))(*_moments_of(row)))]


def _corrected(row: dict) -> list[list]:
    """A group's best estimate with the factors of its share and number of rows."""
    row = _text(row)
    factor = consistency(row["n"] / row["rows"]) * small_sample(row["rows"])
    return [_estimated(row, 0, row["n"], row["rows"], np.array([row[m] for m in _MEAN]), _matrix(row, "c") * factor)]


def _reweighted(row: dict) -> list[list]:
    row = _text(row)
    n, mean, cov = _moments_of(row)
    return [_estimated(row, 0, n, row["rows"], mean, cov * consistency(REWEIGHTED))]


def pooled(n: float, mean: np.ndarray, cov: np.ndarray, above: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An estimate of ``n`` rows with ``PRIOR_ROWS`` of its parent's; the rows that a scatter takes to exist count for none."""
    own = max(0.0, n - (P + 1))
    a = own / (own + PRIOR_ROWS)
    off = mean - above[0]
    return a * mean + (1 - a) * above[0], a * cov + (1 - a) * above[1] + a * (1 - a) * np.outer(off, off)


def _shrunk(row: dict) -> list[list]:
    row = _text(row)
    own, mid, top = ((row[f"{x}rows"], np.array([row[f"{x}{m}"] for m in _MEAN]), _matrix(row, f"{x}c")) for x in ("", "l_", "a_"))
    mean, cov = pooled(*own, pooled(*mid, top[1:]))
    return [_estimated(row, 0, row["n"], row["rows"], mean, cov)]


# --- on the rows --------------------------------------------------------------------

def _moments(values: list[Column] | None = None, prefixes: str = "sq") -> list[Column]:
    v = values or [F.col(f) for f in NAMES]
    sums = [F.sum(x).alias(f"{prefixes[0]}{i}") for i, x in enumerate(v)] if prefixes[0] != "-" else []
    return sums + [F.sum(v[i] * v[j]).alias(f"{prefixes[1]}{i}{j}") for i, j in _PAIRS]


def _distance() -> Column:
    d = [F.col(f) - F.col(f"m{i}") for i, f in enumerate(NAMES)]
    return sum(((2.0 if i != j else 1.0) * F.col(f"w{i}{j}") * d[i] * d[j] for i, j in _PAIRS[1:]), F.col("w00") * d[0] * d[0])


def _joined(rows: DataFrame, table: DataFrame, columns: list[str], keys: list[str] = KEYS, how: str = "inner") -> DataFrame:
    """``rows`` with ``columns`` of a table of a row a group; null keys are equal."""
    on = F.lit(True)
    for k in keys:
        on = on & F.col(f"r.{k}").eqNullSafe(F.col(f"t.{k}"))
    return rows.alias("r").join(table.alias("t"), on, how).select("r.*", *[F.col(f"t.{c}") for c in columns])


def _medians(rows: DataFrame, values: list[Column], names: list[str]) -> DataFrame:
    """(KEYS, names): each value's median within a group, to a bin of 1 / ``FINE``."""
    each = F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.floor(v * FINE).cast("int").alias("bin")) for j, v in enumerate(values)]))
    counts = rows.select(*KEYS, each.alias("x")).groupBy(*KEYS, "x.j", "x.bin").agg(F.count("*").alias("c"))
    w = W.partitionBy(*KEYS, "j")
    running = counts.withColumns({"run": F.sum("c").over(w.orderBy("bin")), "all": F.sum("c").over(w)}).where(F.col("run") * 2 >= F.col("all"))
    middle = running.groupBy(*KEYS, "j").agg(((F.min("bin") + 0.5) / FINE).alias("v"))
    return middle.groupBy(*KEYS).agg(*[F.max(F.when(F.col("j") == j, F.col("v"))).alias(n) for j, n in enumerate(names)])


def _starts(rows: DataFrame) -> DataFrame:
    spreads = [f"d{i}" for i in range(P)]
    middles = stored(_medians(rows, [F.col(f) for f in NAMES], _MEAN), "mcd-medians")
    off = [F.abs(F.col(f) - F.col(m)) for f, m in zip(NAMES, _MEAN, strict=True)]
    apart = _medians(_joined(rows, middles, _MEAN), off, spreads)
    scale = [F.greatest(F.col(d) * 1.4826, F.lit(x)).alias(d) for d, (_, x) in zip(spreads, FEATURES, strict=True)]
    centre = stored(_joined(apart, middles, _MEAN).select(*KEYS, *_MEAN, *scale), "mcd-scales")
    z = [(F.col(f) - F.col(m)) / F.col(d) for f, m, d in zip(NAMES, _MEAN, spreads, strict=True)]
    turned = _joined(rows, centre, _MEAN + spreads).select(*KEYS, *[x.alias(f) for f, x in zip(NAMES, z, strict=True)])
    norm = F.greatest(F.sqrt(sum((F.col(f) * F.col(f) for f in NAMES[1:]), F.col(NAMES[0]) * F.col(NAMES[0]))), F.lit(1e-9))
    sums = turned.groupBy(*KEYS).agg(F.count("*").alias("n"), *_moments([F.tanh(f) for f in NAMES]), *_moments([F.col(f) / norm for f in NAMES], "-u"))
    made = stored(_by_row(_joined(sums, centre, _MEAN + spreads), _started), "mcd")
    discard(middles)
    discard(centre)
    return made


def _concentrated(rows: DataFrame, now: DataFrame) -> DataFrame:
    """Estimates on the h nearest rows of every (group, start)."""
    measured = _joined(rows, now, ["start", *_MEAN, *_INVERSE]).select(*KEYS, "start", *NAMES, F.floor(BINS * F.log2(1 + _distance())).cast("int").alias("bin"))
    key = [*KEYS, "start"]
    by_bin = measured.groupBy(*key, "bin").agg(F.count("*").cast("double").alias("n"), *_moments())
    w = W.partitionBy(*key)
    by_bin = by_bin.withColumns({"run": F.sum("n").over(w.orderBy("bin")), "rows": F.sum("n").over(w)})
    h = F.least(F.col("rows"), F.floor(F.col("rows") * SUPPORT + (P + 1) / 2))
    share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (h - (F.col("run") - F.col("n"))) / F.col("n")))
    near = by_bin.withColumn("share", share).where("share > 0")
    sums = near.groupBy(*key).agg(F.sum(F.col("share") * F.col("n")).alias("n"), F.max("rows").alias("rows"), *[F.sum(F.col("share") * F.col(s)).alias(s) for s in _SUMS])
    return _by_row(sums, _fitted)


def least_determinant(rows: DataFrame) -> DataFrame:
    """The settled estimate of least determinant of each group; ``rows`` have ``KEYS`` and ``NAMES``."""
    now = _starts(rows)
    for _ in range(MOST_STEPS):
        after = stored(_concentrated(rows, now), "mcd")
        change = _joined(after, now.withColumnRenamed("logdet", "before"), ["before"], [*KEYS, "start"]).agg(F.max(F.abs(F.col("logdet") - F.col("before")))).first()[0]
        discard(now)
        now = after
        if change is None or change < SETTLED:
            break
    values = ["n", "rows", *_MEAN, *_COV]
    best = now.groupBy(*KEYS).agg(F.min_by(F.struct(*values, "logdet"), F.struct("logdet", "start")).alias("b"))
    return stored(best.select(*KEYS, F.lit(0).alias("start"), "b.*"), "mcd-best")


def outlier_parameters(vectors: DataFrame) -> DataFrame:
    """Mean and inverse scatter (``_MEAN``, ``_INVERSE``) by (lang, source)."""
    rows = vectors.withColumn("level", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    rows = rows.withColumns({"source": F.when(F.col("level") < 1, F.col("source")), "lang": F.when(F.col("level") < 2, F.col("lang"))})
    raw = stored(_by_row(least_determinant(rows), _corrected), "mcd-raw")
    near = _joined(rows, raw, ["rows", *_MEAN, *_INVERSE]).where(_distance() <= NEAR)
    found = stored(_by_row(near.groupBy(*KEYS).agg(F.count("*").cast("double").alias("n"), F.max("rows").alias("rows"), *_moments()), _reweighted), "mcd-reweighted")
    columns = ["rows", *_MEAN, *_COV]
    named = lambda k, x, keys: found.where(F.col("level") == k).select(*keys, *[F.col(c).alias(f"{x}{c}") for c in columns])
    own = _joined(found.where("level = 0"), named(1, "l_", ["lang"]), [f"l_{c}" for c in columns], ["lang"])
    # one row: the estimate of all rows
    own = own.crossJoin(F.broadcast(named(2, "a_", []).limit(1)))
    return _by_row(own, _shrunk).select("lang", "source", *_MEAN, *_INVERSE)


def judge(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, distance).

    ``distance`` is the squared distance from the group's centre, null where the fixed rules fail.
    """
    made = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), as_bytes().alias("text"))
    rows = map_arrow(rows, lambda b: {c: b[c] for c in ("doc_id", "lang", "source")} | statistics(b["text"].to_pylist()), made)
    rows = stored(rows.select("*", *features(), fails_rules().alias("base_failed")), "quality")
    found = stored(outlier_parameters(rows.where("not base_failed").select("lang", "source", *NAMES)), "mcd-final")
    mine = _joined(rows, found, [*_MEAN, *_INVERSE], ["lang", "source"], "left").withColumn("distance", F.when(~F.col("base_failed"), _distance()))
    far = F.coalesce(F.col("distance") > CUTOFF, F.lit(False))
    return mine.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & ~far).alias("kept"), "distance")
