"""The pipeline's stages in sequence against plain Python, on a small table with awkward rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tests.llm import common
from tests.llm.test_operators import SPACED, brute_contamination, brute_fingerprint, brute_schedule, item_words, least_reachable
from voxlake.llm import toxicity
from voxlake.llm.queries import tokenizer_path

VILE = ["vileling", "vilester", "vilesome", "grimly"]


def toxic(text):
    return any(v in (text or "") for v in VILE)


def made_rows():
    r = random.Random(4)
    plain = [f"word{i}" for i in range(300)]

    def doc(bad):
        w = [r.choice(plain) for _ in range(r.randint(30, 120))]
        for _ in range(4 * bad):
            w[r.randrange(len(w))] = r.choice(VILE)
        return " ".join(w)

    out = [(1000 + i, doc(i % 4 == 0), ["en", "de"][i % 2], ["s1", "s2", None][i % 3]) for i in range(240)]
    own = [(d, t, lang, s) for d, t, lang, s, *_ in common.rows()]
    copies = [(2000 + i, out[4 * i + 1][1], "en", "s9") for i in range(10)]  # exact copies
    return own + out + copies


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipeline")
    rows = made_rows()
    full = [(*x, None if x[1] is None else len(x[1])) for x in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{at}/documents.parquet")
    labels = [(d, 1, int(toxic(t))) for d, t, _, _ in rows if d is not None and 1000 <= d < 2000]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    bench = [(1, " ".join(item_words(rows[5][1])[-20:])), (2, rows[100][1]), (3, None), (4, ""), (5, "nothing of this stands in any text")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at), rows, bench


def brute_mix(rows, weights=(3.0, 1.0, 2.0), share=1.5, most=2.0):
    """(doc_id, words taken) of every pass of a document, by the schedule."""
    size = lambda t: len(SPACED.findall(t or ""))
    by = defaultdict(list)
    for row in rows:
        by[row[3]].append(row)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    sizes = {s: sum(size(x[1]) for x in by[s]) for s in order}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    # water filling
    left, budget, target = set(order), share * sum(sizes.values()), {}
    while left:
        level = budget / sum(weight[s] for s in left)
        full = {s for s in left if level * weight[s] >= most * sizes[s]}
        if not full:
            target |= {s: level * weight[s] for s in left}
            break
        for s in full:
            target[s] = most * sizes[s]
            budget -= target[s]
        left -= full
    goals = [(s, int(target[s] + 1e-6)) for s in order if target[s] >= 1]
    total = sum(w for _, w in goals)
    words = max(1, min(1024, -(-total // 65536)))
    slots = defaultdict(int)
    for s in brute_schedule(goals, words):
        slots[s] += 1
    out = []
    for s in order:
        take = min(int(most * sizes[s]), slots[s] * words)
        mark = lambda x: hashlib.md5("\x01".join("-" if v is None else f"={v}" for v in (x[0], x[3], x[1])).encode()).hexdigest()
        stream = sorted(by[s], key=lambda x: (hashlib.md5(f"mix{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] is not None, x[0] or 0, size(x[1]), mark(x)))
        at = 0
        for _ in range(2):
            for x in stream:
                n = min(size(x[1]), take - at)
                if n > 0:
                    out.append((x, n))
                at += size(x[1])
        out += [(x, 0) for x in stream if not size(x[1])]
    return out


def cut(text, n):
    """The text up to the end of its n-th word."""
    ends = [m.end() for m in SPACED.finditer(text or "")]
    return text if n >= len(ends) else text[: ends[n - 1]]


def test_pipeline_against_plain_python(spark, folder):
    from tokenizers import Tokenizer

    at, rows, bench = folder
    # 1: the model's own verdicts, held against the planted words
    docs = spark.read.parquet(f"{at}/documents.parquet")
    judged = {(r.doc_id): r.predicted for r in toxicity.judged(docs, spark.read.parquet(f"{at}/labels.parquet")).collect() if r.doc_id is not None}
    made = [r for r in rows if r[0] is not None and r[0] >= 1000]
    assert sum(judged[r[0]] == int(toxic(r[1])) for r in made) >= 0.97 * len(made)
    nameless = [r for r in rows if r[0] is None]
    kept = [r for r in rows if r[0] is not None and not judged[r[0]]] + nameless
    # 2: one row of each group of near copies; rows without an id stay
    known = [r for r in kept if r[0] is not None]
    prints = [brute_fingerprint(r[1]) for r in known]
    roots = least_reachable(len(known), [(i, j) for i in range(len(known)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    first = {}
    for r, root in zip(known, roots, strict=True):
        first[root] = min(first.get(root, r), r, key=lambda x: x[0])
    kept = [*first.values(), *nameless]
    # 3: contaminated documents go
    verdicts = list(brute_contamination(kept, bench))
    kept = [r for r, (_, n_words, n_hit, _) in zip(kept, verdicts, strict=True) if not (n_hit and 20 * n_hit >= n_words)]
    assert all(r[0] not in (rows[5][0], rows[100][0]) for r in kept)
    # 4 and 5: the mix, and the token files' digest of it
    own = Tokenizer.from_file(tokenizer_path())
    mixed = sorted(((x[0], own.encode(cut(x[1], n) if n else x[1] or "", add_special_tokens=False).ids + [2]) for x, n in brute_mix(kept)), key=lambda x: (x[0] is not None, x[0] or 0, np.array(x[1], dtype="<u2").tobytes()))
    got = sorted(map(tuple, corpus_pipeline.run(spark, at).select("doc_id", "start", "n_tokens", "ids_crc32").collect()), key=lambda x: x[1])
    assert [g[0] for g in got] == [m[0] for m in mixed]
    assert [g[1] for g in got] == np.concatenate(([0], np.cumsum([len(m[1]) for m in mixed])[:-1])).tolist()
    digest = lambda ids: zlib.crc32(np.array(ids, dtype="<u4").tobytes())
    group = lambda pairs: {d: sorted(x for e, x in pairs if e == d) for d in {e for e, _ in pairs}}
    assert group([(g[0], (g[2], g[3])) for g in got]) == group([(d, (len(ids), digest(ids))) for d, ids in mixed])


def test_stages_keep_the_columns(spark, folder):
    at = folder[0]
    docs = spark.read.parquet(f"{at}/documents.parquet").withColumnsRenamed({"n_chars": "size"}).selectExpr("*", "'a' as score", "'b' as slot", "1 as `dotted.name`")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, at)
        assert out.columns == docs.columns, name
        assert out.schema.simpleString() == docs.schema.simpleString() and 0 < out.count()


def test_stages_on_an_empty_table(spark, folder):
    at = folder[0]
    docs = spark.read.parquet(f"{at}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, at).count() == 0
