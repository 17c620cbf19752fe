"""Operators against plain Python on a small table with nulls, repeats, long and empty texts."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from tests.llm.common import documents, empty, rows
from voxlake.llm import chat, components, decontaminate, line_dedup, mixing, quality, sharding, simhash, token_binary, toxicity, url_filter
from voxlake.llm.queries import RULES, tokenizer_path

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACED = re.compile("[^\x20\x09-\x0d]+")


def item_words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))


# --- 1 ---------------------------------------------------------------------------

def brute_contamination(docs, items):
    windows = {}
    for item, text in items:
        w = item_words(text)
        k = min(13, len(w))
        for i in range(len(w) - k + 1) if w else ():
            windows.setdefault(tuple(w[i : i + k]), set()).add(item)
    sizes = {len(x) for x in windows}
    for doc in docs:
        w = item_words(doc[1])
        hit, found = set(), set()
        for k in sizes:
            for i in range(len(w) - k + 1):
                if (own := windows.get(tuple(w[i : i + k]))) is not None:
                    hit.update(range(i, i + k))
                    found |= own
        yield doc[0], len(w), len(hit), tuple(sorted(x for x in found if x is not None))


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_contamination(spark, block_bytes):
    docs = rows()
    bench = [(1, " ".join(item_words(docs[0][1])[:20])), (2, "W1 w2"), (3, None), (4, ""), (5, " ".join(item_words(docs[5][1])[-30:])), (None, "dup DUP dup"), (7, " ".join(item_words(docs[10][1])[:13])), (8, "W1, w2!")]
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontaminate.contamination(documents(spark), table, block_bytes=block_bytes).select("doc_id", "contamination.*").collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == Counter(brute_contamination(docs, bench))
    assert all(sum(s.after - s.first for s in r.hit_spans) == r.n_hit for r in got)


def test_decontaminate_modes(spark):
    docs = documents(spark)
    passage = " ".join(item_words(rows()[5][1])[:30])
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    cut = decontaminate.decontaminate(docs, bench, remove="spans")
    assert cut.count() == docs.count()
    assert not [r for r in decontaminate.contamination(cut, bench).select("contamination.n_hit").collect() if r.n_hit]
    none = decontaminate.contamination(docs, bench.limit(0)).select("contamination.n_hit").distinct().collect()
    assert [r.n_hit for r in none] == [0]


# --- 2 ---------------------------------------------------------------------------

def brute_fingerprint(text):
    w = SPACED.findall((text or "").translate(LOWER))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def least_reachable(n, links):
    p = list(range(n))

    def find(x):
        while p[x] != x:
            p[x] = p[p[x]]
            x = p[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_near_duplicates(spark):
    docs = rows()
    prints = [brute_fingerprint(r[1]) for r in docs]
    roots = least_reachable(len(docs), [(i, j) for i in range(len(docs)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    ids = defaultdict(list)
    for r, root in zip(docs, roots, strict=True):
        if r[0] is not None:
            ids[root].append(r[0])
    want = Counter((r[0], p, min(ids[root], default=None)) for r, p, root in zip(docs, prints, roots, strict=True))
    got = simhash.near_duplicates(documents(spark)).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in got) == want
    kept = simhash.keep_one(documents(spark)).collect()
    assert Counter(r.doc_id for r in kept) == Counter([min(x) for x in ids.values() if x] + [None] * sum(r[0] is None for r in docs))


@pytest.mark.parametrize("chunk", [16, 4096])
def test_links_of_large_buckets(spark, chunk):
    r = np.random.default_rng(3)
    seeds = r.integers(0, 1 << 63, size=12, dtype=np.uint64)
    prints = sorted({int(s) ^ sum(1 << int(b) for b in set(r.integers(0, 64, size=r.integers(0, 6)).tolist())) for s in seeds for _ in range(80)})
    table = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long")
    want = least_reachable(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 3])
    at = {p: i for i, p in enumerate(prints)}
    links = [(at[x.a & (1 << 64) - 1], at[x.b & (1 << 64) - 1]) for x in simhash.fingerprint_links(table, chunk=chunk).collect()]
    assert least_reachable(len(prints), links) == want


def test_tables_of_many_fingerprints():
    for n in (1, 1 << 21, 1 << 30, 1 << 36):
        masks = simhash.bands_for(n)
        r = np.random.default_rng(n % 97)
        for _ in range(300):
            flips = sum(1 << int(b) for b in set(r.integers(0, 64, size=3).tolist()))
            assert any(not flips & m for m in masks)


def test_components(spark):
    r = np.random.default_rng(5)
    links = [(int(a), int(b)) for a, b in r.integers(0, 300, size=(220, 2))] + [(i, i + 1) for i in range(400, 460)] + [(500, 500 + i) for i in range(1, 40)]
    want = least_reachable(600, links)
    got = {x.node: x.root for x in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(600))
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- 3 ---------------------------------------------------------------------------

def test_urls(spark):
    urls = ["http://A.example.com/en/1?x#y", "https://www.example.com/en/", None, "no scheme", "http://x.net/es/a", "http://net", "x://", "http://a.co.uk/1", "http://com/", "HTTP://B.NET/fr/#f", "http://h?q", "http://ex.net/de/ü\nz"]
    table = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "url as host", "'x' as verdict", "cast(null as string) as html")
    got = {r.page_id: r for r in url_filter.judge(table, RULES).collect()}
    assert len(got) == len(urls)
    assert [got[i].rule for i in range(len(urls))] == ["example.com/en/", "www.example.com/en/", None, None, "net/es/", None, None, None, "com/", "net/fr/", None, None]
    assert (got[0].host, got[0].path, got[0].verdict) == ("a.example.com", "/en/1", "block")
    assert [(got[i].host, got[i].path) for i in (2, 3, 6)] == [("", "")] * 3
    assert got[10].host == "h" and got[10].path == "" and got[11].path == "/de/ü\nz"


def brute_weight(groups):
    """``groups``: (n, bad, prior) of each group."""
    seen = [(n, k, p) for n, k, p in groups if n]
    sn, g = sum(n for n, _, _ in seen), len(seen)
    spread, within = sum(n * (k / n - p) ** 2 for n, k, p in seen), sum(n * p * (1 - p) for n, _, p in seen)
    if not within or sn <= g:
        return 1.0
    rho = (spread / (within / sn) - g) / (sn - g)
    return min(100.0, max(1.0, 1 / rho - 1)) if rho > 0 else 100.0


def brute_bounds(outcomes):
    """host to (rate, low, outcomes of its domain); a host is NAME.DOMAIN.SUFFIX here."""
    host = defaultdict(lambda: [0, 0])
    for h, bad in outcomes:
        host[h][0] += bad is not None
        host[h][1] += bad or 0
    domain, suffix = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for h, (n, k) in host.items():
        for into, name in ((domain, h.split(".", 1)[1]), (suffix, h.rsplit(".", 1)[1])):
            into[name][0] += n
            into[name][1] += k
    n, k = sum(x[0] for x in host.values()), sum(x[1] for x in host.values())
    above = lambda name: k / n if n else 0.0
    for level, up in ((suffix, lambda x: None), (domain, lambda x: x.rsplit(".", 1)[1]), (host, lambda x: x.split(".", 1)[1])):
        w = brute_weight([(m, j, above(up(name))) for name, (m, j) in level.items()])
        rates = {name: (j + w * above(up(name))) / (m + w) for name, (m, j) in level.items()}
        above = rates.__getitem__
    return {h: (r, r - 1.645 * (r * (1 - r) / (host[h][0] + w + 1)) ** 0.5, domain[h.split(".", 1)[1]][0]) for h, r in rates.items()}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_unruled_pages_by_brute_force(spark, seed):
    r = np.random.default_rng(seed)
    rate = {f"h{i}.d{i % 7}.{'org' if i % 7 < 4 else 'io'}": [0.02, 0.9, 0.3][i % 3 if seed > 1 else 0] for i in range(40)}
    seen = [(h, int(r.random() < p) if r.random() < 0.9 else None) for h, p in rate.items() for _ in range(int(r.integers(1, 30)))]
    seen += [("new.d1.org", None), ("new.d9.io", None)]
    pages = [(i, f"http://{h}/p{i}", None if bad is None else ("<p>" + ("#*$%" * 20 if bad else "a clean page & more") + "</p><script>'####'</script>")) for i, (h, bad) in enumerate(seen)]
    want = brute_bounds(seen)
    got = url_filter.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), RULES).collect()
    assert len(got) == len(pages)
    for x in got:
        rate_, low, n = want[x.host]
        assert abs(x.low - low) < 1e-9 and x.rule is None and x.verdict == ("block" if low > url_filter.MOST_BAD and n else "allow")
    if seed > 1:
        assert {x.verdict for x in got} == {"allow", "block"}
    assert {x.verdict for x in got if x.host == "new.d9.io"} == {"allow"}


def test_reputation_shrinks(spark):
    seen = [(f"h{i}.bad.org", 1) for i in range(8) for _ in range(20)] + [(f"h{i}.good.org", 0) for i in range(8) for _ in range(20)] + [("new.bad.org", None), ("new.good.org", None)]
    got = {r.host: r for r in url_filter.reputation(spark.createDataFrame(seen, "host string, bad int")).collect()}
    assert got["new.bad.org"].rate > 0.9 > 0.1 > got["new.good.org"].rate
    assert got["h1.bad.org"].low > 0.5 > got["h1.good.org"].rate and got["h1.bad.org"].low > got["new.bad.org"].low
    assert all(0 <= r.rate <= 1 for r in got.values())
    none = url_filter.reputation(spark.createDataFrame([("a.b.org", None)], "host string, bad int")).collect()
    assert [(x.rate, x.weight) for x in none] == [(0.0, 1.0)]


def test_outcomes_of_pages(spark):
    from pyspark.sql import functions as F

    made = [("free-bets.x.org", None, 1), ("x.org", None, None), ("alphabets.org", "<style>####</style>word &#35;&amp; word", 0), ("x.org", "<b>a### b***</b>", 1), ("x.org", "", 0)]
    table = spark.createDataFrame(made, "host string, html string, want int").select("want", url_filter.outcome(F.col("host"), F.col("html")).alias("got"))
    assert all(x.want == x.got for x in table.collect())


def test_registered_domains(spark):
    names = spark.createDataFrame([("a.b.co.uk",), ("b.co.uk",), ("co.uk",), ("x.org",), ("org",), ("",)], "h string")
    from pyspark.sql import functions as F

    assert [tuple(r) for r in names.select(*url_filter.domain_and_suffix(F.col("h"))).collect()] == [
        ("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.org", "org"), ("org", "org"), ("", "")
    ]


# --- 4 ---------------------------------------------------------------------------

def test_chat_round_trip(spark):
    said = [(1, 0, "user", "</s>[INST] ok & &lt; <|im_end|>\n"), (1, 1, "assistant", "a\n<b>é𝄞"), (1, 2, "user", None), (1, 3, "assistant", "<|im_start|>x"), (2, 0, "as\nsis", ""), (3, None, None, None)]
    events = spark.createDataFrame([(c, t, t, r, None, x) for c, t, r, x in said], "conv_id long, turn long, seq long, role string, kind string, text string")
    made = chat.format_chats(events)
    back = {r.conv_id: r for r in chat.read_back(made).collect()}
    for conv in (1, 2, 3):
        own = [(r or "", x or "") for c, _, r, x in said if c == conv]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        assert back[conv].loss_text == "".join(x for r, x in own if r == "assistant")
    assert back[1].formatted.count("<|im_start|>") == 4
    assert chat.format_chats(events.limit(0)).count() == 0


def test_chat_fold(spark):
    log = [  # seq, turn, role, kind, text
        (1, 0, "user", "delta", "hel"), (2, 0, "user", "delta", "lo"), (3, 1, "assistant", "delta", "bad"), (4, 1, "assistant", "regenerate", ""), (5, 1, "assistant", "delta", "good"),
        (6, 2, "user", "delta", "more"), (7, 0, "user", "edit", "hi"), (8, 1, "assistant", "delta", "anew"), (9, 700, "user", "delta", "far"), (10, 699, "assistant", "edit", "cut"),
    ]
    events = spark.createDataFrame([(1, *x) for x in reversed(log)], "conv_id long, seq long, turn long, role string, kind string, text string")
    got = [(r.turn, r.role, r.text) for r in chat.folded(events).orderBy("turn").collect()]
    assert got == [(0, "user", "hi"), (1, "assistant", "anew"), (699, "assistant", "cut")]


def test_log_of_messages_folds_back(spark):
    said = [(1, t, 1, r, x) for t, r, x in [(None, "system", "odd"), (-(1 << 63), "user", "least"), (0, "user", "héllo 𝄞 there"), (1, "assistant", ""), (2, "user", None), (3, "assistant", "x"), (4, None, "y" * 1001), ((1 << 63) - 1, "user", "last")]]
    said += [(2, 0, 1, "user", "a"), (2, 0, 2, "user", "b"), (None, 5, 1, "user", "c")]
    messages = spark.createDataFrame(said, "conv_id long, turn long, copy int, role string, text string")
    log = chat.as_log(messages)
    assert log.where("text = 'superseded'").count() == 9 and {r.kind for r in log.collect()} == {"delta", "edit", "regenerate"}
    got = Counter((r.conv_id, r.turn, r["copy"], r.role, r.text) for r in chat.folded(log.repartition(5)).collect())
    assert got == Counter((c, t, k, r or "", x or "") for c, t, k, r, x in said)


# --- 5 ---------------------------------------------------------------------------

PARTS = ([3.0, 1.0, 2.0], 1.5, 2.0)


def brute_schedule(goals, size, sequence="golden"):
    """Sources of the slots: ``goals`` (source, words), in order."""
    total, slots, ends, at = sum(w for _, w in goals), [], [], 0
    for name, w in goals:
        at += w
        ends.append((at * 2**31 // total, name))
    for i in range(-(-total // size)):
        p = (i + 1) * 1327217885 % 2**31 if sequence == "golden" else int(f"{i + 1:031b}"[::-1], 2)
        slots.append(next(name for end, name in ends if p < end))
    return slots


@pytest.mark.parametrize("sequence", ["golden", "van_der_corput"])
def test_schedule_against_brute_force(spark, sequence):
    goals = [("a", 30000), ("b", 10000), ("c", 7), (None, 999)]
    table = spark.createDataFrame([(s, w, float(w), 2 * w) for s, w in goals], "source string, source_size long, target double, limit long")
    plan = sorted((r.slot, r.source, r["rank"], r.start, r.after, r.words) for r in mixing.schedule(table, 10, sequence).collect())
    want = brute_schedule(goals, 10, sequence)
    assert [x[1] for x in plan] == want
    for name, words in goals:
        own = [x for x in plan if x[1] == name]
        assert [x[2] for x in own] == list(range(len(own)))
        assert all(x[4] - x[3] == 10 for x in own[:-1]) and all(x[4] == y[3] for x, y in zip(own, own[1:], strict=False))
        assert all(x[5] == min(2 * words, 10 * len(own)) for x in own)
        # every prefix of the mix is near the targets
        seen, share = 0, words / sum(w for _, w in goals)
        for k, x in enumerate(plan, 1):
            seen += x[1] == name
            assert abs(seen - k * share) <= (3 if sequence == "golden" else 1 + np.log2(k + 1) / 2)


@pytest.mark.parametrize("sequence", ["golden", "van_der_corput"])
def test_mixing(spark, sequence):
    docs = documents(spark)
    got = mixing.taken(docs, *PARTS, slot_words=64, sequence=sequence).collect()
    want = [(r[0], len(SPACED.findall(r[1] or ""))) for r in rows()]
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter(want)
    assert all(0 <= r.taken <= 2 * r["size"] and (r.slot is None) == (r.taken == 0) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, (s or "").encode()))
    slots = Counter(brute_schedule([(s, int(by[s][0].target)) for s in order], 64, sequence))
    for s, own in by.items():
        assert sum(r.taken for r in own) == min(2 * own[0].source_size, 64 * slots[s])
        assert abs(sum(r.taken for r in own) - own[0].target) <= 4 * 64 and sum(r["size"] for r in own) == own[0].source_size
        assert own[0].target <= 2 * own[0].source_size + 1e-6
    assert abs(sum(own[0].target for own in by.values()) - 1.5 * sum(n for _, n in want)) < 1e-3
    again = mixing.taken(docs.repartition(7), *PARTS, slot_words=64, sequence=sequence).collect()
    assert Counter(again) == Counter(got)


def test_sequences_differ_within_the_bound(spark):
    docs = documents(spark)
    a, b = ({(s.source): s.w for s in mixing.taken(docs, *PARTS, slot_words=16, sequence=q).groupBy("source").sum("taken").toDF("source", "w").collect()} for q in ("golden", "van_der_corput"))
    assert a != b and all(abs(a[s] - b[s]) <= 8 * 16 for s in a)


def test_mixed_rows_hold_what_is_taken(spark):
    docs = documents(spark)
    assert docs.columns == mixing.mixed(docs, *PARTS).columns
    made = mixing.mixed(docs, *PARTS, slot_words=64)
    uses = mixing.taken(docs, *PARTS, slot_words=64).collect()
    words, empties = Counter(), Counter()
    texts = defaultdict(set)
    for r in rows():
        texts[r[0]].add(r[1] or "")
    out = [p.asDict() for p in made.collect()]
    for r in out:
        n = len(SPACED.findall(r["text"] or ""))
        (words if n else empties)[r["doc_id"]] += n or 1
        assert any(t.startswith(r["text"] or "") for t in texts[r["doc_id"]])
    assert +words == +Counter({k: v for k, v in ((d, sum(u.taken for u in uses if u.doc_id == d)) for d in {u.doc_id for u in uses})})
    assert empties == Counter(u.doc_id for u in uses if u["size"] == 0)
    # in the schedule's order: the slots of first passes never fall, but for second passes
    once = {u.doc_id: u.slot for u in uses if 0 < u.taken <= u["size"]}
    order = [once[r["doc_id"]] for r in out if r["doc_id"] in once and r["doc_id"] is not None and r["doc_id"] != rows()[3][0]]
    assert order == sorted(order)


def test_first_words(spark):
    from pyspark.sql import functions as F

    text = "  a\x01 b\n\nc\td\x0b é 𝄞x  "
    got = [spark.range(1).select(mixing.first_words(F.lit(text), F.lit(n))).first()[0] for n in range(1, 7)]
    assert [SPACED.findall(x) for x in got] == [["a\x01", "b", "c", "d", "é", "𝄞x"][:n] for n in range(1, 7)]
    assert all(text.startswith(x) and not x[-1].isspace() for x in got)


# --- 6 ---------------------------------------------------------------------------

def brute_statistics(text):
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    hit = {j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark):
    got = quality.judge(documents(spark)).collect()
    want = []
    for r in rows():
        s = brute_statistics(r[1])
        want.append((r[0], *s, s[0] < 10 or 100 * s[4] > 20 * s[0]))
    assert Counter(tuple(r)[:7] for r in got) == Counter(want)
    assert not [r for r in got if r.kept and r.base_failed]


def test_outliers_go_and_others_stay(spark):
    r = np.random.default_rng(1)
    made = [(i, " ".join(f"word{r.integers(5000)}" for _ in range(int(np.exp(r.normal(5, 0.5))) + 12)), "en", "s") for i in range(400)]
    made += [(1000 + i, " ".join("w" * 60 + f"#$%{r.integers(10**9)}###" for _ in range(200)), "en", "s") for i in range(5)]
    got = {x.doc_id: x.kept for x in quality.judge(spark.createDataFrame(made, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i in range(400)) and not any(got[1000 + i] for i in range(5))


def brute_mcd(x, starts=200, seed=0):
    """Least log determinant of the floored scatter over FAST-MCD's random starts, its mean and scatter."""
    r = np.random.default_rng(seed)
    n, p = x.shape
    h = int(n * quality.SUPPORT + (p + 1) / 2)
    best = None
    for _ in range(starts):
        own = x[r.choice(n, p + 1, replace=False)]
        last = np.inf
        for _ in range(100):
            mean, cov = own.mean(axis=0), quality.floored(np.cov(own.T, bias=True))
            now = np.linalg.slogdet(cov)[1]
            if len(own) == h and last - now < 1e-9:
                break
            last = now if len(own) == h else np.inf
            off = x - mean
            own = x[np.argsort(np.einsum("ij,jk,ik->i", off, np.linalg.inv(cov), off), kind="stable")[:h]]
        if best is None or now < best[0]:
            best = now, mean, cov
    return best


def vectors(spark, x, lang="en", source="s"):
    return spark.createDataFrame([(lang, source, *map(float, v)) for v in x], "lang string, source string, " + ", ".join(f"{f} double" for f in quality.NAMES))


@pytest.mark.parametrize(("n", "share", "above"), [(300, 0.0, 0.1), (300, 0.3, 0.1), (40, 0.2, 0.5)])
def test_least_determinant_against_fast_mcd(spark, n, share, above):
    """Of few rows three starts may settle in a minimum near the least that 200 find."""
    from pyspark.sql import functions as F

    r = np.random.default_rng(n)
    turn = r.normal(size=(quality.P, quality.P))
    x = r.normal(size=(n, quality.P)) @ turn * 2 + 5
    x[: int(n * share)] = r.normal(size=(int(n * share), quality.P)) * 0.5 + 40
    rows_ = vectors(spark, x).withColumn("level", F.lit(0))
    got = quality.least_determinant(rows_).first()
    logdet, mean, _ = brute_mcd(x)
    assert got.rows == n and got.n == int(n * quality.SUPPORT + (quality.P + 1) / 2)
    assert got.logdet <= logdet + above
    spread = np.sqrt(np.diag(np.cov(x[int(n * share) :].T)))
    assert (np.abs(np.array([got[m] for m in quality._MEAN]) - mean) < 0.5 * spread).all()


def test_clustered_outliers_do_not_mask_themselves(spark):
    from pyspark.sql import functions as F

    r = np.random.default_rng(9)
    good, bad = r.normal(size=(700, quality.P)) * 2, r.normal(size=(300, quality.P)) * 0.3 + 20
    few = r.normal(size=(6, quality.P)) * 2
    table = vectors(spark, np.concatenate([good, bad])).unionByName(vectors(spark, few, "en", "few")).unionByName(vectors(spark, few[:1], None, None))
    found = {(p.lang, p.source): p for p in quality.outlier_parameters(table).collect()}
    assert set(found) == {("en", "s"), ("en", "few"), (None, None)}
    p = spark.createDataFrame([found["en", "s"]])
    far = lambda x: [v.d > quality.CUTOFF for v in vectors(spark, x).drop("lang", "source").crossJoin(F.broadcast(p)).select(quality._distance().alias("d")).collect()]
    assert all(far(bad)) and not any(far(good))
    # small groups lean on their language's estimate, and one row on that of all
    assert all(abs(found["en", "few"][f"m{i}"]) < 2.5 for i in range(quality.P))
    assert all(abs(found[None, None][f"m{i}"]) < 1 for i in range(quality.P))


def test_factors():
    assert abs(quality.CUTOFF - 51.0) < 0.5 and abs(quality.chi2_quantile(0.5, 5) - 4.3515) < 1e-3 and abs(quality.NEAR - 12.833) < 1e-2
    r = np.random.default_rng(4)
    d = np.sort((r.normal(size=(200_000, 5)) ** 2).sum(axis=1))
    kept = d[: len(d) // 2]
    assert abs(quality.consistency(0.5) * kept.mean() / 5 - 1) < 0.02
    assert quality.small_sample(30) > quality.small_sample(300) > 1 > quality.small_sample(1e9) - 1e-3


# --- 7 ---------------------------------------------------------------------------

def brute_jump(key, shards):
    key &= (1 << 64) - 1
    b, j = -1, 0
    while j < shards:
        b = j
        key = (key * 2862933555777941757 + 1) & (1 << 64) - 1
        j = int((b + 1) * (float(1 << 31) / float((key >> 33) + 1)))
    return b


def test_sharding(spark):
    keys = np.array([0, 1, -1, 5, 1 << 62, -(1 << 63), 123456789], dtype=np.int64)
    for n in (1, 2, 8, 9, 1000):
        assert sharding.jump(keys, n).tolist() == [brute_jump(int(k), n) for k in keys]
    got = sharding.sharded(documents(spark)).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows())
    slots = defaultdict(list)
    for r in got:
        assert (r.shard, r.grown_shard) == (brute_jump(r.doc_id or 0, 8), brute_jump(r.doc_id or 0, 9)) and r.grown_shard in (r.shard, 8)
        slots[r.shard].append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


# --- 8 ---------------------------------------------------------------------------

@pytest.mark.parametrize("top", [0, 1, 1000, 1 << 40])
def test_elias_fano(top):
    r = np.random.default_rng(top % 11)
    for n in (0, 1, 5, 3000):
        v = np.sort(r.integers(0, top + 1, size=n))
        raw = token_binary.elias_fano(v)
        b = token_binary.Boundaries(raw)
        picked = r.permutation(n)
        assert b.select(picked).tolist() == v[picked].tolist()
    dense = np.arange(0, 300_000, 100)
    assert len(token_binary.elias_fano(dense)) < len(dense) * 1.3


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_tokens(spark, name):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(tokenizer_path(name))
    assert token_binary.Encoder(tokenizer_path(name)).alone == (name == "word_bpe_49k.json")
    odd = [(900, "J\u030cabc", "en", "s"), (901, "<|endoftext|> <|ENDOFTEXT|>", "en", "s"), (902, "İΑΣ don't 'S e\u0301 \x1c\u00a0x", "en", "s")]
    odd += [(-(1 << 63), "Naïve, naïve... (naïve) o'er o'er! l'été'", "en", "s"), ((1 << 63) - 1, "a1b2 x--y _z_ 日本, ﬁn ªº, ŉx\u0301! ß§ §ß", "en", "s"), (903, "it's 'tis we'll'd, ''s '' ΑΣ, ΑΣ", "en", "s")]
    docs = documents(spark).unionByName(spark.createDataFrame(odd, "doc_id long, text string, lang string, source string"), allowMissingColumns=True)
    got = token_binary.tokenized(docs, tokenizer_path(name)).collect()
    every = sorted(((r[0], r[1] or "") for r in [*rows(), *odd]), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    want, at = [], 0
    for doc, text in every:
        ids = [*own.encode(text, add_special_tokens=False).ids, 2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda x: x[1]) == want


# --- 9 ---------------------------------------------------------------------------

def test_toxicity(spark):
    r = np.random.default_rng(2)
    plain = [f"word{i}" for i in range(300)]
    bad = ["vileling", "vilester", "vilesome", "grimly"]

    def doc(toxic):
        w = [str(x) for x in r.choice(plain, size=int(r.integers(20, 200)))]
        for _ in range(3 * toxic):
            w[int(r.integers(len(w)))] = str(r.choice(bad))
        return " ".join(w)

    made = [(i, doc(i % 4 == 0), "en", "s") for i in range(500)] + [(600, None, "en", "s"), (601, "", "en", "s"), (602, "plain " * 30000, "en", "s"), (None, "x", None, None)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(500)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.judged(docs, labels).collect()}
    assert len(got) == len(made) and all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert {i for i, x in got.items() if x.held_out and i is not None and i < 600} == set(held)
    right = [got[i].predicted == int(i % 4 == 0) for i in held]
    assert sum(right) / len(right) >= 0.95
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() < docs.count()
    none = toxicity.judged(docs, labels.limit(0)).select("score").distinct().collect()
    assert [x.score for x in none] == [0.0]


def test_network_gradient():
    r = np.random.default_rng(0)
    n = toxicity.Network(1)
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    x = r.normal(size=(6, 5, toxicity.INPUTS))
    mask = (np.arange(6)[:, None] < np.array([6, 3, 1, 5, 0])).astype(float)
    keep = {}
    n.forward(x, mask, keep)
    g = r.normal(size=5)
    grad, _ = n.backward(keep, g)
    for k, v in n.p.items():
        i = tuple(int(r.integers(s)) for s in v.shape)
        v[i] += 1e-3
        up = n.forward(x, mask) @ g
        v[i] -= 2e-3
        down = n.forward(x, mask) @ g
        v[i] += 1e-3
        assert abs((up - down) / 2e-3 - grad[k][i]) < 1e-2


def brute_logit(n, x):
    """One window (time, inputs) through the network, number by number."""
    p, h_size = n.p, toxicity.HIDDEN
    sig = lambda v: 1 / (1 + np.exp(-v))
    hidden = {}
    for d in "fb":
        h, out = [0.0] * h_size, []
        for t in range(len(x)) if d == "f" else reversed(range(len(x))):
            gate = lambda k: sum(x[t][i] * p[f"W{d}"][i][k] for i in range(toxicity.INPUTS)) + p[f"B{d}"][k]  # noqa: B023, E731
            state = lambda k: sum(h[i] * p[f"U{d}"][i][k] for i in range(h_size))  # noqa: B023, E731
            z = [sig(gate(k) + state(k)) for k in range(h_size)]
            r = [sig(gate(h_size + k) + state(h_size + k)) for k in range(h_size)]
            new = [np.tanh(gate(2 * h_size + k) + r[k] * state(2 * h_size + k)) for k in range(h_size)]
            h = [z[k] * h[k] + (1 - z[k]) * new[k] for k in range(h_size)]
            out.append(h)
        hidden[d] = out if d == "f" else out[::-1]
    both = [a + b for a, b in zip(hidden["f"], hidden["b"], strict=True)]
    weigh = [np.exp(sum(p["v"][j] * np.tanh(sum(h[i] * p["A"][i][j] for i in range(2 * h_size)) + p["a"][j]) for j in range(h_size))) for h in both]
    pooled = [sum(w * h[i] for w, h in zip(weigh, both, strict=True)) / sum(weigh) for i in range(2 * h_size)]
    return sum(a * b for a, b in zip(pooled, p["u"], strict=True)) + p["c"][0]


def test_network_against_brute_force():
    r = np.random.default_rng(6)
    n = toxicity.Network(3)
    lengths = [1, 2, 5, 9]
    x = r.normal(size=(9, 4, toxicity.INPUTS)).astype(np.float32)
    mask = (np.arange(9)[:, None] < np.array(lengths)).astype(np.float32)
    got = n.forward(x, mask)
    want = [brute_logit(n, x[:k, i].tolist()) for i, k in enumerate(lengths)]
    assert np.abs(got - want).max() < 1e-4


def test_order_of_words_counts(spark):
    """Toxic and clean texts hold the same words; only the recurrent part can tell their order."""
    r = np.random.default_rng(5)
    plain = [f"word{i}" for i in range(60)]

    def doc(bad):
        w = [str(x) for x in r.choice(plain, size=12)]
        for at in (2, 7):
            w[at : at + 2] = ["grimly", "vileling"] if bad else ["vileling", "grimly"]
        return " ".join(w)

    made = [(i, doc(i % 2), "en", "s") for i in range(900)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(900)], "doc_id long, toxic int")
    held = [x for x in toxicity.judged(docs, labels).collect() if x.held_out]
    right = sum(x.predicted == x.doc_id % 2 for x in held) / len(held)
    assert right >= 0.9


# --- 10 --------------------------------------------------------------------------

def brute_removed(docs, least):
    places = sorted({((d[0] is not None, d[0] or 0, m), i, x) for d in docs for m in [np.array([xxhash.xxh3_64_intdigest((d[1] or "").encode())], dtype=np.uint64).view(np.int64)[0]] for i, x in enumerate((d[1] or "").split("\n"))})
    lines = defaultdict(list)
    for d, _, x in places:
        lines[d].append(x)
    starts = [(d, i) for d, i, _ in places]
    gone = defaultdict(set)
    by_line = defaultdict(list)
    for d, i in starts:
        by_line[lines[d][i]].append((d, i))
    for line, where in by_line.items():
        for a in where:
            best = 0
            for b in where:
                if b < a:
                    k = 0
                    while a[1] + k < len(lines[a[0]]) and b[1] + k < len(lines[b[0]]) and lines[a[0]][a[1] + k] == lines[b[0]][b[1] + k]:
                        k += 1
                    best = max(best, k)
            if best and sum(len(SPACED.findall(x)) for x in lines[a[0]][a[1] : a[1] + best]) >= least:
                gone[a[0]].update(range(a[1], a[1] + best))
    return gone


@pytest.mark.parametrize("least", [1, 8, 50])
def test_line_dedup(spark, least):
    docs = rows()
    gone = brute_removed(docs, least)
    got = line_dedup.judged(documents(spark), least).collect()
    want = Counter()
    for d in docs:
        mark = np.array([xxhash.xxh3_64_intdigest((d[1] or "").encode())], dtype=np.uint64).view(np.int64)[0]
        want[(d[0], (d[1] or "").count("\n") + 1, tuple(sorted(gone[(d[0] is not None, d[0] or 0, mark)])))] += 1
    assert Counter((r.doc_id, r.n_lines, tuple(r.removed)) for r in got) == want
    assert all(r.n_removed == len(r.removed) for r in got)


def test_line_dedup_texts(spark):
    docs = documents(spark)
    made = line_dedup.deduplicated(docs, 8)
    assert made.columns == docs.columns and made.count() == docs.count()
    once = [r for r in line_dedup.judged(made.where("doc_id is not null").dropDuplicates(["doc_id"]), 60).collect()]
    assert sum(r.n_removed for r in once) <= sum(r.n_removed for r in line_dedup.judged(docs, 60).collect())


# --- all -------------------------------------------------------------------------

def test_empty_tables(spark):
    none = empty(spark)
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert decontaminate.contamination(none, bench).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string, html string"), RULES).count() == 0
    assert mixing.taken(none, [3.0, 1.0, 2.0], 1.5, 2.0).count() == 0
    assert mixing.mixed(none, [3.0, 1.0, 2.0], 1.5, 2.0).count() == 0
    assert quality.judge(none).count() == 0
    assert sharding.sharded(none).count() == 0
    assert token_binary.tokenized(none, tokenizer_path()).count() == 0
    assert toxicity.judged(none, labels).count() == 0
    assert line_dedup.judged(none).count() == 0
