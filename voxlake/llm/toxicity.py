"""Toxicity: a bidirectional gated recurrent network with attention pooling.

A text's lower-cased words go through the network in overlapping windows of ``STEPS``
words, one every ``STRIDE``; the whole text is covered, and its score is that of its
highest window.  A word's input joins word and character evidence: shrunken log odds of
the word and of its character n-grams (mean and largest), whether the word was seen in
training, and learned embeddings of the word and of its n-grams, in hashed tables of
fixed size.  Forward and backward passes, the attention and the training are numpy.

Training is on the driver, on a bounded sample of labelled rows: at most
``SAMPLE_TOXIC`` toxic and ``SAMPLE_CLEAN`` clean rows by hashed id, of texts up to
``SAMPLE_CHARS`` characters (of rows that share an id, the least text).  Log odds for a training row come from the half of the
sample that it is not in.  A toxic text is taught by its highest window (by evidence at
first, then by the network), a clean one by its highest and a random one.  A logistic
fit on the sample's scores then sets the scale, so that 0.5 divides the classes.

Defined cases: a null or empty text, or one without words, is scored as an empty
window; rows without doc_id are scored and count as held out; labels that are repeated
for an id count as toxic if any does; with no labelled row, or one class only, every
score is that share of toxic rows or 0; repeated rows are scored alike; an empty table
gives an empty result; columns other than text (lang, source, doc_id) are never inputs.
"""

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from voxlake.llm.common import WORD_BYTES, as_bytes, map_arrow

STEPS, STRIDE = 48, 32
HIDDEN, FIXED, LEARNED = 8, 4, 2
INPUTS = FIXED + 2 * LEARNED
BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_CHARS = 2000, 3000, 16_000
EPOCHS, BATCH, RATE = 14, 128, 0.01
#: Distinct words whose inputs a task keeps.
KEPT_WORDS = 200_000
#: Windows scored at a time, and words whose n-grams are taken together.
CHUNK, BLOCK = 2048, 20_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(WORD_BYTES).split() if text else []


def word_buckets(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words)) % BUCKETS


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all words' character n-grams (with ends marked), word after word, and each word's first."""
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    text = np.frombuffer(b"<" + b"><".join(words) + b">", dtype=np.uint8).astype(np.uint32)
    after = np.repeat(np.cumsum(sizes), sizes)  # where each byte's word ends
    at = np.arange(len(text))
    found, owner = [], []
    word = np.repeat(np.arange(len(words)), sizes)
    h = np.zeros(len(text), dtype=np.uint32)
    for j in range(max(GRAMS)):
        h = h * np.uint32(16777619)
        h[: len(text) - j] ^= text[j:]
        if j + 1 in GRAMS:
            inside = np.flatnonzero(at + j < after)
            mixed = (h[inside] ^ np.uint32(j * 0x9E3779B1 & 0xFFFFFFFF)) * np.uint32(2654435761)
            found.append(mixed >> np.uint32(16))
            owner.append(word[inside])
    owners = np.concatenate(owner)
    order = np.argsort(owners, kind="stable")
    return np.concatenate(found)[order].astype(np.int64), np.searchsorted(owners[order], np.arange(len(words)))


class Vocabulary:
    """Words' buckets and, by blocks of words, their n-grams' buckets in 16 bits."""

    def __init__(self, words: list[bytes]):
        self.n, self.buckets = len(words), word_buckets(words)
        found = [gram_buckets(words[i : i + BLOCK]) for i in range(0, len(words), BLOCK)]
        self.count = np.concatenate([np.diff(np.concatenate((first, [len(grams)]))) for grams, first in found])
        self.grams = np.concatenate([grams.astype(np.uint16) for grams, _ in found])
        self.first = np.concatenate(([0], np.cumsum(self.count)[:-1]))

    def blocks(self) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Words, their grams, and each word's first among these."""
        for i in range(0, self.n, BLOCK):
            some = slice(i, min(i + BLOCK, self.n))
            first = self.first[some]
            yield some, self.grams[first[0] : first[-1] + self.count[some][-1]], first - first[0]

    def grams_of(self, words: np.ndarray) -> np.ndarray:
        n = self.count[words]
        return self.grams[np.repeat(self.first[words] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))]


class Evidence:
    """Hashed log-odds tables and their word inputs."""

    def __init__(self, word_odds: np.ndarray, word_known: np.ndarray, gram_odds: np.ndarray):
        self.word_odds, self.word_known, self.gram_odds = word_odds, word_known, gram_odds

    @staticmethod
    def odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: int, n_clean: int) -> np.ndarray:
        seen = toxic + clean
        raw = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n_clean + 1))
        return np.where(seen >= 2, raw * seen / (seen + 3), 0).astype(np.float32) / 3

    def fixed(self, buckets: np.ndarray, grams: np.ndarray, first: np.ndarray) -> np.ndarray:
        odds = self.gram_odds[grams]
        count = np.diff(np.concatenate((first, [len(grams)])))
        return np.stack([self.word_odds[buckets], np.add.reduceat(odds, first) / count, np.maximum.reduceat(odds, first), self.word_known[buckets]], axis=1).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Network:
    """Parameters by name; two directions f and b."""

    def __init__(self, seed: int = 7):
        r = np.random.default_rng(seed)
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"W{d}"] = r.normal(0, 0.4, (INPUTS, 3 * HIDDEN))
            self.p[f"U{d}"] = r.normal(0, 0.3, (HIDDEN, 3 * HIDDEN))
            self.p[f"B{d}"] = np.zeros(3 * HIDDEN)
        self.p |= {"A": r.normal(0, 0.4, (2 * HIDDEN, HIDDEN)), "a": np.zeros(HIDDEN), "v": r.normal(0, 0.4, HIDDEN), "u": r.normal(0, 0.4, 2 * HIDDEN), "c": np.array([-1.0])}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def states(self, x: np.ndarray, mask: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, window, HIDDEN) of one direction; a masked step repeats its state."""
        p, H = self.p, HIDDEN
        xw = x @ p[f"W{d}"] + p[f"B{d}"]
        out = np.empty((*x.shape[:2], H), dtype=np.float32)
        h = np.zeros((x.shape[1], H), dtype=np.float32)
        for t in range(x.shape[0]) if d == "f" else range(x.shape[0] - 1, -1, -1):
            hu = h @ p[f"U{d}"]
            zr = sigmoid(xw[t, :, : 2 * H] + hu[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(xw[t, :, 2 * H :] + r * hu[:, 2 * H :])
            m = mask[t][:, None]
            after = h + m * (1 - z) * (n - h)
            if keep is not None:
                keep.append((t, h, z, r, n, hu[:, 2 * H :], m))
            h = out[t] = after
        return out

    def forward(self, x: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows; x (time, window, INPUTS), mask (time, window)."""
        p = self.p
        traces = {"f": [], "b": []} if keep is not None else {"f": None, "b": None}
        hs = np.concatenate([self.states(x, mask, d, traces[d]) for d in "fb"], axis=2)
        q = np.tanh(hs @ p["A"] + p["a"])
        e = np.where(mask > 0, q @ p["v"], -1e9)
        w = np.exp(e - e.max(axis=0)) * mask
        w /= np.maximum(w.sum(axis=0), 1e-9)
        pooled = (w[:, :, None] * hs).sum(axis=0)
        if keep is not None:
            keep.update(x=x, hs=hs, q=q, w=w, pooled=pooled, traces=traces)
        return pooled @ p["u"] + p["c"][0]

    def backward(self, k: dict, g: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters and of x, for the logits' gradient ``g``."""
        p, H = self.p, HIDDEN
        grad = {"u": k["pooled"].T @ g, "c": np.array([g.sum()])}
        dpool = g[:, None] * p["u"]
        dw = (k["hs"] * dpool).sum(axis=2)
        dh = k["w"][:, :, None] * dpool
        de = k["w"] * (dw - (k["w"] * dw).sum(axis=0))
        grad["v"] = np.einsum("tbh,tb->h", k["q"], de)
        dq = de[:, :, None] * p["v"] * (1 - k["q"] ** 2)
        grad["A"] = np.einsum("tbi,tbj->ij", k["hs"], dq)
        grad["a"] = dq.sum(axis=(0, 1))
        dh = dh + dq @ p["A"].T
        dx = np.zeros_like(k["x"])
        for i, d in enumerate("fb"):
            W, U = p[f"W{d}"], p[f"U{d}"]
            x, before = k["x"], np.empty((*dh.shape[:2], H), dtype=np.float32)
            gates, inners = (np.empty((*dh.shape[:2], 3 * H), dtype=np.float32) for _ in range(2))
            carry = np.zeros(dh.shape[1:2] + (H,), dtype=np.float32)
            for t, h, z, r, n, hn, m in reversed(k["traces"][d]):
                total = carry + dh[t, :, i * H : (i + 1) * H]
                step = total * m
                dn = step * (1 - z) * (1 - n * n)
                dz = step * (h - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                before[t] = h
                gates[t] = np.concatenate([dz, dr, dn], axis=1)
                inners[t] = np.concatenate([dz, dr, dn * r], axis=1)
                carry = total * (1 - m) + step * z + inners[t] @ U.T
            dx += gates @ W.T
            rows = gates.reshape(-1, 3 * H)
            grad |= {f"U{d}": before.reshape(-1, H).T @ inners.reshape(-1, 3 * H), f"B{d}": rows.sum(axis=0), f"W{d}": x.reshape(-1, x.shape[2]).T @ rows}
        return grad, dx


class Adam:
    def __init__(self, parameters: dict[str, np.ndarray]):
        self.p, self.n = parameters, 0
        self.m = {k: np.zeros_like(x) for k, x in parameters.items()}
        self.s = {k: np.zeros_like(x) for k, x in parameters.items()}

    def step(self, grad: dict[str, np.ndarray], rate: float) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grad.values()))
        for k, g in grad.items():
            g = g.astype(np.float32) * min(1.0, 5.0 / (norm + 1e-9))
            self.m[k] += 0.1 * (g - self.m[k])
            self.s[k] += 0.01 * (g * g - self.s[k])
            self.p[k] -= rate * (self.m[k] / (1 - 0.9**self.n)) / (np.sqrt(self.s[k] / (1 - 0.99**self.n)) + 1e-6)


def summed(at: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Rows of ``values`` added up by ``at``, of ``n`` places."""
    return np.stack([np.bincount(at, column, n) for column in values.T], axis=1).astype(np.float32)


def windows_of(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts with ``counts`` words: first word of each window, its number of words, and each text's first window."""
    n = np.maximum(1, -(-np.maximum(counts - STEPS, 0) // STRIDE) + 1)
    first = np.concatenate(([0], np.cumsum(n)[:-1])).astype(np.int64)
    text = np.repeat(np.arange(len(counts)), n)
    inside = (np.arange(int(n.sum())) - first[text]) * STRIDE
    base = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return base[text] + inside, np.clip(counts[text] - inside, 0, STEPS), first


class Model:
    """Trained tables and network; scores texts."""

    def __init__(self, evidence: Evidence, network: Network, word_table: np.ndarray, gram_table: np.ndarray, scale: float, shift: float):
        self.evidence, self.network = evidence, network
        self.word_table, self.gram_table = word_table, gram_table
        self.scale, self.shift = scale, shift

    def inputs(self, words: list[bytes]) -> np.ndarray:
        buckets = word_buckets(words)
        grams, first = gram_buckets(words)
        count = np.diff(np.concatenate((first, [len(grams)])))[:, None]
        learned = np.add.reduceat(self.gram_table[grams], first, axis=0) / count
        return np.concatenate([self.evidence.fixed(buckets, grams, first), self.word_table[buckets], learned], axis=1).astype(np.float32)


class Scorer:
    """A worker's scorer: keeps the inputs of words it has met."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.table = np.zeros((1 << 15, INPUTS), dtype=np.float32)

    def score(self, texts: list[bytes | None]) -> np.ndarray:
        words = [words_of(t) for t in texts]
        if len(self.numbers) > KEPT_WORDS:
            self.reset()
        numbers = self.numbers
        new = list({w for own in words for w in own if w not in numbers})
        if new:
            at = len(numbers)
            while len(self.table) < at + len(new):
                self.table = np.concatenate([self.table, np.zeros_like(self.table)])
            for i in range(0, len(new), 50_000):
                some = new[i : i + 50_000]
                self.table[at + i : at + i + len(some)] = self.model.inputs(some)
            numbers.update(zip(new, range(at, at + len(new)), strict=True))
        counts = np.array([len(w) for w in words], dtype=np.int64)
        ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(words)), dtype=np.int64, count=int(counts.sum()))
        ids = np.concatenate([ids, np.zeros(STEPS, dtype=np.int64)])
        logits, first = logits_of(self.model.network, self.table, ids, counts)
        return sigmoid(self.model.scale * np.maximum.reduceat(logits, first).astype(np.float64) + self.model.shift) if len(counts) else np.zeros(0)


def logits_of(network: Network, table: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Logits of all windows, and each text's first; ``ids`` has STEPS entries to spare."""
    start, size, first = windows_of(counts) if len(counts) else (np.zeros(0, np.int64),) * 3
    out = np.empty(len(start), dtype=np.float32)
    order = np.argsort(-size, kind="stable")  # windows of like length together: short ones need few steps
    for at in range(0, len(start), CHUNK):
        some = order[at : at + CHUNK]
        steps = max(1, int(size[some].max()))
        t = np.arange(steps)[:, None]
        mask = (t < size[some]).astype(np.float32)
        out[some] = network.forward(table[ids[start[some] + t]], mask)
    return out, first


def train(texts: list[bytes], toxic: list[int], seed: int = 7) -> Model | float:
    """A model, or the one score of all texts where the labels don't divide them."""
    y = np.asarray(toxic, dtype=np.int64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 0.0
    r = np.random.default_rng(seed)
    numbers: dict[bytes, int] = {}
    number = numbers.setdefault
    parts = [np.array([number(w, len(numbers)) for w in words_of(t)], dtype=np.int32) for t in texts]
    counts = np.array([len(x) for x in parts], dtype=np.int64)
    flat = np.concatenate([*parts, np.zeros(STEPS, dtype=np.int32)])
    vocabulary = Vocabulary(list(numbers) or [b"x"])
    buckets = vocabulary.buckets
    del parts, numbers, number
    base = np.concatenate(([0], np.cumsum(counts)))
    half = r.permutation(len(y)) % 2
    # documents that have a bucket, by class and half
    seen = np.zeros((2, 2, 2, BUCKETS), dtype=np.float64)
    for i in range(len(y)):
        own = np.unique(flat[base[i] : base[i + 1]])
        if len(own):
            seen[0, half[i], y[i], np.unique(buckets[own])] += 1
            seen[1, half[i], y[i], np.unique(vocabulary.grams_of(own))] += 1

    def evidence(parts: list[int]) -> Evidence:
        n = [max(1, int(((y == c) & np.isin(half, parts)).sum())) for c in (0, 1)]
        w, g = seen[0, parts].sum(axis=0), seen[1, parts].sum(axis=0)
        return Evidence(Evidence.odds(w[1], w[0], n[1], n[0]), (w.sum(axis=0) >= 2).astype(np.float32), Evidence.odds(g[1], g[0], n[1], n[0]))

    def fixed(known: Evidence) -> np.ndarray:
        return np.concatenate([known.fixed(buckets[some], grams, first) for some, grams, first in vocabulary.blocks()])

    crossed = [fixed(evidence([1])), fixed(evidence([0]))]
    network = Network(seed)
    tables = {"words": r.normal(0, 0.05, (BUCKETS, LEARNED)).astype(np.float32), "grams": r.normal(0, 0.05, (BUCKETS, LEARNED)).astype(np.float32)}
    adam = Adam(network.p | tables)

    def learned() -> np.ndarray:
        sums = np.concatenate([np.add.reduceat(tables["grams"][grams], first, axis=0) for _, grams, first in vocabulary.blocks()])
        return np.concatenate([tables["words"][buckets], sums / vocabulary.count[:, None].astype(np.float32)], axis=1)

    start, size, at = windows_of(counts)
    owner = np.repeat(np.arange(len(y)), np.diff(np.concatenate((at, [len(start)]))))
    steps = np.arange(STEPS)[:, None]
    table = [np.concatenate([c, learned()], axis=1).astype(np.float32) for c in crossed]

    def all_logits() -> np.ndarray:
        out = np.empty(len(start), dtype=np.float32)
        for h in (0, 1):
            mine = np.flatnonzero(half[owner] == h)
            for i in range(0, len(mine), CHUNK):
                some = mine[i : i + CHUNK]
                out[some] = network.forward(table[h][flat[start[some] + steps]], (steps < size[some]).astype(np.float32))
        return out

    strength = np.empty(len(start), dtype=np.float32)
    for h in (0, 1):
        mine = np.flatnonzero(half[owner] == h)
        evident = np.maximum(crossed[h][:, 0], 0) + np.maximum(crossed[h][:, 2], 0) + crossed[h][:, 1]
        for i in range(0, len(mine), CHUNK):
            some = mine[i : i + CHUNK]
            strength[some] = np.where(steps < size[some], evident[flat[start[some] + steps]], -9).max(axis=0)
    for epoch in range(EPOCHS):
        if epoch and epoch % 3 == 0:
            strength = all_logits()
        order = np.lexsort((-strength, owner))
        top = order[at]
        some = at + (r.random(len(y)) * np.diff(np.concatenate((at, [len(start)])))).astype(np.int64)
        chosen = np.concatenate([top, some[y == 0]])
        chosen = chosen[r.permutation(len(chosen))]
        # batches of one half each, as the halves' evidence differs
        chosen = chosen[np.argsort(half[owner[chosen]], kind="stable")]
        edges = [int((half[owner[chosen]] == 0).sum())]
        groups = [chosen[: edges[0]], chosen[edges[0] :]]
        batches = [(h, g[i : i + BATCH]) for h, g in enumerate(groups) for i in range(0, len(g), BATCH)]
        for b in r.permutation(len(batches)):
            h, mine = batches[b]
            target = y[owner[mine]].astype(np.float32)
            mask = (steps < size[mine]).astype(np.float32)
            if b % 16 == 0:  # some empty windows, clean
                mask[:, :2], target[:2] = 0, 0
            numbers_here = flat[start[mine] + steps]
            x = table[h][numbers_here]
            keep: dict = {}
            logits = network.forward(x, mask, keep)
            g = ((sigmoid(logits) - target) / len(mine)).astype(np.float32)
            grad, dx = network.backward(keep, g)
            there, inverse = np.unique(numbers_here, return_inverse=True)
            sums = summed(inverse.ravel(), dx[:, :, FIXED:].reshape(-1, 2 * LEARNED), len(there))
            words_grad = summed(buckets[there], sums[:, :LEARNED], BUCKETS)
            n = vocabulary.count[there]
            grams_grad = summed(vocabulary.grams_of(there), np.repeat(sums[:, LEARNED:] / n[:, None], n, axis=0), BUCKETS)
            adam.step(grad | {"words": words_grad, "grams": grams_grad}, RATE * (1 - epoch / EPOCHS) + 0.001)
        table = [np.concatenate([c, learned()], axis=1).astype(np.float32) for c in crossed]
    scale, shift = _logistic(np.maximum.reduceat(all_logits(), at).astype(np.float64), y)
    return Model(evidence([0, 1]), network, tables["words"], tables["grams"], scale, shift)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift of a one-variable logistic fit, by Newton's method with a small ridge."""
    beta = np.array([1.0, 0.0])
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = sigmoid(design @ beta)
        ridge = 1e-2 * np.array([beta[0] - 1, beta[1]])
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        beta = beta - np.clip(np.linalg.solve(hessian, design.T @ (p - y) + ridge), -1, 1)
    return float(max(beta[0], 0.05)), float(beta[1])


# --- over tables ------------------------------------------------------------------

def remainder(doc_id: str = "doc_id") -> Column:
    """crc32(doc_id as text) mod 5; 0 (held out) without an id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5, F.lit(0))


def fitted(documents: DataFrame, labels: DataFrame) -> Model | float:
    """Train on the bounded sample of ``labels`` (doc_id, toxic) that are not held out."""
    known = labels.where((remainder() != 0) & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    by_hash = F.xxhash64("doc_id")
    some = known.where("toxic = 1").orderBy(by_hash, "doc_id").limit(SAMPLE_TOXIC).unionByName(known.where("toxic = 0").orderBy(by_hash, "doc_id").limit(SAMPLE_CLEAN))
    # at most SAMPLE_TOXIC + SAMPLE_CLEAN rows of two numbers
    texts = documents.where(F.length("text") <= SAMPLE_CHARS).join(F.broadcast(some), "doc_id")
    # ids may repeat in the documents: one text of each; the rows come a partition at a time
    rows = texts.groupBy("doc_id").agg(F.min(as_bytes()), F.max("toxic")).toLocalIterator()
    found = sorted((doc, int(toxic), bytes(text)) for doc, text, toxic in rows)
    return train([text for _, _, text in found], [toxic for _, toxic, _ in found])


def scored(documents: DataFrame, labels: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """``columns`` of ``documents`` (all by default) in a struct ``row``, and ``score``."""
    model = fitted(documents, labels)
    shared = documents.sparkSession.sparkContext.broadcast(model)
    columns = documents.columns if columns is None else columns

    def begin():
        model = shared.value
        score = (lambda texts: np.full(len(texts), model)) if isinstance(model, float) else Scorer(model).score
        return lambda batch: {"row": batch["row"], "score": score(batch["text"].to_pylist())}

    rows = documents.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), as_bytes().alias("text"))
    return map_arrow(rows, begin, rows.select("row").withColumn("score", F.lit(0.0)).schema, by_task=True)


def judged(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    rows = scored(documents, labels, ["doc_id"])
    return rows.select(F.col("row.doc_id").alias("doc_id"), "score").select(
        "doc_id", (remainder() == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those scored 0.5 or more."""
    return scored(documents, labels).where("score < 0.5").select("row.*")
