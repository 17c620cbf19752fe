"""Token-ID output: id arrays with Elias-Fano document boundaries.

Texts are encoded where they are scanned, and only (doc_id, ids) is stored, sorted and
shuffled.  Documents in ascending doc_id order become blocks of at most about
``BLOCK_IDS`` ids (a longer document is a block of its own).  A block holds the ids of
its documents one after another, as little-endian 16-bit words (32-bit if the vocabulary
needs it), and two Elias-Fano forms: the documents' ends, and their doc_ids above the
block's least.  Low bits are packed, high bits stand in unary; ``Boundaries.select``
finds the i-th set bit of the unary part through sampled ranks, so an offset is read
without a table of 64-bit offsets.  Blocks are rows of Parquet files, which any store
that Spark writes to can hold; the blocks' global starts come from two levels of prefix
sums over their id counts.

Encoding: the tokenizer's file is read first.  Where it normalizes by composition, white
space and lower case, and cuts letters, digits and other signs apart without white space
(``SPLIT``), a word between ASCII spaces encodes alone as it does in its text: tasks then
keep a bounded cache from words to ids, and a new word of letters, with signs after it or
not, goes through the model without the cutting step.  Every other word goes through the
whole library, and so does a whole text in which lower-casing and composition could
interact, or which holds a special token's string.  Any other tokenizer gets whole texts.

Defined cases: a null or empty text is the end id alone; null doc_ids come first;
documents of equal id stand side by side, by their ids' bytes; an empty table gives no
rows; other columns are not read; a doc_id that is no whole number is an error (ANSI).
One id on a third of all rows is dealt by the leading ``RANGE_BYTES`` of the ids too.
"""

import json
import os
import struct
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from voxlake.llm.common import KEPT, as_bytes, discard, map_arrow, n_partitions, shared_path, small_batches, stored

END_ID = 2
BLOCK_IDS = 1 << 16
#: Words that a task's cache holds before it starts anew.
CACHE_WORDS = 1_000_000
#: Words of one text given to the library.
JOINED = 200
#: Leading bytes of a document's ids that deal documents of one id.
RANGE_BYTES = 64
# fixed value: the cutting pattern for which words encode alone
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Signs that may follow a word's letters; an apostrophe may join a letter after it.
SIGNS = bytes(c for c in range(0x21, 0x7F) if not chr(c).isalnum() and c != 0x27)


# --- Elias-Fano -------------------------------------------------------------------

def elias_fano(values: np.ndarray) -> bytes:
    """Nondecreasing values (64-bit, read as unsigned): count, low width, then the low and the high bits."""
    values = values.astype(np.int64, copy=False).view(np.uint64) if values.dtype != np.uint64 else values
    n = len(values)
    top = int(values[-1]) if n else 0
    width = max(0, (top // n).bit_length() - 1) if n else 0
    bits = ((values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
    high = (values >> np.uint64(width)).astype(np.int64) + np.arange(n)
    unary = np.zeros((int(high[-1]) + 1) if n else 0, dtype=np.uint8)
    unary[high] = 1
    return struct.pack("<IB", n, width) + np.packbits(bits, bitorder="little").tobytes() + np.packbits(unary, bitorder="little").tobytes()


def _places() -> np.ndarray:
    """(256, 8): where a byte's r-th set bit stands."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little")
    return np.argsort(1 - bits, axis=1, kind="stable")


class Boundaries:
    """Select over an Elias-Fano form, with a sampled rank every ``SAMPLE`` bytes of the unary part."""

    SAMPLE = 64
    #: Selections of one step.
    STEP = 4096
    _ONES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(axis=1).astype(np.int64)
    _PLACE = _places()

    def __init__(self, raw: bytes):
        self.n, self.width = struct.unpack_from("<IB", raw)
        at = 5 + -(-self.n * self.width // 8)
        self.low = np.frombuffer(raw, np.uint8, at - 5, 5)
        high = np.frombuffer(raw, np.uint8, len(raw) - at, at)
        self.high = np.concatenate((high, np.zeros(-len(high) % self.SAMPLE, np.uint8))).reshape(-1, self.SAMPLE)
        self.ranks = np.concatenate(([0], np.cumsum(self._ONES[self.high].sum(axis=1))))

    def select(self, which: np.ndarray) -> np.ndarray:
        """Values (uint64) at the places ``which``."""
        which = np.asarray(which, dtype=np.int64)
        out = np.zeros(len(which), dtype=np.uint64)
        for a in range(0, len(which), self.STEP):
            i = which[a : a + self.STEP]
            block = np.searchsorted(self.ranks, i, side="right") - 1
            ones = np.cumsum(self._ONES[self.high[block]], axis=1)
            rest = i - self.ranks[block]
            byte = (ones <= rest[:, None]).sum(axis=1)
            each = np.arange(len(i))
            before = np.where(byte > 0, ones[each, byte - 1], 0)
            place = (block * self.SAMPLE + byte) * 8 + self._PLACE[self.high[block, byte], rest - before]
            value = (place - i).astype(np.uint64) << np.uint64(self.width)
            for b in range(self.width):
                at = i * self.width + b
                value |= ((self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(np.uint64) << np.uint64(b)
            out[a : a + self.STEP] = value
        return out


# --- encoding ---------------------------------------------------------------------

def words_stand_alone(spec: dict) -> bool:
    """Whether a tokenizer's file says that words between ASCII spaces encode alone, in lower case."""

    def steps(part: dict | None, key: str) -> list[dict]:
        return [] if part is None else part[key] if part["type"] == "Sequence" else [part]

    normal = steps(spec.get("normalizer"), "normalizers")
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    cuts = steps(spec.get("pre_tokenizer"), "pretokenizers")
    model = spec["model"]
    return (
        normal == known
        and len(cuts) == 2
        and cuts[0] == {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True}
        and (cuts[1]["type"], cuts[1]["add_prefix_space"], cuts[1]["use_regex"]) == ("ByteLevel", False, False)
        and model["type"] == "BPE"
        and bool(model["end_of_word_suffix"])
        and not (model["dropout"] or model["unk_token"] or model["continuing_subword_prefix"])
        and not any(spec.get(x) for x in ("truncation", "padding"))
    )


class Encoder:
    """Whole texts to little-endian ids (``dtype``), equal to the library's own."""

    def __init__(self, path: str, end_id: int = END_ID):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = "<u2" if max(self.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
        self.width = int(self.dtype[-1])
        added = self.tokenizer.get_added_tokens_decoder()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        #: A special token between words given to the library together: one id, which no word has.
        self.mark = next(((i, t.content) for i, t in sorted(added.items())), None)
        self.special = [t.content.encode().lower() for t in added.values()]
        self.alone = self.mark is not None and words_stand_alone(spec)
        self.cache: dict[bytes, bytes] = {}
        if self.alone:
            suffix = spec["model"]["end_of_word_suffix"]
            # the model behind a plain cut at spaces, for lower-case letters; a word's last token has the suffix
            self.letters = Tokenizer.from_file(path)
            self.letters.normalizer = normalizers.Lowercase()
            self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            self.last = np.zeros(max(spec["model"]["vocab"].values(), default=0) + 1, dtype=bool)
            self.last[[i for t, i in spec["model"]["vocab"].items() if t.endswith(suffix)]] = True

    def whole(self, texts: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, dtype=self.dtype).tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _keep(self, words: list[bytes], ids: np.ndarray, starts: list[int], ends: list[int]) -> None:
        raw, w = ids.tobytes(), self.width
        self.cache.update((x, raw[w * i : w * j]) for x, i, j in zip(words, starts, ends, strict=True))

    def learn_letters(self, words: list[bytes]) -> None:
        """Cache the ids of words of letters."""
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.asarray(self.letters.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype=self.dtype)
            ends = (np.flatnonzero(self.last[ids]) + 1).tolist()
            assert len(ends) == len(some)
            self._keep(some, ids, [0, *ends[:-1]], ends)

    def learn_any(self, words: list[bytes]) -> None:
        """Cache the ids of words without a special token's string."""
        between = f" {self.mark[1]} "
        for at in range(0, len(words), JOINED):
            some = words[at : at + JOINED]
            ids = np.asarray(self.tokenizer.encode_batch_fast([between.join(x.decode() for x in some)], add_special_tokens=False)[0].ids, dtype=self.dtype)
            cuts = np.flatnonzero(ids == self.mark[0]).tolist()
            assert len(cuts) == len(some) - 1
            self._keep(some, ids, [0, *(c + 1 for c in cuts)], [*cuts, len(ids)])

    def learn(self, words: set[bytes]) -> None:
        """Cache the ids of new words: letters and the signs after them apart, all else by the library."""
        letters, other, joined, cache = set(), set(), [], self.cache
        for w in words:
            core = w.rstrip(SIGNS)
            if core.isalpha() or (core and not core.isascii() and _plain_letters(core.decode())):
                if core not in cache:
                    letters.add(core)
                if len(core) < len(w):
                    tail = w[len(core) :]
                    joined.append((w, core, tail))
                    if tail not in cache:
                        other.add(tail)
            else:
                other.add(w)
        if letters:
            self.learn_letters(list(letters))
        if other:
            self.learn_any(list(other))
        cache.update((w, cache[a] + cache[b]) for w, a, b in joined)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not self.alone:
            return self.whole([t.decode() if t else "" for t in texts])
        lowered = [t.lower() if t else b"" for t in texts]
        together = [bool(t) and self.together(t, low) for t, low in zip(texts, lowered, strict=True)]
        words = [[] if a else low.split() for low, a in zip(lowered, together, strict=True)]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache = self.cache
        new = set().union(*words).difference(cache)
        if new:
            self.learn(new)
        get, join = cache.__getitem__, b"".join
        return [self.whole([t.decode()])[0] if a else join(map(get, own)) for t, a, own in zip(texts, together, words, strict=True)]

    def together(self, text: bytes, lowered: bytes) -> bool:
        """Whether words may not be taken one by one, in lower case."""
        if any(x in lowered for x in self.special):
            return True
        if text.isascii():
            return False
        return not (unicodedata.is_normalized("NFC", text.decode()) and unicodedata.is_normalized("NFC", lowered.decode()))


def _plain_letters(word: str) -> bool:
    """Letters of the Latin blocks only, whose class no version of Unicode has changed."""
    return word.isalpha() and max(word) < "\u0250"


def encoder(path: str, end_id: int = END_ID) -> Encoder:
    """The worker's encoder; its cache outlives a task."""
    key = (path, end_id)
    if key not in KEPT:
        KEPT[key] = Encoder(path, end_id)
    return KEPT[key]


# --- the file format --------------------------------------------------------------

#: A block: ids little-endian of ``id_bytes`` each; the first ``n_null`` documents have no id, the others' ids are
#: ``first_doc`` and an Elias-Fano number each; ends in Elias-Fano form.
FORMAT = "part int, block int, n_docs long, n_null long, n_ids long, id_bytes int, ids binary, first_doc long, doc_ids binary, ends binary"
_ARROW = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}


def _block(part: int, number: int, doc_ids: list, raw: list[bytes], id_bytes: int) -> dict:
    known = np.array([d for d in doc_ids if d is not None], dtype=np.int64)
    ends = np.cumsum(np.array([len(x) // id_bytes for x in raw], dtype=np.int64))
    return {
        "part": part,
        "block": number,
        "n_docs": len(raw),
        "n_null": len(raw) - len(known),
        "n_ids": int(ends[-1]),
        "id_bytes": id_bytes,
        "ids": b"".join(raw),
        "first_doc": int(known[0]) if len(known) else 0,
        "doc_ids": elias_fano(known.view(np.uint64) - known.view(np.uint64)[:1]),
        "ends": elias_fano(ends),
    }


def encoded(documents: DataFrame, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """(doc_id, ids): each text's ids and the end id, in the bytes of the file format; encoded in the scan."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), as_bytes().alias("text"))

    def run(batches):
        own = encoder(tokenizer, end_id)
        end = np.array([end_id], dtype=own.dtype).tobytes()
        for batch in batches:
            ids = [x + end for x in own.encode(batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    small_batches(documents.sparkSession)
    return rows.mapInArrow(run, "doc_id long, ids binary")


def write_blocks(documents: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS) -> None:
    """Encode ``documents`` in ascending doc_id order and write the blocks to ``path``."""
    spark = documents.sparkSession
    id_bytes = Encoder(tokenizer, end_id).width
    # stored, as dealing by ranges reads its input twice
    ids = stored(encoded(documents, tokenizer, end_id), "ids")
    dealt = ids.withColumn("lead", F.substring("ids", 1, RANGE_BYTES)).repartitionByRange(n_partitions(spark), "doc_id", "lead").drop("lead").sortWithinPartitions("doc_id", "ids")
    schema = StructType.fromDDL(FORMAT)
    arrow = pa.schema([pa.field(f.name, _ARROW[f.dataType.simpleString()]) for f in schema])

    def run(batches):
        part, number = TaskContext.get().partitionId(), 0
        doc_ids, raw, held = [], [], 0
        for batch in batches:
            for doc, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = len(own) // id_bytes
                if raw and held + n > block_ids:
                    yield pa.RecordBatch.from_pylist([_block(part, number, doc_ids, raw, id_bytes)], arrow)
                    number, doc_ids, raw, held = number + 1, [], [], 0
                doc_ids.append(doc)
                raw.append(own)
                held += n
        if raw:
            yield pa.RecordBatch.from_pylist([_block(part, number, doc_ids, raw, id_bytes)], arrow)

    dealt.mapInArrow(run, schema).write.option("compression", "zstd").parquet(path)
    discard(ids)


def block_starts(blocks: DataFrame) -> DataFrame:
    """(part, block, base): ids of all blocks before each one."""
    counts = blocks.select("part", "block", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n"))
    parts = parts.select(F.col("part").alias("p"), F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    return counts.join(parts, F.col("part") == F.col("p")).select("part", "block", (F.col("before") + F.coalesce(F.sum("n_ids").over(inside), F.lit(0))).cast("long").alias("base"))


def decoded(row: dict) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """A block's doc_ids, its ids (32-bit), and its documents' starts and ends, all offsets by select."""
    known = Boundaries(row["doc_ids"]).select(np.arange(row["n_docs"] - row["n_null"]))
    doc_ids = [None] * row["n_null"] + (known + np.array([row["first_doc"]], dtype=np.int64).view(np.uint64)).view(np.int64).tolist()
    ends = Boundaries(row["ends"]).select(np.arange(row["n_docs"])).astype(np.int64)
    return doc_ids, np.frombuffer(row["ids"], f"<u{row['id_bytes']}").astype("<u4"), np.concatenate(([0], ends[:-1])), ends


def read_blocks(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files under ``path``.

    Blocks are decoded where they are scanned; only the documents' numbers are joined
    with the blocks' bases.
    """
    blocks = spark.read.schema(StructType.fromDDL(FORMAT)).parquet(path)

    def run(batch):
        out = {n: [] for n in ("part", "block", "doc_id", "first", "n_tokens", "ids_crc32")}
        for row in pa.RecordBatch.from_pydict(batch).to_pylist():
            doc_ids, ids, starts, ends = decoded(row)
            raw = memoryview(ids.tobytes())
            out["part"] += [row["part"]] * len(doc_ids)
            out["block"] += [row["block"]] * len(doc_ids)
            out["doc_id"] += doc_ids
            out["first"] += starts.tolist()
            out["n_tokens"] += (ends - starts).tolist()
            out["ids_crc32"] += [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
        return out

    docs = map_arrow(blocks, run, "part int, block int, doc_id long, first long, n_tokens long, ids_crc32 long")
    return docs.join(block_starts(blocks), ["part", "block"]).select("doc_id", (F.col("base") + F.col("first")).alias("start"), "n_tokens", "ids_crc32")


def tokenized(documents: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), read back from the files written for ``documents``."""
    path = shared_path(documents.sparkSession, "tokens")
    write_blocks(documents, tokenizer, path)
    return read_blocks(documents.sparkSession, path)
