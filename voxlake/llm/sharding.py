"""Sharding by jump consistent hashing, with gapless slots.

The key and the number of shards alone decide the shard: no ring table, and a shard
more takes rows only into itself, about one in (shards + 1).  Slots number the rows of
a shard by id, then text's checksum and size: rows are dealt by ranges of these, ranges
are counted first, and rows are ranked inside their range, so no shard is one task.

Defined cases: a null key hashes like 0; a null text has size 1 (its end) and the
CRC-32 of no bytes; rows of equal key share a shard and stand side by side (rows
alike in key, checksum and size in one range); null keys come first; an empty table gives
an empty result; a key that is no whole number is an error (ANSI); other columns are not
read.
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from voxlake.llm.common import discard, n_partitions, stored

SHARDS = 8
# fixed values: multiplier of the generator and its output range
MULTIPLIER, HIGH = 2862933555777941757, float(1 << 31)


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each key (int64, read as unsigned)."""
    state = keys.astype(np.int64).view(np.uint64).copy()
    shard = np.zeros(len(state), dtype=np.int64)
    live = np.arange(len(state))
    ahead = np.zeros(len(state), dtype=np.int64)
    while len(live):
        shard[live] = ahead[live]
        state[live] = state[live] * np.uint64(MULTIPLIER) + np.uint64(1)
        ahead[live] = ((shard[live] + 1) * (HIGH / ((state[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = live[ahead[live] < shards]
    return shard


def jump_column(key: str, shards: int):
    @F.pandas_udf("int")
    def placed(keys: pd.Series) -> pd.Series:
        return pd.Series(jump(keys.to_numpy(dtype=np.int64), shards).astype(np.int32))

    return placed(F.coalesce(F.col(key).cast("long"), F.lit(0)))


def sharded(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard)."""
    raw = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(F.col("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"))
    rows = rows.withColumns({"shard": jump_column("doc_id", shards), "grown_shard": jump_column("doc_id", shards + 1)})
    order = ["shard", "doc_id", "text_crc32", "size"]
    # stored, as dealing by ranges reads its input twice, and the ranges must not change after they are counted
    sized = stored(rows, "shards")
    dealt = stored(sized.repartitionByRange(n_partitions(documents.sparkSession), *order).withColumn("bucket", F.spark_partition_id()), "dealt")
    discard(sized)
    counts = dealt.groupBy("shard", "bucket").agg(F.count("*").alias("c"))
    before = W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    ranked = dealt.join(counts, ["shard", "bucket"]).withColumn("slot", F.col("before") + F.row_number().over(inside) - 1)
    return ranked.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), "grown_shard")
