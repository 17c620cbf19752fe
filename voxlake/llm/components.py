"""Connected components of a distributed edge table, by alternating stars.

Each round joins every node's larger neighbours to its smallest neighbour (large
star), then every node's smaller neighbours to its smallest one (small star), until
the edges no longer change: each node then points to its component's smallest node.
Rounds are written to shared storage, and the driver sees counts and checksums only.
Minima are aggregated before the joins, so a hub's edges meet in no single task.
"""

from pyspark.sql import DataFrame, functions as F

from voxlake.llm.common import discard, stored


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links, longs, in any order, to (node, root): the least node reachable.

    Self links and repeated links are allowed and add nothing; nodes without a link to
    another node do not appear.
    """
    now = stored(
        edges.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges"
    )
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("lo").alias("hi"), F.col("hi").alias("lo")))
        least = both.groupBy("hi").agg(F.min("lo").alias("least")).select("hi", F.least("hi", "least").alias("least"))
        large = (
            both.where("lo > hi").join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi <> lo").distinct()
        )
        large = stored(large, "large-star")
        least = large.groupBy("hi").agg(F.min("lo").alias("least"))
        small = large.join(least, "hi").select(F.col("lo").alias("hi"), F.col("least").alias("lo")).where("hi <> lo")
        after = stored(small.unionByName(least.select("hi", F.col("least").alias("lo"))).distinct(), "small-star")
        discard(now)
        discard(large)
        now, before, mark = after, mark, _mark(after)
        if before == mark:
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo")), F.bit_xor(F.xxhash64("lo", "hi"))).first())
