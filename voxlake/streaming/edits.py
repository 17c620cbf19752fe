"""Edits as a stream: a running leaf table, and edit logs folded batch by batch."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from voxlake.functions import morton as m
from voxlake.operators.edits import replay


def streaming_leaves(voxels: DataFrame) -> DataFrame:
    """(tile, lo, hi) of an unbounded voxel stream: the state is a mask a leaf, partial sums leave the tasks."""
    lo, hi = m.lo_hi(F.pmod(F.col("_m"), F.lit(64)))
    keyed = voxels.select(m.morton3().alias("_m")).select(m.ascend("_m", 2).alias("tile"), lo.alias("lo"), hi.alias("hi"))
    return keyed.groupBy("tile").agg(F.bit_or("lo").alias("lo"), F.bit_or("hi").alias("hi"))


def windowed_activity(edits: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Edits by kind and window of event time (column ts); rows later than ``late`` are dropped."""
    return edits.withWatermark("ts", late).groupBy(F.window("ts", window), "action").agg(F.count("*").alias("n")).select("window.start", "window.end", "action", "n")


def _path(spark: SparkSession, folder: str, number: int):
    return spark._jvm.org.apache.hadoop.fs.Path(f"{folder.rstrip('/')}/state-{number:012d}")


def newest(spark: SparkSession, folder: str, below: int | None = None) -> DataFrame | None:
    """Voxels (x, y, z, material) after the newest whole batch written to ``folder`` (numbered under ``below``)."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(root):
        return None
    found = sorted(s.getPath().getName() for s in files.listStatus(root) if files.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    if below is not None:
        found = [n for n in found if int(n.rsplit("-", 1)[1]) < below]
    return spark.read.parquet(f"{folder.rstrip('/')}/{found[-1]}") if found else None


def follow(lines: DataFrame, start: DataFrame, resolution: int, folder: str, checkpoint: str, parse: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Fold each micro batch of a log's lines into the voxels; the state after batch n is the table state-n in ``folder``.

    The state is on shared storage under its batch's number: a query that starts again from
    its checkpoint goes on from the newest state before its batch, and a batch that comes
    twice is written over with the same rows.  Older states are removed but one.
    """
    spark = start.sparkSession
    begin = start if "material" in start.columns else start.withColumn("material", F.lit(0))

    def apply(batch: DataFrame, number: int) -> None:
        before = newest(spark, folder, number)
        after = replay(begin if before is None else before, parse(batch), resolution).voxels()
        after.write.mode("overwrite").parquet(str(_path(spark, folder, number)))
        old = _path(spark, folder, number - 2)
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    return lines.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
