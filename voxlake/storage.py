"""Tables written to the folder that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; a temporary folder only where none is set and the master is local."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    found = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not found.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="voxlake-"))
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
    return found.get()


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark).rstrip('/')}/voxlake-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, compression: str = "zstd") -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, lineage cut."""
    path = shared_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._voxlake_path = path
    return out


def discard(df: DataFrame) -> None:
    """Remove what ``stored`` wrote, once nothing will read it again."""
    spark = df.sparkSession
    where = spark._jvm.org.apache.hadoop.fs.Path(df._voxlake_path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
