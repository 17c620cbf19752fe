"""What the corpus operators share: shared storage, word cutting and prefix sums."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from voxlake.storage import discard, shared_path, shared_root, stored

__all__ = [
    "BATCH_ROWS", "KEPT", "WORD_BYTES", "as_bytes", "discard", "map_arrow", "n_partitions", "shared_path", "shared_root", "small_batches", "stored",
]

#: Rows of one Arrow batch handed to Python; texts are of any length, so few rows.
BATCH_ROWS = 500

#: Byte table: A-Z to a-z, word bytes (0-9, a-z, 0x80 and up) kept, all else to a space.
WORD_BYTES = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


#: What a Python worker keeps between tasks of one step; the next step's tasks clear it.
KEPT: dict = {}


def small_batches(spark: SparkSession) -> None:
    """Bound the memory of an Arrow batch of whole texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def as_bytes(column: str = "text") -> Column:
    return F.col(column).cast("string").cast("binary")


def map_arrow(df: DataFrame, function: Callable, schema: StructType | str, by_task: bool = False) -> DataFrame:
    """Run ``function`` over the Arrow batches of ``df``.

    It gets the columns by name and returns, by the names of ``schema``, arrays or lists.
    With ``by_task`` it is called once a task and returns that function, so that what it
    keeps goes when the task ends.
    """
    small_batches(df.sparkSession)
    schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        KEPT.clear()
        on_batch = function() if by_task else function
        for batch in batches:
            made = on_batch({n: batch.column(i) for i, n in enumerate(batch.schema.names)})
            yield pa.RecordBatch.from_arrays(
                [v.cast(f.type) if isinstance(v := made[f.name], pa.Array) else pa.array(v, f.type) for f in arrow], schema=arrow
            )

    return df.mapInArrow(run, schema)


def n_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
