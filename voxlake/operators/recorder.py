"""Statistics of frames: named values recorded by frame, summed up, and written as CSV or JSON."""

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "frame long, name string, value double"


class Recorder:
    """Values by frame; rows are kept on the driver, a few a frame, until they are written."""

    def __init__(self, spark: SparkSession):
        self.spark, self.frame, self.rows = spark, 0, []

    def report(self, name: str, value: float) -> None:
        self.rows.append((self.frame, name, float(value)))

    def next_frame(self) -> None:
        self.frame += 1

    def table(self) -> DataFrame:
        return self.spark.createDataFrame(self.rows, SCHEMA)


def summed(values: DataFrame) -> DataFrame:
    """(name, total, n, average, least, most) of (frame, name, value)."""
    return values.groupBy("name").agg(F.sum("value").alias("total"), F.count("value").alias("n"), F.avg("value").alias("average"), F.min("value").alias("least"), F.max("value").alias("most"))


def by_frame(values: DataFrame, names: list[str]) -> DataFrame:
    """(frame, a column a name): a frame's sums, null where nothing was reported."""
    return values.groupBy("frame").agg(*[F.sum(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])


def write_csv(values: DataFrame, names: list[str], path: str) -> None:
    by_frame(values, names).repartitionByRange("frame").sortWithinPartitions("frame").write.option("header", True).csv(path)


def write_json(values: DataFrame, path: str) -> None:
    values.repartitionByRange("frame").sortWithinPartitions("frame", "name").write.json(path)
