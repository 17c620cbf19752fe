"""Images as rows (x, y, value or r, g, b): sampling, blur and min/max pyramids."""

import math

from pyspark.sql import DataFrame, functions as F

from voxlake.storage import stored


def sample(points: DataFrame, image: DataFrame, width: int, height: int, bilinear: bool = True) -> DataFrame:
    """``points`` (u, v in [0, 1], wrapped) with ``value``: nearest, or weighted over four texels."""
    u, v = F.col("u") * width, F.col("v") * height
    if not bilinear:
        near = points.withColumns({"_x": F.pmod(F.floor(u), F.lit(width)).cast("long"), "_y": F.pmod(F.floor(v), F.lit(height)).cast("long")})
        return near.join(image.select(F.col("x").alias("_x"), F.col("y").alias("_y"), "value"), ["_x", "_y"]).select(*points.columns, "value")
    keyed = points.withColumns({"_id": F.monotonically_increasing_id(), "_u": u - 0.5, "_v": v - 0.5})
    keyed = stored(keyed, "samples")
    fx, fy = F.col("_u") - F.floor("_u"), F.col("_v") - F.floor("_v")
    corners = [F.struct(F.pmod(F.floor("_u") + i, F.lit(width)).cast("long").alias("x"), F.pmod(F.floor("_v") + j, F.lit(height)).cast("long").alias("y"), ((fx if i else 1 - fx) * (fy if j else 1 - fy)).alias("w")) for i in (0, 1) for j in (0, 1)]
    four = keyed.select("_id", F.explode(F.array(*corners)).alias("k")).select("_id", F.col("k.x").alias("x"), F.col("k.y").alias("y"), F.col("k.w").alias("w"))
    sums = four.join(image, ["x", "y"]).groupBy("_id").agg(F.sum(F.col("w") * F.col("value")).alias("value"))
    return keyed.join(sums, "_id").select(*points.columns, "value")


def gaussian(radius: int, sigma: float) -> list[float]:
    w = [math.exp(-(i * i) / (2 * sigma * sigma)) for i in range(-radius, radius + 1)]
    return [x / sum(w) for x in w]


def blurred(image: DataFrame, width: int, height: int, radius: int = 2, sigma: float = 1.0, guide: str | None = None, edge: float = 0.1) -> DataFrame:
    """(x, y, value) after two one-axis passes; with a ``guide`` column, texels across an edge weigh nothing.

    Each texel gives its value to its neighbours' places, and sums are taken there, so a
    pass is one aggregation.
    """
    now = image
    for axis, n in (("x", width), ("y", height)):
        taps = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(w).alias("w")) for i, w in zip(range(-radius, radius + 1), gaussian(radius, sigma), strict=True)])
        given = now.select("*", F.explode(taps).alias("t")).withColumn(axis, F.col(axis) + F.col("t.o")).where((F.col(axis) >= 0) & (F.col(axis) < n))
        if guide:
            here = now.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.col(guide).alias("_g"))
            given = given.join(here, (F.col("x") == F.col("_x")) & (F.col("y") == F.col("_y"))).withColumn("_w", F.when(F.abs(F.col(guide) - F.col("_g")) <= edge, F.col("t.w")).otherwise(0.0))
        else:
            given = given.withColumn("_w", F.col("t.w"))
        sums = given.groupBy("x", "y").agg((F.sum(F.col("_w") * F.col("value")) / F.sum("_w")).alias("value"))
        now = sums if not guide else sums.join(image.select("x", "y", guide), ["x", "y"])
    return now.select("x", "y", "value")


def min_max_levels(image: DataFrame, levels: int) -> DataFrame:
    """(level, x, y, low, high): halved ``levels`` times; each texel names its cells once."""
    up = image.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels))))
    cell = lambda c: F.call_function("shiftright", F.col(c), F.col("level")).alias(c)
    return up.select("level", cell("x"), cell("y"), "value").groupBy("level", "x", "y").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def maybe_visible(boxes: DataFrame, levels: DataFrame) -> DataFrame:
    """``boxes`` (level, x, y, near) that may be in front of the depth image there."""
    return boxes.join(levels, ["level", "x", "y"]).where(F.col("near") <= F.col("high")).select(*boxes.columns)
