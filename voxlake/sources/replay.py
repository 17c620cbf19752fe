"""Replay logs: comma-separated actions, a frame ending at each EndFrame."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.operators.dag import running_start

# fixed values: action names of the log and ours
ACTIONS = {
    "SetLocation": "location",
    "SetRotation": "rotation",
    "SetToolParameters": "tool",
    "EditSphere": "sphere",
    "EditCube": "box",
    "EditCopy": "copy",
    "EditFill": "fill",
    "EditPaint": "paint",
    "Undo": "undo",
    "Redo": "redo",
    "EndFrame": "end_frame",
}
#: Numbers of arguments that an action may have.
ARITY = {"EditSphere": (5, 6), "EditCube": (5, 6), "EditCopy": (10, 21), "EditFill": (4,), "EditPaint": (4, 7, 8), "SetToolParameters": (11, 14), "Undo": (0,), "Redo": (0,), "EndFrame": (0,)}


def parse(lines: DataFrame) -> DataFrame:
    """(seq, line) to edits: seq, frame, action, x, y, z, radius, add, material, source and target, matrix, swirl, period, fault.

    Trailing empty cells are dropped; ``fault`` names an unknown action or a wrong number
    of arguments.  Frames are numbered by the EndFrame rows before a row.
    """
    cells = F.split(F.regexp_replace("line", ",+$", ""), ",")
    p = lines.where(F.length("line") > 0).select("seq", cells.alias("c"))
    name, n = F.element_at("c", 1), F.size("c") - 1
    action = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])[name]
    arg = lambda i, kind="double": F.try_element_at("c", F.lit(i + 2)).try_cast(kind)
    edit = name.startswith("Edit")
    copy = name == "EditCopy"
    fits = F.lit(None).cast("boolean")
    for key, sizes in ARITY.items():
        fits = F.when(name == key, n.isin(*sizes)).otherwise(fits)
    fault = F.when(action.isNull(), "action").when(~F.coalesce(fits, F.lit(True)), "arguments")
    radius = F.when(copy, arg(9)).when(edit, arg(3))
    flag = lambda i: F.lower(F.try_element_at("c", F.lit(i + 2))) == "true"
    shaped = name.isin("EditSphere", "EditCube")
    material = F.when(shaped, F.coalesce(arg(5, "int"), F.lit(4))).when(name == "EditPaint", F.coalesce(arg(7, "int"), F.lit(1)))
    identity = [1.0 if i % 4 == 0 else 0.0 for i in range(9)]
    rows = p.select(
        "seq",
        action.alias("action"),
        *[F.when(edit, arg(i)).alias(a) for i, a in enumerate("xyz")],
        radius.alias("radius"),
        F.when(shaped, flag(4)).alias("add"),
        material.alias("material"),
        *[F.when(copy, F.coalesce(arg(3 + i), F.lit(0.0))).alias(f"s{a}") for i, a in enumerate("xyz")],
        *[F.when(copy, F.coalesce(arg(6 + i), F.lit(0.0))).alias(f"d{a}") for i, a in enumerate("xyz")],
        F.when(copy, F.array(*[F.coalesce(arg(10 + i), F.lit(v)) for i, v in enumerate(identity)])).alias("matrix"),
        F.when(copy, F.coalesce(flag(19), F.lit(False))).alias("swirl"),
        F.when(copy, F.coalesce(arg(20), F.lit(1.0))).alias("period"),
        fault.alias("fault"),
    )
    counted = rows.withColumns({"_log": F.lit(0), "_end": F.coalesce((F.col("action") == "end_frame").cast("long"), F.lit(0).cast("long"))})
    return running_start(counted, "_log", "seq", "_end", "frame").withColumn("frame", F.col("frame").cast("int")).drop("_log", "_end")


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """Edits of one log; a log is a list of commands, in file order."""
    text = spark.read.option("wholetext", True).text(path)
    return parse(text.select(F.posexplode(F.split("value", "\r?\n")).alias("seq", "line")).withColumn("seq", F.col("seq").cast("long")))


def lines_of(edits: DataFrame) -> DataFrame:
    """(seq, line): the log's own form of edits, read back by ``parse``."""
    names = F.create_map(*[F.lit(x) for a, b in ACTIONS.items() for x in (b, a)])
    say = lambda *c: [F.coalesce(F.col(x).cast("string"), F.lit("0")) for x in c]
    a = F.col("action")
    copy = F.concat_ws(",", *say("x", "y", "z", "sx", "sy", "sz", "dx", "dy", "dz", "radius"), F.array_join(F.col("matrix").cast("array<string>"), ","), *say("swirl", "period"))
    arguments = (
        F.when(a.isin("sphere", "box"), F.concat_ws(",", *say("x", "y", "z", "radius", "add", "material")))
        .when(a == "copy", copy)
        .when(a == "fill", F.concat_ws(",", *say("x", "y", "z", "radius")))
        .when(a == "paint", F.concat_ws(",", *say("x", "y", "z", "radius"), F.lit("1,1,1"), *say("material")))
    )
    return edits.select("seq", F.concat_ws(",", names[a], arguments).alias("line"))


def write_replay(edits: DataFrame, path: str) -> None:
    """One text file, in order."""
    lines_of(edits).coalesce(1).sortWithinPartitions("seq").select("line").write.text(path)


def scaled(edits: DataFrame, levels: int) -> DataFrame:
    """Coordinates of a log made for a scene 2^levels times smaller."""
    k = float(2**levels)
    return edits.withColumns({c: F.col(c) * k for c in ("x", "y", "z", "radius", "sx", "sy", "sz", "dx", "dy", "dz")})


def playlist(lines: DataFrame) -> DataFrame:
    """(seq, line) of alternating log names and pauses to (place, name, pause)."""
    pair: Column = F.floor(F.col("seq") / 2)
    both = lines.groupBy(pair.alias("place")).agg(F.max(F.when(F.col("seq") % 2 == 0, F.col("line"))).alias("name"), F.max(F.when(F.col("seq") % 2 == 1, F.col("line").try_cast("double"))).alias("pause"))
    return both.where("name is not null")
