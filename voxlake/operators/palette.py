"""Colours of voxels: palettes, nearest materials, greedy reduction, run-length blocks."""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxlake.functions import colors as c
from voxlake.functions import morton as m
from voxlake.operators.dag import running_start
from voxlake.storage import discard, stored

#: Colour error above which a compressed colour counts as bad.
MOST_ERROR = 0.04
#: Colours of a macro block.
MACRO = 16384
#: Materials of a palette that is broadcast.
MOST_MATERIALS = 4096


def _rgb(prefix: str = "") -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{n}") for n in "rgb")


def color_counts(colors: DataFrame) -> DataFrame:
    return colors.groupBy("r", "g", "b").agg(F.count("*").alias("n"))


#: Spaces of ``material_means``, each with its channels' names.
SPACES = {"rgb": (lambda rgb: rgb, "rgb"), "yuv": (c.yuv, "yuv"), "lab": (c.lab, "lab")}


def material_means(voxels: DataFrame, space: str = "rgb") -> DataFrame:
    """(material, and the channels' names) means of coloured voxels in a colour space."""
    convert, names = SPACES[space]
    return voxels.groupBy("material").agg(*[F.avg(x).alias(n) for x, n in zip(convert(_rgb()), names, strict=True)])


def _candidates(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """Distinct colours with every material and their squared CIELAB distance; the palette's size is checked."""
    if palette.limit(MOST_MATERIALS + 1).count() > MOST_MATERIALS:
        raise ValueError(f"a palette has up to {MOST_MATERIALS} materials")
    p = palette.select("material", *[x.alias(f"p{n}") for x, n in zip(c.lab(_rgb()), "lab", strict=True)])
    d = colors.select("r", "g", "b", *([F.col("n")] if "n" in colors.columns else []), *[x.alias(f"c{n}") for x, n in zip(c.lab(_rgb()), "lab", strict=True)])
    far = sum(((F.col(f"c{n}") - F.col(f"p{n}")) * (F.col(f"c{n}") - F.col(f"p{n}")) for n in "lab"), F.lit(0.0))
    return d.join(F.broadcast(p), F.lit(True)).withColumn("d", far)


def nearest_materials(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """(r, g, b, material): the nearest material of each distinct colour, ties to the least."""
    both = _candidates(colors.select("r", "g", "b").distinct(), palette)
    return both.groupBy("r", "g", "b").agg(F.min(F.struct("d", "material")).alias("best")).select("r", "g", "b", "best.material")


def palette_costs(colors: DataFrame, palette: DataFrame) -> DataFrame:
    """(material, cost, uses): what dropping a material costs: its colours' step to their second best, by count."""
    both = _candidates(color_counts(colors), palette)
    two = both.groupBy("r", "g", "b", "n").agg(F.array_sort(F.collect_list(F.struct("d", "material"))).alias("by"))
    first, second = F.element_at("by", 1), F.try_element_at("by", F.lit(2))
    step = two.select(first.material.alias("material"), (F.col("n") * (second.d - first.d)).alias("cost"), "n")
    sums = step.groupBy("material").agg(F.sum("cost").alias("cost"), F.sum("n").alias("uses"))
    return palette.select("material").join(sums, "material", "left").select("material", F.coalesce("cost", F.lit(0.0)).alias("cost"), F.coalesce("uses", F.lit(0)).alias("uses"))


def reduced_palette(colors: DataFrame, palette: DataFrame, keep: int) -> DataFrame:
    """Drop the cheapest material until ``keep`` are left.

    Each distinct colour's materials are sorted by distance once and stored; a drop is an
    aggregation over the first two that are left, and its driver holds the dropped materials.
    """
    both = _candidates(color_counts(colors), palette)
    by = stored(both.groupBy("r", "g", "b").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("d", "material"))).alias("by")), "palette-distances")
    materials = [r["material"] for r in palette.select("material").orderBy("material").collect()]  # the palette's size is checked
    dropped: list = []
    while len(materials) > max(keep, 1):
        left = F.filter("by", lambda x: ~x.material.isin(dropped)) if dropped else F.col("by")
        two = by.select("n", F.slice(left, 1, 2).alias("two"))
        step = two.select(F.element_at("two", 1).material.alias("material"), (F.col("n") * (F.element_at("two", 2).d - F.element_at("two", 1).d)).alias("cost"))
        cost = {r["material"]: r["cost"] for r in step.groupBy("material").agg(F.sum("cost").alias("cost")).collect()}
        worst = min(materials, key=lambda m: (cost.get(m, 0.0), m))
        materials.remove(worst)
        dropped.append(worst)
    discard(by)
    return palette.where(F.col("material").isin(materials))


def usable_faces(faces: DataFrame) -> DataFrame:
    """Materials all of whose faces are there and opaque: (material, face, transparent) to (material)."""
    return faces.groupBy("material").agg(F.count_distinct("face").alias("n"), F.max(F.col("transparent").cast("int")).alias("t")).where("n = 6 and t = 0").select("material")


def bad_colors(rows: DataFrame) -> DataFrame:
    """Rows whose compressed colour (cr, cg, cb) is further than the threshold from (r, g, b)."""
    return rows.where(c.error(_rgb(), _rgb("c")) > MOST_ERROR)


# --- colour streams ---------------------------------------------------------------

def color_stream(voxels: DataFrame) -> DataFrame:
    """(rank, color): packed colours of (x, y, z, r, g, b) in depth-first order."""
    keyed = voxels.select(m.morton3().alias("_m"), F.lit(1).alias("_g"), F.lit(1).cast("long").alias("_one"), c.packed(_rgb()).alias("color"))
    return running_start(keyed, "_g", "_m", "_one", "rank").select("rank", "color")


def run_blocks(stream: DataFrame, macro: int = MACRO) -> DataFrame:
    """(macro, start, length, color): runs of equal colours, cut at macro blocks.

    Ranks are dense, so a run is a group of equal (rank - place among its colour) in its macro block.
    """
    block = stream.withColumn("macro", F.floor(F.col("rank") / macro))
    place = F.row_number().over(W.partitionBy("macro", "color").orderBy("rank"))
    runs = block.withColumn("island", F.col("rank") - place)
    return runs.groupBy("macro", "color", "island").agg(F.min("rank").alias("start"), F.count("*").alias("length")).select("macro", "start", "length", "color")


def weight_blocks(stream: DataFrame, bits: int = 2, macro: int = MACRO, size: int = 64) -> DataFrame:
    """(block, low, high, weights): ``size`` colours as two rgb565 ends and a weight of ``bits`` bits each."""
    rows = stream.withColumn("block", F.floor(F.col("rank") / size))
    red, green, blue = c.unpacked(F.col("color"))
    ends = rows.select("block", "rank", red.alias("r"), green.alias("g"), blue.alias("b"))
    box = ends.groupBy("block").agg(*[f(n).alias(f"{p}{n}") for n in "rgb" for p, f in (("l", F.min), ("h", F.max))], F.array_sort(F.collect_list(F.struct("rank", "r", "g", "b"))).alias("cs"))
    low, high = _rgb("l"), _rgb("h")
    span = c.distance2(low, high)

    def at(x: Column) -> Column:
        t = sum(((x[n] - F.col(f"l{n}")) * (F.col(f"h{n}") - F.col(f"l{n}")) for n in "rgb"), F.lit(0.0)) / span
        return F.when(span == 0, 0).otherwise(F.round(c.clamped(t) * ((1 << bits) - 1))).cast("int")

    return box.select("block", c.packed(low, c.RGB565).alias("low"), c.packed(high, c.RGB565).alias("high"), F.transform("cs", at).alias("weights"))


def block_colors(blocks: DataFrame, bits: int = 2, size: int = 64) -> DataFrame:
    """(rank, r, g, b) of ``weight_blocks``."""
    each = blocks.select("block", "low", "high", F.posexplode("weights").alias("i", "w"))
    mixed = c.lerp(c.unpacked(F.col("low"), c.RGB565), c.unpacked(F.col("high"), c.RGB565), c.weight(F.col("w"), bits))
    return each.select((F.col("block") * size + F.col("i")).alias("rank"), *[x.alias(n) for x, n in zip(mixed, "rgb", strict=True)])


def lookup_colors(queries: DataFrame, runs: DataFrame, macro: int = MACRO) -> DataFrame:
    """``queries`` (rank) with the colour of the run that holds it; joined by macro block."""
    q = queries.withColumn("_macro", F.floor(F.col("rank") / macro))
    r = runs.select(F.col("macro").alias("_macro"), F.col("start").alias("_s"), F.col("length").alias("_n"), "color")
    return q.join(r, "_macro").where((F.col("rank") >= F.col("_s")) & (F.col("rank") < F.col("_s") + F.col("_n"))).select(*queries.columns, "color")
