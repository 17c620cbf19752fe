"""Transform DAGs in 16-bit words: pointers, codes, tables, node words, and back to voxels.

A pointer is, low bits first, the Huffman code of its shape, the shifts that are not zero
(z, y, x, biased, child level + 1 bits each), and the child's index: its first word within
its level, or a leaf's place.  In a node it takes two or three words, the lowest bit 0; or
one word as a slot of the level's pointer table, or two, lowest bit 1, beyond the first
65536 slots.  A node is a header word, two bits a child (the words of its pointer), and its
pointers.  Levels go bottom-up, as an index depends on the words of the level below.

Everything but the codes (a few hundred shapes a level, on the driver) is DataFrame
operations; places and running sums come from ranges, so no level is one task.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from voxlake.functions import huffman
from voxlake.operators.dag import ranked, running_start
from voxlake.operators.transform import MOST_LEVEL, POINTER, TransformDag, found_in, unfolded
from voxlake.storage import stored

#: Words that a direct pointer may take, bits of a word, words of a table entry and of a leaf.
MOST_WORDS, WORD, ENTRY_WORDS, LEAF_WORDS = 3, 16, 4, 4
#: Table slots that a one-word pointer reaches.
NEAR_SLOTS = 1 << 16
#: Bits of a whole pointer, so that it stays a positive long with its flag.
MOST_BITS = 61
_AXES = ("tx", "ty", "tz")


def shape_of(level: int, g: Column, shifts: list[Column]) -> Column:
    """A pointer's shape: axis order, mirrors and, where the child's level may shift, which shifts are stored."""
    if level - 1 > MOST_LEVEL:
        return g.cast("int")
    return (g * 8 + sum((F.when(t != 0, 1 << i).otherwise(0) for i, t in enumerate(shifts)), F.lit(0))).cast("int")


def bits_of(x: Column) -> Column:
    """Bits of a nonnegative number, 0 for 0."""
    return F.when(x == 0, 0).otherwise(F.length(F.bin(x))).cast("int")


def _left(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftleft", x, n if isinstance(n, Column) else F.lit(n))


def _right(x: Column, n: Column | int) -> Column:
    return F.call_function("shiftright", x, (n if isinstance(n, Column) else F.lit(n)).cast("int"))


def distinct_pointers(dag: TransformDag, level: int) -> DataFrame:
    """(child, g, tx, ty, tz, refs, type) of a level's pointers."""
    refs = dag.edges[level].groupBy(*POINTER).agg(F.count("*").alias("refs"))
    return refs.withColumn("type", shape_of(level, F.col("g"), [F.col(t) for t in _AXES]))


def shape_codes(pointers: DataFrame, level: int) -> DataFrame:
    """(level, type, pointers, length, code) of a level's shapes; the code's first bit is the lowest."""
    spark = pointers.sparkSession
    rows = [(r["type"], r["n"]) for r in pointers.groupBy("type").agg(F.count("*").alias("n")).orderBy("type").collect()]  # 384 shapes at most
    lengths = huffman.limited_lengths([n for _, n in rows], WORD)
    made = [(level, t, n, k, huffman.reversed_bits(c)) for (t, n), k, c in zip(rows, lengths, huffman.code_words(lengths), strict=True)]
    return spark.createDataFrame(made, "level int, type int, pointers long, length int, code long")


def encoded_pointers(pointers: DataFrame, codes: DataFrame, index: DataFrame, level: int) -> DataFrame:
    """``pointers`` with ``pointer`` (the whole, without a flag) and ``words`` (of its direct form)."""
    both = pointers.join(index, "child").join(F.broadcast(codes.select("type", "length", "code")), "type")  # codes: 384 rows at most
    value = F.col("index")
    for t in _AXES:
        value = F.when(F.col(t) != 0, _left(value, level) + (F.col(t) + (1 << level - 1))).otherwise(value)
    value = _left(value, F.col("length")) + F.col("code")
    made = both.select(*pointers.columns, value.cast("long").alias("pointer"))
    fits = F.when(bits_of(F.col("pointer")) > MOST_BITS, F.raise_error(F.lit("a pointer is too long"))).otherwise(F.col("pointer"))
    words = F.greatest(F.lit(2), F.ceil((bits_of(F.col("pointer")) + 1) / WORD)).cast("int")
    return made.withColumn("pointer", fits.cast("long")).withColumn("words", words)


def table_decisions(pointers: DataFrame) -> DataFrame:
    """``pointers`` with ``slot`` (null: direct) and ``stored_words``.

    By falling references: a pointer goes to the table where that takes fewer words, or
    where it is too long to stand in a node.  What a slot costs depends on how many
    precede it, one word or two: those that pay at one word are ranked, the first 65536
    have their slots, and behind the last of these what pays at two is ranked in turn.
    """
    order = [F.desc("refs"), F.asc("child"), F.asc("g"), F.asc("tx"), F.asc("ty"), F.asc("tz")]
    pays = lambda words: (F.col("words") > MOST_WORDS) | (F.col("refs") * words + ENTRY_WORDS < F.col("refs") * F.col("words"))
    rows = ranked(pointers.withColumns({"_g": F.lit(0), "_near": pays(1)}), "_g", order, "_place")
    rows = stored(running_start(rows.withColumn("_one", F.col("_near").cast("long")), "_g", "_place", "_one", "_before"), "decisions")
    near = F.col("_near") & (F.col("_before") < NEAR_SLOTS)
    # a row behind 65536 that pay is decided at two words
    far = rows.where((F.col("_before") >= NEAR_SLOTS) & pays(2)).withColumn("_two", F.lit(1).cast("long"))
    far = running_start(far, "_g", "_place", "_two", "_after").select(F.col("_place").alias("_p"), (F.col("_after") + NEAR_SLOTS).alias("_far"))
    both = rows.join(far, F.col("_place") == F.col("_p"), "left")
    slot = F.when(near, F.col("_before")).otherwise(F.col("_far"))
    size = F.when(near, 1).when(slot.isNotNull(), F.greatest(F.lit(2), F.ceil((bits_of(slot) + 1) / WORD)).cast("int")).otherwise(F.col("words"))
    return both.select(*pointers.columns, slot.alias("slot"), size.alias("stored_words"))


class Transform16:
    """The encoded form: ``nodes`` (level, id, start, words array<int>), ``tables`` (level, slot, pointer),
    ``codes`` (level, type, pointers, length, code), ``leaves`` (place, lo, hi) and ``root`` (index, g)."""

    def __init__(self, nodes: DataFrame, tables: DataFrame, codes: DataFrame, leaves: DataFrame, root: DataFrame, depth: int):
        self.nodes, self.tables, self.codes, self.leaves, self.root, self.depth = nodes, tables, codes, leaves, root, depth

    @classmethod
    def of(cls, dag: TransformDag) -> "Transform16":
        refs = dag.all_edges().groupBy((F.col("level") - 1).alias("level"), F.col("child").alias("id")).agg(F.count("*").alias("refs"))
        top = dag.root.select(F.lit(dag.depth).alias("level"), F.col("child").alias("id"), F.lit(1).cast("long").alias("refs"))
        places = stored(ranked(refs.unionByName(top), "level", [F.desc("refs"), F.asc("id")], "place"), "places")
        leaves = stored(dag.leaves.join(places.where("level = 2"), "id").select("place", "lo", "hi"), "leaves16")
        index = places.where("level = 2").select(F.col("id").alias("child"), F.col("place").alias("index"))
        nodes, tables, codes = [], [], []
        for level in range(3, dag.depth + 1):
            pointers = stored(distinct_pointers(dag, level), "pointers")
            shapes = shape_codes(pointers, level)
            decided = stored(table_decisions(encoded_pointers(pointers, shapes, index, level)), "decided")
            # a direct pointer's lowest bit is 0; of a slot of two words, 1
            value = F.when(F.col("slot").isNull(), F.col("pointer") * 2).when(F.col("stored_words") == 1, F.col("slot")).otherwise(F.col("slot") * 2 + 1)
            kids = dag.edges[level].join(decided.select(*POINTER, F.col("stored_words").alias("k"), value.alias("value")), POINTER)
            held = F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda i: _right(F.col("value"), i * WORD).bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int"))
            parts = kids.select("parent", "slot", "k", held.alias("w")).groupBy(F.col("parent").alias("id")).agg(
                F.sum(_left(F.col("k"), F.col("slot") * 2)).cast("int").alias("header"), F.sort_array(F.collect_list(F.struct("slot", "w"))).alias("kids")
            )
            words = F.concat(F.array("header"), F.flatten(F.transform("kids", lambda x: x.w)))
            placed = parts.select("id", words.alias("words")).join(places.where(F.col("level") == level).select("id", "place"), "id")
            sized = placed.select(F.lit(level).alias("level"), "id", "place", "words", F.size("words").cast("long").alias("n"))
            made = stored(running_start(sized, "level", "place", "n").select("level", "id", "start", "words"), "nodes16")
            index = made.select(F.col("id").alias("child"), F.col("start").alias("index"))
            nodes.append(made)
            codes.append(shapes)
            tables.append(decided.where("slot is not null").select(F.lit(level).alias("level"), "slot", "pointer"))
        root = dag.root.join(index, "child").select("index", "g")
        union = lambda parts: reduce(DataFrame.unionByName, parts)
        return cls(union(nodes), union(tables), union(codes), leaves, root, dag.depth)

    # --- sizes --------------------------------------------------------------------

    def sizes(self) -> DataFrame:
        """(level, nodes, node_words, table_slots, bytes); a leaf and a table entry are four words."""
        slots = self.tables.groupBy("level").agg(F.count("*").alias("table_slots"))
        inner = self.nodes.groupBy("level").agg(F.count("*").alias("nodes"), F.sum(F.size("words")).alias("node_words")).join(slots, "level", "left")
        leaf = self.leaves.agg(F.count("*").alias("nodes")).select(F.lit(2).alias("level"), "nodes", (F.col("nodes") * LEAF_WORDS).alias("node_words"), F.lit(0).cast("long").alias("table_slots"))
        both = inner.select("level", "nodes", "node_words", F.coalesce("table_slots", F.lit(0)).alias("table_slots")).unionByName(leaf)
        return both.withColumn("bytes", (F.col("node_words") + ENTRY_WORDS * F.col("table_slots")) * 2)

    # --- decoding -----------------------------------------------------------------

    def _followed(self, state: DataFrame, level: int) -> DataFrame:
        here = self.nodes.where(F.col("level") == level).select(F.col("start").alias("node"), "words")
        header = F.element_at("words", 1)
        k = lambda i: F.shiftright(header, 2 * i).bitwiseAND(F.lit(3))
        at = lambda i: sum((k(j) for j in range(i)), F.lit(2))
        word = lambda i, j: F.when(k(i) > j, _left(F.element_at("words", (at(i) + j).cast("int")).cast("long"), WORD * j)).otherwise(0)
        each = F.array(*[F.struct(F.lit(i).alias("slot"), k(i).alias("k"), sum((word(i, j) for j in range(MOST_WORDS)), F.lit(0).cast("long")).alias("raw")) for i in range(8)])
        kids = state.join(here, "node").withColumn("p", F.explode(F.filter(each, lambda x: x.k > 0))).select(*state.columns, "p.slot", "p.k", "p.raw")
        direct = (F.col("k") > 1) & (F.col("raw") % 2 == 0)
        kids = kids.withColumn("_slot", F.when(~direct, F.when(F.col("k") == 1, F.col("raw")).otherwise(_right(F.col("raw"), 1))))
        table = self.tables.where(F.col("level") == level).select(F.col("slot").alias("_slot"), F.col("pointer").alias("_held"))
        kids = kids.join(table, "_slot", "left").withColumn("pointer", F.when(F.col("_slot").isNull(), _right(F.col("raw"), 1)).otherwise(F.col("_held")))
        # a code is a prefix: of the lengths there are, one finds a shape
        codes = self.codes.where(F.col("level") == level).select("type", "length", "code")
        lengths = sorted(r[0] for r in codes.select("length").distinct().collect())  # 16 at most
        tried = kids.withColumn("length", F.explode(F.array(*[F.lit(n) for n in lengths]))).withColumn("code", F.col("pointer").bitwiseAND(_left(F.lit(1).cast("long"), F.col("length")) - 1))
        found = tried.join(F.broadcast(codes), ["length", "code"])  # 384 rows at most
        rest, shifts = _right(F.col("pointer"), F.col("length")), {}
        for i, t in reversed(list(enumerate(_AXES))):
            if level - 1 > MOST_LEVEL:
                shifts[t] = F.lit(0)
                continue
            there = F.shiftright("type", i).bitwiseAND(F.lit(1)) == 1
            found = found.withColumn("_rest", rest).withColumn(t, F.when(there, F.col("_rest").bitwiseAND(F.lit((1 << level) - 1)) - (1 << level - 1)).otherwise(0).cast("int"))
            found = found.withColumn("_rest2", F.when(there, _right(F.col("_rest"), level)).otherwise(F.col("_rest"))).drop("_rest").withColumnRenamed("_rest2", f"_rest{i}")
            rest, shifts[t] = F.col(f"_rest{i}"), F.col(t)
        g = F.col("type") if level - 1 > MOST_LEVEL else F.shiftright("type", 3)
        return found.select(*state.columns, "slot", rest.alias("child"), g.cast("int").alias("cg"), *[shifts[t].cast("int").alias(t) for t in _AXES])

    def voxels(self) -> DataFrame:
        """(x, y, z), from the words alone."""
        return unfolded(self.root.select(F.col("index").alias("node"), "g"), self.depth, self._followed, self.leaves.withColumnRenamed("place", "node"))

    def members(self, queries: DataFrame) -> DataFrame:
        """``queries`` (x, y, z) with ``found``, from the words alone."""
        return found_in(queries, self.root.select(F.col("index").alias("node"), "g"), self.depth, self._followed, self.leaves.withColumnRenamed("place", "node"))

    # --- files --------------------------------------------------------------------

    def write(self, path: str) -> None:
        """A folder of Parquet tables; words stay 16-bit numbers in order of their places."""
        self.nodes.repartitionByRange("level", "start").sortWithinPartitions("level", "start").write.parquet(f"{path}/nodes")
        self.tables.repartitionByRange("level", "slot").sortWithinPartitions("level", "slot").write.parquet(f"{path}/tables")
        self.leaves.repartitionByRange("place").sortWithinPartitions("place").write.parquet(f"{path}/leaves")
        self.codes.coalesce(1).write.parquet(f"{path}/codes")
        self.root.withColumn("depth", F.lit(self.depth)).coalesce(1).write.parquet(f"{path}/root")

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> "Transform16":
        part = lambda name: spark.read.parquet(f"{path}/{name}")
        root = part("root")
        return cls(part("nodes"), part("tables"), part("codes"), part("leaves"), root.select("index", "g"), root.first()["depth"])
