"""Mixing sources to target weights by a low-discrepancy schedule.

Targets share a word budget by weight; a target stops at a multiple of its source and the
excess is shared again by weight.  The mix is a run of slots of ``slot_words`` words each.
Slot i takes the source whose interval of cumulative targets holds the i-th point of a
low-discrepancy sequence (golden-ratio steps, or van der Corput's), in whole numbers
modulo 2^31, so every run computes the same schedule.  Slots are ranked within their
source, and rank r takes block r of the source's stream: its documents in a hashed order,
repeated from the start when they end, cut into blocks of ``slot_words``.  A source so
gets as many blocks as it has slots: its words follow from the schedule and are within a
few slots of its target; only the block at ``most`` times the source is cut short.

A slot has the ``LEAST_SLOTS``-th part of the budget, rounded up, and at most
``SLOT_WORDS`` words.  Ranks and stream positions are prefix sums in two levels (sums by
bucket, then inside a bucket), so a source with a third of the rows is spread over many
tasks.

Defined cases: a null text has size 0 and is in no slot; the null source is a source, last
in order; a source without words takes nothing; a source whose share is under a slot may
take nothing, or a slot; documents of equal id, text and source stand side by side, by the
text's hash; repeated rows are separate documents, each with its own place; an empty table
gives an empty result; other columns are not read, but pass through ``mixed``.
"""

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from voxlake.llm.common import n_partitions, stored

#: Most words of a slot, and the slots that a small budget is cut into.
SLOT_WORDS, LEAST_SLOTS = 1024, 65536
#: Slots or documents of a bucket, about.
BUCKET = 1024
#: Points are whole numbers under 2^31; the golden ratio's fraction of that, odd.
POINT_BITS = 31
GOLDEN = 1327217885
#: Bins of the points by which one finds its source.
BIN_BITS = 12
SALT = "mix"


def size_of(text: str = "text") -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    spaced = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), "\t\n\x0b\f\r", "     ")
    # words begin where a non-space follows a space or the start
    return F.length(F.regexp_replace(F.regexp_replace(spaced, "[^ ]+", "x"), " ", "")).cast("long")


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """(source, source_size, target): water filling of ``share`` of all words.

    ``sizes`` has (source, source_size), a row a source; weights repeat along the sources
    in code-point order, null last.  With the sources in order of cap per weight, the
    first ones are full; the level is that of the first source that is not.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    n = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (n % len(weights) + 1).cast("int"))
    w = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_level = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = W.partitionBy()
    w = w.withColumns({
        "budget": F.lit(float(share)) * F.sum("source_size").over(everything),
        "full_before": F.coalesce(F.sum("cap").over(by_level.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)),
        "weight_from": F.sum("weight").over(by_level.rowsBetween(W.currentRow, W.unboundedFollowing)),
    })
    w = w.withColumn("level", (F.col("budget") - F.col("full_before")) / F.col("weight_from"))
    open_ = F.col("level") * F.col("weight") < F.col("cap")
    w = w.withColumn("final", F.min(F.when(open_, F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("level")))).over(everything))
    return w.select(
        "source", "source_size", F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final.level") * F.col("weight"))).alias("target")
    )


def point(slot: Column, sequence: str = "golden") -> Column:
    """The slot's point, a long under 2^31; each is taken once in 2^31 slots."""
    low = (slot + 1).bitwiseAND(F.lit((1 << POINT_BITS) - 1))
    if sequence == "golden":
        return (low * GOLDEN).bitwiseAND(F.lit((1 << POINT_BITS) - 1))
    if sequence == "van_der_corput":
        return F.conv(F.reverse(F.lpad(F.bin(low), POINT_BITS, "0")), 2, 10).cast("long")
    raise ValueError(f"unknown sequence {sequence!r}")


def schedule(goals: DataFrame, slot_words: int | None = None, sequence: str = "golden") -> DataFrame:
    """(slot, source, rank, slots, words, start, after): the mix in order.

    ``goals`` has (source, source_size, target, limit), ``limit`` the most words that a
    source may give.  start and after are positions in the source's stream, ``slots`` and
    ``words`` what the source has in all.
    """
    spark = goals.sparkSession
    order = W.orderBy(F.col("source").asc_nulls_last())
    whole = goals.where("target >= 1").select("source", "limit", F.floor("target").cast("decimal(20,0)").alias("words"))
    ends = whole.withColumns({"end": F.sum("words").over(order), "sum": F.sum("words").over(W.partitionBy())})
    cut = F.expr(f"cast(cast(end as decimal(20,0)) * {1 << POINT_BITS} div cast(sum as decimal(20,0)) as long)")
    shares = ends.select("source", "limit", "words", cut.alias("high"))
    shares = stored(shares.withColumn("low", F.lag("high", 1, 0).over(order)), "shares")
    total = int(shares.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    size = slot_words or max(1, min(SLOT_WORDS, -(-total // LEAST_SLOTS)))
    slots = -(-total // size)
    parts = max(1, min(slots // 65536, 20_000))
    points = spark.range(0, slots, 1, parts).select(F.col("id").alias("slot"), point(F.col("id"), sequence).alias("p"))
    # an equal-width bin of the points names the few sources whose intervals reach into it
    bin_of = lambda x: F.shiftright(x, POINT_BITS - BIN_BITS).cast("int")
    binned = shares.where("high > low").withColumn("bin", F.explode(F.sequence(bin_of(F.col("low")), bin_of(F.col("high") - 1))))
    placed = points.withColumn("bin", bin_of(F.col("p"))).join(binned, "bin").where("p >= low and p < high").select("slot", "source", "limit")
    placed = placed.withColumn("bucket", F.floor(F.col("slot") / BUCKET))
    counts = stored(placed.groupBy("source", "bucket").agg(F.count("*").alias("n")), "mix-counts")
    by_source = W.partitionBy("source").orderBy("bucket")
    counts = counts.select("source", "bucket", F.coalesce(F.sum("n").over(by_source.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("n").over(W.partitionBy("source")).alias("slots"))
    inside = W.partitionBy("source", "bucket").orderBy("slot")
    ranked = placed.alias("p").join(counts.alias("c"), F.col("p.source").eqNullSafe(F.col("c.source")) & (F.col("p.bucket") == F.col("c.bucket"))).select(
        "p.slot", "p.source", "p.limit", "c.slots", "p.bucket", "c.before"
    )
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(inside) - 1)
    at = lambda r: F.least(F.col("limit"), r * size).cast("long")
    made = ranked.select("slot", "source", "rank", "slots", at(F.col("slots")).alias("words"), at(F.col("rank")).alias("start"), at(F.col("rank") + 1).alias("after"))
    return made.withColumn("slot_words", F.lit(size).cast("long"))


def _mark(doc_id: Column, text: Column, source: Column) -> Column:
    """128 bits that name a row's id, text and source, as hexadecimal digits."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in (doc_id, source, text)]))


def streamed(documents: DataFrame) -> DataFrame:
    """(doc_id, source, mark, copy, size, start): where each document stands in its source's stream.

    The order is that of the MD5 of the salted doc_id, its leading digits are the buckets;
    ``mark`` hashes id, text and source, and ``copy`` numbers rows alike in them.
    """
    rows = documents.select(F.col("doc_id"), F.col("source"), size_of().alias("size"), _mark(F.col("doc_id"), F.col("text"), F.col("source")).alias("mark"))
    rows = stored(rows.withColumn("key", F.md5(F.concat(F.lit(SALT), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))), "mix-sizes")
    n = max(1, rows.count() // BUCKET)
    digits = max(1, len(f"{n:x}"))
    rows = rows.withColumn("bucket", F.substring("key", 1, digits))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("s"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select("source", "bucket", F.coalesce(F.sum("s").over(before), F.lit(0)).alias("before"))
    inside = W.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "mark").rowsBetween(W.unboundedPreceding, -1)
    joined = rows.alias("r").join(sums.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r.bucket") == F.col("s.bucket"))).select("r.*", "s.before")
    alike = F.row_number().over(W.partitionBy("source", "bucket", "mark").orderBy("key"))
    return joined.select("doc_id", "source", "mark", alike.alias("copy"), "size", (F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("start"))


def mix(documents: DataFrame, weights: list[float], share: float, most: float, slot_words: int | None = None, sequence: str = "golden") -> tuple[DataFrame, DataFrame]:
    """(assigned, pieces).

    ``assigned``: (row, doc_id, source, mark, copy, size, start, source_size, target), a row a document.
    ``pieces``: (slot, row, epoch, first, after): which words of which documents a slot takes;
    ``epoch`` counts the times that the source's stream began anew.
    """
    docs = streamed(documents)
    goals = targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    goals = stored(goals.withColumn("limit", F.floor(F.col("source_size") * F.lit(float(most))).cast("long")), "mix-goals")
    plan = stored(schedule(goals, slot_words, sequence), "mix-plan")
    assigned = docs.alias("d").join(goals.alias("g"), F.col("d.source").eqNullSafe(F.col("g.source"))).select("d.*", "g.source_size", "g.target")
    assigned = stored(assigned.withColumn("row", F.monotonically_increasing_id()), "mix-assigned")
    sized = plan.groupBy("source").agg(F.max("words").alias("words"), F.max("slot_words").alias("slot_words"))
    spread = assigned.where("size > 0").alias("a").join(sized.alias("z"), F.col("a.source").eqNullSafe(F.col("z.source"))).select("a.row", "a.source", "a.size", "a.start", "a.source_size", "z.words", "z.slot_words")
    epochs = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.col("words") / F.col("source_size")) - 1).cast("int"))
    spread = spread.withColumn("epoch", F.explode(epochs)).withColumn("at", F.col("start") + F.col("epoch") * F.col("source_size")).where(F.col("at") < F.col("words"))
    last = F.least(F.col("at") + F.col("size"), F.col("words")) - 1
    rank_at = lambda x: F.floor(x / F.col("slot_words")).cast("long")
    spread = spread.withColumn("rank", F.explode(F.sequence(rank_at(F.col("at")), rank_at(last))))
    both = spread.alias("x").join(plan.alias("p"), F.col("x.source").eqNullSafe(F.col("p.source")) & (F.col("x.rank") == F.col("p.rank")))
    pieces = both.select(
        "p.slot", "x.row", "x.epoch",
        (F.greatest(F.col("p.start"), F.col("x.at")) - F.col("x.at")).alias("first"),
        (F.least(F.col("p.after"), F.col("x.at") + F.col("x.size")) - F.col("x.at")).alias("after"),
    ).where("after > first")
    return assigned, pieces


def taken(documents: DataFrame, weights: list[float], share: float, most: float, slot_words: int | None = None, sequence: str = "golden") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, slot) of every document.

    ``taken``: the words of it that the slots hold, repeats counted; ``slot``: the first of them, null if none.
    """
    assigned, pieces = mix(documents, weights, share, most, slot_words, sequence)
    sums = pieces.groupBy("row").agg(F.sum(F.col("after") - F.col("first")).alias("taken"), F.min("slot").alias("slot"))
    return assigned.join(sums, "row", "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "slot")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    mark = "\x01"
    spaced = F.translate(text, f"\t\n\x0b\f\r{mark}", "     x")
    ended = F.regexp_replace(spaced, r"([^ ])(?= |\z)", f"$1{mark}")
    # before the n-th mark stand n - 1 others
    return F.substr(text, F.lit(1), F.length(F.call_function("substring_index", ended, F.lit(mark), n.cast("int"))) - n.cast("int") + 1)


def mixed(documents: DataFrame, weights: list[float], share: float, most: float, slot_words: int | None = None, sequence: str = "golden") -> DataFrame:
    """``documents`` as the mix has them, in the schedule's order (by range partition and row).

    A document comes once for every time that its source's stream passes it; where the
    stream ends inside it, it comes with the words that are taken.  A document without
    words comes once, after the others.
    """
    assigned, pieces = mix(documents, weights, share, most, slot_words, sequence)
    passes = pieces.groupBy("row", "epoch").agg(F.min("slot").alias("_vx_slot"), F.max("after").alias("_vx_words"))
    places = assigned.join(passes, "row", "left").where(F.col("_vx_words").isNotNull() | (F.col("size") == 0))
    columns = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(documents.columns)]
    text = documents.columns.index("text")
    own = documents.select(*columns, _mark(F.col("doc_id"), F.col("text"), F.col("source")).alias("_vx_mark"))
    # rows alike in id, text and source, numbered: each takes the place of its number
    own = own.withColumn("_vx_copy", F.row_number().over(W.partitionBy("_vx_mark").orderBy(F.xxhash64(*[f"c{i}" for i in range(len(columns))]))))
    places = places.select(F.col("mark").alias("_vx_mark"), F.col("copy").alias("_vx_copy"), F.col("size").alias("_vx_size"), "_vx_slot", "_vx_words")
    both = own.join(places, ["_vx_mark", "_vx_copy"])
    cut = F.when(F.col("_vx_words") < F.col("_vx_size"), first_words(F.col(f"c{text}").cast("string"), F.col("_vx_words"))).otherwise(F.col(f"c{text}").cast("string"))
    slot = F.coalesce("_vx_slot", F.lit((1 << 63) - 1))
    ordered = both.withColumn(f"c{text}", cut).withColumn("_vx_slot", slot).repartitionByRange(n_partitions(documents.sparkSession), "_vx_slot", "_vx_mark").sortWithinPartitions("_vx_slot", "_vx_mark", "_vx_copy")
    return ordered.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(documents.columns)])
