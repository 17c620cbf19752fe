"""Chat formatting from an event log, with DataFrame functions only.

A log row is an event: conversation, sequence number, turn, role, kind and text (and
``copy``, which tells messages of one turn apart).  The
fold: ``delta`` appends its text to the turn's message; ``edit`` and ``regenerate``
begin the turn's message anew (with their own text) and drop every later turn that was
written before them.  Events are folded by (conversation, turn, copy), messages rendered and
joined in blocks of turns, and the blocks joined by conversation, so the rows that
meet in a task shrink before the last step; only a conversation's own text, which is
one output value, comes together.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn.  In role and text
``&``, ``<`` and ``[`` (where a control string could begin), and in the role also the
line end, become character entities, which ``unescaped`` turns back.  The loss mask has
an entry a turn: the length of the turn's block, and where in it, and how long, the text
under the loss is (length 0 but for assistant turns).

Defined cases: a null text or role is empty; a null sequence number comes first; equal
(turn, seq) events are taken in order of role, kind and text; a null turn comes first;
a null kind is a delta; a null conversation is one; an empty log gives no rows; other
columns are not read.
"""

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window as W, functions as F

START, END = "<|im_start|>", "<|im_end|>\n"
#: Character to entity, in the order of escaping; undone in the reverse order.
ENTITIES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
LINE_END = ("\n", "&#10;")
#: Turns of a block.
BLOCK = 256
LOSS_ROLE = "assistant"


def escaped(text: Column, role: bool = False) -> Column:
    for plain, entity in (*ENTITIES, LINE_END) if role else ENTITIES:
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def unescaped(text: Column) -> Column:
    for plain, entity in reversed((*ENTITIES, LINE_END)):
        text = F.replace(text, F.lit(entity), F.lit(plain))
    return text


def folded(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, block, turn, copy, role, text) of a log (conv_id, seq, turn, role, kind, text)."""
    copy = F.col("copy") if "copy" in events.columns else F.lit(0).alias("copy")
    e = events.select(
        "conv_id", "turn", copy, "seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("kind", F.lit("delta")).alias("kind"), F.coalesce("text", F.lit("")).alias("text")
    )
    e = e.withColumn("block", F.floor(F.col("turn") / BLOCK))
    begins = F.col("kind").isin("edit", "regenerate")
    turns = e.groupBy("conv_id", "block", "turn", "copy").agg(
        F.sort_array(F.collect_list(F.struct("seq", "role", "kind", "text"))).alias("log"), F.max(F.when(begins, F.col("seq"))).alias("reset")
    )
    # running maximum of resets over earlier turns, in two levels
    blocks = turns.groupBy("conv_id", "block").agg(F.max("reset").alias("most"))
    before = W.partitionBy("conv_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.max("most").over(before).alias("earlier"))
    # in decimals, where the least turn has a number before it
    here = W.partitionBy("conv_id", "block").orderBy(F.col("turn").cast("decimal(20,0)")).rangeBetween(W.unboundedPreceding, -1)
    cut = turns.join(blocks, turns.conv_id.eqNullSafe(blocks.c) & turns.block.eqNullSafe(blocks.b)).withColumn(
        "after", F.greatest(F.max("reset").over(here), "earlier")
    )
    kept = F.filter("log", lambda x: (F.col("reset").isNull() | (x.seq >= F.col("reset"))) & (F.col("after").isNull() | (x.seq > F.col("after"))))
    kept = cut.select("conv_id", "block", "turn", "copy", kept.alias("log")).where(F.size("log") > 0)
    return kept.select("conv_id", "block", "turn", "copy", F.element_at("log", 1).role.alias("role"), F.array_join(F.transform("log", lambda x: x.text), "").alias("text"))


def rendered(messages: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) of messages (conv_id, block, turn, copy, role, text)."""
    head = F.concat(F.lit(START), escaped(F.col("role"), role=True), F.lit("\n"))
    body = escaped(F.col("text"))
    under = F.when(F.col("role") == LOSS_ROLE, F.length("body")).otherwise(0).cast("long")
    m = messages.withColumns({"head": head, "body": body})
    m = m.select(
        "conv_id",
        "block",
        F.struct(
            "turn",
            "copy",
            F.concat("head", "body", F.lit(END)).alias("shown"),
            F.struct(
                (F.length("head") + F.length("body") + len(END)).cast("long").alias("chars"), F.length("head").cast("long").alias("loss_start"), under.alias("loss_chars")
            ).alias("mask"),
        ).alias("m"),
    )
    blocks = m.groupBy("conv_id", "block").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    blocks = blocks.select(
        "conv_id", F.struct("block", F.array_join(F.transform("ms", lambda x: x.shown), "").alias("shown"), F.transform("ms", lambda x: x.mask).alias("masks")).alias("b")
    )
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list("b")).alias("bs"))
    return whole.select(
        "conv_id", F.array_join(F.transform("bs", lambda x: x.shown), "").alias("formatted"), F.flatten(F.transform("bs", lambda x: x.masks)).alias("loss_mask")
    )


def as_log(messages: DataFrame) -> DataFrame:
    """The event log of finished messages (conv_id, turn, copy, role, text), as an editor would have written it.

    Every message is begun with a draft and then written anew, by an edit in odd turns and a
    regeneration in others, its text in two deltas; and a draft of the next turn, said before
    that, is to go with it.  Folding the log gives the messages again.
    """
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    first, second = F.substr(text, F.lit(1), half), F.substr(text, half + 1)
    odd = F.coalesce(F.pmod(F.col("turn"), F.lit(2)) == 1, F.lit(False))
    # eight numbers a turn, in order of turns; a null turn comes before all
    base = F.coalesce(F.col("turn").cast("decimal(20,0)") * 8, F.lit(Decimal(-(1 << 67))))
    written = [  # (number, kind, text) in no order
        (4, F.lit("delta"), second),
        (0, F.lit("delta"), F.reverse(F.substr(text, F.lit(1), F.lit(8)))),
        (2, F.when(odd, "edit").otherwise("regenerate"), F.when(odd, first).otherwise("")),
        (3, F.lit("delta"), F.when(odd, "").otherwise(first)),
    ]
    same, after = (F.col("turn"), F.col("copy").cast("int")), (F.try_add(F.col("turn"), F.lit(1)), F.lit(-1))
    event = lambda at, n, kind, said: F.struct(at[0].alias("turn"), at[1].alias("copy"), (base + n).cast("decimal(24,0)").alias("seq"), kind.alias("kind"), said.alias("text"))
    events = F.array(*[event(same, *x) for x in written], event(after, 1, F.lit("delta"), F.lit("superseded")))
    log = messages.select("conv_id", "role", F.explode(events).alias("e")).select("conv_id", "role", "e.*")
    return log.where("turn is not null or copy <> -1")


def format_chats(events: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_mask) for each conversation of the log."""
    return rendered(folded(events))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text, formatted): turns (role, text) parsed from the output, and the text its mask marks."""
    parts = formatted.withColumn("parts", F.slice(F.split("formatted", r"<\|im_end\|>\n"), 1, F.size("loss_mask")))

    def turn(x: Column) -> Column:
        inner = F.substr(x, F.lit(len(START) + 1))
        at = F.instr(inner, "\n")
        return F.struct(unescaped(F.substr(inner, F.lit(1), at - 1)).alias("role"), unescaped(F.substr(inner, at + 1)).alias("text"))

    marked = F.zip_with("parts", "loss_mask", lambda x, k: F.substr(x, (k.loss_start + 1).cast("int"), k.loss_chars.cast("int")))
    return parts.select("conv_id", F.transform("parts", turn).alias("turns"), unescaped(F.array_join(marked, "")).alias("loss_text"), "formatted")
