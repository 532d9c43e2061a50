"""Chat formatting into budgeted windows, with DataFrame functions only.

Turns are marked as ``<|im_start|>role\\ntext<|im_end|>\\n``. Inside texts and roles ``&`` becomes ``&amp;`` and ``<|``
becomes ``&lt;|``, so that no control string of a text survives and the change can be undone; line ends in roles become ``&#10;``.

Prefix sums of turn tokens cut a conversation into windows of whole turns. A window begins with the system turn, if the
conversation opens with one, then repeats turns that end the window before, then has its own turns. What system turn
and repeated history may take is set aside from the budget first; half of the rest is the width of a cell of the
prefix sums. The turns that begin in a cell form a window, the last of them at most as long as a cell; a turn that is
longer and crosses the end of its cell is a window of its own. So own turns never take more than two cells, and no
window of several own turns exceeds the budget. History is repeated as far as the budget leaves room; a single turn
that is longer than what the system turn leaves of the budget has none, and its window alone is larger. The loss mask covers
the texts of the window's own assistant turns; repeated turns are masked.

A very long conversation is spread over tasks: prefix sums and windows restart every 1,024 turn numbers, history and
system turn are handed on from part to part. Rows of one turn number that are more than that are split
further by a hash of role and text, all but equal rows. Texts are shuffled once, by part.

Defined results: null texts and roles are empty; rows without turn number come first; rows with equal turn numbers are
ordered by a hash of role and text, and repeated rows all stay. Rows without conversation form one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import BROADCAST_KEYS, saved, words_by_space

START, END = "<|im_start|>", "<|im_end|>\n"
#: Turn numbers in a part of a conversation, and rows from which a turn number is split.
BLOCK = 1024


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("&#10;"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("&#10;"), F.lit("\n")))


#: What tells the parts of a conversation apart, in their order; all columns are without nulls, so that equal keys stay together in one shuffle.
CONV, PART = ("_conv", "_none"), ("_block", "_turn", "_sub")


def _in_parts(rows: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns with the keys of their conversation and part."""
    keys = rows.select(F.col(conv).alias("_conv"), F.col(conv).isNull().alias("_none"), F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("_n"))
    per_turn = keys.groupBy("_conv", "_none", "_n").count().where(F.col("count") > BLOCK)
    crowded = saved(per_turn.select(F.col("_conv").alias("c"), F.col("_none").alias("e"), F.col("_n").alias("n"), F.ceil(F.col("count") / BLOCK).alias("k")))
    turns = rows.select(
        F.col(conv).alias("_conv"), F.col(conv).isNull().alias("_none"), F.coalesce(F.col(turn).cast("long"), F.lit(-(1 << 62))).alias("_n"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    turns = turns.withColumns({"_h": F.shiftrightunsigned(F.xxhash64("role", "text"), 1), "_block": F.floor(F.col("_n") / BLOCK), "_turn": F.lit(0).cast("long"), "_sub": F.lit(0).cast("long")})
    few = crowded.count()
    if few:  # turn numbers with very many rows: a part for each range of hashes, in a place of its own among the turns of the block
        side = F.broadcast(crowded) if few <= BROADCAST_KEYS else crowded
        turns = turns.join(side, F.col("_conv").eqNullSafe(F.col("c")) & (F.col("_none") == F.col("e")) & (F.col("_n") == F.col("n")), "left")
        split = F.floor(F.col("_h") / F.lit(float(1 << 63)) * F.col("_k"))
        blocks = crowded.select("c", "e", F.col("n").alias("cn"), F.floor(F.col("n") / BLOCK).alias("cb")).groupBy("c", "e", "cb").agg(F.array_sort(F.collect_set("cn")).alias("cuts"))
        turns = turns.drop("c", "e", "n").withColumnRenamed("k", "_k")
        turns = turns.join(F.broadcast(blocks) if few <= BROADCAST_KEYS else blocks, F.col("_conv").eqNullSafe(F.col("c")) & (F.col("_none") == F.col("e")) & (F.col("_block") == F.col("cb")), "left")
        before = F.coalesce(F.size(F.filter("cuts", lambda x: x < F.col("_n"))), F.lit(0))
        own = F.col("_k").isNotNull().cast("long")
        turns = turns.withColumns({"_turn": (2 * F.greatest(before, F.lit(0)) + own).cast("long"), "_sub": F.coalesce(F.when(F.col("_k").isNotNull(), split), F.lit(0)).cast("long")}).drop("c", "e", "cb", "cuts", "_k")
    kind = turns.schema["_conv"].dataType
    return turns.withColumn("_conv", F.coalesce("_conv", F.lit("").cast(kind) if isinstance(kind, StringType) else F.lit(0).cast(kind)))


def format_windows(rows: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = 512, history: int = 128, learn: str = "assistant", system: str = "system") -> DataFrame:
    """(conv, part, window, formatted, turns) with turns an array of (own, loss, start, length) in code points of formatted.

    Windows follow each other by part, then window. ``start`` and ``length`` are the place of the turn's text; loss is
    true where the mask has it. A turn counts its words and 4 tokens.
    """
    keys = [*CONV, *PART]
    turns = _in_parts(rows, conv, turn, role, text).withColumn("tokens", F.size(words_by_space(F.col("text"))) + F.lit(4))
    order = ("_n", "_h", "role", "text")
    # one row for each part: what opens the conversation, and the part that follows
    parts = turns.groupBy(*keys).agg(F.min(F.struct("_n", "_h", "role", "tokens")).alias("first"))
    along = Window.partitionBy(*CONV).orderBy(*PART)
    opens = F.first("first").over(along)
    parts = parts.select(
        *keys, F.when(opens["role"] == system, opens["tokens"]).otherwise(F.lit(0)).alias("system"), (F.row_number().over(along) == 1).alias("opening"),
        F.lead(F.struct(*PART)).over(along).alias("then"),
    )
    part = Window.partitionBy(*keys)
    cell = F.greatest(F.floor((F.lit(budget - history) - F.col("system")) / 2), F.lit(1))
    turns = turns.join(parts, keys).withColumn("pos", F.row_number().over(part.orderBy(*order))).withColumn("leads", F.col("opening") & (F.col("pos") == 1) & (F.col("system") > 0))
    counted = F.when(F.col("leads"), F.lit(0)).otherwise(F.col("tokens"))
    turns = turns.withColumn("at", F.sum(counted).over(part.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)) - counted)
    alone = (counted > cell) & (F.floor((F.col("at") + counted - 1) / cell) > F.floor(F.col("at") / cell))
    turns = turns.withColumn("window", 2 * F.floor(F.col("at") / cell) + alone.cast("long"))
    turns = turns.withColumns({"own": F.sum(counted).over(part.orderBy("window").rangeBetween(0, 0)), "left": F.sum(counted).over(Window.partitionBy(*keys, "window").orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, 0))})
    turns = turns.withColumn("next", F.min(F.struct("window", "own")).over(part.orderBy(F.col("window").desc()).rangeBetween(Window.unboundedPreceding, -1)))
    room = lambda own: F.least(F.lit(history), F.lit(budget) - F.col("system") - own)
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    said = lambda rank, own: F.struct(F.lit(rank).alias("rank"), "pos", F.lit(own).alias("own"), (F.lit(own) & (F.col("role") == learn)).alias("loss"), head.alias("head"), escape(F.col("text")).alias("text"))
    again = F.col("next").isNotNull() & ~F.col("leads") & (F.col("left") <= room(F.col("next.own")))
    placed = turns.select(*keys, F.explode(F.array_compact(F.array(F.struct("window", said(2, True).alias("x")), F.when(again, F.struct(F.col("next.window").alias("window"), said(2, False).alias("x")))))).alias("y"))
    windows = placed.groupBy(*keys, F.col("y.window").alias("window")).agg(F.array_sort(F.collect_list("y.x")).alias("xs"))
    # the system turn in all windows but its own, and history that crosses from part to part
    spans = turns.groupBy(*keys).agg(F.min(F.struct("window", "own")).alias("start"), F.collect_set("window").alias("all"))
    lead = turns.where("leads").select(*CONV, F.struct(*PART).alias("home_part"), F.col("window").alias("home"), said(0, False).alias("x"))
    everywhere = spans.select(*keys, F.explode("all").alias("window")).join(lead, list(CONV)).where(~((F.struct(*PART) == F.col("home_part")) & (F.col("window") == F.col("home"))))
    tails = turns.where(F.col("next").isNull() & F.col("then").isNotNull() & ~F.col("leads") & (F.col("left") <= history))
    tails = tails.select(*CONV, *[F.col(f"then.{c}").alias(c) for c in PART], "left", "system", said(1, False).alias("x")).join(spans, keys).where(F.col("left") <= room(F.col("start.own")))
    more = everywhere.select(*keys, "window", "x").unionByName(tails.select(*keys, F.col("start.window").alias("window"), "x"))
    more = more.groupBy(*keys).agg(F.collect_list(F.struct("window", "x")).alias("more"))
    joined = windows.join(more, keys, "left")
    others = F.transform(F.filter("more", lambda m: m["window"] == F.col("window")), lambda m: m["x"])
    joined = joined.withColumn("xs", F.when(F.col("more").isNull(), F.col("xs")).otherwise(F.array_sort(F.concat(others, "xs"))))
    formatted = F.concat_ws("", F.transform("xs", lambda x: F.concat(x["head"], x["text"], F.lit(END))))
    marks = F.aggregate(
        "xs",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<own:boolean,loss:boolean,start:int,length:int>>").alias("all")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["head"]) + F.length(x["text"]) + F.lit(len(END))).alias("at"),
            F.concat(s["all"], F.array(F.struct(x["own"].alias("own"), x["loss"].alias("loss"), (s["at"] + F.length(x["head"])).alias("start"), F.length(x["text"]).alias("length")))).alias("all"),
        ),
        lambda s: s["all"],
    )
    return joined.select(F.when(~F.col("_none"), F.col("_conv")).alias(conv), F.struct(*PART).alias("part"), "window", formatted.alias("formatted"), marks.alias("turns"))


def read_turns(windows: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """(conv, part, window, said, chars) of each window, read from its formatted text and its mask.

    ``said`` has (role, text, learned, other) of each of the window's own turns: learned is true where the mask covers it, and
    ``other`` is the text under the mask where that differs from the turn's text.
    """
    parts = F.split("formatted", "<\\|im_end\\|>\n")
    both = F.arrays_zip(F.slice(parts, 1, F.size("turns")).alias("part"), F.col("turns").alias("turn"))
    body = lambda x: F.substring(x["part"], F.lit(len(START) + 1), F.length(x["part"]))
    own = F.transform(F.filter(both, lambda x: x["turn"]["own"]), lambda x: _said(body(x), F.when(x["turn"]["loss"], F.substring(F.col("formatted"), x["turn"]["start"] + 1, x["turn"]["length"]))))
    return windows.select(F.col(conv).alias("conv"), "part", "window", own.alias("said"), F.length("formatted").alias("chars"))


def _said(body: Column, masked: Column) -> Column:
    """(role, text, learned, other) from role, line end, text; roles have no line end of their own there."""
    cut = F.instr(body, F.lit("\n"))
    text = F.substring(body, cut + 1, F.length(body))
    return F.struct(
        unescape_role(F.substring(body, F.lit(1), cut - 1)).alias("role"), unescape(text).alias("text"), masked.isNotNull().alias("learned"), F.when(masked != text, unescape(masked)).alias("other"),
    )


def conversation_digest(windows: DataFrame, *, conv: str = "conv_id") -> DataFrame:
    """One row for each conversation: turns, hashes and lengths of what its windows give back."""
    read = read_turns(windows, conv=conv)
    got = read.groupBy("conv").agg(F.array_sort(F.collect_list(F.struct("part", "window", "said"))).alias("ws"), F.sum(F.size("said")).cast("long").alias("n_turns"), F.sum("chars").cast("long").alias("formatted_chars"))
    turns = got.withColumn("turns", F.flatten(F.transform("ws", lambda w: w["said"])))
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    learned = F.concat_ws("", F.transform(F.filter("turns", lambda t: t["learned"]), lambda t: F.coalesce(t["other"], t["text"])))
    return turns.select(
        F.col("conv").alias(conv), "n_turns", F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"), F.sha2(learned.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )
