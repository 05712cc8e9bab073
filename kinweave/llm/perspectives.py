"""Chat formatting by rotation of perspective.

For every participant of a conversation the dialogue is rendered with that speaker as the
assistant and all others as named users. Character spans mark what a model is trained on: the
content of the assistant's turns with its end marker. System turns belong to nobody: every rendering shows them as system
turns, and they are never trained on.

A rendering comes in parts, in the order of block and part: a block is `block` consecutive turn numbers, so a conversation that holds a large share
of all rows is many rows, each bounded. Laid end to end, the parts are the whole dialogue: `char_start` and `first_message` say where a part
begins in it, and the spans of the mask are counted from the dialogue's start. A block of more than `most` messages
(which only repeated turn numbers can cause) is cut on, along the same order.

Defined results: messages of one turn are in the order of a hash of role and text; repeats of a message are rendered as often as they occur, those
beyond each `most` after the turn's other messages. Null turns come first, in a block numbered null; a null or empty role is the
speaker `unknown`; a null text is empty. Null conversation ids form one conversation. An empty table gives an empty one.
A conversation of system turns alone has no participant and no row. Marker strings inside texts and names are
broken by a zero-width space, so that a text can't forge a turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
BLOCK, MOST = 256, 4096


def safe(text: Column) -> Column:
    return F.replace(text, F.lit("<|im_"), F.lit("<​|im_"))


def _same(*names: str) -> Column:
    """Equality with the columns of these names behind `_`, nulls being equal."""
    out = F.lit(True)
    for n in names:
        out = out & F.col(n).eqNullSafe(F.col(f"_{n}"))
    return out


def _keyed(df: DataFrame, *names: str) -> DataFrame:
    for n in names:
        df = df.withColumnRenamed(n, f"_{n}")
    return df


def _messages(turns: DataFrame, block: int, most: int, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, block, part, turn, lot, hash, role, text, k: each distinct message, k times in its place."""
    role = F.when(F.coalesce(F.col(role_col), F.lit("")) == "", F.lit("unknown")).otherwise(F.col(role_col))
    said = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = said.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    rows = rows.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(most)))))
    rows = rows.withColumns({"k": F.least(F.col("n") - F.col("lot") * most, F.lit(most)).cast("int"), "hash": F.md5(F.concat_ws("\n", "role", "text")), "block": F.floor(F.col("turn") / F.lit(block)).cast("long")})
    # where a block is too long, its parts follow the order: turn, lot, hash
    full = rows.groupBy("conv_id", "block").agg(F.sum("k").alias("total"), (F.max("lot") + 1).alias("lots")).where(F.col("total") > most)
    full = _keyed(full.withColumn("cuts", F.ceil(F.col("total") / F.lit(most)).cast("long")).drop("total"), "conv_id", "block")
    rows = rows.join(full, _same("conv_id", "block"), "left")
    slot = F.shiftright(F.conv(F.substring("hash", 1, 8), 16, 10).cast("long") * F.col("cuts"), 32)
    turn = F.coalesce(F.col("turn") - F.col("block") * block, F.lit(0))
    part = F.when(F.col("cuts").isNull(), F.lit(0)).otherwise((turn * F.col("lots") + F.col("lot")) * F.col("cuts") + slot).cast("long")
    return rows.select("conv_id", "block", part.alias("part"), "turn", "lot", "hash", "role", safe(F.col("text")).alias("text"), "k")


def _head(role: Column, speaker: Column) -> Column:
    name = F.when(role == speaker, F.lit("assistant")).when(role == "system", F.lit("system")).otherwise(F.concat(F.lit("user name="), safe(role)))
    return F.concat(F.lit(START), name, F.lit("\n"))


def rotate(turns: DataFrame, block: int = BLOCK, most: int = MOST, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """A row per conversation, part and participant: where the part begins, rendered text, mask spans and counts."""
    rows = _messages(turns, block, most, conv_col, turn_col, role_col, text_col)
    nobody = F.lit(None).cast("string")
    size = F.length(_head(F.col("role"), nobody)) + F.length("text") + len(END) + 1
    own = F.length(_head(F.col("role"), F.col("role"))) - F.length(_head(F.col("role"), nobody))  # how much shorter a speaker's own head is
    by_role = rows.groupBy("conv_id", "block", "part", "role").agg(F.sum("k").alias("said"), F.sum(size * F.col("k")).alias("chars"), F.first(own).alias("less"))
    parts = by_role.groupBy("conv_id", "block", "part").agg(F.sum("said").alias("n_messages"), F.sum("chars").alias("chars"))
    speakers = by_role.where("role <> 'system'").select("conv_id", F.col("role").alias("perspective")).distinct()
    spoken = _keyed(by_role.select("conv_id", "block", "part", F.col("role").alias("perspective"), (F.col("said") * F.col("less")).alias("less")), "conv_id", "block", "part", "perspective")
    grid = parts.join(_keyed(speakers, "conv_id"), _same("conv_id")).drop("_conv_id").join(spoken, _same("conv_id", "block", "part", "perspective"), "left")
    before = Window.partitionBy("conv_id", "perspective").orderBy(F.asc_nulls_first("block"), "part").rowsBetween(Window.unboundedPreceding, -1)
    chars = F.col("chars") + F.coalesce("less", F.lit(0))
    grid = grid.select("conv_id", "block", "part", "perspective", "n_messages", F.coalesce(F.sum("n_messages").over(before), F.lit(0)).alias("first_message"), F.coalesce(F.sum(chars).over(before), F.lit(0)).alias("char_start"))
    packed = rows.groupBy("conv_id", "block", "part").agg(F.sort_array(F.collect_list(F.struct("turn", "lot", "hash", "role", "text", "k"))).alias("sorted"))
    packed = packed.select("conv_id", "block", "part", F.flatten(F.transform("sorted", lambda m: F.array_repeat(F.struct(m["role"].alias("role"), m["text"].alias("text")), m["k"]))).alias("messages"))
    whole = grid.join(_keyed(packed, "conv_id", "block", "part"), _same("conv_id", "block", "part"))

    speaker = F.col("perspective")
    heads = F.transform("messages", lambda m: F.struct((m["role"] == speaker).alias("own"), _head(m["role"], speaker).alias("head"), F.concat(m["text"], F.lit(END)).alias("body")))
    whole = whole.withColumn("heads", heads)

    def mark(seen: Column, m: Column) -> Column:
        start = seen["at"] + F.length(m["head"])
        end = start + F.length(m["body"])
        span = F.array(F.array(start, end))
        return F.struct((end + 1).alias("at"), F.when(m["own"], F.concat(seen["spans"], span)).otherwise(seen["spans"]).alias("spans"))

    empty = F.struct(F.col("char_start").cast("long").alias("at"), F.array().cast("array<array<bigint>>").alias("spans"))
    whole = whole.withColumn("mask", F.aggregate("heads", empty, mark)["spans"])
    flat = F.array_join(F.transform("mask", lambda s: F.concat(s[0].cast("string"), F.lit("-"), s[1].cast("string"))), ",")
    return whole.select(
        "conv_id", "block", "part", "perspective", F.col("first_message").cast("long").alias("first_message"), F.col("char_start").cast("long").alias("char_start"), F.col("n_messages").cast("long").alias("n_messages"),
        F.size("mask").cast("long").alias("n_trained"), F.aggregate("mask", F.lit(0).cast("long"), lambda a, s: a + s[1] - s[0]).alias("trained_chars"),
        F.array_join(F.transform("heads", lambda m: F.concat(m["head"], m["body"], F.lit("\n"))), "").alias("rendered"), "mask", F.sha2(flat, 256).alias("mask_sha256"),
    )
