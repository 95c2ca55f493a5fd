"""Chat formatting: the dialogue from the perspective of each participant, with loss masks.

For every participant of a conversation the whole dialogue is rendered with that speaker as `assistant`,
system turns as `system`, and the other speakers as `user` under their names. A mask is a list of
character spans [start, end) of the rendered dialogue that the assistant is to learn: its own texts and
their end marks.

All of it is DataFrame functions. A dialogue comes in parts of at most `part_turns` turns, each with its
offset in the dialogue, so that no conversation, however long, has to fit into one row or task: turns are
numbered in two steps (turns in blocks, blocks in the conversation), and identical turns are counted
before any shuffle and unfolded after it.

Defined results: turns are ordered by turn (null last), then by a hash of role and text, then role and
text; identical rows are rendered as often as they occur; a null text is rendered empty; a null or empty
role speaks as `unknown` or `%empty`; a null conv_id is a conversation of its own; a conversation of system turns only
has no participant and no row; an empty table gives no rows; extra columns are ignored. Participants are
told apart by their role as it is; names are escaped so that none can end its header and no two are alike
(`Ann Lee` shows as `Ann%20Lee`); marks inside texts are broken by a zero-width space.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PART_TURNS = 256
SYSTEM, UNKNOWN = "system", "unknown"
START, END = "<|im_start|>", "<|im_end|>"
BLOCK = 512  # turn numbers in a block
SLOTS = 256  # blocks of turns that share one number


def _clean(text: Column) -> Column:
    broken = F.replace(text, F.lit("<|im_"), F.lit("<​|im_"))
    return F.coalesce(broken, F.lit(""))


# What a name may not hold in a header, and the sign that tells it is written otherwise.
_ESCAPED = {"%": "%25", " ": "%20", "\t": "%09", "\n": "%0A", "\x0b": "%0B", "\x0c": "%0C", "\r": "%0D", "|": "%7C", "<": "%3C", ">": "%3E"}


def _speaker(role: Column) -> Column:
    """The name of a role in headers; different roles have different names."""
    name = role
    for sign, code in _ESCAPED.items():
        name = F.replace(name, F.lit(sign), F.lit(code))
    return (
        F.when(role.isNull(), UNKNOWN)
        .when(role == UNKNOWN, "%75nknown")
        .when(role == "", "%empty")
        .when(F.trim(role) == SYSTEM, SYSTEM)
        .otherwise(name)
    )


def header(speaker: Column, perspective: Column) -> Column:
    return F.concat(
        F.lit(START),
        F.when(speaker == SYSTEM, F.lit(SYSTEM))
        .when(speaker == perspective, F.lit("assistant"))
        .otherwise(F.concat(F.lit("user name="), speaker)),
        F.lit("\n"),
    )


def numbered(conversations: DataFrame) -> DataFrame:
    """conv_id, speaker, text, times (identical rows) and first, the number of turns before them."""
    unique = (
        conversations.select("conv_id", "turn", "role", "text")
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.count("*").alias("times"))
        .withColumn("hash", F.xxhash64("role", "text"))
        .withColumn("block", F.floor(F.col("turn") / BLOCK))
        .withColumn("slot", F.shiftrightunsigned("hash", 56))
    )
    key = ["conv_id", "turn_block", "turn_key", "slot_key"]
    # Turns of a block are in order by number, so a slot may only divide one number: blocks that hold more
    # rows than numbers are told apart by number and slot.
    sizes = unique.groupBy("conv_id", "block").agg(F.count("*").alias("rows"))
    dense = sizes.filter(F.col("rows") > BLOCK).select(F.col("conv_id").alias("c"), F.col("block").alias("b"), F.lit(True).alias("dense"))
    placed = unique.join(dense, F.col("conv_id").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")), "left").select(
        "conv_id", "turn", "role", "text", "times", "hash",
        F.col("block").alias("turn_block"),
        F.when(F.col("dense"), F.col("turn")).alias("turn_key"),
        F.when(F.col("dense"), F.col("slot")).alias("slot_key"),
    )
    order = [F.col("turn_block").asc_nulls_last(), F.col("turn_key").asc_nulls_last(), F.col("slot_key").asc_nulls_last()]
    before = W.partitionBy("conv_id").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    sums = placed.groupBy(*key).agg(F.sum("times").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = sums.select(*(F.col(k).alias(f"s_{k}") for k in key), "base")
    based = placed.join(sums, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in key])
    inside = (
        W.partitionBy(*key)
        .orderBy(F.col("turn").asc_nulls_last(), "hash", F.col("role").asc_nulls_last(), F.col("text").asc_nulls_last())
        .rowsBetween(W.unboundedPreceding, -1)
    )
    return based.select(
        "conv_id",
        _speaker(F.col("role")).alias("speaker"),
        _clean(F.col("text")).alias("text"),
        "times",
        (F.col("base") + F.coalesce(F.sum("times").over(inside), F.lit(0))).alias("first"),
    )


def perspectives(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """One row for each conversation, participant and part: rendered text, its offset, turns, mask."""
    turns = numbered(conversations)
    unfolded = turns.select("conv_id", "speaker", "text", F.explode(F.sequence("first", F.expr("first + times - 1"))).alias("seq"))
    people = unfolded.filter(F.col("speaker") != SYSTEM).groupBy("conv_id", "speaker").agg(F.lit(1).alias("one"))
    people = people.select(F.col("conv_id").alias("p_conv"), F.col("speaker").alias("perspective"))
    each = unfolded.join(people, F.col("conv_id").eqNullSafe(F.col("p_conv"))).withColumns(
        {
            "head": header(F.col("speaker"), F.col("perspective")),
            "own": F.col("speaker") == F.col("perspective"),
            "part": F.floor(F.col("seq") / part_turns),
        }
    )
    body = F.concat("head", "text", F.lit(END + "\n"))
    gathered = (
        each.groupBy("conv_id", "perspective", "part")
        .agg(F.array_sort(F.collect_list(F.struct("seq", body.alias("body"), F.length("head").alias("head_length"), "own"))).alias("turns"))
        .withColumn("rendered", F.array_join(F.col("turns.body"), ""))
        .withColumn("length", F.length("rendered").cast("long"))
    )
    ahead = W.partitionBy("conv_id", "perspective").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        each.groupBy("conv_id", "perspective", "part")
        .agg(F.sum(F.length(body)).cast("long").alias("length"))
        .withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0)).cast("long"))
        .select(F.col("conv_id").alias("o_conv"), F.col("perspective").alias("o_who"), F.col("part").alias("o_part"), "offset")
    )
    same = F.col("conv_id").eqNullSafe(F.col("o_conv")) & (F.col("perspective") == F.col("o_who")) & (F.col("part") == F.col("o_part"))
    start = F.struct(F.col("offset").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(done: Column, turn: Column) -> Column:
        end = done["at"] + F.length(turn["body"])
        span = F.struct((done["at"] + turn["head_length"]).alias("start"), (end - 1).alias("end"))
        spans = F.when(turn["own"], F.array_append(done["spans"], span)).otherwise(done["spans"])
        return F.struct(end.alias("at"), spans.alias("spans"))

    return gathered.join(offsets, same).select(
        "conv_id",
        "perspective",
        F.col("part").cast("long").alias("part"),
        F.size("turns").alias("n_turns"),
        F.col("offset"),
        "rendered",
        F.aggregate("turns", start, step)["spans"].alias("mask"),
    )
