"""Multi-party perspective rotation of conversations, with DataFrame functions only.

For every participant the whole dialogue is rendered with that speaker as the assistant and all others
as named users; only the assistant's words carry loss. The result has one row per conversation, perspective
and turn, with the place of the segment in the rendering, so that no dialogue has to fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanforge.llm.common import join_heavy, saved

#: Speakers that take no perspective and stay what they are.
NARRATORS = ("system",)
#: Fixed value: the markers of a turn.
OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
#: What both markers start with, and how it is written inside a text or a name, so that no text can open or close a turn.
MARK, BROKEN = "<|im_", "<| im_"
#: Turns whose lengths are summed together before the sums are chained.
BLOCK = 256


def unmarked(text: Column) -> Column:
    return F.replace(text, F.lit(MARK), F.lit(BROKEN))


def heading(role: Column, name: Column) -> Column:
    return F.when(role == "user", F.concat(F.lit(OPEN + "user name="), F.translate(unmarked(name), "\n\r", "  "), F.lit("\n"))).otherwise(F.concat(F.lit(OPEN), role, F.lit("\n")))


def rotate(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", narrators: tuple[str, ...] = NARRATORS, block: int = BLOCK) -> DataFrame:
    """(conv, perspective, turn, role, speaker, segment, seg_start, seg_end, loss_start, loss_end).

    Places are code points of the whole rendering, ends exclusive; the loss span covers the words and the
    closing marker of the perspective's own turns and is empty elsewhere. A null speaker is named by the empty
    string, a null text is empty, markers inside a text or a name are broken by a space and line ends in a name become spaces, a null conversation is one of its own; turns with the same number are
    ordered by speaker, then text, and repeated rows stay repeated; null turns come first. A conversation of
    narrators only has no perspective; other columns are ignored.
    """
    rows = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("speaker"), F.coalesce(text_col, F.lit("")).alias("text"))
    # Joins skip null keys, so a conversation is named by a string.
    rows = rows.withColumn("key", F.coalesce(F.concat(F.lit("c"), F.col("conv").cast("string")), F.lit("null")))
    cast = rows.where(~F.col("speaker").isin(*narrators)).select("key", "speaker").distinct().groupBy("key").agg(F.collect_list("speaker").alias("cast"))
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    every = join_heavy(rows, cast, "key", sizes).withColumn("perspective", F.explode("cast")).drop("cast")
    own = F.col("speaker") == F.col("perspective")
    role = F.when(own, "assistant").when(F.col("speaker").isin(*narrators), F.col("speaker")).otherwise("user")
    every = every.withColumn("role", role).withColumn("head", heading(F.col("role"), F.col("speaker")))
    every = every.withColumn("segment", F.concat("head", unmarked(F.col("text")), F.lit(CLOSE))).withColumn("len", F.length("segment").cast("long")).withColumn("part", F.floor(F.coalesce(F.col("turn"), F.lit(-(1 << 40))) / block))
    group = ["key", "perspective"]
    totals = every.groupBy(*group, "part").agg(F.sum("len").alias("total"))
    before = totals.withColumn("before", F.coalesce(F.sum("total").over(Window.partitionBy(*group).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("total")
    inside = F.sum("len").over(Window.partitionBy(*group, "part").orderBy(F.col("turn").asc_nulls_first(), "speaker", "text").rowsBetween(Window.unboundedPreceding, 0))
    placed = every.withColumn("inside", inside).join(before, [*group, "part"])
    end = F.col("before") + F.col("inside")
    start = end - F.col("len")
    loss = F.when(F.col("role") == "assistant", start + F.length("head")).otherwise(end)
    return placed.select(F.col("conv").alias(conv_col), "perspective", F.col("turn").alias(turn_col), "role", "speaker", "segment", start.alias("seg_start"), end.alias("seg_end"), loss.alias("loss_start"), end.alias("loss_end"))


def assemble(rotated: DataFrame, *, conv_col: str = "conv_id") -> DataFrame:
    """One row per conversation and perspective: the rendering, and its loss spans in order.

    A rendering is one value of one row, so this is for conversations that fit a row; the rows of :func:`rotate` do not have to. Rows of null conversations are one
    conversation, repeated rows stand as often as given, an empty table gives an empty one.
    """
    part = F.sort_array(F.collect_list(F.struct("seg_start", "segment", "loss_start", "loss_end")))
    whole = saved(rotated).groupBy(conv_col, "perspective").agg(part.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["loss_start"] < x["loss_end"]), lambda x: F.struct(x["loss_start"].alias("start"), x["loss_end"].alias("end")))
    return whole.select(conv_col, "perspective", F.array_join(F.transform("p", lambda x: x["segment"]), "").alias("rendered"), spans.alias("loss"))
