"""Chat formatting by perspective rotation.

For every participant of a conversation the whole dialogue is rendered with
that speaker as the assistant and every other one as a named user; system
turns stay system turns.  The result has one row per perspective and turn with
the rendered segment, its place in the rendered dialogue, and the range to
train on (the assistant's own words and its end mark), so a long conversation
never has to meet in one row or one task.

Cases: a null speaker is the participant ``unknown``; a null text is empty;
null turns come first; turns with the same number are ordered by speaker and
text, and repeated rows are repeated turns; texts of any length stay whole; a conversation of system turns only
has no participant and gives nothing; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Turns counted together before blocks are summed, and characters of a text by which turns of one number are
#: parted: both keep a long conversation out of one task, whatever its numbers.
BLOCK_TURNS, PART_CHARS = 256, 8
SYSTEM = "system"
END = "<|end|>\n"


def rotate_perspectives(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``perspective``, ``position``, ``speaker``, ``chat_role``, ``name``, ``rendered``, ``char_start``, ``train_start``, ``train_end``.

    Positions and character places count from 0; ``train_*`` are null where
    nothing is trained on.
    """
    said = turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    # Ranges of turns, cut into parts that keep the order: turns of one number are parted by speaker and opening.
    said = said.withColumns({"block": F.coalesce(F.floor(F.col("turn") / BLOCK_TURNS), F.lit(-(2**62))), "part": F.struct("turn", "speaker", F.substring("text", 1, PART_CHARS).alias("opening"))})
    people = said.where(F.col("speaker") != SYSTEM).select(F.col("conv").alias("c"), F.col("speaker").alias("perspective")).distinct()
    faced = said.join(people, F.col("conv").eqNullSafe(F.col("c"))).drop("c")
    role = F.when(F.col("speaker") == SYSTEM, SYSTEM).when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit("<|"), role, F.coalesce(F.concat(F.lit(" name="), name), F.lit("")), F.lit("|>\n"))
    shaped = faced.withColumns({"chat_role": role, "name": name, "head": head}).withColumn("rendered", F.concat("head", "text", F.lit(END)))

    # Places within a part, then the sums of the parts before it in the block, and of the blocks before that.
    view = ["conv", "perspective"]
    inside = Window.partitionBy(*view, "block", "part").orderBy("text").rowsBetween(Window.unboundedPreceding, 0)
    placed = shaped.withColumns({"nth": F.row_number().over(inside).cast("long"), "upto": F.sum(F.length("rendered")).over(inside)})
    parts = shaped.groupBy(*view, "block", "part").agg(F.count("*").alias("n"), F.sum(F.length("rendered")).alias("chars"))
    blocks = parts.groupBy(*view, "block").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))
    so_far = lambda column, line: F.coalesce(F.sum(column).over(line.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    by_block, by_part = Window.partitionBy(*view).orderBy("block"), Window.partitionBy(*view, "block").orderBy("part")
    ahead = blocks.select(F.col("conv").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), so_far("n", by_block).alias("n1"), so_far("chars", by_block).alias("c1"))
    within = parts.select(*view, "block", "part", so_far("n", by_part).alias("n2"), so_far("chars", by_part).alias("c2"))
    sums = within.join(ahead, F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")))
    sums = sums.select("c", "p", "b", F.col("part").alias("q"), (F.col("n1") + F.col("n2")).alias("n0"), (F.col("c1") + F.col("c2")).alias("c0"))
    whole = placed.join(sums, F.col("conv").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("block") == F.col("b")) & F.col("part").eqNullSafe(F.col("q")))
    start = F.col("c0") + F.col("upto") - F.length("rendered")
    mine = F.col("chat_role") == "assistant"
    return whole.select(
        "conv",
        "perspective",
        (F.col("n0") + F.col("nth") - 1).alias("position"),
        "speaker",
        "chat_role",
        "name",
        "rendered",
        start.alias("char_start"),
        F.when(mine, start + F.length("head")).alias("train_start"),
        F.when(mine, start + F.length("rendered")).alias("train_end"),
    )
