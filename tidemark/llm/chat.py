"""Perspective rotation of dialogues, in DataFrame functions only.

For every participant of a dialogue the whole dialogue is rendered with that speaker as the assistant and all others as named users. The
rendering is kept as its segments, one row per turn, with their places in the rendered text, so that no dialogue is ever gathered: segments
in order of `start`, joined, are the text. The mask of a segment is the span that a model learns: what the assistant says and the end mark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that speak in every rendering but have no perspective of their own.
CONTEXT = ("system",)
UNNAMED = "unknown"
END = "<|end|>"
#: Turns summed in one window; longer dialogues add the sums of their blocks.
BLOCK = 4096


def safe(text: Column) -> Column:
    """Text that can't be read as a mark: `<|` gets a backslash between its signs."""
    return F.replace(text, F.lit("<|"), F.lit("<\\|"))


def rotated(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", speaker: str = "role", text: str = "text",
            context: tuple[str, ...] = CONTEXT, block: int = BLOCK) -> DataFrame:
    """One row per dialogue, participant and turn: conv_id, assistant, turn, speaker, segment, start, mask_start, mask_end.

    Participants are told apart by their names as given. They are shown with blanks and the signs `<>|#` as underscores; of participants of a
    dialogue that would then look alike, those after the first in order of their names get a number, `#2` and so on. Places count code points from the start of the rendering; the mask is null in others' turns. Turns go by number, null first, then by
    speaker and text; repeated rows are rendered repeatedly. A null speaker is the participant `unknown`, a null text is empty, null
    dialogue ids are one dialogue. A dialogue whose turns are all context has no participant and gives no row. Other columns are ignored.
    """
    name = F.coalesce(F.col(speaker).cast("string"), F.lit(UNNAMED))
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), name.alias("_name"),
                        safe(F.coalesce(F.col(text), F.lit(""))).alias("content"))
    names = rows.select("conv_id", "_name").distinct().withColumn("_shown", F.regexp_replace("_name", r"[<>|#\s]", "_"))
    # a context role keeps its name; its like among the participants is numbered after it
    first = F.when(F.col("_name").isin(*context), F.lit(0)).otherwise(1)
    alike = F.row_number().over(Window.partitionBy("conv_id", "_shown").orderBy(first, "_name"))
    names = names.select(F.col("conv_id").alias("of"), F.col("_name").alias("_of"), F.concat(
        "_shown", F.when(alike > 1, F.concat(F.lit("#"), alike.cast("string"))).otherwise(F.lit(""))).alias("speaker"))
    people = names.where(~F.col("_of").isin(*context)).select("of", F.col("speaker").alias("assistant"))
    rows = rows.join(names, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("_name") == F.col("_of"))).drop("of", "_of", "_name")
    joined = rows.join(people, F.col("conv_id").eqNullSafe(F.col("of"))).drop("of")
    own = F.col("speaker") == F.col("assistant")
    head = (F.when(own, F.lit("<|assistant|>\n")).when(F.col("speaker").isin(*context), F.concat(F.lit("<|"), "speaker", F.lit("|>\n")))
            .otherwise(F.concat(F.lit("<|user name="), "speaker", F.lit("|>\n"))))
    shown = joined.select("conv_id", "assistant", "turn", "speaker", "content", head.alias("head")).withColumn(
        "size", F.length("head") + F.length("content") + len(END) + 1)
    shown = shown.withColumn("block", F.floor(F.col("turn") / block))
    sums = shown.groupBy("conv_id", "assistant", "block").agg(F.sum("size").alias("in_block"))
    before = Window.partitionBy("conv_id", "assistant").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("conv_id").alias("c"), F.col("assistant").alias("a"), F.col("block").alias("b"),
                          F.coalesce(F.sum("in_block").over(before), F.lit(0)).alias("offset"))
    within = Window.partitionBy("conv_id", "assistant", "block").orderBy("turn", "speaker", "content").rowsBetween(Window.unboundedPreceding, -1)
    placed = shown.withColumn("local", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("assistant") == F.col("a")) & F.col("block").eqNullSafe(F.col("b")))
    start = F.col("offset") + F.col("local")
    mask = start + F.length("head")
    return placed.select(
        "conv_id", "assistant", "turn", "speaker", F.concat("head", "content", F.lit(END + "\n")).alias("segment"), start.alias("start"),
        F.when(own, mask).alias("mask_start"), F.when(own, mask + F.length("content") + len(END)).alias("mask_end"))
