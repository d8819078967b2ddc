"""Multi-party perspective rotation of conversations.

For every participant of a conversation the dialogue is rendered with this participant as the assistant
and the others as named users. The rendering is written in pieces, one for each turn, with the piece's
place in the whole: pieces of a perspective in order of ``position`` are the whole text. A conversation may
hold a large share of all turns, so nothing gathers one: places come from a global sort by range and from
sums per range, never from a window over a conversation.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldwise.session import settle

CONTEXT = ("system",)


def rotate(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", speaker_col: str = "role", text_col: str = "text", context: tuple[str, ...] = CONTEXT,
) -> DataFrame:
    """(conv_id, perspective, position, turn, speaker, role, name, piece, char_start, char_end, mask_start, mask_end, trained).

    ``mask_start`` to ``mask_end`` is what the perspective's speaker says, as characters of the whole
    rendering; other pieces have an empty mask and ``trained`` false. Speakers in ``context`` keep their
    role and are no perspective; a null speaker is the user "unknown". A null text is empty. Turns sort by
    number (null first), then speaker and text; equal turns are written each. Rows with a null
    conversation form one conversation; one whose speakers are all context has no rendering.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(speaker_col), F.lit("unknown")).alias("speaker"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    people = rows.filter(~F.col("speaker").isin(*context)).select(F.col("conv_id").alias("__conv"), F.col("speaker").alias("perspective")).distinct()
    both = rows.join(people, rows["conv_id"].eqNullSafe(people["__conv"])).drop("__conv")
    role = (
        F.when(F.col("speaker") == F.col("perspective"), "assistant").when(F.col("speaker").isin(*context), F.col("speaker")).otherwise("user")
    )
    head = F.concat(F.lit("<|"), F.col("role"), F.when(F.col("role") == "user", F.concat(F.lit(" name="), F.col("speaker"))).otherwise(""), F.lit("|>\n"))
    pieces = (
        both.withColumn("role", role)
        .withColumn("name", F.when(F.col("role") == "user", F.col("speaker")))
        .withColumn("head", F.length(head))
        .withColumn("piece", F.concat(head, F.col("text"), F.lit("\n")))
        .withColumn("__row", F.monotonically_increasing_id())
    )
    order = ["conv_id", "perspective", "turn", "speaker", "text", "__row"]
    ranges = settle(pieces.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()))
    inside = Window.partitionBy("__range", "conv_id", "perspective").orderBy("turn", "speaker", "text", "__row")
    sums = ranges.groupBy("conv_id", "perspective", "__range").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("piece")).alias("size"))
    # One row for each range that a perspective touches: the number of ranges bounds the window.
    earlier = Window.partitionBy("conv_id", "perspective").orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(
        F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("__range").alias("r"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n_before"), F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("size_before"),
    )
    placed = ranges.withColumn("n", F.row_number().over(inside)).withColumn("size", F.sum(F.length("piece")).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    joined = placed.join(
        before.filter("n_before > 0"),
        F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & (F.col("__range") == F.col("r")), "left",
    )
    end = F.coalesce(F.col("size_before"), F.lit(0)) + F.col("size")
    start = end - F.length("piece")
    own = F.col("role") == "assistant"
    return joined.select(
        "conv_id", "perspective", (F.coalesce(F.col("n_before"), F.lit(0)) + F.col("n")).alias("position"), "turn", "speaker", "role", "name", "piece",
        start.alias("char_start"), end.alias("char_end"),
        F.when(own, start + F.col("head")).otherwise(start).alias("mask_start"), F.when(own, end).otherwise(start).alias("mask_end"), own.alias("trained"),
    )
