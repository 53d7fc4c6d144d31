"""Conversation turns in order, numbered over all tasks, in blocks that no conversation makes longer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bookreplay.llm.common import cut

#: Rows of a block: 2 to this power.
BLOCK_BITS = 12
#: Characters of role and text that break ties of a turn; hashes of the whole break the rest.
TIE_CHARS = 64


def in_order(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of ``rows`` (null role or text: empty) with ``pos``, which rises with
    conv_id, then turn (null first), then role and text, and ``block``: at most 4,096 rows of a
    conversation that follow each other.

    Rows are dealt by ranges of these keys, so a conversation of any length, one whose turns are all
    equal, or one row repeated without end spreads over many tasks; a number is the task's place and the
    row's place in it. The table is written, so the numbers stay whatever executors are lost later."""
    cols = [F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn")]
    cols += [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    held = rows.select(*cols, F.monotonically_increasing_id().alias("_tie"))
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first()]
    keys += [F.substring(c, 1, TIE_CHARS).asc() for c in ("role", "text")] + [F.xxhash64("role", "text").asc(), F.col("_tie").asc()]
    dealt = held.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return cut(dealt.select("conv_id", "turn", "role", "text", F.monotonically_increasing_id().alias("pos")).withColumn("block", F.shiftright("pos", BLOCK_BITS)), "turns")


def blocks_of(turns: DataFrame) -> DataFrame:
    """conv_id, block, first_pos, n, and ``before``: the conversation's rows in earlier blocks. The window
    sees a row for each block."""
    found = turns.groupBy("conv_id", "block").agg(F.min("pos").alias("first_pos"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0).cast("long")))


def same(a: str, b: str) -> Column:
    """A join condition under which null meets null."""
    return F.col(a).eqNullSafe(F.col(b))
