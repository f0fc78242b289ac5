"""Chat formatting: the same dialogue from each participant's side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>\n"
#: Turns of a conversation that are put in order in one task: those whose numbers share the quotient by this.
BLOCK = 1024


def perspectives(turns: DataFrame, system: tuple[str, ...] = ("system",)) -> DataFrame:
    """Segments of every conversation as each of its participants would be trained on it.

    One row for each (conv_id, perspective, pos): speaker, shown_as, name,
    segment (what is written), start and end (characters of the rendered
    dialogue, which is all segments in order), mask_start and mask_end (the part
    to learn from: text and end mark of the assistant's turns; else nothing, at
    the segment's end).

    The perspective's speaker is shown as ``assistant``; roles in ``system`` stay
    ``system`` and are no participants; all others are ``user`` with their names.
    A dialogue that holds a third of all rows is never one row or one task:
    turns are ordered and measured in blocks by turn number, and the blocks'
    sums, one row each, give where they begin.

    Turns are ordered by (turn, speaker, text), nulls first. Null or empty role:
    speaker ``unknown``. Characters other than letters, digits, ``_`` and ``-``
    of a name become ``_``. Null text is written as empty. ``<|`` in a text
    becomes ``< |``, so no text can forge a mark. Repeated rows are turns of
    their own. A conversation of system turns alone has no participant and no
    rows. Null conv_id: a conversation of its own. Empty table: empty. Other
    columns are dropped. Turns that all carry one number are one block.
    """
    role = F.coalesce(F.when(F.col("role") != "", F.regexp_replace("role", "[^A-Za-z0-9_-]", "_")), F.lit("unknown"))
    t = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), role.alias("speaker"), F.replace(F.coalesce(F.col("text"), F.lit("")), F.lit("<|"), F.lit("< |")).alias("text"))
    t = t.withColumn("block", F.coalesce(F.floor(F.col("turn") / BLOCK), F.lit(-1 << 40)))
    t = t.withColumn("key", F.struct(F.col("conv_id").isNull().alias("none"), F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("id")))
    who = t.filter(~F.col("speaker").isin(*system)).select("key", F.col("speaker").alias("perspective")).distinct()
    seen = t.join(who, "key")
    shown = F.when(F.col("speaker").isin(*system), "system").when(F.col("speaker") == F.col("perspective"), "assistant").otherwise("user")
    seen = seen.withColumn("shown_as", shown).withColumn("name", F.when(F.col("shown_as") == "user", F.col("speaker")))
    head = F.concat(F.lit(OPEN), F.col("shown_as"), F.coalesce(F.concat(F.lit(" name="), F.col("name")), F.lit("")), F.lit("\n"))
    seen = seen.withColumn("segment", F.concat(head, F.col("text"), F.lit(CLOSE))).withColumn("size", F.length("segment").cast("long")).withColumn("head", F.length(head).cast("long"))
    side = ["key", "perspective"]
    order = Window.partitionBy(*side, "block").orderBy("turn", "speaker", "text")
    seen = seen.withColumn("i", F.row_number().over(order)).withColumn("to", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = seen.groupBy(*side, "block").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    before = Window.partitionBy(*side).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(*side, "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n0"), F.coalesce(F.sum("size").over(before), F.lit(0)).alias("at0"))
    out = seen.join(blocks, [*side, "block"])
    end = F.col("at0") + F.col("to")
    mine = F.col("shown_as") == "assistant"
    return out.select("conv_id", "perspective", (F.col("n0") + F.col("i") - 1).alias("pos"), "speaker", "shown_as", "name", "segment", (end - F.col("size")).alias("start"), end.alias("end"), F.when(mine, end - F.col("size") + F.col("head")).otherwise(end).alias("mask_start"), end.alias("mask_end"))
