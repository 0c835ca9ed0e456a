"""Chat formatting: every participant's view of a dialogue, with that speaker as the assistant.

The other speakers become users with a name, system turns stay system turns, and only the text of the
assistant's turns is trained on. A view is a sequence of segments, one row each with its place in the
rendered dialogue, so a dialogue of any length never has to fit one task; ``whole_views`` joins the
segments of dialogues that are known to be small. No user functions.

Control marks cannot be forged: in texts and names ``<|`` becomes ``< |``, so neither can open or close a turn, and
line ends in a name become spaces, so a name cannot close its own header. Masks count the rendered characters.

Defined results: a null text is empty, a null speaker is the user ``unknown``, a null turn comes first;
turns with the same number are ordered by speaker and text, and repeated rows are repeated turns. A
dialogue without participants (system turns only) has no view, an empty table none either. A null
dialogue id is a dialogue of its own. Only the named columns are read. Turns that share one number are put in
order by one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.skew import even_join

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
SLICE = 256


def _turns(turns: DataFrame, conv: str, turn: str, speaker: str, text: str) -> DataFrame:
    return turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(F.col(conv).isNull().alias("none"), F.coalesce(F.col(conv).cast("string"), F.lit("")).alias("id")).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        _tame(F.regexp_replace(F.coalesce(F.col(speaker), F.lit("unknown")), r"[\r\n]", " ")).alias("speaker"),
        _tame(F.coalesce(F.col(text), F.lit(""))).alias("content"),
    )


def _tame(text: Column) -> Column:
    """``text`` without anything that reads as a control mark."""
    return F.replace(text, F.lit("<|"), F.lit("< |"))


def perspectives(
    turns: DataFrame,
    conv: str = "conv_id",
    turn: str = "turn",
    speaker: str = "role",
    text: str = "text",
    system: str = "system",
) -> DataFrame:
    """One row per participant and turn: ``segment`` (the rendered turn) from ``start``, and its mask.

    Characters ``mask_start`` to ``mask_end`` of the whole rendered dialogue are trained on; both are
    null in turns of others. ``step`` counts the turns of a dialogue from 0.
    """
    rows = _turns(turns, conv, turn, speaker, text)
    people = rows.filter(F.col("speaker") != system).groupBy("conv", "speaker").agg(F.lit(1).alias("__one"))
    people = people.select("conv", F.col("speaker").alias("perspective"))
    seen = even_join(rows, people, ["conv"], "inner")
    own = F.col("speaker") == F.col("perspective")
    is_system = F.col("speaker") == system
    head = F.concat(
        F.lit(OPEN),
        F.when(is_system, F.lit("system")).when(own, F.lit("assistant")).otherwise(
            F.concat(F.lit("user name="), F.col("speaker"))
        ),
        F.lit("\n"),
    )
    rendered = seen.select(
        "conv", "conv_id", "perspective", "turn", "speaker", "content",
        F.when(is_system, F.lit("system")).when(own, F.lit("assistant")).otherwise(F.lit("user")).alias("role"),
        own.alias("trained"),
        F.length(head).cast("long").alias("head"),
        F.concat(head, F.col("content"), F.lit(CLOSE)).alias("segment"),
    )
    placed = _placed(rendered, ["conv", "perspective"], ["turn", "speaker", "content"])
    first = F.col("start") + F.col("head")
    return placed.select(
        "conv_id", "perspective", "step", "turn", "role", "speaker", "segment", "start",
        F.when(F.col("trained"), first).alias("mask_start"),
        F.when(F.col("trained"), first + F.length("content") + len(CLOSE)).alias("mask_end"),
    )


def _placed(rows: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    """Add ``step`` and ``start``, the number and length of the rows before; long groups are cut by turn."""
    key = [*group, "__slice"]
    cut = rows.withColumn("__slice", F.floor(F.coalesce("turn", F.lit(-1)) / SLICE))
    sums = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("__n"), F.sum(F.length("segment")).alias("__chars"))
    earlier = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    offsets = sums.select(*key, before("__n").alias("__rows"), before("__chars").alias("__from"))
    inside = W.partitionBy(*key).orderBy(*order)
    running: Column = F.sum(F.length("segment")).over(inside.rowsBetween(W.unboundedPreceding, -1))
    return (
        cut.withColumn("__row", F.row_number().over(inside))
        .withColumn("__run", F.coalesce(running, F.lit(0)))
        .join(offsets, key)
        .withColumn("step", F.col("__rows") + F.col("__row") - 1)
        .withColumn("start", F.col("__from") + F.col("__run"))
    )


def whole_views(segments: DataFrame) -> DataFrame:
    """One row per view with the whole ``text`` and the trained ``spans``; for dialogues that fit a task."""
    turns = F.array_sort(
        F.collect_list(F.struct("step", "segment", "mask_start", "mask_end"))
    )
    return (
        segments.groupBy("conv_id", "perspective")
        .agg(turns.alias("turns"))
        .select(
            "conv_id",
            "perspective",
            F.array_join(F.transform("turns", lambda t: t["segment"]), "").alias("text"),
            F.transform(
                F.filter("turns", lambda t: t["mask_start"].isNotNull()),
                lambda t: F.struct(t["mask_start"].alias("start"), t["mask_end"].alias("end")),
            ).alias("spans"),
        )
    )
