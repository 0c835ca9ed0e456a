"""Which spans hold a number, for spans of any length, without comparing all pairs.

A span is cut into the fewest aligned blocks whose lengths are powers of two: at most two of each length. A number
lies in one block of each length, so it finds its spans by an equi-join on length and block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpoint


def blocks(start: Column, end: Column, bits: int) -> Column:
    """``[(level, block)]`` of the numbers ``start`` to ``end`` (both included, within ``0 .. 2 ** bits - 1``)."""
    kind = "array<struct<level:int,block:bigint>>"
    first = F.struct(start.cast("long").alias("low"), (end + 1).cast("long").alias("high"), F.array().cast(kind).alias("cut"))

    def step(state: Column, level: Column) -> Column:
        def block(number: Column) -> Column:
            return F.array(F.struct(level.alias("level"), number.alias("block")))

        none = F.array().cast(kind)
        left = (state["low"] < state["high"]) & (state["low"] % 2 == 1)
        low = F.when(left, state["low"] + 1).otherwise(state["low"])
        right = (low < state["high"]) & (state["high"] % 2 == 1)
        high = F.when(right, state["high"] - 1).otherwise(state["high"])
        cut = F.concat(
            state["cut"], F.when(left, block(state["low"])).otherwise(none), F.when(right, block(high)).otherwise(none)
        )
        return F.struct(
            F.floor(low / 2).cast("long").alias("low"), F.floor(high / 2).cast("long").alias("high"), cut.alias("cut")
        )

    return F.aggregate(F.sequence(F.lit(0), F.lit(bits)), first, step, lambda state: state["cut"])


def holding(
    points: DataFrame, at: Column, spans: DataFrame, start: Column, end: Column, keys: list[str], *, bits: int
) -> DataFrame:
    """Every row of ``points`` with every row of ``spans`` of the same ``keys`` that holds ``at``.

    Numbers lie in ``0 .. 2 ** bits - 1``. A null key, number or end matches nothing, nor does a span that ends
    before it starts. Columns other than the keys must differ. Only the block lengths that occur are tried.
    """
    # Equal spans are cut once.
    ends = spans.select("*", start.cast("long").alias("__start"), end.cast("long").alias("__end"))
    limits = ends.select("__start", "__end").dropna().distinct()
    pieces = checkpoint(limits.select("*", F.inline(blocks(F.col("__start"), F.col("__end"), bits)).alias("__level", "__block")))
    # Neither blocks nor tried numbers are estimated well, so they must not be taken for small and broadcast.
    cut = ends.join(pieces.hint("merge"), ["__start", "__end"]).drop("__start", "__end")
    levels = sorted(r[0] for r in pieces.select("__level").distinct().collect())
    tried = F.array(*[F.struct(F.lit(n).alias("level"), F.shiftright(at.cast("long"), n).alias("block")) for n in levels])
    if not levels:
        tried = F.array().cast("array<struct<level:int,block:bigint>>")
    looked = points.select("*", F.inline(tried).alias("__level", "__block"))
    return looked.join(cut.hint("merge"), [*keys, "__level", "__block"]).drop("__level", "__block")
