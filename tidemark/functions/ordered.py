"""Order-dependent columns for groups of any size.

A plain window puts a whole group into one task. These helpers cut every group into slices
along its order (a day, a block of sequence numbers), work inside the slices in parallel and
carry one summary row per slice across. A group with a third of all rows is then spread over
as many tasks as it has slices. ``keys`` must not be null; the order may be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

_SLICE = "__slice"
_BEFORE_ALL = -(1 << 62)


def days(column: str, width: int) -> Column:
    """Slice number of a date or timestamp: blocks of ``width`` days."""
    return F.floor(F.datediff(F.col(column), F.lit("1970-01-01")) / F.lit(width))


def minutes(column: str, width: int) -> Column:
    """Slice number of a timestamp: blocks of ``width`` minutes."""
    return F.floor(F.unix_micros(F.col(column).cast("timestamp")) / F.lit(width * 60_000_000))


def blocks(column: str, width: int) -> Column:
    """Slice number of an integer order column: blocks of ``width`` numbers."""
    return F.floor(F.col(column) / F.lit(width))


def _cut(df: DataFrame, by: Column) -> DataFrame:
    return df.withColumn(_SLICE, F.coalesce(by.cast("long"), F.lit(_BEFORE_ALL)))


def rank_in_order(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    by: Column,
    name: str,
    descending: bool = False,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based position of each row in its group, ordered by ``order``.

    ``facts`` has one row per group; its columns are added as well, over the slices instead of a join
    that would bring the whole group together.
    """
    arrow = F.desc if descending else F.asc
    cut = _cut(df, by)
    earlier = W.partitionBy(*keys).orderBy(arrow(_SLICE)).rowsBetween(W.unboundedPreceding, -1)
    offsets = (
        cut.groupBy(*keys, _SLICE)
        .agg(F.count(F.lit(1)).alias("__n"))
        .select(*keys, _SLICE, F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"))
    )
    if facts is not None:
        offsets = offsets.join(facts, keys, "left")
    inside = W.partitionBy(*keys, _SLICE).orderBy(*[arrow(c) for c in order])
    return (
        cut.withColumn("__local", F.row_number().over(inside))
        .join(offsets, [*keys, _SLICE])
        .withColumn(name, F.col("__before") + F.col("__local"))
        .drop(_SLICE, "__local", "__before")
    )


def previous_in_order(
    df: DataFrame, keys: list[str], order: list[str], by: Column, value: str, name: str
) -> DataFrame:
    """Add ``value`` of the row just before each row of its group."""
    cut = _cut(df, by)
    across = W.partitionBy(*keys).orderBy(_SLICE)
    carried = (
        cut.groupBy(*keys, _SLICE)
        .agg(F.max_by(F.struct(value), F.struct(*order)).alias("__last"))
        .select(*keys, _SLICE, F.lag("__last").over(across).alias("__carried"))
    )
    inside = W.partitionBy(*keys, _SLICE).orderBy(*order)
    return (
        cut.withColumn("__row", F.row_number().over(inside))
        .withColumn("__lag", F.lag(value).over(inside))
        .join(carried, [*keys, _SLICE])
        .withColumn(
            name,
            F.when(F.col("__row") == 1, F.col(f"__carried.{value}")).otherwise(F.col("__lag")),
        )
        .drop(_SLICE, "__row", "__lag", "__carried")
    )


def latest_before(
    df: DataFrame, keys: list[str], order: str, by: Column, value: Column, name: str
) -> DataFrame:
    """Add the largest non-null ``value`` among the rows up to and including each row."""
    cut = _cut(df, by).withColumn("__value", value)
    earlier = W.partitionBy(*keys).orderBy(_SLICE).rowsBetween(W.unboundedPreceding, -1)
    carried = (
        cut.groupBy(*keys, _SLICE)
        .agg(F.max("__value").alias("__top"))
        .select(*keys, _SLICE, F.max("__top").over(earlier).alias("__carried"))
    )
    inside = (
        W.partitionBy(*keys, _SLICE).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        cut.withColumn("__local", F.max("__value").over(inside))
        .join(carried, [*keys, _SLICE])
        .withColumn(name, F.greatest("__local", "__carried"))
        .drop(_SLICE, "__value", "__local", "__carried")
    )
