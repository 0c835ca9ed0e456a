"""Gapless numbers inside groups of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.words import partitions


def numbered(rows: DataFrame, group: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: gapless numbers from 0 inside each group.

    A group is cut by a hash of ``order`` into as many slices as a shuffle has parts, so one that holds a
    third of all rows is spread over all tasks. Numbers follow the slices, not ``order`` itself. Rows that
    are equal in ``group`` and ``order`` are interchangeable. ``rows`` must be cheap to read twice.
    """
    slices = partitions(rows.sparkSession)
    cut = rows.withColumn("__slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    sizes = cut.groupBy(*group, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    before = W.partitionBy(*group).orderBy("__slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(
        *group, "__slice", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")
    )
    inside = W.partitionBy(*group, "__slice").orderBy(*order)
    return (
        cut.withColumn("__row", F.row_number().over(inside))
        .join(offsets, [*group, "__slice"])
        .withColumn(name, F.col("__before") + F.col("__row") - 1)
        .drop("__slice", "__row", "__before")
    )
