"""Joins that stay even when a few keys hold a large part of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def even_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """``rows.join(lookup, keys, how)`` for a ``lookup`` that was aggregated by the same keys.

    Spark would reuse the aggregate's partitioning for the join, and AQE splits a hot partition only
    where both sides come straight from a shuffle. Joining on the keys as one struct makes the (much
    smaller) lookup side shuffle once more, so that AQE can split the rows of a hot key over many
    tasks. ``how`` keeps the left side or less.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"cannot split the rows of a {how} join")
    key = _struct(keys)
    left = rows.withColumn("__key", key)
    right = lookup.withColumn("__key", key).drop(*keys)
    return left.join(right, "__key", how).drop("__key")


def _struct(keys: list[str]) -> Column:
    """The keys as one value; null where a key is null, so that it matches nothing."""
    present = F.col(keys[0]).isNotNull()
    for key in keys[1:]:
        present = present & F.col(key).isNotNull()
    return F.when(present, F.struct(*keys))
