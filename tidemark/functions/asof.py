"""The last state before a moment, for a moment per row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.ordered import days, latest_before


def as_of_join(
    rows: DataFrame,
    states: DataFrame,
    keys: Sequence[str],
    *,
    at: str,
    date: str,
    values: Sequence[str],
    tie: Sequence[str] = (),
    by: Column | None = None,
) -> DataFrame:
    """``rows`` with the ``values`` of the last of ``states`` of the same keys whose ``date`` is not after ``at``.

    Of states with one date the one with the largest ``tie`` counts, then the largest values. A row without
    such a state, or with a null key or moment, gets nulls; so does every row if there are no states. Both sides
    are put into one order per key and the last state is carried over its slices (``by``, a slice number of the
    column ``__at``, by default thirty days), so neither a key with a third of all rows nor its many states
    meet in one task, and no row is compared with more than one state.
    """
    kept = states.dropna(subset=[date, *keys])
    state = F.struct(F.col(date).alias("__date"), *tie, F.struct(*values).alias("__values"))
    row = F.struct(*rows.columns)
    left = rows.dropna(subset=list(keys)).select(*keys, F.col(at).alias("__at"), F.lit(1).alias("__side"), row.alias("__row"))
    right = kept.select(*keys, F.col(date).alias("__at"), F.lit(0).alias("__side"), state.alias("__state"))
    both = left.unionByName(right, allowMissingColumns=True).withColumn("__order", F.struct("__at", "__side"))
    slices = days("__at", 30) if by is None else by
    carried = latest_before(both, list(keys), "__order", slices, F.col("__state"), "__last")
    found = carried.filter("__side = 1").select("__row.*", *[F.col(f"__last.__values.{v}").alias(v) for v in values])
    keyless = rows.filter(reduce(Column.__or__, [F.col(k).isNull() for k in keys]))
    return found.unionByName(keyless, allowMissingColumns=True)
