"""Keeping a mirror of a set in step with its change log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def last_changes(changes: DataFrame) -> DataFrame:
    """The last change of each id. ``max_by`` combines before the shuffle, so a hot id costs a row per task."""
    payload = [c for c in changes.columns if c not in ("seq", "id")]
    return (
        changes.groupBy("id")
        .agg(F.max_by(F.struct(*payload), "seq").alias("last"))
        .select("id", "last.*")
    )


def apply_changes(mirror: DataFrame, changes: DataFrame) -> DataFrame:
    """The mirror after ``changes(seq, op, id, ...)``: upserts replace by id, removals delete.

    The last change of an id wins, removing a missing id does nothing, and applying the same changes
    again gives the same mirror.
    """
    last = last_changes(changes)
    kept = mirror.join(last.select("id"), "id", "left_anti")
    return kept.unionByName(last.filter(F.col("op") == "upsert").select(*mirror.columns))
