"""Following chains of references (merges, citations, symlinks) to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import checkpoint


def follow(edges: DataFrame, source: str, target: str) -> DataFrame:
    """For each ``source`` the end of its chain: columns ``source``, ``root``, ``closed``.

    Every round doubles the distance covered and is written to the checkpoint folder. A chain with an end
    that is further away than a round reaches has links for which the next round is enough, so once as many
    sources move as in the round before, all of them run into circles and are not ``closed``. A source with two
    targets is refused; see ``groups`` for such graphs. No side of a round is sent through the driver.
    """
    hops = edges.select(
        F.col(source).alias("source"), F.col(target).alias("root")
    ).filter(F.col("source") != F.col("root")).distinct()
    hops = checkpoint(hops)
    if not hops.groupBy("source").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").isEmpty():
        raise ValueError(f"a {source} has more than one {target}")
    moving, before = hops.count(), None
    while moving and moving != before:
        onward = hops.select(F.col("source").alias("root"), F.col("root").alias("__next")).hint("merge")
        moved = hops.join(onward, "root", "left").select(
            "source",
            F.coalesce("__next", "root").alias("root"),
            F.col("__next").isNotNull().alias("__moved"),
        )
        moved = checkpoint(moved)
        hops = moved.select("source", "root")
        moving, before = moved.filter("__moved").count(), moving
    still_open = hops.select(F.col("source").alias("root"), F.lit(True).alias("__open")).hint("merge")
    return hops.join(still_open, "root", "left").select(
        "source", "root", F.col("__open").isNull().alias("closed")
    )


def groups(edges: DataFrame, source: str, target: str) -> DataFrame:
    """What hangs together over ``edges``, many to many: ``node`` and ``group``, the smallest node reached.

    Labels take the smallest label of a neighbour and then the label of that label, so the distance
    covered doubles; each round is checkpointed. Ends when no label changes. No side of a round is sent through the driver.
    """
    pairs = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL")
    both = checkpoint(pairs.union(pairs.select("b", "a")).distinct())
    labels = checkpoint(both.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("group")))
    while True:
        near = both.join(labels.hint("merge"), F.col("b") == F.col("node")).groupBy("a").agg(F.min("group").alias("__near"))
        better = labels.join(near.hint("merge"), F.col("node") == F.col("a"), "left").select(
            "node", F.least("group", "__near").alias("group"), F.col("group").alias("__before")
        )
        better = checkpoint(better)
        ahead = better.select(F.col("node").alias("__at"), F.col("group").alias("__ahead"))
        moved = checkpoint(
            better.join(ahead.hint("merge"), F.col("group") == F.col("__at"), "left").select(
                "node", F.least("group", "__ahead").alias("group"), "__before"
            )
        )
        if moved.filter(F.col("group") != F.col("__before")).isEmpty():
            return moved.select("node", "group")
        labels = moved.select("node", "group")
