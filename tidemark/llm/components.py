"""Connected components of a graph given as edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import written


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``, longs): ``root`` is the smallest node it reaches.

    Labels take the smallest label of their neighbours and then follow it one step, which halves chains.
    Each round is a table in the shared folder. A node with many edges is an aggregation with partial sums
    and a join that Spark can split.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("root")), "labels")
    before = None
    while (total := labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]) != before:
        before = total
        near = (
            both.join(labels, F.col("b") == F.col("node"))
            .groupBy("a")
            .agg(F.min("root").alias("least"))
        )
        better = labels.join(near, F.col("node") == F.col("a"), "left").select(
            "node", F.least("root", F.coalesce("least", "root")).alias("root")
        )
        labels = written(better, "labels")
        ahead = labels.select(F.col("node").alias("at"), F.col("root").alias("then"))
        labels = written(
            labels.join(ahead, F.col("root") == F.col("at"), "left").select(
                "node", F.least("root", F.coalesce("then", "root")).alias("root")
            ),
            "labels",
        )
    return labels
