"""Classes of things that turn out to be the same, batch after batch, without writing known classes again.

A class is named by its smallest member. What is stored is one row per member that is not the name: what it was
merged into when that was found out. A row is never changed, because a name that is merged gets a row of its own;
so a member's class is the end of its chain of rows. A batch follows the chains of its own members only. Members and
rows are joined where they are, never sent through the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.links import follow, groups
from tidemark.session import checkpoint
from tidemark.streaming import versions


def _rows(spark: SparkSession, path: str, before: str | None = None) -> DataFrame | None:
    names = [n for n in versions.complete(spark, path) if before is None or n < before]
    return spark.read.parquet(*[f"{path}/{n}" for n in names]) if names else None


def _names(members: DataFrame, known: DataFrame | None) -> DataFrame:
    """``member, name``: the class each member is in by now; a round per merge that a class went through."""
    at = members.select("member", F.col("member").alias("name"))
    if known is None:
        return at
    step = known.select(F.col("member").alias("name"), F.col("into").alias("__into")).hint("merge")
    while True:
        moved = checkpoint(at.join(step, "name", "left"))
        at = moved.select("member", F.coalesce("__into", "name").alias("name"))
        if moved.filter("__into IS NOT NULL").isEmpty():
            return at


def merge(edges: DataFrame, path: str, batch: int) -> None:
    """Add ``edges(a, b)``: what they join is one class from now on. ``batch`` numbers the calls from 0.

    Writes one folder with a row per member or class name that the edges merged into another; a batch that is
    repeated starts from the batches before it and writes the same rows. Edges with a null end join nothing.
    """
    spark = edges.sparkSession
    version = versions.name(1, batch)
    known = _rows(spark, path, version)
    given = checkpoint(edges.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL"))
    members = given.select(F.col("a").alias("member")).union(given.select("b")).distinct()
    names = checkpoint(_names(members, known)).hint("merge")
    ends = given.join(names.toDF("a", "name_a"), "a").join(names.toDF("b", "name_b"), "b")
    joined = groups(ends, "name_a", "name_b").select(F.col("node").alias("member"), F.col("group").alias("into"))
    joined.filter("member <> into").write.mode("overwrite").parquet(f"{path}/{version}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``member, name`` of every member that is not itself the name of its class."""
    rows = _rows(spark, path)
    if rows is None:
        raise FileNotFoundError(f"no finished batch in {path}")
    return follow(rows, "member", "into").select(F.col("source").alias("member"), F.col("root").alias("name"))


def classes_of(members: DataFrame, path: str) -> DataFrame:
    """``member, name`` for each distinct ``member``; one that was never merged is its own class."""
    distinct = members.select("member").distinct()
    return _names(distinct, _rows(members.sparkSession, path))
