"""Real paths: what a path means once every link on its way has been followed, as a file system would.

A path is read from the top. The first of its ancestors that is a link is replaced by the link's target, and so
on until no ancestor is one; ``..`` behind a link leaves the target's folder, not the link's. All paths share
the rounds: one equi-join on exploded ancestors each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.functions.links import follow
from tidemark.functions.skew import even_join
from tidemark.functions.text import let
from tidemark.session import checkpoint


def rooted(path: Column, home: str | None = None) -> Column:
    """``path`` with a leading ``~`` replaced by ``home``, nothing else changed."""
    if home is None:
        return path
    own = (path == "~") | F.startswith(path, F.lit("~/"))
    return F.when(own, F.concat(F.lit(home), F.substring(path, 2, 1 << 30))).otherwise(path)


def _ways(place: Column) -> Column:
    """Every ancestor of a path, itself included, from the top: ``nth, here, rest``."""

    def ways(names: Column) -> Column:
        return F.transform(
            names,
            lambda _, i: F.struct(
                i.alias("nth"),
                paths.normalised(F.array_join(F.slice(names, F.lit(1), i + 1), "/")).alias("here"),
                F.array_join(F.slice(names, i + 2, F.size(names)), "/").alias("rest"),
            ),
        )

    return let(F.filter(F.split(place, "/", -1), lambda n: ~n.isin("", ".")), ways)


def _met(rows: DataFrame, links: DataFrame) -> DataFrame:
    """``key, at, rest``: the first link on the way of ``rows(key, place)``; rows without one are left out."""
    ways = rows.select("key", F.inline(_ways(F.col("place"))))
    met = ways.join(links.select(F.col("link").alias("here")).hint("merge"), "here")
    first = met.groupBy("key").agg(F.min_by(F.struct("here", "rest"), "nth").alias("first"))
    return first.select("key", F.col("first.here").alias("at"), "first.rest")


def _below(folder: Column, rest: Column) -> Column:
    return F.when(rest == "", folder).otherwise(F.concat(folder, F.lit("/"), rest))


def _collapsed(waits: DataFrame, ends: DataFrame) -> DataFrame:
    """``key, place``: what ``waits(key, at, rest)`` become when each ``at`` gives way to its own wait or end.

    Chains of any length collapse in as many rounds as the logarithm of it; there are no circles among them.
    """
    while True:
        step = waits.select(F.col("key").alias("at"), F.col("at").alias("__at"), F.col("rest").alias("__rest")).hint("merge")
        moved = checkpoint(
            even_join(waits, step, ["at"]).select(
                "key",
                F.coalesce("__at", "at").alias("at"),
                F.when(F.col("__at").isNull(), F.col("rest"))
                .otherwise(F.when(F.col("rest") == "", F.col("__rest")).otherwise(_below(F.col("__rest"), F.col("rest"))))
                .alias("rest"),
                F.col("__at").isNotNull().alias("__moved"),
            )
        )
        waits = moved.drop("__moved")
        if moved.filter("__moved").isEmpty():
            break
    tops = ends.select(F.col("key").alias("at"), "real").hint("merge")
    return even_join(waits, tops, ["at"], "inner").select("key", _below(F.col("real"), F.col("rest")).alias("place"))


def resolved_links(links: DataFrame, *, home: str | None = None) -> DataFrame:
    """``link, real, closed`` for ``links(path, target)``: where every link leads in the end.

    Links stand under their own place in the listing; a relative target starts in the link's folder. Of two
    targets of one link the smaller counts; a null path or target is no link. A link that cannot be followed
    because it runs in a circle, or leads into one, is not ``closed``, and ``real`` is its target as it stands.

    A link waits for the first link on the way of its target. Waits that run in a circle are found by pointer
    doubling, the others collapse by doubling; what they give is looked at again, because behind the end of one
    link there may be another.
    """
    given = links.select(paths.absolute(F.col("path"), home).alias("key"), rooted(F.col("target"), home).alias("target"))
    given = given.filter("key IS NOT NULL AND target IS NOT NULL").groupBy("key").agg(F.min("target").alias("target"))
    place = F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(
        F.concat(paths.parent(F.col("key")), F.lit("/"), "target")
    )
    rows = checkpoint(given.select("key", place.alias("place")))
    table = rows.select(F.col("key").alias("link"))
    spark = rows.sparkSession
    ends = spark.createDataFrame([], "key STRING, real STRING, closed BOOLEAN")
    while True:
        waits = checkpoint(_met(rows, table))
        free = rows.join(waits.select("key").hint("merge"), "key", "left_anti")
        done = free.select("key", paths.normalised(F.col("place")).alias("real"), F.lit(True).alias("closed"))
        if waits.isEmpty():
            return ends.unionByName(done).withColumnRenamed("key", "link")
        chains = checkpoint(follow(waits, "key", "at"))
        stuck = waits.filter("key = at").select(F.col("key").alias("root"), F.lit(True).alias("__self"))
        lost = chains.join(stuck, "root", "left").filter("NOT closed OR __self").select(F.col("source").alias("key"))
        lost = lost.union(stuck.select("root"))
        # What waits for a link that is known to run in a circle is lost with it.
        known = ends.filter("NOT closed").select(F.col("key").alias("root"))
        lost = checkpoint(lost.union(chains.join(known, "root").select("source")).distinct())
        astray = rows.join(lost, "key").select("key", paths.normalised(F.col("place")).alias("real"), F.lit(False).alias("closed"))
        ends = checkpoint(ends.unionByName(done).unionByName(astray))
        rows = checkpoint(_collapsed(waits.join(lost, "key", "left_anti"), ends.filter("closed")))


def real_paths(wanted: DataFrame, links: DataFrame, *, home: str | None = None) -> DataFrame:
    """``path, real, closed`` for every distinct ``path`` of ``wanted`` (absolute, or below ``~``).

    ``links(path, target)`` are followed to their ends first, so a path takes one round per link on its way,
    however long that link's own chain is. Links that ``resolved_links`` has already followed, as a written table,
    are taken as they are, so that several calls share that work. A path through a circle is not ``closed`` and stays as it stands
    from there on. A null path has no row.
    """
    ends = links if "real" in links.columns else checkpoint(resolved_links(links, home=home))
    return _through(wanted, ends, home)


def _through(wanted: DataFrame, ends: DataFrame, home: str | None) -> DataFrame:
    rows = wanted.filter("path IS NOT NULL").select("path").distinct()
    rows = checkpoint(rows.select("path", rooted(F.col("path"), home).alias("place"), F.lit(True).alias("closed")))
    finished = None
    while True:
        met = _met(rows.filter("closed").select(F.col("path").alias("key"), "place"), ends)
        met = checkpoint(met.withColumnRenamed("key", "path"))
        stays = rows.join(met.select("path").hint("merge"), "path", "left_anti")
        stays = stays.select("path", paths.normalised(F.col("place")).alias("real"), "closed")
        finished = stays if finished is None else finished.unionByName(stays)
        if met.isEmpty():
            return finished
        finished = checkpoint(finished)
        onward = F.when(F.col("closed"), F.col("real")).otherwise(F.col("at"))
        rows = checkpoint(
            even_join(met, ends.withColumnRenamed("link", "at").hint("merge"), ["at"], "inner").select(
                "path", _below(onward, F.col("rest")).alias("place"), "closed"
            )
        )


def with_real(rows: DataFrame, links: DataFrame, column: str, name: str, *, home: str | None = None) -> DataFrame:
    """``rows`` with the real path of ``column`` as ``name``."""
    real = real_paths(rows.select(F.col(column).alias("path")), links, home=home)
    return even_join(rows, real.select(F.col("path").alias(column), F.col("real").alias(name)).hint("merge"), [column])
