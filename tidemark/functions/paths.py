"""Path columns: ancestors, parents, leaf names. Paths are absolute and use ``/``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let


def parts(path: Column) -> Column:
    return F.split(path, "/", -1)


def parent(path: Column) -> Column:
    """The path without its last component; empty at the top."""
    return F.substring(path, F.lit(1), F.greatest(F.length(path) - F.length(leaf(path)) - 1, F.lit(0)))


def leaf(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def self_and_ancestors(path: Column) -> Column:
    """``/a/b`` gives ``[/a, /a/b]``; the filesystem root itself is left out."""

    def prefixes(names: Column) -> Column:
        return F.when(
            F.size(names) >= 2,
            F.transform(
                F.sequence(F.lit(2), F.size(names)), lambda n: F.array_join(F.slice(names, 1, n), "/")
            ),
        ).otherwise(F.array().cast("array<string>"))

    return let(parts(path), prefixes)


def name_below(path: Column, folder: Column) -> Column:
    """The component of ``path`` right under ``folder``, which must be one of its ancestors."""
    rest = F.substring(path, F.length(folder) + 2, F.length(path))
    return F.substring_index(rest, "/", 1)


def normalised(path: Column) -> Column:
    """An absolute path without ``.``, ``..`` and empty components."""

    def step(done: Column, name: Column) -> Column:
        return (
            F.when(name.isin("", "."), done)
            .when(name == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.array_append(done, name))
        )

    kept = F.aggregate(parts(path), F.array().cast("array<string>"), step)
    return F.concat(F.lit("/"), F.array_join(kept, "/"))


def resolved(target: Column, folder: Column) -> Column:
    """``target`` seen from ``folder``: absolute targets stay, relative ones start there."""
    return normalised(
        F.when(F.startswith(target, F.lit("/")), target).otherwise(F.concat(folder, F.lit("/"), target))
    )


def absolute(path: Column, home: str | None = None) -> Column:
    """``path`` normalised, with a leading ``~`` replaced by ``home``."""
    if home is not None:
        own = (path == "~") | F.startswith(path, F.lit("~/"))
        path = F.when(own, F.concat(F.lit(home), F.substring(path, 2, 1 << 30))).otherwise(path)
    return normalised(path)
