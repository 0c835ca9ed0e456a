"""Size columns: labels for people and the numbers read back from labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def label(kb: Column) -> Column:
    """A size in KB as text: whole KB below 1 MB, then one decimal in MB, GB or TB."""
    size = kb.cast("double")
    mb, gb, tb = 1024.0, 1024.0**2, 1024.0**3
    return (
        F.when(size < 1, F.format_string("%d B", (size * 1024).cast("long")))
        .when(size < mb, F.format_string("%d KB", size.cast("long")))
        .when(size < gb, F.format_string("%.1f MB", size / mb))
        .when(size < tb, F.format_string("%.1f GB", size / gb))
        .otherwise(F.format_string("%.1f TB", size / tb))
    )


def unit(kb: Column) -> Column:
    """The unit ``label`` picks."""
    return (
        F.when(kb < 1, "B")
        .when(kb < 1024, "KB")
        .when(kb < 1024**2, "MB")
        .when(kb < 1024**3, "GB")
        .otherwise("TB")
    )


def gigabytes(text: Column, strict: bool = False) -> Column:
    """The first number of a size label in GB; no number gives 0.

    A label without a unit counts as GB, and so does one in KB or B unless ``strict``.
    """
    units = "TB|GB|MB|KB|B" if strict else "TB|GB|MB"
    # Fixed value: how a size label is written.
    pattern = rf"(?i)([\d.]+)\s*({units})?"
    number = F.regexp_extract(text, pattern, 1)
    amount = F.regexp_extract(number, r"^(\d*\.?\d*)", 1).try_cast("double")
    named = F.upper(F.regexp_extract(text, pattern, 2))
    scale = (
        F.when(named == "TB", F.lit(1024.0))
        .when(named == "MB", F.lit(1 / 1024))
        .when(named == "KB", F.lit(1 / 1024**2))
        .when(named == "B", F.lit(1 / 1024**3))
        .otherwise(F.lit(1.0))
    )
    return F.coalesce(amount * scale, F.lit(0.0))


def without_estimate_note(text: Column) -> Column:
    """Drop a bracket such as "（估算…）" that repeats what "约" already says."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"[（(]\s*估算[^）)]*[）)]", ""))
