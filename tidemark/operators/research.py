"""Subject timelines, competitor comparison and source checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions.asof import as_of_join
from tidemark.functions.links import groups
from tidemark.functions.ordered import days, previous_in_order
from tidemark.functions.spans import holding

# How good a kind of source is, best first; the threat levels.
SOURCE_ORDER = ("primary", "media", "reprint")
THREATS = ("高", "中", "低")


# The dates that a date column may hold, and the bits that count them.
FIRST_DATE, LAST_DATE, DATE_BITS = "0001-01-01", "9999-12-31", 22


def timeline(events: DataFrame, *, slice_days: int = 1) -> DataFrame:
    """Events of each subject in order with the date before and the gap in days."""
    return previous_in_order(
        events, ["subject"], ["date", "name"], days("date", slice_days), "date", "previous_date"
    ).withColumn("gap_days", F.datediff("date", "previous_date"))


def timeline_gaps(events: DataFrame, *, max_gap: int, slice_days: int = 1) -> DataFrame:
    """Breaks of more than ``max_gap`` days between neighbouring events."""
    return timeline(events, slice_days=slice_days).filter(F.col("gap_days") > max_gap)


def assign_phase(events: DataFrame, phases: DataFrame) -> DataFrame:
    """Add the ``phase`` whose span holds the event's date; events outside all phases keep null.

    ``phases(phase, start, end)`` apply to all subjects, or with a ``subject`` column to one each. A null end is
    open, a running phase, and so is a null start; both days count. An event in several phases has a row for
    each. Dates are looked up in the blocks of ``functions.spans``, so a phase of any length costs a few rows,
    and only distinct dates are looked up.
    """
    keys = ["subject"] if "subject" in phases.columns else []
    first, last = (F.coalesce(c, F.lit(d).cast("date")) for c, d in (("start", FIRST_DATE), ("end", LAST_DATE)))
    dates = events.select(*keys, "date").filter("date IS NOT NULL").distinct()
    found = holding(
        dates, _day(F.col("date")), phases.select(*keys, "phase", first.alias("start"), last.alias("end")),
        _day(F.col("start")), _day(F.col("end")), keys, bits=DATE_BITS,
    )
    return events.join(found.select(*keys, "date", "phase"), [*keys, "date"], "left").select(*events.columns, "phase")


def _day(date: Column) -> Column:
    return F.datediff(date, F.lit(FIRST_DATE).cast("date"))


def outside_phases(assigned: DataFrame) -> DataFrame:
    return assigned.filter(F.col("phase").isNull())


def scenario(subjects: DataFrame, competitors: DataFrame, *, direct: str = "direct") -> DataFrame:
    """Per subject the number of direct competitors and the scenario: A none, B one or two, C more."""
    counts = (
        competitors.filter(F.col("type") == direct)
        .groupBy("subject")
        .agg(F.count_distinct("competitor").alias("direct"))
    )
    return (
        subjects.select("subject")
        .distinct()
        .join(counts, "subject", "left")
        .fillna(0, ["direct"])
        .withColumn(
            "scenario", F.when(F.col("direct") == 0, "A").when(F.col("direct") <= 2, "B").otherwise("C")
        )
    )


def representatives(
    competitors: DataFrame, *, k: int = 5, direct: str = "direct", score: str = "score"
) -> DataFrame:
    """Add ``role``: the ``k`` best-scored direct competitors of a subject are compared in depth."""
    if not 3 <= k <= 5:
        raise ValueError("three to five competitors are compared in depth")
    best = W.partitionBy("subject").orderBy(F.desc(score), F.asc("competitor"))
    # Only the top k of a subject reach its window; the flag then travels back by a join.
    top = (
        competitors.filter(F.col("type") == direct)
        .select("subject", "competitor", score)
        .withColumn("__place", F.row_number().over(best))
        .filter(F.col("__place") <= k)
        .select("subject", "competitor", F.lit("in depth").alias("role"))
    )
    return competitors.join(top, ["subject", "competitor"], "left").fillna("brief", ["role"])


def matrix(values: DataFrame, parties: Sequence[str]) -> DataFrame:
    """``values(dimension, party, value)`` with a column per party."""
    return values.groupBy("dimension").pivot("party", list(parties)).agg(F.max("value"))


def threat_summary(competitors: DataFrame) -> DataFrame:
    """Competitors by type and threat with all subtotals; a subtotal says ``all``."""
    return (
        competitors.cube("type", "threat")
        .agg(
            F.count(F.lit(1)).alias("competitors"),
            F.grouping("type").alias("__t"),
            F.grouping("threat").alias("__h"),
        )
        .select(
            F.when(F.col("__t") == 1, "all").otherwise(F.col("type")).alias("type"),
            F.when(F.col("__h") == 1, "all").otherwise(F.col("threat")).alias("threat"),
            "competitors",
        )
    )


def _source_rank(order: Sequence[str]) -> Column:
    return F.coalesce(
        F.array_position(F.array(*[F.lit(k) for k in order]), F.col("source_kind")).try_cast("int"), F.lit(0)
    )


def best_source(claims: DataFrame, *, order: Sequence[str] = SOURCE_ORDER) -> DataFrame:
    """The best source of each claim; kinds not in ``order`` come last, urls break ties."""
    rank = _source_rank(order)
    rank = F.when(rank == 0, len(order) + 1).otherwise(rank)
    return claims.groupBy("claim_id").agg(
        F.min_by(F.struct("source_kind", "url"), F.struct(rank, F.col("url"))).alias("best")
    ).select("claim_id", "best.source_kind", "best.url")


def single_source(claims: DataFrame) -> DataFrame:
    """Claims all of whose mentions come from one origin."""
    return (
        claims.groupBy("claim_id")
        .agg(F.min("origin").alias("origin"), F.max("origin").alias("__max"), F.count(F.lit(1)).alias("mentions"))
        .filter(F.col("origin") == F.col("__max"))
        .drop("__max")
    )


def independent_sources(claims: DataFrame, cites: DataFrame) -> DataFrame:
    """Origins per claim, and how many of them are independent of each other.

    Origins that cite each other, directly or over others, are one source, whoever cites whom and however
    many roots they have. So ``independent`` is at most ``origins``; an origin counts once per claim.
    """
    sources = groups(cites, "origin", "cites").select(F.col("node").alias("origin"), "group")
    return (
        claims.select("claim_id", "origin")
        .distinct()
        .join(sources, "origin", "left")
        .groupBy("claim_id", F.coalesce("group", "origin").alias("source"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("claim_id")
        .agg(F.sum("n").alias("origins"), F.count(F.lit(1)).alias("independent"))
    )


def unsourced(claims: DataFrame, sources: DataFrame, *, marker: str = "暂缺") -> DataFrame:
    """Claims ``(claim_id, text)`` without a source, and whether the text admits it with the marker."""
    return claims.join(sources.select("claim_id"), "claim_id", "left_anti").select(
        "claim_id", F.coalesce(F.contains(F.col("text"), F.lit(marker)), F.lit(False)).alias("marked")
    )


def roots(traits: DataFrame, links: DataFrame, events: DataFrame, *, cut_date=None) -> DataFrame:
    """Per present trait the number of linked events up to the cut date and the first of them.

    ``traits(trait)``, ``links(trait, event)``, ``events(event, date)``; a trait without an earlier event is kept
    with ``root`` null. Without ``cut_date`` every trait has its own, ``traits(trait, cut_date)``, a trait once;
    nothing is earlier than a null.
    """
    dated = links.join(events, "event")
    if cut_date is None:
        earlier = dated.join(traits.select("trait", "cut_date"), "trait").filter(F.col("date") <= F.col("cut_date"))
    else:
        earlier = dated.filter(F.col("date") <= F.lit(cut_date).cast("date"))
    stats = (
        earlier.groupBy("trait")
        .agg(F.count(F.lit(1)).alias("events"), F.min(F.struct("date", "event")).alias("__first"))
        .select("trait", "events", F.col("__first.event").alias("root"), F.col("__first.date").alias("root_date"))
    )
    return traits.join(stats, "trait", "left").fillna(0, ["events"])


def as_of(
    df: DataFrame, *, cut_date, keys: Sequence[str], value: str, date: str = "date", tie: Sequence[str] = ()
) -> DataFrame:
    """The last ``value`` of each key on or before the cut date."""
    return (
        df.filter(F.col(date) <= F.lit(cut_date).cast("date"))
        .groupBy(*keys)
        .agg(F.max(F.struct(date, *tie, value)).alias("__last"))
        .select(*keys, F.col(f"__last.{date}").alias(date), F.col(f"__last.{value}").alias(value))
    )


def as_of_each(
    comparisons: DataFrame, states: DataFrame, *, keys: Sequence[str], value: str, date: str = "date", tie: Sequence[str] = ()
) -> DataFrame:
    """Each of ``comparisons(*keys, cut_date, ...)`` with the last ``value`` on or before its own cut date."""
    return as_of_join(comparisons, states, keys, at="cut_date", date=date, values=[value], tie=tie)
