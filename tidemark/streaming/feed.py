"""Feed rules on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.feed import SETTLED_HOURS


def ingest_stream(items: DataFrame, *, delay: str = "7 days") -> DataFrame:
    """Items without repeated ids; state and late rows are bounded by the seven days the pool covers."""
    return (
        items.withColumn("discovered_at", F.col("discovered_at").cast("timestamp"))
        .withWatermark("discovered_at", delay)
        .dropDuplicatesWithinWatermark(["id"])
    )


def story_sessions(reports: DataFrame, *, delay: str = "1 hour") -> DataFrame:
    """Stories that settled: emitted once more than 48 hours passed without a report.

    Set ``spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition`` to merge a hot story's
    reports before they are shuffled.
    """
    return (
        reports.withColumn("ts", F.col("ts").cast("timestamp"))
        .withWatermark("ts", delay)
        .groupBy(F.session_window("ts", f"{SETTLED_HOURS} hours"), "story_id")
        .agg(
            F.count(F.lit(1)).alias("reports"),
            F.max("ts").alias("last_ts"),
            F.max("report_id").alias("last_report"),
        )
        .select("story_id", "reports", "last_ts", "last_report")
    )
