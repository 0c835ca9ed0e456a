"""Daily cuts and rolling boards of a feed, kept up to date on a stream."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.operators.feed import DISPLAY_ZONE, timeline_ts
from tidemark.streaming import versions

COUNTS = ["item_count", "selected_count"]


def _date_of(moment: Column) -> Column:
    """The date of a wall-clock time that is kept as an instant; the session's zone has no part in it."""
    return F.date_from_unix_date(F.floor(F.unix_micros(moment) / F.lit(86_400_000_000)).cast("int"))


def daily_counts(items: DataFrame, path: str, *, delay: str = "1 day", zone: str = DISPLAY_ZONE) -> StreamingQuery:
    """Count ``items(discovered_at, selected)`` per calendar day of ``zone``; works off the backlog and stops.

    A batch writes the days it changed, with their counts so far, as one folder in ``<path>/days``: a late item
    revises a day that was written before. Days end with the watermark, ``delay`` behind the newest item: state
    is kept for the days since then only, and an item of an ended day is dropped.
    """
    spark = items.sparkSession
    local = F.from_utc_timestamp(F.col("discovered_at").cast("timestamp"), zone)
    counted = (
        items.select(local.alias("at"), "selected")
        .withWatermark("at", delay)
        .groupBy(F.window("at", "1 day").alias("day"))
        .agg(F.count(F.lit(1)).alias("item_count"), F.count_if("selected").alias("selected_count"))
        .select(_date_of(F.col("day.start")).alias("date"), *COUNTS)
    )

    def step(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{path}/days/{versions.name(1, batch_id)}"
        )

    return (
        counted.writeStream.outputMode("update")
        .foreachBatch(step)
        .option("checkpointLocation", f"{path}/cursor")
        .trigger(availableNow=True)
        .start()
    )


def read_days(spark: SparkSession, path: str) -> DataFrame:
    """``date, item_count, selected_count`` as last revised, and how often a day was written."""
    names = versions.complete(spark, f"{path}/days")
    if not names:
        raise FileNotFoundError(f"no finished batch in {path}")
    written = spark.read.parquet(*[f"{path}/days/{n}" for n in names])
    last = written.groupBy("date").agg(F.max_by(F.struct(*COUNTS), "batch").alias("last"), F.count(F.lit(1)).alias("writes"))
    return last.select("date", "last.*", "writes")


def rolling_board(
    items: DataFrame, *, window: str = "24 hours", slide: str = "1 hour", delay: str = "72 hours"
) -> DataFrame:
    """Counts per category of the items of the last ``window``, at every ``slide``: ``edge, category, ...``.

    An item counts from its timeline time on, up to but without ``edge``. Items are counted per slide first, and
    only these counts are spread over the windows that hold them, so state and shuffle have a row per slide,
    category and window, not per item. Append mode: a board is emitted once the watermark, ``delay`` behind the
    newest item, has passed its edge; later items are dropped. ``window`` must be a multiple of ``slide``.
    """
    per_slide = (
        items.select(timeline_ts().cast("timestamp").alias("at"), "category", "selected")
        .withWatermark("at", delay)
        .groupBy(F.window("at", slide).alias("step"), "category")
        .agg(F.count(F.lit(1)).alias("items"), F.count_if("selected").alias("chosen"))
    )
    held = F.window(F.window_time("step"), window, slide).alias("held")
    return (
        per_slide.groupBy(held, "category")
        .agg(F.sum("items").alias("item_count"), F.sum("chosen").alias("selected_count"))
        .select(F.col("held.end").alias("edge"), "category", *COUNTS)
    )
