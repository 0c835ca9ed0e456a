"""Failure streaks on a stream of check results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions.ordered import blocks, latest_before
from tidemark.session import checkpoint
from tidemark.streaming import versions

KEYS = ["run", "check"]


def _streaks(batch: DataFrame, n: int, slice_size: int) -> DataFrame:
    """Failures of a batch by the last success before them in the batch (null: none yet).

    ``heads`` are the first ``n`` failures in order; the rank is cut at ``n`` before rows are shuffled.
    """
    last_ok = F.when(F.col("ok"), F.col("seq"))
    failed = latest_before(batch, KEYS, "seq", blocks("seq", slice_size), last_ok, "last_ok").filter(~F.col("ok"))
    counts = failed.groupBy(*KEYS, "last_ok").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("failures"))
    order = W.partitionBy(*KEYS, "last_ok").orderBy("seq")
    heads = (
        failed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
        .groupBy(*KEYS, "last_ok").agg(F.array_sort(F.collect_list("seq")).alias("heads"))
    )
    same = [counts[k] == heads[k] for k in KEYS] + [counts["last_ok"].eqNullSafe(heads["last_ok"])]
    return counts.join(heads, same).select(*[counts[c] for c in (*KEYS, "last_ok", "first_seq", "failures")], "heads")


def advance(state: DataFrame, batch: DataFrame, *, n: int, slice_size: int) -> tuple[DataFrame, DataFrame]:
    """Alerts of a batch and the counters of its runs and checks after it.

    ``state(run, check, first_seq, failures)`` counts the failures since the last success. The alert of a
    streak is its ``n``-th failure, ``alert_seq``, so it does not depend on where batches are cut. A hot
    check's rows are counted in slices, not in one task.
    """
    found = _streaks(batch, n, slice_size)
    carried = state.select(*KEYS, F.col("first_seq").alias("since"), F.col("failures").alias("before"))
    opening = F.col("last_ok").isNull() & F.col("before").isNotNull()
    # One row per streak; alerts and counters are both made from it.
    joined = checkpoint(found.join(carried, KEYS, "left").select(
        *KEYS,
        "last_ok",
        F.when(opening, F.col("since")).otherwise(F.col("first_seq")).alias("first_seq"),
        (F.col("failures") + F.when(opening, F.col("before")).otherwise(0)).alias("failures"),
        F.when(opening, F.col("before")).otherwise(F.lit(0)).alias("before"),
        "heads",
    ))
    alerts = joined.filter((F.col("failures") >= n) & (F.col("before") < n)).select(
        *KEYS, "first_seq", F.get("heads", (n - 1 - F.col("before")).cast("int")).alias("alert_seq")
    )
    top_ok = batch.groupBy(*KEYS).agg(F.max(F.when(F.col("ok"), F.col("seq"))).alias("top_ok"))
    # What is still open is the streak behind the last success of the batch, or all of it without one.
    still_open = (
        joined.join(top_ok, KEYS)
        .filter(F.col("last_ok").eqNullSafe(F.col("top_ok")))
        .select(*KEYS, "first_seq", "failures")
    )
    untouched = state.join(top_ok, KEYS, "left_anti")
    return alerts, untouched.select(*KEYS, "first_seq", "failures").unionByName(still_open)


def streak_alerts(
    runs: DataFrame, path: str, *, n: int = 3, slice_size: int = 1_000_000, buckets: int = versions.BUCKETS
) -> StreamingQuery:
    """Alert on ``n`` failures in a row of ``runs(run, check, seq, ok)``; works off the backlog and stops.

    Batches must arrive in the order of ``seq``; inside a batch any order will do. Alerts are one
    version folder per batch in ``<path>/alerts``, the counters in ``<path>/state``, of which a batch
    rewrites the buckets it touches. The counters are committed last, so a repeated batch starts from the
    same counters and rewrites the same alerts.
    """
    spark = runs.sparkSession
    counters = f"{path}/state"
    if versions.latest(spark, counters) is None:
        first = runs.select(*KEYS, F.col("seq").alias("first_seq"), F.lit(0).cast("long").alias("failures")).schema
        versions.write(spark.createDataFrame([], first), counters, versions.name(1), KEYS, buckets)

    def step(batch: DataFrame, batch_id: int) -> None:
        version = versions.name(1, batch_id)

        def change(state: DataFrame) -> DataFrame:
            alerts, after = advance(state, batch, n=n, slice_size=slice_size)
            alerts.write.mode("overwrite").parquet(f"{path}/alerts/{version}")
            return after

        versions.update(counters, version, batch, KEYS, change)

    return (
        runs.writeStream.foreachBatch(step)
        .option("checkpointLocation", f"{path}/cursor")
        .trigger(availableNow=True)
        .start()
    )


def read_alerts(spark, path: str) -> DataFrame:
    """The alerts of all finished batches."""
    names = versions.complete(spark, f"{path}/state")[1:]
    if not names:
        raise FileNotFoundError(f"no finished batch in {path}")
    return spark.read.parquet(*[f"{path}/alerts/{n}" for n in names])
