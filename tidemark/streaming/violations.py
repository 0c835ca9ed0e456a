"""Kinds of violation that come back, told once on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.streaming import versions

KEYS = ["project", "kind"]


def repeat_alerts(violations: DataFrame, path: str, *, n: int = 3) -> StreamingQuery:
    """Tell each kind of violation of ``violations(project, kind)`` once, in the batch of its ``n``-th sighting.

    Works off the backlog and stops. The running counts are the state of the stream's aggregation, which adds
    up the rows of a hot kind before they are shuffled; a batch sees the kinds whose count it changed. What an
    earlier batch has told stays told: alerts are one folder per batch in ``<path>/alerts``, and a batch that is
    repeated after a crash looks at the batches before it only and writes the same folder again. The state has
    a row per kind and project. Null projects and kinds are counted like others.
    """
    spark = violations.sparkSession
    alerts = f"{path}/alerts"

    def step(batch: DataFrame, batch_id: int) -> None:
        version = versions.name(1, batch_id)
        due = batch.filter(F.col("times") >= n).select(*KEYS)
        earlier = [v for v in versions.complete(spark, alerts) if v < version]
        if earlier:
            told = spark.read.schema(due.schema).parquet(*[f"{alerts}/{v}" for v in earlier])
            same = [due[k].eqNullSafe(told[k]) for k in KEYS]
            due = due.join(told, same, "left_anti")
        due.write.mode("overwrite").parquet(f"{alerts}/{version}")

    return (
        violations.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("times"))
        .writeStream.outputMode("update")
        .foreachBatch(step)
        .option("checkpointLocation", f"{path}/cursor")
        .trigger(availableNow=True)
        .start()
    )


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    """``project, kind`` of all alerts so far."""
    names = versions.complete(spark, f"{path}/alerts")
    if not names:
        raise FileNotFoundError(f"no finished batch in {path}")
    return spark.read.parquet(*[f"{path}/alerts/{n}" for n in names])
