"""Registered mirror and stream queries. The streams read the events table as a file source."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import mirror
from tidemark.plans.registry import day_text, query, ts_text
from tidemark.session import work_dir
from tidemark.sources import derived
from tidemark.sources.tables import table
from tidemark.streaming import boards, classes, feed, runs, versions, violations
from tidemark.streaming import mirror as mirroring

#: Buckets of the mirror and the counters over the given tables, where every batch touches all of them.
BUCKETS = 16
APPLIED = """
    WITH last AS (SELECT id, arg_max(op, seq) AS op, arg_max(value, seq) AS value FROM changes GROUP BY id)
    SELECT id, value FROM mirror WHERE id NOT IN (SELECT id FROM last) UNION ALL SELECT id, value FROM last WHERE op = 'upsert'"""


def stream(spark, folder, name):
    """A given table as a stream. The pattern finds it as one file and as a folder of files."""
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}[.]parquet")


def collected(spark, df, purpose):
    """The rows a stream appends until its backlog is empty."""
    out = work_dir(spark, purpose)
    running = (
        df.writeStream.format("parquet")
        .option("path", f"{out}/rows")
        .option("checkpointLocation", f"{out}/cursor")
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{out}/rows")


@query("mirror_apply_changes", "mirror", "changes", sql=APPLIED)
def _(spark, folder):
    return mirror.apply_changes(derived.mirror(spark, folder), derived.changes(spark, folder))


def snapshot(spark, folder):
    """The mirror's rows as the responses of one snapshot, fifty items a page, the last page closed."""
    rows = derived.mirror(spark, folder)
    last = rows.agg(F.floor(F.max("id") / 50)).scalar()
    page = F.floor(F.col("id") / 50)
    return rows.groupBy(page.alias("n")).agg(F.collect_list(F.struct("id", "value")).alias("items")).select(
        F.lit(1).alias("snapshot"), (F.col("n") + 1).alias("page"), F.lit("c").alias("cursor"),
        (F.col("n") < last).alias("hasMore"), "items",
    )


def snapshot_rows(responses):
    return responses.select(F.inline("items"))


def landed(spark, rows, order, purpose, work, parts=3):
    """``rows`` land in ``parts`` steps by ``order``; after each one ``work(stream)`` takes what is new."""
    landing = work_dir(spark, purpose)
    step = rows.agg(F.ceil((F.max(order) + 1) / parts)).scalar()
    for part in range(parts):
        own = rows.filter(F.floor(F.col(order) / step) == part)
        own.write.mode("append").parquet(landing)
        work(spark.readStream.schema(rows.schema).parquet(landing)).awaitTermination()


@query("mirror_rebuild", "mirror", sql="SELECT id, value FROM mirror")
def _(spark, folder):
    path = work_dir(spark, "rebuild")
    mirroring.rebuild_mirror(snapshot(spark, folder), snapshot_rows, path)
    return versions.read(spark, path)


@query("mirror_stream", "mirror", "changes", sql=APPLIED)
def _(spark, folder):
    path = work_dir(spark, "mirror")
    mirroring.rebuild_mirror(snapshot(spark, folder), snapshot_rows, path, buckets=BUCKETS)
    changes = derived.changes(spark, folder)
    landed(spark, changes, "seq", "changes", lambda stream: mirroring.mirror_stream(stream, path))
    return versions.read(spark, path)


@query("stream_ingest", sql="""
    SELECT event_id AS id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS discovered_at FROM events""")
def _(spark, folder):
    # Every item arrives twice.
    items = stream(spark, folder, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("discovered_at"))
    once = feed.ingest_stream(items.union(items))
    return collected(spark, once, "ingest").select("id", ts_text("discovered_at").alias("discovered_at"))


@query("stream_story_sessions", "story_reports", sql="""
    SELECT story_id, count(*) AS reports, strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS last_ts, max(report_id) AS last_report
    FROM story_reports GROUP BY story_id
    HAVING max(ts) + INTERVAL 48 HOUR <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM story_reports)""")
def _(spark, folder):
    reports = stream(spark, folder, "events").select(
        (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("story_id"), F.col("event_id").alias("report_id"), "ts"
    )
    settled = collected(spark, feed.story_sessions(reports), "sessions")
    return settled.select("story_id", "reports", ts_text("last_ts").alias("last_ts"), "last_report")


@query("stream_streak_alerts", "runs", sql="""
    WITH marked AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY run, "check" ORDER BY seq) AS island FROM runs),
    numbered AS (SELECT *, row_number() OVER (PARTITION BY run, "check", island ORDER BY seq) AS n,
                        min(seq) OVER (PARTITION BY run, "check", island) AS first_seq FROM marked WHERE NOT ok)
    SELECT run, "check", first_seq, seq AS alert_seq FROM numbered WHERE n = 3""")
def _(spark, folder):
    path = work_dir(spark, "streaks")
    results = derived.run_rows(table(spark, folder, "events"))
    landed(spark, results, "seq", "runs", lambda stream: runs.streak_alerts(stream, path, slice_size=1000, buckets=BUCKETS))
    return runs.read_alerts(spark, path)


@query("stream_repeat_violations", "runs", sql="""
    SELECT run AS project, "check" AS kind FROM runs WHERE NOT ok GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, folder):
    path = work_dir(spark, "violations")
    seen = derived.run_rows(table(spark, folder, "events")).filter("NOT ok").select(
        F.col("run").alias("project"), F.col("check").alias("kind"), "seq"
    )
    landed(spark, seen, "seq", "violations-in", lambda stream: violations.repeat_alerts(stream, path))
    return violations.read_alerts(spark, path)


@query("stream_daily_index", "feed_items", sql="""
    SELECT strftime(day, '%Y-%m-%d') AS date, count(*) AS item_count, count(*) FILTER (selected) AS selected_count
    FROM (SELECT *, CAST(discovered_at AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai' AS DATE) AS day FROM feed_items) GROUP BY day""")
def _(spark, folder):
    path = work_dir(spark, "days")
    items = derived.feed_entries(spark, folder).select("id", "discovered_at", "selected")
    # Items arrive in the order of their numbers, so a day is revised by several batches; none is too late.
    landed(spark, items, "id", "days-in", lambda stream: boards.daily_counts(stream, path, delay="400 days"))
    days = boards.read_days(spark, path)
    return days.select(day_text("date").alias("date"), "item_count", "selected_count")


def board_sql(hours, slide):
    return f"""
    WITH steps AS (
        SELECT time_bucket(INTERVAL {slide} HOUR, timeline_ts, TIMESTAMP '1970-01-01') AS step, category,
               count(*) AS n, count(*) FILTER (selected) AS chosen FROM timeline_items GROUP BY ALL),
    edges AS (
        SELECT step + (k + 1) * INTERVAL {slide} HOUR AS edge, category, n, chosen FROM steps, range({hours // slide}) r(k))
    SELECT strftime(edge, '%Y-%m-%d %H:%M:%S.%f') AS edge, category, CAST(sum(n) AS BIGINT) AS item_count, CAST(sum(chosen) AS BIGINT) AS selected_count
    FROM edges WHERE edge <= (SELECT date_trunc('millisecond', max(timeline_ts)) - INTERVAL 72 HOUR FROM timeline_items) GROUP BY edge, category"""


def board(spark, folder, window, slide):
    lag = F.from_json("props", "k INT").k
    items = stream(spark, folder, "events").select(
        F.when(F.col("event_type") != "error", F.timestamp_add("HOUR", -lag, F.col("ts"))).alias("published_at"),
        F.col("ts").alias("discovered_at"),
        derived.mapped(F.col("event_type"), derived.CATEGORY, "other").alias("category"),
        (F.col("value") >= 50).alias("selected"),
    )
    rows = collected(spark, boards.rolling_board(items, window=window, slide=slide), "board")
    return rows.withColumn("edge", ts_text("edge"))


@query("stream_board_24h", "timeline_items", sql=board_sql(24, 1))
def _(spark, folder):
    return board(spark, folder, "24 hours", "1 hour")


@query("stream_board_7d", "timeline_items", sql=board_sql(168, 24))
def _(spark, folder):
    return board(spark, folder, "7 days", "1 day")


@query("stream_merged_stories", "story_alias", sql="""
    WITH RECURSIVE chain(id, story) AS (SELECT c_custkey, c_custkey FROM customer
        UNION ALL SELECT id, new_id FROM chain JOIN story_alias ON story = old_id)
    SELECT id AS member, min(story) AS name FROM chain GROUP BY id""")
def _(spark, folder):
    # Merges arrive in four batches, in no order of the chains they belong to.
    path = work_dir(spark, "classes")
    merged = derived.story_alias(spark, folder).select(F.col("old_id").alias("a"), F.col("new_id").alias("b"))
    for batch in range(4):
        classes.merge(merged.filter(F.pmod(F.xxhash64("a"), F.lit(4)) == batch), path, batch)
    everyone = table(spark, folder, "customer").select(F.col("c_custkey").alias("member"))
    return classes.classes_of(everyone, path)
