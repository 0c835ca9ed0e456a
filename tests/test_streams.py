"""Streams give what the batch operators give on the same rows, however the rows are cut into batches."""

from __future__ import annotations

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from test_evals import RUN, brute_streaks

from tidemark.operators.mirror import apply_changes
from tidemark.streaming import feed, mirror, runs, versions

CHANGE = "seq BIGINT, op STRING, id STRING, value INT"
PAGE = "snapshot INT, page INT, cursor STRING, hasMore BOOLEAN, items ARRAY<STRUCT<id: STRING, value: INT>>"


def responses(spark, rows, closed=True):
    """The rows as a snapshot of two pages."""
    return spark.createDataFrame([(1, 1, "c", True, rows[:1]), (1, 2, "c", not closed, rows[1:])], PAGE)


def items_of(documents):
    return documents.selectExpr("inline(items)")


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def land(spark, rows, schema, folder, stamp):
    """One file of a stream's input; the time stamp keeps the files in order."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    for name in os.listdir(folder):
        path = f"{folder}/{name}"
        if name.endswith(".parquet") and os.path.getmtime(path) > 2_000_000:
            os.utime(path, (stamp, stamp))


def source(spark, schema, folder):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


CHANGES = [
    (1, "upsert", "a", 1), (2, "upsert", "a", 2), (3, "remove", "zz", None), (4, "upsert", "b", 3),
    (5, "remove", "a", None), (6, "upsert", "c", 4), (7, "upsert", "a", 9), (8, "remove", "c", None),
]


@pytest.fixture
def start(spark):
    return spark.createDataFrame([("a", 0), ("keep", 7), ("c", 0)], "id STRING, value INT")


def test_changes_last_wins_and_replay_changes_nothing(spark, start):
    changes = spark.createDataFrame(CHANGES, CHANGE)
    once = apply_changes(start, changes)
    assert rows_of(once) == [("a", 9), ("b", 3), ("keep", 7)]
    assert rows_of(apply_changes(once, changes)) == rows_of(once)


def test_mirror(spark, start, tmp_path):
    path, landing = f"{tmp_path}/mirror", f"{tmp_path}/changes"
    rows = [("a", 0), ("keep", 7), ("c", 0)]
    with pytest.raises(FileNotFoundError):
        land(spark, CHANGES[:1], CHANGE, landing, 1_000_000)
        mirror.mirror_stream(source(spark, CHANGE, landing), path)
    with pytest.raises(ValueError):
        mirror.rebuild_mirror(responses(spark, rows, closed=False), items_of, path)
    assert versions.latest(spark, path) is None
    first = mirror.rebuild_mirror(responses(spark, rows), items_of, path)
    for n, part in enumerate((CHANGES[1:4], CHANGES[4:6], CHANGES[6:])):
        land(spark, part, CHANGE, landing, 1_000_010 + n)
    mirror.mirror_stream(source(spark, CHANGE, landing), path).awaitTermination()
    want = rows_of(apply_changes(start, spark.createDataFrame(CHANGES, CHANGE)))
    assert rows_of(versions.read(spark, path)) == want
    assert len(versions.complete(spark, path)) == 5
    assert rows_of(versions.read(spark, path, first)) == rows_of(start)

    # A batch that crashed before its mark was written is invisible, and its repetition heals it.
    last = versions.latest(spark, path)
    os.remove(f"{path}/{last}/_SUCCESS")
    assert versions.latest(spark, path) < last
    batch = spark.createDataFrame(CHANGES[6:], CHANGE)
    versions.update(path, last, batch, ["id"], lambda rows: apply_changes(rows, batch))
    assert rows_of(versions.read(spark, path)) == want

    # The batch left the buckets of other ids where they were.
    touched = {r.b for r in batch.select(versions.bucket(["id"]).alias("b")).collect()}
    before = versions.manifest(spark, path, versions.latest(spark, path, before=last)).folders
    after = versions.manifest(spark, path, last).folders
    assert {b: f for b, f in after.items() if b not in touched} == {b: f for b, f in before.items() if b not in touched}
    assert all(f.startswith(f"rows-{last}/") for b, f in after.items() if b in touched)
    gone = versions.remove_old(spark, path, keep=2)
    assert len(versions.complete(spark, path)) == 2 and gone and rows_of(versions.read(spark, path)) == want

    # A broken cursor: one rebuild, a new generation with its own cursor.
    again = mirror.rebuild_mirror(responses(spark, [("new", 1)]), items_of, path)
    assert versions.latest(spark, path) == again and rows_of(versions.read(spark, path)) == [("new", 1)]


def test_a_small_batch_writes_a_small_part(spark, tmp_path):
    """Many buckets, chosen at the rebuild and kept; large ones are written by several tasks."""
    path = f"{tmp_path}/mirror"
    rows = spark.range(20_000).select(F.col("id").cast("string").alias("id"), F.col("id").cast("int").alias("value"))
    versions.write(rows, path, versions.name(1), ["id"], 1000)
    first = versions.manifest(spark, path, versions.name(1))
    assert first.buckets == 1000 and len(first.folders) == 1000
    land(spark, [(n, "upsert", str(n), -n) for n in range(1, 11)] + [(11, "upsert", "new", 5)], CHANGE, f"{tmp_path}/in", 1_000_000)
    mirror.mirror_stream(source(spark, CHANGE, f"{tmp_path}/in"), path).awaitTermination()
    after = versions.manifest(spark, path, versions.latest(spark, path))
    assert after.buckets == 1000
    assert 5 <= sum(after.folders[b] != f for b, f in first.folders.items()) <= 11
    got = {r.id: r.value for r in versions.read(spark, path).collect()}
    assert got == {**{str(n): n for n in range(20_000)}, **{str(n): -n for n in range(1, 11)}, "new": 5}
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    spark.conf.set(key, "64k")
    try:
        large = spark.range(200_000).select(F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
        versions.write(large, f"{tmp_path}/few", versions.name(1), ["k"], 2)
    finally:
        spark.conf.unset(key)
    for folder in versions.manifest(spark, f"{tmp_path}/few", versions.name(1)).folders.values():
        assert sum(n.endswith(".parquet") for n in os.listdir(f"{tmp_path}/few/{folder}")) > 2
    assert versions.read(spark, f"{tmp_path}/few").count() == 200_000


def drained(spark, df, tmp_path):
    running = (
        df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cursor")
        .trigger(availableNow=True).start()
    )
    running.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{tmp_path}/out")


def test_ingest_drops_repeats_and_what_is_too_late(spark, tmp_path):
    now, schema = dt.datetime(2026, 1, 20), "id STRING, discovered_at TIMESTAMP"
    day = dt.timedelta(days=1)
    land(spark, [("a", now), ("a", now), ("b", now - 3 * day)], schema, f"{tmp_path}/in", 1_000_000)
    # Rows are late against the watermark that the batch before last has set.
    land(spark, [("d", now)], schema, f"{tmp_path}/in", 1_000_001)
    land(spark, [("a", now + day), ("c", now - 5 * day), ("late", now - 9 * day)], schema, f"{tmp_path}/in", 1_000_002)
    got = drained(spark, feed.ingest_stream(source(spark, schema, f"{tmp_path}/in")), tmp_path)
    assert sorted(r.id for r in got.collect()) == ["a", "b", "c", "d"]


def test_sessions_close_after_more_than_48_hours(spark, tmp_path):
    now, schema, hour = dt.datetime(2026, 1, 1), "story_id INT, report_id INT, ts TIMESTAMP", dt.timedelta(hours=1)
    rows = [(1, 1, now), (1, 2, now + 48 * hour), (2, 3, now), (2, 4, now + 48 * hour + dt.timedelta(seconds=1)), (3, 9, now + 200 * hour)]
    land(spark, rows, schema, f"{tmp_path}/in", 1_000_000)
    got = drained(spark, feed.story_sessions(source(spark, schema, f"{tmp_path}/in")), tmp_path)
    assert sorted((r.story_id, r.reports) for r in got.collect()) == [(1, 2), (2, 1), (2, 1)]


@pytest.mark.parametrize("cuts", [(), (4, 9, 60), (1, 2, 3, 40, 41)])
def test_alerts_carry_over_batches(spark, tmp_path, cuts):
    rows = [("r", "c", n, (n * 7919) % 11 > 6) for n in range(90)] + [("s", "d", n, n == 30) for n in range(90)]
    edges = [0, *cuts, 90]
    for n, (low, high) in enumerate(zip(edges, edges[1:])):
        land(spark, [r for r in rows if low <= r[2] < high], RUN, f"{tmp_path}/in", 1_000_000 + n)
    runs.streak_alerts(source(spark, RUN, f"{tmp_path}/in"), f"{tmp_path}/alerts", slice_size=8).awaitTermination()
    alerts = runs.read_alerts(spark, f"{tmp_path}/alerts")
    got = sorted((r.run, r.check, r.first_seq, r.alert_seq) for r in alerts.collect())
    third = lambda run, check, first: [r[2] for r in rows if r[:2] == (run, check) and r[2] >= first and not r[3]][2]
    assert got == [(run, check, first, third(run, check, first)) for run, check, first, _, _ in brute_streaks(rows, 3)]
    state = versions.read(spark, f"{tmp_path}/alerts/state")
    assert {(r.run, r.check): r.failures for r in state.collect()}["s", "d"] == 59


def test_work_folder_needs_a_shared_place_on_a_cluster():
    from tidemark.session import work_dir

    class Session:
        """As much of a session as the folder depends on."""

        def __init__(self, master, shared):
            self.master, self.shared = master, shared
            self.sparkContext = self.conf = self

        def getConf(self):
            return self

        def get(self, key, default=None):
            return self.shared or default

        def getCheckpointDir(self):
            return None

    with pytest.raises(ValueError):
        work_dir(Session("yarn", None), "x")
    assert work_dir(Session("yarn", "s3a://shared/ck/"), "x").startswith("s3a://shared/ck/x-")
    assert os.path.isdir(work_dir(Session("local[2]", None), "x"))


def test_json_pages_to_the_mirror(spark, tmp_path):
    from tidemark.sources import tables

    def item(n, title):
        return {"id": f"i{n}", "title": title, "links": {"site": f"https://s/{n}"}, "source": {"name": "x"}, "discoveredAt": "2026-01-01T00:00:00Z", "selected": True}

    pages = [
        {"snapshot": 1, "page": 1, "cursor": "w", "nextPage": "p2", "hasMore": True, "count": 2, "items": [item(1, "one"), item(2, "two")]},
        {"snapshot": 1, "page": 2, "cursor": "w", "hasMore": False, "count": 1, "items": [item(3, "three")]},
    ]
    steps = [
        {"page": 1, "cursor": "w1", "hasMore": True, "changes": [{"op": "upsert", "id": "i2", "item": item(2, "TWO")}, {"op": "remove", "id": "i1"}]},
        {"page": 2, "cursor": "w2", "hasMore": False, "changes": [{"op": "upsert", "id": "i4", "item": item(4, "four")}, {"op": "remove", "id": "none"}]},
    ]
    for name, documents in (("snapshot", pages), ("changes", steps)):
        os.makedirs(f"{tmp_path}/{name}")
        for n, document in enumerate(documents):
            with open(f"{tmp_path}/{name}/{n}.json", "w") as out:
                json.dump(document, out)
            os.utime(f"{tmp_path}/{name}/{n}.json", (1_000_000 + n, 1_000_000 + n))
    answers = tables.read_json(spark, f"{tmp_path}/snapshot", tables.SNAPSHOT_PAGE)
    mirror.rebuild_mirror(answers, lambda d: tables.feed_items(d, "site"), f"{tmp_path}/m")
    stream = spark.readStream.schema(tables.CHANGE_PAGE).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/changes")
    mirror.mirror_stream(tables.changes(stream, tables.CHANGED_ITEM, "site"), f"{tmp_path}/m").awaitTermination()
    got = {r.id: (r.title, r.links.site) for r in versions.read(spark, f"{tmp_path}/m").collect()}
    assert got == {"i2": ("TWO", "https://s/2"), "i3": ("three", "https://s/3"), "i4": ("four", "https://s/4")}
    assert len(versions.complete(spark, f"{tmp_path}/m")) == 3
