"""Running counts, daily cuts and rolling boards on streams, against the batch operators."""

from __future__ import annotations

import datetime as dt
import random
import shutil

import pytest
from pyspark.sql import functions as F
from test_streams import land, rows_of, source

from tidemark.functions import links
from tidemark.operators import feed, governance
from tidemark.session import checkpoint
from tidemark.streaming import boards, classes, violations

VIOLATION = "project STRING, kind STRING"
ITEM = "id LONG, discovered_at TIMESTAMP, published_at TIMESTAMP, category STRING, selected BOOLEAN"


def told(spark, rows, tmp_path, cuts):
    landing, path = f"{tmp_path}/in", f"{tmp_path}/out"
    for number, (start, end) in enumerate(zip([0, *cuts], [*cuts, len(rows)], strict=True)):
        land(spark, rows[start:end], VIOLATION, landing, 1000 + number)
        if number % 2:  # every other call finds two files
            violations.repeat_alerts(source(spark, VIOLATION, landing), path).awaitTermination()
    violations.repeat_alerts(source(spark, VIOLATION, landing), path).awaitTermination()
    return path


@pytest.mark.parametrize("cuts", [[], [3, 4, 9, 30], list(range(10, 100, 10))])
def test_a_kind_is_told_once_for_any_cut(spark, tmp_path, cuts):
    random_ = random.Random(2)
    rows = [(random_.choice(["p", "q", None]), random_.choice(["a", "b", "c", None, f"rare{i}"])) for i in range(100)]
    path = told(spark, rows, tmp_path, cuts)
    want = governance.repeat_violations(spark.createDataFrame(rows, VIOLATION)).select("project", "kind")
    key = lambda r: str(tuple(r))
    assert sorted(violations.read_alerts(spark, path).collect(), key=key) == sorted(want.collect(), key=key)


def test_a_repeated_batch_tells_the_same(spark, tmp_path):
    """A batch whose folder was written but whose cursor was not moved runs again."""
    rows = [("p", "a")] * 3 + [("p", "b")] * 2
    path = told(spark, rows, tmp_path, [])
    land(spark, [("p", "b"), ("p", "a")], VIOLATION, f"{tmp_path}/in", 2000)
    shutil.copytree(f"{path}/cursor", f"{tmp_path}/before")
    for _ in range(2):
        violations.repeat_alerts(source(spark, VIOLATION, f"{tmp_path}/in"), path).awaitTermination()
        assert rows_of(violations.read_alerts(spark, path)) == [("p", "a"), ("p", "b")]
        shutil.rmtree(f"{path}/cursor")
        shutil.copytree(f"{tmp_path}/before", f"{path}/cursor")


def item(number, day, hour, chosen=True, minute=0):
    at = dt.datetime(2024, 3, day, hour, minute)
    return (number, at, None, "c", chosen)


def test_late_items_revise_a_day_until_it_has_ended(spark, tmp_path):
    """Days of Shanghai (16:00 UTC); the watermark is a day behind the newest item of the batches before."""
    landing, path = f"{tmp_path}/in", f"{tmp_path}/out"
    batches = [
        [item(1, 1, 15), item(2, 1, 16), item(3, 1, 17, False)],  # one on the 1st, two on the 2nd
        [item(4, 3, 12)],  # the 3rd; from now on the watermark is the 2nd, 12:00 UTC, 20:00 in Shanghai
        [item(5, 2, 1), item(6, 1, 10)],  # late for the 2nd, which is open; too late for the 1st, which has ended
        [item(7, 5, 12)],
        [item(8, 2, 3)],  # the 2nd has ended as well
    ]
    for number, rows in enumerate(batches):
        land(spark, rows, ITEM, landing, 1000 + number)
        boards.daily_counts(source(spark, ITEM, landing), path).awaitTermination()
    days = {str(r.date): (r.item_count, r.selected_count) for r in boards.read_days(spark, path).collect()}
    assert days == {"2024-03-01": (1, 1), "2024-03-02": (3, 2), "2024-03-03": (1, 1), "2024-03-05": (1, 1)}
    writes = {str(r.date): r.writes for r in boards.read_days(spark, path).collect()}
    assert writes["2024-03-02"] == 2 and writes["2024-03-03"] == 1
    on_time = spark.createDataFrame([r for rows in batches[:2] for r in rows] + [batches[2][0], batches[3][0]], ITEM)
    assert {str(r.date): r.item_count for r in feed.daily_index(on_time, n=100).collect()} == {d: n for d, (n, _) in days.items()}


def test_boards_equal_the_window_at_every_edge(spark, tmp_path):
    random_ = random.Random(8)
    start = dt.datetime(2024, 3, 1)
    rows = []
    for i in range(300):
        at = start + dt.timedelta(minutes=random_.randrange(0, 60 * 24 * 6))
        shift = random_.choice([None, 1, 30, 100])  # found 100 hours late: the time of publication counts
        rows.append((i, at, shift and at - dt.timedelta(hours=shift), random_.choice("ab"), i % 3 == 0))
    rows += [(900 + i, start + dt.timedelta(days=2), None, "a", True) for i in range(150)]  # a third of all in one hour
    rows.sort(key=lambda r: r[1])
    landing, out = f"{tmp_path}/in", f"{tmp_path}/out"
    for number in range(3):
        land(spark, rows[150 * number : 150 * (number + 1)], ITEM, landing, 1000 + number)
    board = boards.rolling_board(source(spark, ITEM, landing), delay="200 hours")
    running = board.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/cursor")
    land(spark, [(5000, start + dt.timedelta(days=20), None, "a", False)], ITEM, landing, 2000)
    running.trigger(availableNow=True).start().awaitTermination()
    got = {}
    for r in spark.read.schema(board.schema).parquet(f"{out}/rows").collect():
        got.setdefault(r.edge, {})[r.category] = (r.item_count, r.selected_count)
    assert len(got) > 150
    items = spark.createDataFrame(rows, ITEM).cache()
    for edge in sorted(got)[:: len(got) // 12]:
        kept = feed.feed_window(items, now=edge, window="24h", mode="all").filter(F.col("timeline_ts") < F.lit(edge))
        want = kept.groupBy("category").agg(F.count(F.lit(1)).alias("n"), F.count_if("selected").alias("s"))
        assert got[edge] == {r.category: (r.n, r.s) for r in want.collect()}


def union_find(edges):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {x: find(x) for x in root}


def test_merges_that_arrive_later(spark, tmp_path):
    random_ = random.Random(4)
    edges = [(random_.randrange(60), random_.randrange(60)) for _ in range(50)] + [(200 + i, 201 + i) for i in range(40)] + [(7, 7), (None, 3), (4, None)]
    random_.shuffle(edges)
    path = f"{tmp_path}/classes"
    sizes = []
    for batch in range(5):
        part = spark.createDataFrame(edges[20 * batch : 20 * (batch + 1)] or [(None, None)], "a LONG, b LONG")
        for _ in range(1 + (batch == 2)):  # one batch is repeated
            classes.merge(part, path, batch)
        want = union_find(edges[: 20 * (batch + 1)])
        assert {r.member: r.name for r in classes.read(spark, path).collect()} == {m: n for m, n in want.items() if m != n}
        sizes.append(sum(m != n for m, n in want.items()))
        # Every member or name has one row for ever: what was written before stays.
        rows = spark.read.parquet(f"{path}/v*")
        assert rows.count() == rows.select("member").distinct().count()
    everyone = spark.createDataFrame([(m,) for m in [*want, 999]], "member LONG")
    assert {r.member: r.name for r in classes.classes_of(everyone, path).collect()} == {**want, 999: 999}
    small = spark.createDataFrame([(990, 991)], "a LONG, b LONG")
    classes.merge(small, path, 5)
    assert spark.read.parquet(f"{path}/v00000001-{6:012d}").collect() == [(991, 990)]


def test_merges_send_no_side_through_the_driver(spark, tmp_path, monkeypatch):
    plans = []

    def seen(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return checkpoint(df)

    monkeypatch.setattr(classes, "checkpoint", seen)
    monkeypatch.setattr(links, "checkpoint", seen)
    for batch in range(2):
        edges = spark.range(batch * 50, batch * 50 + 80).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
        classes.merge(edges, f"{tmp_path}/classes", batch)
    everyone = spark.range(131).withColumnRenamed("id", "member")
    assert {r.name for r in classes.classes_of(everyone, f"{tmp_path}/classes").collect()} == {0}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
