from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import feed
from tidemark.sources import tables

NOW = dt.datetime(2026, 1, 10, 12)
HOUR = dt.timedelta(hours=1)


@pytest.fixture
def items(spark):
    def item(key, discovered, published=None, selected=True, title="t", category="paper"):
        links = ("https://site.test/1", "https://origin.test/1")
        return (key, title, None, None, ("s",), links, published, discovered, category, 5, selected)

    rows = [
        item("exact72", NOW, NOW - 72 * HOUR),
        item("over72", NOW, NOW - 72 * HOUR - dt.timedelta(microseconds=1)),
        item("unpublished", NOW - HOUR),
        item("future", NOW - 2 * HOUR, NOW + 5 * HOUR),
        item("edge24", NOW - 24 * HOUR, NOW - 25 * HOUR),
        item("old", NOW - 25 * HOUR, NOW - 26 * HOUR),
        item("week", NOW - 7 * 24 * HOUR, None, False, "OpenLab 100%"),
    ]
    return spark.createDataFrame(rows, tables.FEED_ITEM.replace(" NOT NULL", ""))


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


def test_timeline_basis(items):
    basis = {r.id: r.timeline_ts for r in feed.with_timeline_ts(items).collect()}
    assert basis["exact72"] == NOW
    assert basis["over72"] == NOW - 72 * HOUR - dt.timedelta(microseconds=1)
    assert basis["unpublished"] == NOW - HOUR
    assert basis["future"] == NOW - 2 * HOUR


def test_windows(items):
    day = feed.feed_window(items, now=NOW, window="24h", mode="all")
    assert ids(day) == ["edge24", "exact72", "future", "unpublished"]
    published = feed.feed_window(items, now=NOW, window="24h", by="published")
    assert ids(published) == ["future"]
    assert "week" in ids(feed.feed_window(items, now=NOW, mode="all"))
    assert "week" not in ids(feed.feed_window(items, now=NOW))
    assert ids(feed.narrow(items, days=2, now=NOW)) == ["edge24", "exact72", "future", "old", "unpublished"]
    with pytest.raises(ValueError):
        feed.narrow(items, days=8, now=NOW)
    with pytest.raises(ValueError):
        feed.feed_window(items, now=NOW, by="score")


@pytest.mark.parametrize("kind", ["timestamp", "timestamp_ntz"])
def test_window_bound_reaches_the_scan(spark, tmp_path, items, kind):
    for column in ("discovered_at", "published_at"):
        items = items.withColumn(column, F.col(column).cast(kind))
    items.write.parquet(f"{tmp_path}/items")
    read = spark.read.parquet(f"{tmp_path}/items")
    plan = feed.feed_window(read, now=NOW, window="24h").select("id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(discovered_at" in plan
    assert "summary" not in plan.split("ReadSchema")[1].split("\n")[0]


def test_search_and_fallback(items):
    assert ids(feed.feed_search(items, "openlab 100%")) == ["week"]
    found = feed.search_with_fallback(items, "openlab", now=NOW).collect()
    assert [(r.id, r.outside_selection) for r in found] == [("week", True)]
    assert feed.search_with_fallback(items, "nothing here", now=NOW).count() == 0
    both = items.union(items.filter("id = 'old'").withColumn("title", F.lit("openlab")))
    assert ids(feed.search_with_fallback(both, "openlab", now=NOW)) == ["old"]
    for q in ("x", "x" * 201):
        with pytest.raises(ValueError):
            feed.feed_search(items, q)


@pytest.mark.parametrize("limit", [1, 2, 100])
def test_pages_concatenate(items, limit):
    recent = feed.feed_window(items.union(items.withColumn("id", F.concat("id", F.lit("-b")))), now=NOW, mode="all")
    whole = [r.id for r in recent.orderBy(F.desc("timeline_ts"), F.desc("id")).collect()]
    seen, after, more = [], None, True
    while more:
        page = feed.feed_page(recent, limit=limit, after=after).collect()
        assert page[0].page_count == len(page)
        seen += [r.id for r in page]
        after, more = (page[-1].timeline_ts, page[-1].id), page[0].has_more
    assert seen == whole


def test_hot_topics_follow_the_given_rank(spark):
    topics = spark.createDataFrame([(n, n + 1) for n in range(12)], "topic_id INT, rank INT")
    signals = spark.createDataFrame(
        [(0, "a", NOW), (1, "a", NOW), (1, "b", NOW), (1, "b", NOW + HOUR), (11, "z", NOW)],
        "topic_id INT, source_name STRING, ts TIMESTAMP",
    )
    board = feed.hot_topics(topics, signals).collect()
    assert [r["rank"] for r in board] == list(range(1, 11))
    assert (board[1].source_count, board[1].signal_count, board[1].source_names) == (2, 3, ["a", "b"])
    assert board[1].latest_at == NOW + HOUR and board[2].signal_count == 0


def test_story_settles_after_more_than_48_hours(spark):
    silent = {1: 48 * HOUR, 2: 48 * HOUR + dt.timedelta(seconds=1)}
    rows = [(s, s * 10, NOW - gap) for s, gap in silent.items()] + [(2, 5, NOW - 90 * HOUR)]
    told = feed.story_timeline(spark.createDataFrame(rows, "story_id INT, report_id INT, ts TIMESTAMP"), now=NOW)
    got = {(r.story_id, r.report_id): (r.position, r.status, r.latest) for r in told.collect()}
    assert got[1, 10] == (1, "developing", 10)
    assert got[2, 20] == (1, "settled", 20) and got[2, 5] == (2, "settled", 20)


def test_merges_are_followed_and_circles_reported(spark):
    alias = spark.createDataFrame([(i + 1, i) for i in range(1, 40)] + [(100, 101), (101, 100)], "old_id INT, new_id INT")
    ids_ = spark.createDataFrame([(40,), (1,), (100,), (7777,)], "id INT")
    got = {r.id: (r.story_id, r.closed) for r in feed.resolve_story(alias, ids_).collect()}
    assert got[40] == (1, True) and got[1] == (1, True) and got[7777] == (7777, True)
    assert got[100][1] is False


def test_story_links(spark):
    host = "https://site.test"
    links = [f"{host}/story/abc", f"{host}/story/gone", "https://other.test/story/abc", f"{host}.evil/story/abc", None]
    topics = spark.createDataFrame([(n, link) for n, link in enumerate(links)], "topic_id INT, story_link STRING")
    stories = spark.createDataFrame([("abc",)], "public_id STRING")
    got = {r.topic_id: (r.public_id, r.resolved) for r in feed.resolve_story_links(topics, stories, host=host).collect()}
    assert got == {0: ("abc", True), 1: ("gone", False), 2: (None, False), 3: (None, False), 4: (None, False)}


def test_daily_or_nearest(spark):
    days = [dt.date(2026, 1, d) for d in (1, 2, 5)]
    dailies = spark.createDataFrame([(d,) for d in days], "date DATE")
    pick = lambda day: [(r.date, r.exact) for r in feed.daily_or_nearest(dailies, F.lit(day)).collect()]
    assert pick("2026-01-02") == [(dt.date(2026, 1, 2), True)]
    assert pick("2026-01-04") == [(dt.date(2026, 1, 5), False)]
    empty = dailies.filter("false")
    assert feed.daily_or_nearest(empty, F.lit("2026-01-02")).count() == 0


def test_daily_is_cut_in_the_display_zone(spark):
    rows = [("a", dt.datetime(2026, 1, 1, 15, 59)), ("b", dt.datetime(2026, 1, 1, 16, 0)), ("c", dt.datetime(2026, 1, 2, 15, 59, 59))]
    items = spark.createDataFrame(rows, "id STRING, discovered_at TIMESTAMP_NTZ")
    assert ids(feed.daily(items, "2026-01-02")) == ["b", "c"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants_are_shown_in_the_display_zone_whatever_the_session_zone(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        instant = F.expr("timestamp '2026-01-01 16:30:00 UTC'")
        items = spark.range(1).select("id", instant.alias("discovered_at"), instant.alias("published_at"))
        shown = feed.display_time(items).select(F.col("shown_at").cast("string")).first()[0]
        assert shown == "2026-01-02 00:30:00"
        assert feed.daily(items, "2026-01-02").count() == 1 and feed.daily(items, "2026-01-01").count() == 0
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_daily_entries_keep_order_and_fall_back(spark, tmp_path):
    (tmp_path / "d.json").write_text(
        '{"date": "2026-01-01", "lead": "x", "unknown": 1, "sections": [{"title": "S", "items": ['
        '{"title": "one", "links": {"site": null, "original": "o1"}}, {"title": "two", "links": {"site": "s2", "original": "o2"}}]}],'
        ' "flashes": [{"title": "f", "links": {"site": null, "original": "o3"}}]}'
    )
    dailies = tables.read_json(spark, str(tmp_path), tables.DAILY)
    got = [(r.part, r.section, r.item_no, r.link) for r in feed.daily_entries(dailies).collect()]
    assert sorted(got, key=str) == [("flash", None, 0, "o3"), ("section", "S", 0, "o1"), ("section", "S", 1, "s2")]


def test_page_set(spark):
    rows = [
        (1, 1, "c", True), (1, 2, "c", False),
        (2, 1, "c", True), (2, 3, "c", False),
        (3, 1, "c", True), (3, 2, "d", False),
        (4, 1, "c", True),
        (5, 1, "c", True), (5, 1, "c", True), (5, 2, "c", False),
        (6, 1, "c", False), (6, 2, "c", False),
    ]
    pages = spark.createDataFrame(rows, "snapshot INT, page INT, cursor STRING, has_more BOOLEAN")
    got = {r.snapshot: r.complete for r in feed.check_pages(pages).collect()}
    assert got == {1: True, 2: False, 3: False, 4: False, 5: False, 6: False}


def test_fingerprint_ignores_order_and_sees_changes(items):
    one = feed.fingerprint(items).collect()
    assert feed.fingerprint(items.repartition(5, "id").select(*reversed(items.columns))).collect() == one
    assert feed.fingerprint(items.withColumn("score", F.lit(6))).collect() != one
    assert feed.fingerprint(items.filter("false")).collect()[0]["rows"] == 0


def test_contract_counts(items):
    broken = items.withColumn("score", F.lit(101)).withColumn("title", F.lit(None).cast("string"))
    got = {r.rule: r.violations for r in feed.check_items(broken).collect()}
    assert got["title present"] == 7 and got["score in 0..100"] == 7 and got["id present"] == 0


def test_feed_pages_are_read_with_unknown_fields(spark, tmp_path):
    (tmp_path / "p.json").write_text(
        '{"schemaVersion": 1, "extra": {}, "items": [{"id": "a", "title": "T", "originalTitle": null, "summary": null,'
        ' "source": {"name": "s"}, "links": {"site": "u", "original": "o"}, "publishedAt": null,'
        ' "discoveredAt": "2026-01-01T00:00:00Z", "category": "brand-new", "score": null, "selected": true, "more": 1}],'
        ' "page": {"count": 1, "hasMore": false, "nextCursor": null}}'
    )
    row = tables.feed_items(tables.read_json(spark, str(tmp_path), tables.FEED_PAGE), "site").collect()[0]
    assert (row.id, row.links.site, row.category, row.selected) == ("a", "u", "brand-new", True)


def test_related_stories_expand_only_from_what_is_new(spark):
    edges = spark.createDataFrame([(1, 2, "r"), (2, 1, "r"), (2, 3, "r"), (3, 2, "r"), (3, 4, "r"), (9, 1, "r")], "story_id INT, related_id INT, kind STRING")
    given = spark.createDataFrame([(1,)], "story_id INT")
    got = {(r.story_id, r.related_id): r.hops for r in feed.related(given, edges, hops=3).collect()}
    assert got == {(1, 2): 1, (1, 3): 2, (1, 4): 3}


def test_texts_are_searched_where_they_lie(spark):
    items = spark.createDataFrame([(1, "Alpha"), (2, "beta"), (3, "x")], "id INT, title STRING")
    texts = spark.createDataFrame([(2, None, "an ALPHA inside"), (3, "none", None), (4, "alpha", "")], "id INT, original_title STRING, summary STRING")
    assert sorted(r.id for r in feed.feed_search(items, "alpha", texts).collect()) == [1, 2]


def test_feed_queries_without_texts_do_not_read_documents(spark):
    from tidemark.plans.catalog import PLANS

    for name in ("feed_timeline_ts", "feed_window_24h_timeline", "feed_daily_index", "feed_display_time", "feed_public_pool"):
        plan = PLANS[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "documents.parquet" not in plan, name


@pytest.mark.parametrize("row", [0, 30, 1 << 16])
@pytest.mark.parametrize("hops", [1, 2, 3])
def test_related_by_lists_and_by_pairs(spark, monkeypatch, hops, row):
    monkeypatch.setattr(feed, "ROW", row)
    rng = random.Random(hops)
    edges = [(0, n) for n in range(1, 25)] + [(rng.randrange(40), rng.randrange(40)) for _ in range(45)] + [(None, 1), (1, None), (3, 3)]
    given = [*range(0, 40, 3), 0, 77]
    want = set()
    for story in set(given):
        seen, front = {story}, {story}
        for hop in range(1, hops + 1):
            front = {b for a, b in edges if a in front and a is not None and b is not None} - seen
            seen |= front
            want |= {(story, b, hop) for b in front}
    links = spark.createDataFrame(edges, "story_id LONG, related_id LONG")
    got = feed.related(spark.createDataFrame([(g,) for g in given], "story_id LONG"), links, hops=hops)
    assert got.columns == ["story_id", "related_id", "hops"]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_related_over_two_hops_does_not_shuffle_pairs(spark, tmp_path):
    # Forty stories lead to ten that all lead to the same thousand: forty thousand pairs.
    edges = spark.range(400).selectExpr("id % 40 AS story_id", "1000 + id DIV 40 AS related_id")
    edges = edges.union(spark.range(10_000).selectExpr("1000 + id % 10", "5000 + id DIV 10"))
    got = feed.related(spark.range(40).toDF("story_id"), edges, hops=2)
    got.write.parquet(f"{tmp_path}/related")
    assert spark.read.parquet(f"{tmp_path}/related").count() == 40 * 1010
    # Pairs are made by the last step; nothing is grouped or dealt behind it.
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    made = next(i for i, line in enumerate(plan) if "explode(__reached" in line)
    assert not any("Aggregate" in line or "Join" in line for line in plan[:made])
