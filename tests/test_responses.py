"""Saved responses and report documents, from JSON to the operators."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import functions as F

from tidemark.operators import feed, storage
from tidemark.sources import tables


def saved(spark, tmp_path, name, documents, schema):
    (tmp_path / name).mkdir()
    for n, document in enumerate(documents):
        (tmp_path / name / f"{n}.json").write_text(json.dumps(document))
    return tables.read_json(spark, f"{tmp_path}/{name}", schema)


def test_topics(spark, tmp_path):
    item = {"rank": 1, "title": "T", "sourceCount": 3, "signalCount": 9, "sourceNames": ["a", "b"], "latestAt": "2026-01-01T00:00:00Z"}
    given = [{"schemaVersion": 1, "count": 2, "items": [item | {"links": {"story": "https://site.test/story/s1"}}, {"rank": 2}]}, {"schemaVersion": 1, "count": 0, "items": []}]
    rows = tables.topics(saved(spark, tmp_path, "topics", given, tables.TOPIC_PAGE)).orderBy("rank").collect()
    assert [(r.rank, r.source_count, r.source_names, r.story_link) for r in rows] == [
        (1, 3, ["a", "b"], "https://site.test/story/s1"), (2, None, None, None),
    ]


def test_stories_their_reports_edges_and_merges(spark, tmp_path):
    def report(n, day):
        return {"id": f"r{n}", "title": f"R{n}", "source": {"name": "x"}, "publishedAt": f"2026-01-{day:02d}T00:00:00Z", "links": {}}

    def to(story):
        return {"title": story, "links": {"api": f"https://site.test/api/v1/stories/{story}?x=1"}}

    given = [
        {"status": 200, "asked": "/api/v1/stories/s1", "story": {"id": "s1", "title": "S", "status": "settled", "latest": "l", "digest": "d",
         "reports": [report(2, 5), report(1, 2)], "storyline": [to("s2"), to("s2")], "related": [to("s3"), {"title": "none"}]}},
        {"status": 308, "asked": "/api/v1/stories/old", "location": "https://site.test/api/v1/stories/mid"},
        {"status": 308, "asked": "/api/v1/stories/mid", "location": "/api/v1/stories/s1"},
        {"status": 404, "asked": "/api/v1/stories/gone"},
    ]
    pages = saved(spark, tmp_path, "stories", given, tables.STORY_PAGE)
    assert [tuple(r) for r in tables.stories(pages).collect()] == [("s1", "S", "settled", "l", "d")]
    edges = tables.story_edges(pages)
    assert sorted(tuple(r) for r in edges.collect()) == [("s1", "s2", "storyline"), ("s1", "s3", "related")]
    reports = tables.story_reports(pages)
    shown = feed.story_timeline(reports, now=dt.datetime(2026, 1, 10)).orderBy("position").collect()
    assert [(r.report_id, r.status, r.latest) for r in shown] == [("r2", "settled", "r2"), ("r1", "settled", "r2")]
    ids = spark.createDataFrame([("old",), ("s1",), ("gone",)], "id STRING")
    ends = {r.id: r.story_id for r in feed.resolve_story(tables.story_aliases(pages), ids).collect()}
    assert ends == {"old": "s1", "s1": "s1", "gone": "gone"}
    near = feed.related(ids.filter("id = 's1'").select(F.col("id").alias("story_id")), edges, hops=1)
    assert {r.related_id for r in near.collect()} == {"s2", "s3"}


def test_daily_index(spark, tmp_path):
    given = [{"schemaVersion": 1, "count": 1, "items": [{"date": "2026-01-02", "lead": "x", "links": {"site": "https://site.test/d"}}]}]
    rows = tables.daily_dates(saved(spark, tmp_path, "dailies", given, tables.DAILY_INDEX), "site").collect()
    assert [tuple(r) for r in rows] == [(dt.date(2026, 1, 2), "x", "https://site.test/d")]


def test_report_document(spark, tmp_path):
    tiered = spark.createDataFrame(
        [("green", "c", "/d/c", 10, "d"), ("yellow", "y", "/d/y", 20, "d"), ("red", "r", "/d/r", 30, "d"), ("none", "n", "/d/n", 5, "d")],
        "tier STRING, name STRING, path STRING, size_kb LONG, disk STRING",
    )
    notes = spark.createDataFrame(
        [("/d/c", "10 KB", ["p"], ["/d/c/x"], [("l", "rm")], None, None), ("/d/y", None, None, None, None, "high", None), ("/d/r", None, None, None, None, None, "ours"), ("/gone", None, None, None, None, "x", "x")],
        "path STRING, size_estimate STRING, kill_processes ARRAY<STRING>, trash_paths ARRAY<STRING>, commands ARRAY<STRUCT<label: STRING, cmd: STRING>>, risk STRING, why_keep STRING",
    )
    entries = spark.createDataFrame([("/d/no", True), ("/d/c/1", False)], "path STRING, denied BOOLEAN")
    disks = spark.createDataFrame([("d", 100, 80)], "disk STRING, total_kb LONG, used_kb LONG")
    scan = {"generated_at": "2026-05-28 12:00:00", "scan_seconds": 42.1, "system": {"os": "x", "disk_total": "1 TB"}, "groups": {}}
    scans = saved(spark, tmp_path, "scan", [scan], tables.SCAN)
    summary = spark.createDataFrame([("fine", ["first"], ["later"])], "overview STRING, priority ARRAY<STRING>, long_term ARRAY<STRING>")
    sections = storage.report_sections(tiered, entries, disks, notes=notes, scans=scans, summary=summary)
    storage.write_report(sections, f"{tmp_path}/report")
    got = {}
    for r in spark.read.text(f"{tmp_path}/report").collect():
        got.setdefault(r.section, []).append(json.loads(r.value))
    assert got["green"] == [{"name": "c", "path": "/d/c", "size_estimate": "10 KB", "kill_processes": ["p"], "trash_paths": ["/d/c/x"], "commands": [{"label": "l", "cmd": "rm"}], "size_kb": 10}]
    assert got["yellow"] == [{"name": "y", "path": "/d/y", "risk": "high", "size_kb": 20}]
    assert got["red"] == [{"name": "r", "path": "/d/r", "why_keep": "ours", "size_kb": 30}]
    assert got["meta"] == [{"generated_at": "2026-05-28 12:00:00", "scan_seconds": 42.1}] and got["system"] == [{"os": "x", "disk_total": "1 TB"}]
    assert got["denied"] == [{"path": "/d/no"}]
    assert {"overview": "fine", "priority": ["first"], "long_term": ["later"]} in got["summary"] and len(got["summary"]) == 2
    assert [r["rank"] for r in sorted(got["top5"], key=lambda r: r["rank"])] == [1, 2, 3, 4]
