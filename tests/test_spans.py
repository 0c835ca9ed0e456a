"""Spans of any length, states as of a moment of each row, and sketches."""

from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tidemark.functions import spans
from tidemark.operators import feed, research

DAY = dt.date


def key(row):
    return str(tuple(row))


def test_spans_hold_what_lies_between(spark):
    random_ = random.Random(1)
    limits = [(random_.randrange(512), random_.randrange(512), random_.choice("xy")) for _ in range(150)]
    limits += [(0, 511, "x"), (0, 0, "x"), (511, 511, "y"), (256, 255, "x"), (None, 5, "x"), (5, None, "x"), (1, 510, None)]
    points = [(random_.randrange(512), random_.choice("xyz")) for _ in range(200)] + [(0, "x"), (511, "y"), (None, "x"), (3, None)]
    left = spark.createDataFrame(points, "at LONG, k STRING")
    right = spark.createDataFrame([(i, *s) for i, s in enumerate(limits)], "span INT, low LONG, high LONG, k STRING")
    got = spans.holding(left, F.col("at"), right, F.col("low"), F.col("high"), ["k"], bits=9).select("at", "k", "span")
    want = [
        (a, k, i) for a, k in points for i, (low, high, of) in enumerate(limits)
        if None not in (a, k, low, high) and k == of and low <= a <= high
    ]
    assert sorted(got.collect(), key=key) == sorted(want, key=key)
    none = spans.holding(left, F.col("at"), right.limit(0), F.col("low"), F.col("high"), ["k"], bits=9)
    assert none.columns == ["k", "at", "span", "low", "high"] and none.collect() == []


def test_a_phase_of_any_length_makes_few_rows(spark):
    ages = spark.createDataFrame([(DAY(1, 1, 1), DAY(9999, 12, 31)), (DAY(1, 1, 2), DAY(9999, 12, 30))], "start DATE, end DATE")
    day = lambda c: F.datediff(c, F.lit("0001-01-01").cast("date"))
    sizes = ages.select(F.size(spans.blocks(day("start"), day("end"), research.DATE_BITS)).alias("n")).collect()
    assert max(r.n for r in sizes) < 50


def test_running_and_overlapping_phases(spark):
    events = [("s", DAY(2024, 1, 1), "a"), ("s", DAY(2030, 6, 1), "b"), ("s", DAY(1, 1, 1), "c"), ("t", DAY(2024, 1, 1), "d"), ("s", None, "e"), (None, DAY(2024, 1, 1), "f")]
    events += [("s", DAY(2024, 1, 1), "a")] + [("hot", DAY(2024, 2, 1 + i % 28), f"h{i}") for i in range(300)]
    phases = [("s", "running", DAY(2024, 1, 1), None), ("s", "dawn", None, DAY(1999, 1, 1)), ("s", "overlap", DAY(2023, 12, 31), DAY(2024, 1, 1)),
              ("s", "reversed", DAY(2024, 2, 1), DAY(2024, 1, 1)), ("hot", "all", None, None)]
    placed = research.assign_phase(
        spark.createDataFrame(events, "subject STRING, date DATE, name STRING"),
        spark.createDataFrame(phases, "subject STRING, phase STRING, start DATE, end DATE"),
    )
    assert placed.columns == ["subject", "date", "name", "phase"]
    got = sorted((r.name, r.phase or "") for r in placed.filter("subject <> 'hot' OR subject IS NULL").collect())
    assert got == [
        ("a", "overlap"), ("a", "overlap"), ("a", "running"), ("a", "running"), ("b", "running"), ("c", "dawn"), ("d", ""), ("e", ""), ("f", ""),
    ]
    assert placed.filter("subject = 'hot' AND phase = 'all'").count() == 300
    everyone = spark.createDataFrame([("now", DAY(2024, 1, 1), None)], "phase STRING, start DATE, end DATE")
    for_all = research.assign_phase(spark.createDataFrame(events, "subject STRING, date DATE, name STRING"), everyone)
    assert for_all.filter("phase = 'now'").count() == 305
    assert {r.name for r in research.outside_phases(for_all).collect()} == {"c", "e"}


def test_every_comparison_has_its_own_cut(spark):
    """A key with a third of the rows, ties, nothing before the cut, nulls, and equal moments."""
    random_ = random.Random(3)
    start = DAY(2020, 1, 1)
    keys = ["hot"] * 5 + [f"k{i}" for i in range(10)]

    def day():
        return start + dt.timedelta(days=random_.randrange(0, 400))

    states = [(random_.choice(keys), day(), i, random_.choice(["u", "v", None])) for i in range(600)]
    states += [("k1", DAY(2020, 5, 5), 1000 + i, f"tie{i}") for i in range(5)] + [(None, start, 1, "nobody"), ("k2", None, 1, "never")]
    cuts = [(i, random_.choice(keys), day()) for i in range(500)]
    cuts += [(900, "k1", DAY(2020, 5, 5)), (901, "k1", DAY(2019, 1, 1)), (902, "unknown", start), (903, None, start), (904, "k2", None), (904, "k2", None)]
    given = spark.createDataFrame(states, "party STRING, date DATE, seq INT, value STRING")
    asked = spark.createDataFrame(cuts, "n INT, party STRING, cut_date DATE")
    got = research.as_of_each(asked, given, keys=["party"], value="value", tie=["seq"])
    assert got.columns == ["n", "party", "cut_date", "value"]

    def last(party, cut):
        before = [s for s in states if cut and party and s[0] == party and s[1] and s[1] <= cut]
        return max(before, key=lambda s: s[1:3])[3] if before else None

    assert sorted(map(tuple, got.collect()), key=str) == sorted([(n, p, c, last(p, c)) for n, p, c in cuts], key=str)
    same = research.as_of(given.dropna(), cut_date="2020-09-01", keys=["party"], value="value", tie=["seq"]).collect()
    each = asked.select("party").dropna().distinct().withColumn("cut_date", F.lit("2020-09-01").cast("date"))
    found = research.as_of_each(each, given.dropna(), keys=["party"], value="value", tie=["seq"]).filter("value IS NOT NULL")
    assert {(r.party, r.value) for r in found.collect()} == {(r.party, r.value) for r in same}
    assert research.as_of_each(asked, given.limit(0), keys=["party"], value="value").filter("value IS NOT NULL").count() == 0


def test_roots_with_a_cut_per_trait(spark):
    traits = spark.createDataFrame([("t", DAY(2020, 1, 2)), ("u", DAY(2019, 1, 1)), ("v", None)], "trait STRING, cut_date DATE")
    links = spark.createDataFrame([("t", 1), ("t", 2), ("t", 3), ("u", 1), ("v", 1)], "trait STRING, event INT")
    events = spark.createDataFrame([(1, DAY(2020, 1, 2)), (2, DAY(2020, 1, 1)), (3, DAY(2020, 1, 3))], "event INT, date DATE")
    got = {r.trait: (r.events, r.root) for r in research.roots(traits, links, events).collect()}
    assert got == {"t": (2, 2), "u": (0, None), "v": (0, None)}


def test_sketches_of_days_merge_to_any_range(spark):
    signals = spark.range(40_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 5)).alias("topic_id"),
        F.concat(F.lit("s"), F.pmod(F.xxhash64("id"), F.lit(9000))).alias("source_name"),
        F.timestamp_seconds(F.col("id") * 100 + 1_700_000_000).alias("ts"),
    )
    sketches = feed.source_sketches(signals).cache()
    assert sketches.count() == signals.select("topic_id", F.to_date("ts")).distinct().count()
    for first, last in ((None, None), ("2023-11-20", "2023-12-05"), ("2023-12-01", None)):
        inside = signals
        inside = inside.filter(F.to_date("ts") >= first) if first else inside
        inside = inside.filter(F.to_date("ts") <= last) if last else inside
        exact = {r[0]: r[1] for r in inside.groupBy("topic_id").agg(F.count_distinct("source_name")).collect()}
        got = {r.topic_id: r.sources for r in feed.source_estimates(sketches, first=first, last=last).collect()}
        assert got.keys() == exact.keys()
        assert all(abs(got[t] - n) <= feed.SKETCH_ERROR * n for t, n in exact.items())
    empty = feed.source_estimates(sketches, first="2099-01-01")
    assert empty.collect() == []


def test_spans_are_not_broadcast(spark):
    """What is exploded is larger than Spark takes it for, and must not pass the driver whole."""
    points = spark.range(100).select(F.col("id").alias("at"), F.col("id").alias("key"))
    held = spark.range(100).select(F.lit(0).alias("low"), F.col("id").alias("high"), F.col("id").alias("key"))
    found = spans.holding(points, F.col("at"), held, F.col("low"), F.col("high"), ["key"], bits=8)
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 100
