from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from tidemark.functions.ordered import blocks, latest_before, previous_in_order, rank_in_order
from tidemark.operators import research

DAY = dt.timedelta(days=1)
START = dt.date(2020, 1, 1)


def test_gaps(spark):
    rows = [("s", START + DAY * n, f"e{n}", None) for n in (0, 10, 45, 400)] + [("t", START, "x", None)]
    events = spark.createDataFrame(rows, "subject STRING, date DATE, name STRING, trigger STRING")
    line = [(r.name, r.gap_days) for r in research.timeline(events).filter("subject = 's'").orderBy("date").collect()]
    assert line == [("e0", None), ("e10", 10), ("e45", 35), ("e400", 355)]
    assert [r.name for r in research.timeline_gaps(events, max_gap=35).collect()] == ["e400"]


def test_slices_equal_plain_windows(spark):
    """One key holds most rows; every slice width gives what one window over the whole group gives."""
    from pyspark.sql import Window as W

    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string").substr(1, 2)).alias("k"),
        F.xxhash64("id").alias("seq"), "id",
    )
    order = W.partitionBy("k").orderBy("seq")
    plain = rows.select(
        "id", F.row_number().over(order).alias("p"), F.lag("id").over(order).alias("b"),
        F.max(F.when(F.col("id") % 7 == 0, F.col("seq"))).over(order).alias("t"),
    )
    want = {r.id: (r.p, r.b, r.t) for r in plain.collect()}
    for width in (1 << 55, 1 << 62):
        by = blocks("seq", width)
        got = rank_in_order(rows, ["k"], ["seq"], by, "p")
        got = previous_in_order(got, ["k"], ["seq"], by, "id", "b")
        got = latest_before(got, ["k"], "seq", by, F.when(F.col("id") % 7 == 0, F.col("seq")), "t")
        assert {r.id: (r.p, r.b, r.t) for r in got.collect()} == want


def test_phases(spark):
    events = spark.createDataFrame([("s", START), ("s", START + DAY * 59), ("s", START + DAY * 60), ("t", START - DAY)], "subject STRING, date DATE")
    phase = spark.createDataFrame([("first", START, START + DAY * 59)], "phase STRING, start DATE, end DATE")
    got = sorted((str(r.date), r.phase) for r in research.assign_phase(events, phase).collect())
    assert [p for _, p in got] == [None, "first", "first", None]
    own = phase.withColumn("subject", F.lit("t"))
    assert research.outside_phases(research.assign_phase(events, own)).count() == 4


def test_scenarios_and_representatives(spark):
    rows = [("b1", "c1"), ("b2", "c1"), ("b2", "c2")] + [("c3", f"c{n}") for n in range(6)]
    rivals = spark.createDataFrame([(s, c, "direct", "高", float(n)) for n, (s, c) in enumerate(rows)] + [("a0", "x", "indirect", "低", 9.0)],
                                   "subject STRING, competitor STRING, type STRING, threat STRING, score DOUBLE")
    got = {r.subject: r.scenario for r in research.scenario(rivals, rivals).collect()}
    assert got == {"a0": "A", "b1": "B", "b2": "B", "c3": "C"}
    roles = {(r.subject, r.competitor): r.role for r in research.representatives(rivals, k=3).collect()}
    assert sorted(c for (s, c), r in roles.items() if s == "c3" and r == "in depth") == ["c3", "c4", "c5"]
    assert roles["a0", "x"] == "brief" and roles["b2", "c1"] == "in depth"
    totals = {(r.type, r.threat): r.competitors for r in research.threat_summary(rivals).collect()}
    assert totals["all", "all"] == 10 and totals["direct", "all"] == 9 and totals["indirect", "低"] == 1


def test_sources(spark):
    rows = [(1, "a", "reprint", "u3"), (1, "b", "primary", "u2"), (1, "c", "primary", "u1"), (2, "a", "rumour", "u4"), (3, "x", "media", "u5"), (3, "y", "media", "u6")]
    claims = spark.createDataFrame(rows, "claim_id INT, origin STRING, source_kind STRING, url STRING")
    assert {r.claim_id: r.url for r in research.best_source(claims).collect()} == {1: "u1", 2: "u4", 3: "u5"}
    assert [r.claim_id for r in research.single_source(claims).collect()] == [2]
    cites = spark.createDataFrame([("a", "b"), ("b", "root"), ("c", "root"), ("x", "y"), ("y", "x")], "origin STRING, cites STRING")
    got = {r.claim_id: (r.origins, r.independent) for r in research.independent_sources(claims, cites).collect()}
    assert got == {1: (3, 1), 2: (1, 1), 3: (2, 1)}
    # An origin that cites two others is still one origin, and one source.
    two = spark.createDataFrame([("a", "b"), ("a", "c"), ("z", "c")], "origin STRING, cites STRING")
    many = spark.createDataFrame([(1, "a"), (2, "a"), (2, "z"), (2, "q")], "claim_id INT, origin STRING")
    assert {r.claim_id: (r.origins, r.independent) for r in research.independent_sources(many, two).collect()} == {1: (1, 1), 2: (3, 2)}
    texts = spark.createDataFrame([(1, "有来源"), (9, "该信息暂缺"), (8, "断言")], "claim_id INT, text STRING")
    assert {r.claim_id: r.marked for r in research.unsourced(texts, claims).collect()} == {9: True, 8: False}


def test_as_of_roots_matrix(spark):
    values = spark.createDataFrame([("p", START, "old"), ("p", START + DAY, "new"), ("p", START + DAY * 2, "later")], "party STRING, date DATE, value STRING")
    assert [r.value for r in research.as_of(values, cut_date=START + DAY, keys=["party"], value="value").collect()] == ["new"]
    traits = spark.createDataFrame([("t1",), ("t2",)], "trait STRING")
    links = spark.createDataFrame([("t1", 1), ("t1", 2), ("t2", 3)], "trait STRING, event INT")
    events = spark.createDataFrame([(1, START + DAY), (2, START), (3, START + DAY * 9)], "event INT, date DATE")
    found = {r.trait: (r.events, r.root) for r in research.roots(traits, links, events, cut_date=START + DAY * 5).collect()}
    assert found == {"t1": (2, 2), "t2": (0, None)}
    cells = spark.createDataFrame([("price", "A", "1"), ("speed", "B", "2")], "dimension STRING, party STRING, value STRING")
    assert {tuple(r) for r in research.matrix(cells, ["A", "B"]).collect()} == {("price", "1", None), ("speed", None, "2")}
