from __future__ import annotations

import os
import subprocess
import sys

from pyspark.sql import functions as F

from tidemark.operators.feed import fingerprint
from tidemark.operators.reuse import result_key, reused


def jobs(spark, name, work):
    """How many jobs ``work`` runs."""
    context = spark.sparkContext
    context.setJobGroup(name, name)
    try:
        work()
        return len(context.statusTracker().getJobIdsForGroup(name))
    finally:
        context._jsc.clearJobGroup()


def counted(items, least):
    return items.filter(F.col("v") >= least).groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_an_unchanged_input_is_only_fingerprinted(spark, tmp_path):
    store, at = f"{tmp_path}/store", f"{tmp_path}/in"
    spark.range(5000).select((F.col("id") % 7).alias("k"), F.col("id").alias("v")).write.parquet(at)
    items = spark.read.parquet(at)
    first, found = reused(store, "counts", {"items": items}, {"least": 10}, counted)
    assert not found and rows(first) == rows(counted(items, 10))

    def never(**_):
        raise AssertionError("computed again")

    again = {}
    print_jobs = jobs(spark, "print", lambda: fingerprint(items).first())
    call_jobs = jobs(spark, "call", lambda: again.update(out=reused(store, "counts", {"items": items}, {"least": 10}, never)))
    second, found = again["out"]
    assert found and rows(second) == rows(first)
    # Beside the fingerprint's, only the one that reads the result's own schema.
    assert call_jobs <= print_jobs + 1
    # The order of rows and files is no change.
    shuffled = items.repartition(5, "v")
    assert reused(store, "counts", {"items": shuffled}, {"least": 10}, never)[1]


def test_what_changed_is_computed_again(spark, tmp_path):
    store = f"{tmp_path}/store"
    items = spark.createDataFrame([(1, 10), (1, 11), (2, 12), (None, None)], "k INT, v INT")
    calls = [
        ({"items": items}, {"least": 10}), ({"items": items}, {"least": 11}), ({"items": items.union(items.limit(1))}, {"least": 10}),
        ({"items": items.withColumn("v", F.col("v").cast("long"))}, {"least": 10}), ({"items": items.limit(0)}, {"least": 10}),
    ]
    assert len({result_key("counts", *c) for c in calls}) == len(calls)
    for inputs, parameters in calls:
        out, found = reused(store, "counts", inputs, parameters, counted)
        assert not found and rows(out) == rows(counted(**inputs, **parameters))
    assert all(reused(store, "counts", *c, counted)[1] for c in calls)
    assert not reused(store, "others", *calls[0], counted)[1]


def test_a_result_without_its_mark_does_not_count(spark, tmp_path):
    items = spark.createDataFrame([(1, 10)], "k INT, v INT")
    asked = ({"items": items}, {"least": 0})
    reused(str(tmp_path), "counts", *asked, counted)
    folder = f"{tmp_path}/counts/{result_key('counts', *asked)}"
    os.remove(f"{folder}/_SUCCESS")
    out, found = reused(str(tmp_path), "counts", *asked, counted)
    assert not found and rows(out) == [(1, 1)] and os.path.exists(f"{folder}/_SUCCESS")


def test_work_folders_go_once_results_are_stored(spark, tmp_path):
    # In a process of its own, because a clean ends all that other tests still read.
    script = """
import os, sys
from tidemark.session import clean, local_session, work_dir, written
spark = local_session(2)
rows = written(spark.range(9), "things")
stream = work_dir(spark, "stream")
rows.write.parquet(sys.argv[1])
gone = clean(spark)
assert len(gone) == 2 and stream in gone and not any(os.path.exists(g) for g in gone), gone
assert spark.read.parquet(sys.argv[1]).count() == 9 and clean(spark) == []
"""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", script, f"{tmp_path}/kept"], cwd=root, check=True, timeout=300)
