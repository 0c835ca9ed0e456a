"""Every registered query against its SQL, on whole tables."""

from __future__ import annotations

import oracle
import pytest

import __spark_entry__ as contract
from tidemark.plans.catalog import ORACLE, PLANS

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, name):
    sql = contract.oracle_sql()[name]
    assert oracle.difference(spark, contract.queries()[name], sql, FOLDER) is None


def test_every_query_has_sql():
    assert set(PLANS) == set(ORACLE), "every query of the library itself can be said in SQL"


def test_entry(spark):
    rows = contract.entry(spark)
    assert rows.columns == ["id", "title", "timeline_ts", "page_count", "has_more"]
    assert rows.count() > 0


def test_related_stories_start_from_every_customer(spark):
    got = contract.queries()["feed_related_stories_all"](spark, FOLDER).select("story_id").distinct()
    orders, lines = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("orders", "lineitem"))
    want = orders.join(lines, orders.o_orderkey == lines.l_orderkey).filter("o_custkey <> l_suppkey").select("o_custkey").distinct()
    assert want.count() and not want.exceptAll(got).count() and not got.exceptAll(want).count()


def test_some_consumers_are_two_hops_away(spark):
    got = contract.queries()["governance_consumers_two_hops"](spark, FOLDER)
    assert {r.hops for r in got.select("hops").distinct().collect()} == {1, 2}
