from __future__ import annotations

import hashlib

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import substrings
from tidemark.llm.words import Words, rolled

SCHEMA = "doc_id LONG, text STRING"


def check(spark, docs):
    rows = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substrings.remove_duplicates(rows).collect() if r.doc_id is not None)
    want = []
    for (doc_id, _), (w, cut) in zip(docs, brute.duplicate_words(docs), strict=True):
        if doc_id is not None:
            want.append((doc_id, len(w), sum(cut), " ".join(x for x, c in zip(w, cut, strict=True) if not c)))
    assert got == sorted(want)


def test_shared_passages(spark, prose):
    passages = [prose(n) for n in (13, 14, 20, 60)]
    docs = []
    for i in range(60):
        parts = [prose(prose.random.randrange(0, 30)) for _ in range(4)]
        parts.insert(2, passages[i % 4])
        if i % 3 == 0:
            parts.append(passages[(i + 1) % 4])
        docs.append((i, "\n".join(parts)))
    docs += [(100, docs[5][1]), (101, docs[5][1]), (102, passages[0] + " " + passages[1]), (103, "go " * 50), (104, "go " * 40)]
    check(spark, docs)


def test_boundaries_of_factors(spark, prose):
    """A window that begins in one source's factor and ends in the next one's is found in a third document."""
    a, b = prose(20).split(), prose(20).split()
    docs = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(a[-9:] + b[:9])), (9, " ".join(a + b))]
    check(spark, docs)
    rows = spark.createDataFrame(docs, SCHEMA)
    spans = {r.doc_id: [(s.start, s.words, s.source_id) for s in r.spans] for r in substrings.remove_duplicates(rows).collect()}
    assert [s[2] for s in spans[9]] == [1, 3, 2]


def test_odd_rows(spark, prose):
    text = prose(40)
    docs = [(1, None), (2, ""), (3, " \t\n"), (None, text), (5, text), (5, text), (6, text), (6, text + " tail"), (7, prose(12)), (-8, prose(30))]
    check(spark, docs)
    empty = substrings.remove_duplicates(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == []
    long = prose(40_000)
    check(spark, [(1, long), (2, long[1000:200_000])])


def test_random_small_alphabet(spark, prose):
    docs = [(i, " ".join(prose.random.choice("xy") for _ in range(prose.random.randrange(10, 60)))) for i in range(40)]
    check(spark, docs)


def test_documents_keep_their_columns(spark, prose):
    text = prose(30)
    rows = [(1, text, "en", "a", 9), (2, text, "de", "b", 9), (3, text + "\n\nown  words", "fr", "c", 9), (4, None, "es", None, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, tag STRING, pieces STRING, n_chars LONG")
    kept = substrings.deduplicated(docs)
    assert kept.columns == docs.columns
    got = {r.doc_id: tuple(r) for r in kept.collect()}
    assert set(got) == {1, 3, 4} and got[1][:4] == rows[0][:4] and got[3] == (3, "own words", "fr", "c", 9)
    assert got[1][4] == len(text) and got[4] == (4, None, "es", None, None)


@pytest.mark.parametrize("share", [1, 8, 1 << 40])
def test_crowded_anchors(spark, prose, monkeypatch, share):
    """Windows of anchors in many texts are dealt one by one; whichever anchors count as such, the rows are the same."""
    monkeypatch.setattr(substrings, "SHARE", share)
    passage, tail = prose(40), prose(9)
    docs = [(i, f"{prose(7)} {passage} {prose(6)} {tail if i % 2 else passage[:80]}") for i in range(40)]
    docs += [(60, passage), (61, prose(20)), (61, f"x {passage}"), (62, "go " * 300)]
    check(spark, docs)


def test_a_text_that_only_repeats_itself_stays_as_it_is(spark, prose):
    """It has looked-up windows, as another text shares them, but loses none: its blanks are not touched either."""
    text = f"{prose(20)}\n\n" + "echo\n" * 40
    docs = spark.createDataFrame([(1, text), (2, f"{prose(20)} " + "echo " * 30)], SCHEMA)
    left = {r.doc_id: r.text for r in substrings.deduplicated(docs).collect()}
    assert left[1] == text and "echo" not in left[2]


@pytest.mark.parametrize("share", [1, 1 << 40])
def test_repeats_inside_a_text(spark, prose, monkeypatch, share):
    """A window that a text repeats is asked for once, in whichever text it stands, and goes at all its places."""
    monkeypatch.setattr(substrings, "SHARE", share)
    a, b = prose(15), prose(21)
    docs = [(i, f"{prose(3)} {a} {prose(i % 4)} {a} {b} {'on off ' * (20 + i)}{prose(2)} {b} {a}") for i in range(12)]
    docs += [(3, docs[3][1]), (20, "on off " * 200), (21, "off on " * 7), (22, f"{b} " * 9), (0, f"{b} {b}")]
    check(spark, docs)
    rows = spark.createDataFrame(docs, SCHEMA).coalesce(1)
    by_doc = substrings._shared_anchors(rows).groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    texts = rows.withColumn("tag", F.monotonically_increasing_id()).join(by_doc, "doc_id").coalesce(1)
    runs = substrings._runs(texts.select("doc_id", "tag", "anchors", "text"), np.full(substrings.SLOTS, share == 1))
    asked = runs.filter("hashes IS NOT NULL").groupBy("tag", "anchor", "hashes").count()
    assert asked.filter("count > 1").count() == 0


def test_a_crowded_anchor_is_worked_by_many_tasks(spark, prose):
    """One phrase in every text, each time between other words: its windows do not all go to one part."""
    phrase = min((prose(5) for _ in range(300)), key=lambda p: rolled(Words([p.encode()]).flat, 5)[0])
    docs = spark.createDataFrame([(i, f"{prose(12)} {phrase} {prose(12)}") for i in range(400)], SCHEMA)
    shared = substrings._shared_anchors(docs).cache()
    crowded = substrings._crowded(shared)
    by_doc = shared.groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors"))
    texts = docs.withColumn("tag", F.lit(0).cast("long")).join(by_doc, "doc_id")
    runs = substrings._runs(texts.select("doc_id", "tag", "anchors", "text"), crowded)
    most = runs.groupBy("anchor").count().orderBy(F.desc("count")).first()
    rows = runs.filter(F.col("anchor") == most["anchor"])
    assert most["count"] > 400 and rows.filter("lone").count() == most["count"]
    assert rows.select("hashes").distinct().count() == most["count"]
    assert substrings._crowded(shared.limit(0)).sum() == 0
    shared.unpersist()


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    got = {r.doc_id: r for r in substrings.remove_duplicates(docs, with_text=False).collect()}
    for (doc_id, _), (w, cut) in zip(rows, brute.duplicate_words(rows), strict=True):
        kept = " ".join(x for x, c in zip(w, cut, strict=True) if not c)
        assert got[doc_id].kept_sha256 == hashlib.sha256(kept.encode()).hexdigest() and got[doc_id].n_removed == sum(cut)
