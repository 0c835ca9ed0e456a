from __future__ import annotations

import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import lexicon
from tidemark.operators import governance, style
from tidemark.operators.style import Phrase

FOLDER = "/root/testdata/sf0.001"
LEXICON = "rule_id STRING, phrase STRING, replacement STRING"


def in_order(rows):
    return sorted((tuple(r) for r in rows), key=str)


def table(spark, phrases):
    return spark.createDataFrame([tuple(p) for p in phrases], LEXICON)


@pytest.fixture
def corpus(spark):
    random_ = random.Random(5)
    texts = ["".join(random_.choice("aab é首😀。\n") for _ in range(random_.randrange(0, 120))) for _ in range(80)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, None), (2, ""), (3, texts[3]), (4, "aaaa"), (None, "aab" * 30), (90, "ab" * 20_000)]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)


def test_a_table_finds_what_expressions_find(spark, corpus):
    """Overlapping phrases, one inside the other, one that overlaps itself, single characters, one that is everywhere."""
    random_ = random.Random(6)
    words = {"a", "aa", "aab", "aabaab", "首", "é首", "😀", "a😀", " ", "\n", "never there", "b", "ab", "ababababab", "。\n"}
    words |= {"".join(random_.choice("aab é首😀") for _ in range(random_.randrange(1, 12))) for _ in range(150)}
    phrases = [Phrase(f"r{i}", w, None if i % 3 else f"{i}") for i, w in enumerate(sorted(words))] + [Phrase("again", "aab")]
    got = in_order(style.phrase_hits(corpus, table(spark, phrases)).collect())
    assert got == in_order(style.phrase_hits(corpus, phrases).collect())
    assert len(got) > 1000


def test_empty_lists_and_texts(spark, corpus):
    odd = table(spark, [("e", "", None), ("n", None, None)])
    assert style.phrase_hits(corpus, odd).collect() == []
    assert style.phrase_hits(corpus.limit(0), table(spark, [("a", "a", None)])).collect() == []
    assert {r.phrases for r in style.phrase_variety(corpus, odd.select("phrase")).collect()} == {0}


def test_phrases_with_blanks(spark):
    phrases = ["不是说xxx不行而是说", "有个xxx的", "axxxbxxxc", "aaxxxaa", "？？？xxx走", "plain", "xxxend", "plain"]
    texts = [
        "不是说这个不行而是说那个", "不是说这个。不行而是说那个", "有个的", "a1b2c", "a1b。2c", "a1c2b3c", "aaa", "aaaa", "？？？走", "？？？。走", "plain end",
        "b a a b b c", "a b\nc a b c", "", None, "aab。aac aa",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    lists = spark.createDataFrame([(p,) for p in phrases], "phrase STRING")
    got = in_order(style.phrase_variety(docs, lists, minimum=1).collect())
    want = style.phrase_variety(docs, phrases, minimum=1).na.fill({"phrases": 0, "enough": False})
    assert got == in_order(want.collect())


def test_retired_symbols_from_a_table(spark):
    files = spark.createDataFrame(
        [("p", "/p/a.md", "old_fn and old_fn, old_"), ("p", "/p/CHANGELOG.md", "old_fn"), ("q", "/q/b.md", "OLD"), ("q", "/q/c.md", None)],
        "project STRING, path STRING, text STRING",
    )
    symbols = ["old_fn", "old_", "OLD", "gone"]
    got = governance.retired_refs(files, spark.createDataFrame([(s,) for s in symbols], "symbol STRING"))
    assert in_order(got.collect()) == in_order(governance.retired_refs(files, symbols).collect())


def test_a_text_sends_one_row_per_phrase(spark):
    """Not one per place: phrases that are everywhere would be shuffled as often as they occur."""
    docs = spark.createDataFrame([(1, "ab" * 20_000), (2, "abé" * 5_000 + "é"), (3, "c")], "doc_id LONG, text STRING")
    phrases = spark.createDataFrame([("a",), ("ab",), ("é",), ("éé",), ("abababab",)], "phrase STRING")
    got = lexicon._held(docs, phrases, "doc_id")
    assert sorted((r.doc_id, r.phrase, r.hits) for r in got.join(phrases, "phrase").collect()) == [
        (1, "a", 20_000), (1, "ab", 20_000), (1, "abababab", 5_000), (2, "a", 5_000), (2, "ab", 5_000), (2, "é", 5_001), (2, "éé", 1),
    ]
    assert got.count() < 20


def test_blanks_in_texts_with_many_places(spark, monkeypatch):
    """The phrases of a text are told in one scan, whatever the number of places, and in blocks all the same."""
    docs = spark.createDataFrame([(1, "ab" * 20_000), (2, "b。a" * 5_000), (3, None)], "doc_id LONG, text STRING")
    phrases = [f"axxx{'ab' * n}" for n in range(1, 40)] + ["bxxxa", "aaxxxb", "b。xxxb"]
    lists = spark.createDataFrame([(p,) for p in phrases], "phrase STRING")
    for block in (lexicon.BLOCK, 7):
        monkeypatch.setattr(lexicon, "BLOCK", block)
        got = style.phrase_variety(docs, lists, minimum=1).select("doc_id", "phrases")
        assert in_order(got.collect()) == [(1, 40), (2, 1), (3, 0)]


def test_a_file_sends_one_row_per_symbol(spark):
    files = spark.createDataFrame([("p", "/p/a.md", "old " * 3_000), ("p", "/p/b.md", "older")], "project STRING, path STRING, text STRING")
    symbols = spark.createDataFrame([("old",), ("old ",), ("er",)], "symbol STRING")
    got = in_order(governance.retired_refs(files, symbols).collect())
    assert got == [("p", "/p/a.md", "old", 3_000), ("p", "/p/a.md", "old ", 3_000), ("p", "/p/b.md", "er", 1), ("p", "/p/b.md", "old", 1)]
    named = files.select(F.struct("project", "path").alias("file"), "text")
    assert lexicon._held(named, symbols.withColumnRenamed("symbol", "phrase"), "file").count() < 10


def test_a_long_list_costs_little_more_than_a_short_one(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    pieces = docs.select(F.explode(F.array(*[F.substring("text", 40 * i + 1, 5 + 3 * i) for i in range(6)])).alias("phrase")).distinct()
    pieces = pieces.filter("length(phrase) > 3").orderBy(F.xxhash64("phrase")).limit(3000).collect()

    def seconds(n):
        listed = table(spark, [(str(i), r.phrase, None) for i, r in enumerate(pieces[:n])])
        start = time.perf_counter()
        style.phrase_hits(docs, listed).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds(10)
    few, many = min(seconds(30) for _ in range(2)), min(seconds(len(pieces)) for _ in range(2))
    assert len(pieces) == 3000 and many < 2 * few + 2


@pytest.mark.parametrize("held, join", [(lexicon.HELD, "BroadcastHashJoin"), (0, "SortMergeJoin")])
def test_a_short_list_goes_to_the_texts(spark, corpus, monkeypatch, held, join):
    monkeypatch.setattr(lexicon, "HELD", held)
    phrases = spark.createDataFrame([("a", "a"), ("b", "ab"), ("c", "首"), ("c", "首"), ("d", "nowhere"), ("e", ""), ("f", None)], "rule STRING, phrase STRING")
    # Not by the size that Spark expects of a list, which is far too low behind an explode and far too high behind a filter.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = lexicon.counts(corpus, phrases)
        assert join in got._jdf.queryExecution().executedPlan().toString()
        rows = in_order(got.select("doc_id", "rule", "hits").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    texts = [(r.doc_id, r.text or "") for r in corpus.collect()]
    listed = [(r.rule, r.phrase) for r in phrases.collect() if r.phrase]
    assert rows == in_order((i, rule, t.count(p)) for i, t in texts for rule, p in listed if p in t)


@pytest.mark.parametrize("packed, blocks", [(100, 1), (3, 4)])
def test_a_longer_list_is_packed_and_no_row_is_shuffled(spark, monkeypatch, packed, blocks):
    """One row per text and phrase is many times the text, so a join of these rows by a shuffle fills the disks."""
    random_ = random.Random(7)
    texts = ["".join(random_.choice("aab é首😀。\n") for _ in range(random_.randrange(0, 150))) for _ in range(60)] + [None, "", "ab" * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")
    words = {"a", "aa", "é", "首", "😀", "aabaab", "ababababab", "never there", ""}
    words |= {"".join(random_.choice("aab é首😀") for _ in range(random_.randrange(1, 12))) for _ in range(120)}
    listed = [(f"r{i}", w, None if i % 3 else i) for i, w in enumerate(sorted(words))] + [("again", "aab", 1), ("again", "aab", 1), ("none", None, 2)]
    phrases = spark.createDataFrame(listed, "rule STRING, phrase STRING, n INT")
    held = lexicon._bytes(phrases.filter("phrase <> ''")) // (packed * blocks) + 1 if blocks > 1 else 2_000
    monkeypatch.setattr(lexicon, "HELD", held)
    monkeypatch.setattr(lexicon, "PACKED", packed)
    asked, packed_ = [], lexicon._packed
    monkeypatch.setattr(lexicon, "_packed", lambda docs, listed, key: asked.append(len(listed)) or packed_(docs, listed, key))
    got = lexicon.counts(docs, phrases)
    plan = got._jdf.queryExecution().executedPlan().toString()
    # Texts are numbered and read once, whatever the number of blocks.
    assert asked == [blocks] and plan.count("MapInArrow") == 1 and "Join" not in plan and "Exchange" not in plan
    rows = in_order(got.select("doc_id", "rule", "n", "phrase", "hits").collect())
    assert rows == in_order((i, r, n, p, t.count(p)) for i, t in enumerate(texts) if t for r, p, n in listed if p and p in t)
    variety = style.phrase_variety(docs, phrases.select("phrase"), minimum=9).collect()
    seen = [(i, sum(p in (t or "") for p in {p for _, p, _ in listed if p})) for i, t in enumerate(texts)]
    assert in_order(variety) == in_order((i, n, n >= 9) for i, n in seen)


def test_packed_phrases_that_share_a_hash(monkeypatch):
    """The hash only leads to a phrase, so all of one length may have the same."""
    monkeypatch.setattr(lexicon, "_LETTER", np.ones(256, np.uint64))
    listed = pa.table({"phrase": ["ba", "ab", "aba", "é", "bb", "ab", "首", "abababab", "babababa"], "n": list(range(9))})
    texts = ["abab abbé", "首", "a", "b", "babababab"]
    held = lexicon._Packed(listed)
    got = []
    for size, number, text, at in held.places(lexicon._Texts([t.encode() for t in texts])):
        rows, which = held.listed(number)
        got += zip(held.rows.take(rows)["phrase"].to_pylist(), held.rows.take(rows)["n"].to_pylist(), text[which].tolist(), at[which].tolist(), strict=True)
    starts = [len("\n".join(texts[:i]).encode()) + (i > 0) for i in range(len(texts))]
    want = [
        (p, n, i, starts[i] + at)
        for n, p in enumerate(listed["phrase"].to_pylist())
        for i, t in enumerate(texts)
        for at in range(len(t.encode()))
        if t.encode()[at:].startswith(p.encode())
    ]
    assert sorted(got) == sorted(want)
