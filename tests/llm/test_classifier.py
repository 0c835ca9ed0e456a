from __future__ import annotations

import itertools
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import classifier


def test_linear_time_score_equals_all_pairs():
    random = np.random.default_rng(3)
    model = classifier.Machine(
        0.3, random.normal(size=classifier.FEATURES), random.normal(size=(classifier.FEATURES, classifier.FACTORS))
    )
    texts = [b"one two three", b"", b"LOUD!! a a a $$$", b"caf\xc3\xa9 12 \n x"]
    index, value, starts = classifier.features(texts, [None, 3, 10**9, 0])
    for d in range(len(texts)):
        own = range(starts[d], starts[d + 1])
        want = model.bias + sum(model.linear[index[i]] * value[i] for i in own)
        want += sum(model.factors[index[i]] @ model.factors[index[j]] * float(value[i]) * value[j] for i, j in itertools.combinations(own, 2))
        assert model.logits(index, value, starts)[d] == pytest.approx(want, rel=1e-4, abs=1e-4)


def test_features_do_not_depend_on_neighbours():
    texts = [b"a b c", b"x !! y\nx !! y", b"last one here"]
    every = classifier.features(texts, [1, 2, 3])
    for d, text in enumerate(texts):
        index, value, _ = classifier.features([text], [d + 1])
        own = slice(every[2][d], every[2][d + 1])
        assert sorted(zip(every[0][own], every[1][own], strict=True)) == sorted(zip(index, value, strict=True))


@pytest.fixture(scope="module")
def scored(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = classifier.fit(docs, labels)
    return classifier.score(docs.select("doc_id", "text", "n_chars"), model).join(labels, "doc_id").withColumn("held", classifier.held_out()).collect()


def test_held_out_accuracy(scored):
    held = [r for r in scored if r.held]
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)
    bad, good = ([r.score for r in held if r.quality == q] for q in (0, 1))
    rank = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert rank > 0.97
    assert np.mean([s >= classifier.THRESHOLD for s in good]) > 0.98
    assert np.mean([s < classifier.THRESHOLD for s in bad]) > 0.75


def test_odd_rows(spark, prose):
    rows = [(i, prose(30), 100, 1) for i in range(40)] + [(100 + i, "$$$ !! " * 20, 100, 0) for i in range(40)]
    docs = spark.createDataFrame([*[r[:3] for r in rows], (900, None, None), (901, "", 0), (902, prose(50_000), None), (900, None, 5)], "doc_id LONG, text STRING, n_chars INT")
    labels = spark.createDataFrame([(r[0], r[3]) for r in rows] + [(None, 1), (3, None), (5, 1), (77777, 0)], "doc_id LONG, quality INT")
    model = classifier.fit(docs, labels)
    got = classifier.score(docs.withColumn("score", F.lit("old")).withColumn("label", F.lit(1)), model)
    assert got.columns == ["doc_id", "text", "n_chars", "label", "score"]
    found = got.collect()
    assert len(found) == len(rows) + 4 and all(0 <= r.score <= 1 for r in found)
    by_id = {r.doc_id: r.score for r in found}
    assert min(by_id[i] for i in range(40)) > max(by_id[100 + i] for i in range(40))
    assert classifier.score(docs.limit(0), model).collect() == []
    blank = classifier.fit(docs, labels.limit(0))
    assert {r.score for r in classifier.score(docs, blank).collect()} == {0.5}


def test_labels_and_source_are_no_inputs(spark, prose):
    docs = spark.createDataFrame([(i, prose(20), "en", f"s{i}") for i in range(20)], "doc_id LONG, text STRING, lang STRING, source STRING")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id LONG, quality INT")
    model = classifier.fit(docs, labels)
    one = {r.text: r.score for r in classifier.score(docs, model).collect()}
    other = docs.select((F.col("doc_id") + 50).alias("doc_id"), "text", F.lit("zz").alias("lang"), F.lit("q").alias("source"))
    assert {r.text: r.score for r in classifier.score(other, model).collect()} == one


def test_long_labelled_texts_count_whole(spark):
    """Only words of low-numbered buckets tell the labels apart, in texts of 6400 different words."""
    common = [f"c{i}" for i in range(12_000)]
    buckets = np.concatenate([classifier.features([w.encode()], [None])[0][:1] for w in common])
    by_bucket = [common[i] for i in np.argsort(buckets, kind="stable")]
    low, rest = by_bucket[:1600], by_bucket[2500:9000]
    random = np.random.default_rng(1)
    rows = [(i, " ".join([*random.choice(rest, 5600, replace=False), *low[i % 2 :: 2]]), 1) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, n_chars LONG")
    labels = spark.createDataFrame([(i, i % 2) for i in range(160)], "doc_id LONG, quality LONG")
    scores = {r.doc_id: r.score for r in classifier.score(docs, classifier.fit(docs, labels)).collect()}
    unseen = [i for i in range(160) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([scores[i] > scores[j] for i in unseen if i % 2 for j in unseen if j % 2 == 0]) > 0.9
    named = classifier.score(docs.withColumn("score", F.lit("own")), classifier.fit(docs, labels), "__quality")
    assert named.columns == ["doc_id", "text", "n_chars", "score", "__quality"] and named.first().score == "own"
