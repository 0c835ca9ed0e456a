from __future__ import annotations

import re

import brute

from tidemark.llm import quality_rules
from tidemark.llm.quality_rules import Rule


def counts(text):
    w = brute.words(text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(8)}
    lines = [x for x in (text or "").split("\n") if brute.words(x)]
    return (
        len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
    )


def test_counts(spark, prose):
    line, passage = prose(12), prose(9)
    texts = [
        None, "", " \n\t ", "one", line, f"{line}\n{line}\n \n{line} ", f"{passage} {passage}", "a " * 30, f"{passage} x {prose(5)} {passage} {passage}",
        "é ö ß *#$%&|<> <b>", "x\r\ny\r\nx\r\n", prose(3000), prose(20) + "\n" + "|".join("abc"), "    a\x0bb\x0cc",
    ]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(1, "", "again")]
    docs = spark.createDataFrame(rows, "doc_id INT, text STRING, n_words STRING")
    got = quality_rules.quality_rules(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want, texts[r.doc_id]
        assert r.base_failed == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r.base_failed and r.kept)


def test_rules_are_a_table(spark, prose):
    docs = spark.createDataFrame([(1, "the " * 3 + prose(40)), (2, prose(40)), (3, "#" * 50 + " the " + prose(30))], "doc_id INT, text STRING")
    got = {r.doc_id: (r.kept, r.failed_rules) for r in quality_rules.quality_rules(docs).collect()}
    assert got[1] == (True, []) and got[2] == (False, ["stop_words"]) and got[3] == (False, ["symbols_per_word"])
    strict = (Rule("few", "n_words", high=35),)
    assert {r.doc_id: r.kept for r in quality_rules.quality_rules(docs, strict).collect()} == {1: False, 2: False, 3: True}


def test_plan_has_no_python_and_no_shuffle(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = quality_rules.quality_rules(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan
    assert quality_rules.quality_rules(docs.limit(0)).collect() == []


def test_labels(spark):
    """Few good documents fail and few junk documents pass."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality_rules.quality_rules(spark.read.parquet(f"{folder}/documents.parquet")).join(labels, "doc_id")
    table = {(r.quality, r.kept): r.n for r in judged.filter("NOT base_failed").groupBy("quality", "kept").count().withColumnRenamed("count", "n").collect()}
    assert table.get((1, False), 0) <= 0.01 * table[1, True]
    assert table.get((0, True), 0) <= table.get((0, False), 0)
