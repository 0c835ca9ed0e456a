from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as tx
from tidemark.operators import style


def docs(spark, *texts, **columns):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    return df.withColumns({k: F.lit(v) for k, v in columns.items()})


def hits(df):
    return {(r.doc_id, r.rule_id): r.hits for r in df.collect()}


def test_phrases_and_marks(spark):
    corpus = docs(spark, "说白了，这意味着什么。说白了。", "说明白了", genre="article")
    assert hits(style.phrase_hits(corpus)) == {(0, "b01"): 2, (0, "b02"): 1, (0, "b03"): 1}
    marked = docs(spark, "他说：“好”——\"x\"", genre="article")
    assert hits(style.punct_hits(marked)) == {(0, "p1"): 1, (0, "p2"): 1, (0, "p3"): 1, (0, "p4"): 1, (0, "p5"): 2}
    assert style.punct_hits(marked.withColumn("genre", F.lit("report"))).count() == 0
    assert hits(style.vague_names(docs(spark, "用某个模型和AI工具"))) == {(0, "v1"): 1, (0, "v2"): 1}


def test_cliches_and_openers(spark):
    corpus = docs(
        spark, "首先看。其次想。最后做。", "在当今AI快速发展的时代，大家好。\n\n随着技术的不断进步", "第一段。\n\n在当今快速发展的时代", "接下来让我们来看看"
    )
    got = hits(style.pattern_hits(corpus))
    assert got[0, "s1"] == 1 and got[1, "s3"] == 1 and got[1, "o1"] == 1 and got[1, "s4"] == 1
    assert (1, "o2") not in got and (2, "o1") not in got and got[2, "s3"] == 1 and got[3, "s2"] == 1


def test_bullets_bold_headings(spark):
    three, four = "- a\n- b\n- c\n", "1. a\n2. b\n3、c\n* d\n"
    got = {r.doc_id: (r.runs, r.longest) for r in style.bullet_runs(docs(spark, three, four, three + "\n" + four + "x\n" + four)).collect()}
    assert got == {1: (1, 4), 2: (2, 4)}
    bold = docs(spark, "**a\nb**", "**a\nb\nc** **d**", "none")
    assert {r.doc_id: r.spans for r in style.bold_spans(bold).collect()} == {1: 1}
    heads = docs(spark, "# T\ntext\n## U\n**all bold**  \n**part** bold\n#no", "plain")
    assert {r.doc_id: r.headings for r in style.heading_hits(heads).collect()} == {0: 3}


def reference_sentences(text: str) -> list[str]:
    found, here, ended = [], "", False
    for c in text:
        if c == "\n":
            found, here, ended = [*found, here], "", False
        elif c in "。！？.!?":
            if here:
                here, ended = here + c, True
        else:
            if ended:
                found, here, ended = [*found, here], "", False
            here += c
    return [s.strip(" ") for s in [*found, here] if s.strip(" ")]


TEXTS = [
    "一二三。四五六！七八九？？真的", "One. Two two?\nThree", "...\n?!x", " ?? a.b", "a ?b\n \n  ?", "", "。。。", "a" * 50 + "." + "b" * 50 + "." + "c" * 58 + ".",
]


def test_sentence_expressions_agree_with_brute_force(spark):
    df = docs(spark, *TEXTS).select(
        "doc_id", tx.sentences(F.col("text")).alias("s"), tx.sentence_count(F.col("text")).alias("n"),
        tx.question_count(F.col("text")).alias("q"), tx.sentence_lengths(F.col("text")).alias("l"),
    )
    for row in df.collect():
        want = reference_sentences(TEXTS[row.doc_id])
        assert row.s == want, TEXTS[row.doc_id]
        assert row.n == len(want) and row.l == [len(s) for s in want]
        assert row.q == sum(s[-1] in "?？" for s in want)


def test_rhythm(spark):
    two, three = "a" * 20 + "." + "b" * 20 + ".", "a" * 20 + "." + "b" * 21 + "." + "c" * 22 + "."
    corpus = docs(spark, two, three, "short." + "b" * 40 + "." + "c" * 40 + ".", three + "d" * 22 + ".")
    assert {r.doc_id: r.flat_places for r in style.flat_rhythm(corpus).collect()} == {1: 1, 3: 2}


def test_breaks_questions_emotion_variety(spark):
    corpus = docs(spark, "一。\n\n二！\n\n三？\n\n四。五。", "一。\n\n二")
    assert [(r.breaks, r.enough) for r in style.break_paragraphs(corpus).orderBy("doc_id").collect()] == [(3, True), (2, False)]
    assert [r.present for r in style.has_question(corpus).orderBy("doc_id").collect()] == [True, False]
    assert [r.present for r in style.emotion_marks(docs(spark, "好。。。", "= =", "好")).orderBy("doc_id").collect()] == [True, True, False]
    varied = docs(spark, "".join(style.COLLOQUIAL[:8]) + style.COLLOQUIAL[0], "".join(style.COLLOQUIAL[:7]))
    assert [(r.phrases, r.enough) for r in style.phrase_variety(varied).orderBy("doc_id").collect()] == [(8, True), (7, False)]


def test_layer_gate_and_report(spark):
    rows = [(1, "L1", f"r{i}", 0, True) for i in range(4)] + [(1, "L2-2", f"q{i}", 0, i > 1) for i in range(5)]
    rows += [(2, "L1", "r0", 7, False), (2, "L1", "r1", 9, False), (2, "L2-2", "q0", 0, True), (2, "L2-2", "q1", 1, False), (2, "L2-2", "q2", 1, False)]
    checks = spark.createDataFrame(rows, "doc_id INT, layer STRING, rule STRING, hits BIGINT, passed BOOLEAN")
    got = {(r.doc_id, r.layer): r.holds for r in style.layer_gate(checks).collect()}
    assert got == {(1, "L1"): True, (1, "L2-2"): True, (2, "L1"): False, (2, "L2-2"): False}
    report = {r.doc_id: r for r in style.qc_report(checks).collect()}
    assert (report[1].layers_to_redo, report[1]["L3-1"]) == (0, None)
    assert (report[2].layers_to_redo, report[2].repairs) == (2, "r1; r0; q1")


def test_reintroduced_bands_grades(spark):
    schema = "doc_id INT, rule_id STRING, hits BIGINT"
    before = spark.createDataFrame([(1, "a", 2), (1, "b", 0)], schema)
    after = spark.createDataFrame([(1, "a", 1), (1, "b", 3), (1, "c", 4), (2, "a", 0)], schema)
    assert {(r.rule_id, r.hits_v2) for r in style.reintroduced(before, after).collect()} == {("b", 3), ("c", 4)}
    sections = docs(spark, "x" * 3999, "x" * 4000, "x" * 8000, "x" * 8001, genre="article", section="total")
    assert [r.band for r in style.length_bands(sections).orderBy("doc_id").collect()] == ["below", "in", "in", "above"]
    flags = spark.createDataFrame([(True, True, True), (True, True, None), (True, False, None), (None, False, False)], "happy BOOLEAN, knowledge BOOLEAN, resonance BOOLEAN")
    assert [r.grade for r in style.hkr(flags).collect()] == ["S", "pass", "reconsider", "drop"]


def test_index_and_tail(spark):
    corpus = docs(spark, "x\n# 标题\n> 研究时间：今天 | 所属领域\n# 第二", "## no\nnothing", genre="article")
    got = [(r.title, r.meta_line) for r in style.report_index(corpus).orderBy("doc_id").collect()]
    assert got == [("标题", "研究时间：今天 | 所属领域"), (None, None)]
    tail = docs(spark, "正文\n再见。\n\n", "再见。正文", genre="article")
    assert [r.present for r in style.tail_present(tail, tail="再见。").orderBy("doc_id").collect()] == [True, False]


def test_no_shuffle_in_a_corpus_pass(spark):
    plan = style.style_checks(docs(spark, "a"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    with pytest.raises(ValueError):
        style.phrase_hits(docs(spark, "a"), ())


def test_cliches_have_no_length_limit(spark):
    gap = "字" * 250
    texts = ["首先 一\n\n其次 二\n\n最后 三", f"首先{gap}其次{gap}最后", f"在当今{'字' * 61}的时代", f"随着{gap}的不断发展", "其次 首先 最后", "首先 首先 其次 最后 首先 其次 其次 最后", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id INT, text STRING")
    got = {(r.doc_id, r.rule_id): r.hits for r in style.pattern_hits(docs, style.CLICHES).collect()}
    assert got == {(0, "s1"): 1, (1, "s1"): 1, (2, "s3"): 1, (3, "s4"): 1, (5, "s1"): 2}


def test_phrases_with_a_blank(spark):
    docs = spark.createDataFrame([(1, "回到价格这块。不是说钱不行而是说。有个屁的用"), (2, "回到。这块")], "doc_id INT, text STRING")
    assert {r.doc_id: r.phrases for r in style.phrase_variety(docs).collect()} == {1: 3, 2: 0}
