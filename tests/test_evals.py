from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evals
from tidemark.sources import tables

RUN = "run STRING, check STRING, seq BIGINT, ok BOOLEAN"


def test_eval_set(spark, tmp_path):
    (tmp_path / "e.json").write_text(
        '{"skill_name": "s", "evals": [{"id": 1, "name": "a", "files": ["fx/one", "/abs"], "expectations": ["x"]},'
        ' {"id": 1, "name": "b", "files": ["fx/none"], "expectations": []}, {"id": 2, "name": "c", "assertions": ["old"]}]}'
    )
    cases = tables.eval_cases(tables.read_json(spark, str(tmp_path), tables.EVAL_SET)).withColumnRenamed("skill_name", "set_id")
    got = {(r.rule, r.detail) for r in evals.check_evals(cases, required=("a", "z")).collect()}
    assert got == {
        ("duplicate id", "1"), ("too few evals", "3"), ("no expectations", "1"), ("no expectations", "2"),
        ("obsolete field", "2"), ("required name missing", "z"),
    }
    files = spark.createDataFrame([("fx/one/deep/file.md",)], "path STRING")
    got = {(r.fixture, r.problem) for r in evals.check_fixtures(cases, files).collect()}
    assert got == {("/abs", "not portable"), ("fx/none", "missing")}


@pytest.mark.parametrize(("positives", "balanced"), [(7, False), (8, True), (12, True), (13, False)])
def test_balance(spark, positives, balanced):
    labels = spark.range(20).select(F.lit("s").alias("set_id"), (F.col("id") < positives).alias("should_trigger"))
    row = evals.label_balance(labels).first()
    assert (row["rows"], row.positives, row.enough, row.balanced) == (20, positives, True, balanced)


def test_markers(spark):
    rows = [("s", "run /tidy now", True)] + [("s", f"intent {n}", True) for n in range(4)] + [("s", f"other {n}", False) for n in range(6)]
    labels = spark.createDataFrame(rows, "set_id STRING, query STRING, should_trigger BOOLEAN")
    row = evals.marker_contract(labels, ("/tidy",)).first()
    assert (row.violations, row.intent_positives, row.bare_negatives, row.holds) == (0, 4, 6, True)
    broken = labels.withColumn("should_trigger", F.lit(False))
    assert [r.query for r in evals.marker_violations(broken, ("/tidy",)).collect()] == ["run /tidy now"]


SPEC = '---\nname: x\ndescription: >-\n  first part,\n  second\n  part\nlicense: MIT\n---\nbody [a](references/a.md) rm -rf\n'


def test_spec(spark):
    docs = spark.createDataFrame([("good", SPEC), ("bare", "no head")], "doc_id STRING, text STRING")
    pairs = {(r.key, r.value) for r in evals.front_matter(docs).collect()}
    assert pairs == {("name", "x"), ("description", "first part, second part"), ("license", "MIT")}
    lacking = {(r.doc_id, r.key) for r in evals.missing_keys(docs, ("name", "version")).collect()}
    assert lacking == {("good", "version"), ("bare", "name"), ("bare", "version")}
    rules = evals.SpecRules(
        max_lines=9, max_description=10, comfortable_description=5, description_phrases=("second", "third"),
        required=("body",), forbidden=(" rm ",), references=("references/a.md", "references/b.md"),
    )
    found = {(r.doc_id, r.rule): r.detail for r in evals.spec_contract(docs, rules).collect()}
    good = {rule: detail for (doc, rule), detail in found.items() if doc == "good"}
    assert good == {
        "description too long": "23", "description near limit": "23", "too many lines": "9", "phrase missing in description": "third",
        "forbidden token": " rm ", "reference missing": "references/b.md", "no version": None,
    }
    versioned = spark.createDataFrame([("v", SPEC.replace("license:", 'version: "1.2.3"\nlicense:'))], docs.schema)
    files = spark.createDataFrame([("references/b.md",)], "path STRING")
    rest = {(r.rule, r.detail) for r in evals.spec_contract(versioned, evals.SpecRules(), files).collect()}
    assert rest == {("reference file missing", "references/a.md")}
    assert {"no front matter", "no description", "phrase missing"} <= {rule for doc, rule in found if doc == "bare"}


def brute_streaks(rows, n):
    found, open_ = [], {}
    for run, check, seq, ok in sorted(rows, key=lambda r: r[2]):
        streak = open_.setdefault((run, check), [])
        if ok:
            if len(streak) >= n:
                found.append((run, check, streak[0], streak[-1], len(streak)))
            open_[run, check] = []
        else:
            streak.append(seq)
    found += [(r, c, s[0], s[-1], len(s)) for (r, c), s in open_.items() if len(s) >= n]
    return sorted(found)


def test_streaks_equal_brute_force(spark):
    rows = [("r", "c", n, ok) for n, ok in enumerate([False, False, True, False, False, False])]
    rows += [("hot", "c", 100 + n, (n * 7919) % 11 > 6) for n in range(2000)] + [("all", "d", 5000 + n, False) for n in range(50)]
    runs = spark.createDataFrame(rows, RUN)
    for size in (7, 100, 10**6):
        assert sorted(tuple(r) for r in evals.failure_streaks(runs, slice_size=size).collect()) == brute_streaks(rows, 3)


def test_baseline_and_rounds(spark):
    baseline = spark.createDataFrame(
        [("r", "tests", 10.0, "up"), ("r", "coverage", 80.0, "up"), ("r", "skipped", 0.0, "equal"), ("r", "time", 5.0, "down")],
        "run STRING, metric STRING, base DOUBLE, direction STRING",
    )
    now = spark.createDataFrame([("r", "tests", 10.0), ("r", "coverage", 79.9), ("r", "skipped", 1.0)], "run STRING, metric STRING, value DOUBLE")
    got = {r.metric: r.verdict for r in evals.baseline_check(now, baseline).collect()}
    assert got == {"tests": "ok", "coverage": "rollback", "skipped": "rollback", "time": "rollback"}
    rounds = spark.createDataFrame([("a", 3), ("a", 4), ("b", 5)], "run STRING, round INT")
    assert {r.run: r.stop for r in evals.round_limit(rounds, n=5).collect()} == {"a": False, "b": True}


def test_scope_and_territories(spark):
    changes = spark.createDataFrame([("t", "/src/a.py", "1"), ("t", "/srcs/b.py", "2"), ("t", "/src/frozen.py", "3")], "task STRING, path STRING, sha256 STRING")
    allowed = spark.createDataFrame([("t", "/src"), ("u", "/srcs")], "task STRING, prefix STRING")
    frozen = spark.createDataFrame([("/src/frozen.py", "0"), ("/src/a.py", "1")], "path STRING, sha256 STRING")
    got = {(r.path, r.violation) for r in evals.scope_violations(changes, allowed, frozen).collect()}
    assert got == {("/srcs/b.py", "outside allowed paths"), ("/src/frozen.py", "frozen file changed")}
    lands = spark.createDataFrame([("a", "/x"), ("b", "/x/y"), ("c", "/x"), ("d", "/xy"), ("b", "/z"), ("b", "/z/q")], "task STRING, prefix STRING")
    got = {(r.task, r.prefix, r.around): (r.other_tasks, r.other) for r in evals.territory_overlap(lands).collect()}
    assert got == {("a", "/x", "/x"): (1, "c"), ("c", "/x", "/x"): (1, "a"), ("b", "/x/y", "/x"): (2, "a")}


def test_book(spark):
    good = "界限 is named before its heading\n" + "".join(f"## {s}\n" for s in evals.BOOK_SECTIONS).replace("任务 N", "任务 1\n## 任务 2")
    swapped = good.replace("## 界限", "@").replace("## 规矩", "## 界限").replace("@", "## 规矩")
    two, one = ["a", "b"], ["a"]
    books = spark.createDataFrame(
        [(1, good, [two] * 5), (2, swapped + "来找我", [two] * 6), (3, good.replace("## 界限", ""), [one, two]), (5, good.replace("任务 1\n## 任务 2", "任务 N"), []), (4, good + "x" * 4000, [])],
        "book_id INT, text STRING, questions ARRAY<ARRAY<STRING>>",
    )
    got = {(r.book_id, r.rule) for r in evals.book_contract(books).collect()}
    assert got == {
        (2, "sections out of order"), (2, "banned wording"), (2, "too many questions"), (3, "section missing"), (5, "section missing"), (3, "question options"), (4, "too long"),
    }
