"""Checks of evaluation sets, specification documents and agent runs.

Every check returns all violations as rows instead of stopping at the first one.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import paths
from tidemark.functions import text as tx
from tidemark.functions.ordered import blocks, latest_before
from tidemark.functions.skew import even_join

# The least an evaluation set must hold.
MIN_EVALS = 11
MIN_LABELS = 20
MIN_EACH_SIDE = 8
MIN_INTENT_POSITIVES = 4
MIN_BARE_NEGATIVES = 6


def check_evals(
    evals: DataFrame, *, required: Sequence[str] = (), minimum: int = MIN_EVALS, obsolete: str = "assertions"
) -> DataFrame:
    """Violations ``set_id, rule, detail`` of ``evals(set_id, id, name, expectations, ...)``.

    All rules are read off one aggregation per id, and one of those per set.
    """
    number = F.col("id").cast("string")
    stale = F.col(obsolete).isNotNull() if obsolete in evals.columns else F.lit(False)
    per_id = evals.groupBy("set_id", "id").agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        F.count_if(F.coalesce(F.size("expectations"), F.lit(0)) <= 0).cast("int").alias("empty"),
        F.count_if(stale).cast("int").alias("stale"),
        F.collect_set(F.when(F.col("name").isin(*required), F.col("name"))).alias("names"),
    )

    def rule(name: str, detail: Column) -> Column:
        return F.struct(F.lit(name).alias("rule"), detail.alias("detail"))

    of_ids = F.concat(
        F.array_repeat(rule("duplicate id", number), (F.col("n") > 1).cast("int")),
        F.array_repeat(rule("no expectations", number), F.col("empty")),
        F.array_repeat(rule("obsolete field", number), F.col("stale")),
    )
    per_set = per_id.groupBy("set_id").agg(
        F.sum("n").alias("n"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names")
    )
    wanted = F.array(*[F.lit(n) for n in required]).cast("array<string>")
    of_sets = F.concat(
        F.array_repeat(rule("too few evals", F.col("n").cast("string")), (F.col("n") < minimum).cast("int")),
        F.transform(F.array_except(wanted, F.col("names")), lambda n: rule("required name missing", n)),
    )
    return per_id.select("set_id", F.inline(of_ids)).unionByName(per_set.select("set_id", F.inline(of_sets)))


def check_fixtures(evals: DataFrame, files: DataFrame) -> DataFrame:
    """Fixture paths of ``evals(set_id, id, files)`` that are absolute or exist neither as file nor directory.

    ``files(path)`` are relative paths as well.
    """
    wanted = evals.select("set_id", "id", F.explode("files").alias("fixture"))
    rooted = F.concat(F.lit("/"), F.col("path"))
    # Files are cut down to their directories once, so that a fixture directory is found by equality.
    there = (
        files.select(F.col("path").alias("fixture"))
        .union(
            files.select(paths.parent(rooted).alias("dir"))
            .distinct()
            .select(F.explode(paths.self_and_ancestors(F.col("dir"))).alias("dir"))
            .select(F.expr("substring(dir, 2)"))
        )
    )
    absolute = F.col("fixture").rlike("^(/|[A-Za-z]:[/\\\\])")
    bare = F.regexp_replace("fixture", "/+$", "")
    missing = (
        wanted.filter(~absolute)
        .withColumn("given", F.col("fixture"))
        .withColumn("fixture", bare)
        .join(there, "fixture", "left_anti")
        .select("set_id", "id", F.col("given").alias("fixture"), F.lit("missing").alias("problem"))
    )
    return missing.unionByName(
        wanted.filter(absolute).select("set_id", "id", "fixture", F.lit("not portable").alias("problem"))
    )


def label_balance(labels: DataFrame) -> DataFrame:
    """Per set: rows, positives, and whether it is large and balanced enough."""
    return (
        labels.groupBy("set_id")
        .agg(F.count(F.lit(1)).alias("rows"), F.count_if("should_trigger").alias("positives"))
        .withColumn("enough", F.col("rows") >= MIN_LABELS)
        .withColumn(
            "balanced", F.col("positives").between(F.lit(MIN_EACH_SIDE), F.col("rows") - MIN_EACH_SIDE)
        )
    )


def _has_any(text: Column, words: Sequence[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def marker_violations(labels: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Queries that name a marker and still are not to trigger."""
    return labels.filter(_has_any(F.col("query"), markers) & ~F.col("should_trigger"))


def marker_contract(labels: DataFrame, markers: Sequence[str]) -> DataFrame:
    """Per set: violations, positives without a marker and negatives without one, and whether they suffice."""
    marked = _has_any(F.col("query"), markers)
    return (
        labels.withColumn("__marked", marked)
        .groupBy("set_id")
        .agg(
            F.count_if(F.col("__marked") & ~F.col("should_trigger")).alias("violations"),
            F.count_if(~F.col("__marked") & F.col("should_trigger")).alias("intent_positives"),
            F.count_if(~F.col("__marked") & ~F.col("should_trigger")).alias("bare_negatives"),
        )
        .withColumn(
            "holds",
            (F.col("violations") == 0)
            & (F.col("intent_positives") >= MIN_INTENT_POSITIVES)
            & (F.col("bare_negatives") >= MIN_BARE_NEGATIVES),
        )
    )


class SpecRules(NamedTuple):
    """Limits and wording of a specification document."""

    max_description: int = 1024
    comfortable_description: int = 850
    max_lines: int = 500
    max_tokens: int = 5000
    chars_per_token: int = 4
    description_phrases: tuple[str, ...] = ()
    required: tuple[str, ...] = ()
    forbidden: tuple[str, ...] = ()
    references: tuple[str, ...] | None = None
    # How a reference and the version are written.
    reference_pattern: str = r"\]\((references/[^)]+)\)"
    version_pattern: str = r'version: "\d+\.\d+\.\d+"'


def front_matter_block(text: Column) -> Column:
    """The lines between the first two ``---`` marks; null where there are none."""
    return F.when(
        F.size(F.split(text, "---", 3)) == 3, F.try_element_at(F.split(text, "---", 3), F.lit(2))
    )


# Fixed value: how a key of the front matter is written.
KEY = "[a-z][a-z0-9-]*"


def front_matter(docs: DataFrame) -> DataFrame:
    """Front matter as ``doc_id, key, value``; the lines that continue a value are joined with spaces."""
    # A key starts a line; lines up to the next key belong to it.
    pairs = F.regexp_extract_all(
        F.concat(F.lit("\n"), front_matter_block(F.col("text"))),
        F.lit(rf"\n({KEY}):([^\n]*(?:\n(?!{KEY}:)[^\n]*)*)"),
        F.lit(0),
    )

    def folded(value: Column) -> Column:
        parts = F.transform(tx.lines(value), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
        return F.array_join(
            F.filter(parts, lambda part: ~part.isin("", ">", ">-", ">+", "|", "|-", "|+")), " "
        )

    key = F.regexp_extract("pair", rf"^\n({KEY}):", 1)
    return docs.select("doc_id", F.explode(pairs).alias("pair")).select(
        "doc_id", key.alias("key"), folded(F.regexp_replace("pair", rf"^\n{KEY}:", "")).alias("value")
    )


def missing_keys(docs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Front-matter keys a document lacks or leaves empty, ``doc_id, key``."""
    wanted = docs.select("doc_id", F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))
    present = front_matter(docs).filter(F.col("value") != "").select("doc_id", "key")
    return wanted.join(present, ["doc_id", "key"], "left_anti")


def description(text: Column) -> Column:
    """The ``description`` of the front matter with its lines joined; empty where there is none."""
    block = F.concat(F.lit("\n"), front_matter_block(text))
    raw = F.regexp_extract(block, rf"\ndescription:([^\n]*(?:\n(?!{KEY}:)[^\n]*)*)", 1)
    parts = F.transform(tx.lines(raw), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    return F.coalesce(
        F.array_join(F.filter(parts, lambda part: ~part.isin("", ">", ">-", ">+", "|", "|-", "|+")), " "), F.lit("")
    )


def spec_contract(specs: DataFrame, rules: SpecRules, files: DataFrame | None = None) -> DataFrame:
    """Broken rules of specification documents ``(doc_id, text)``: ``doc_id, rule, detail``.

    With ``files(path)`` every referenced file must be one of them.
    """
    text, about = F.col("text"), F.col("__about")
    n_lines = F.size(F.split(F.regexp_replace(text, "\n$", ""), "\n", -1))

    def broken(rule: str, condition: Column, detail: Column) -> Column:
        return F.when(
            condition, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
        )

    checks = [
        broken("no front matter", front_matter_block(text).isNull(), F.lit(None)),
        broken("no description", F.length(about) == 0, F.lit(None)),
        broken("no version", ~F.coalesce(front_matter_block(text).rlike(rules.version_pattern), F.lit(False)), F.lit(None)),
        broken("description too long", F.length(about) > rules.max_description, F.length(about)),
        broken("description near limit", F.length(about) > rules.comfortable_description, F.length(about)),
        broken("too many lines", n_lines >= rules.max_lines, n_lines),
        broken("too many tokens", F.length(text) >= rules.max_tokens * rules.chars_per_token, F.length(text)),
    ]
    for phrase in rules.description_phrases:
        checks.append(broken("phrase missing in description", ~F.contains(about, F.lit(phrase)), F.lit(phrase)))
    for phrase in rules.required:
        checks.append(broken("phrase missing", ~F.contains(text, F.lit(phrase)), F.lit(phrase)))
    for token in rules.forbidden:
        checks.append(broken("forbidden token", F.contains(text, F.lit(token)), F.lit(token)))
    if rules.references is not None:
        found = F.array_distinct(F.regexp_extract_all(text, F.lit(rules.reference_pattern), F.lit(1)))
        expected = F.array(*[F.lit(r) for r in rules.references]).cast("array<string>")
        missing, extra = F.array_except(expected, found), F.array_except(found, expected)
        checks.append(broken("reference missing", F.size(missing) > 0, F.array_join(F.array_sort(missing), " ")))
        checks.append(broken("reference unexpected", F.size(extra) > 0, F.array_join(F.array_sort(extra), " ")))
    rows = F.filter(F.array(*checks), lambda c: c.isNotNull())
    absent = "reference file missing"
    if files is not None:
        # Every reference is a finding until its file is found; the texts are read once.
        named = F.array_distinct(F.regexp_extract_all(text, F.lit(rules.reference_pattern), F.lit(1)))
        rows = F.concat(rows, F.transform(named, lambda n: F.struct(F.lit(absent).alias("rule"), n.alias("detail"))))
    result = specs.withColumn("__about", description(text)).select("doc_id", F.inline(rows))
    if files is None:
        return result
    there = files.select(F.lit(absent).alias("rule"), F.col("path").alias("detail"))
    return result.join(there, ["rule", "detail"], "left_anti").select("doc_id", "rule", "detail")


def failure_streaks(runs: DataFrame, *, n: int = 3, slice_size: int = 1_000_000) -> DataFrame:
    """Runs of at least ``n`` failures in a row of ``runs(run, check, seq, ok)``.

    ``run, check, first_seq, last_seq, failures``. A failure belongs to the last success before it, so
    the streaks come from an aggregation and a long history is never sorted in one task.
    """
    last_ok = F.when(F.col("ok"), F.col("seq"))
    marked = latest_before(runs, ["run", "check"], "seq", blocks("seq", slice_size), last_ok, "__last_ok")
    return (
        marked.filter(~F.col("ok"))
        .groupBy("run", "check", "__last_ok")
        .agg(
            F.min("seq").alias("first_seq"),
            F.max("seq").alias("last_seq"),
            F.count(F.lit(1)).alias("failures"),
        )
        .filter(F.col("failures") >= n)
        .drop("__last_ok")
    )


def baseline_check(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """``metrics(run, metric, value)`` against ``baseline(run, metric, base, direction)``.

    Direction ``up`` must not fall below the base, ``down`` must not exceed it, ``equal`` must match.
    A metric of the baseline that is not reported any more is a regression as well.
    """
    value, base = F.col("value"), F.col("base")
    ok = (
        F.when(F.col("direction") == "up", value >= base)
        .when(F.col("direction") == "down", value <= base)
        .otherwise(value == base)
    )
    return baseline.join(metrics, ["run", "metric"], "left").select(
        "run",
        "metric",
        "value",
        "base",
        F.when(F.coalesce(ok, F.lit(False)), "ok").otherwise("rollback").alias("verdict"),
    )


def round_limit(runs: DataFrame, *, n: int) -> DataFrame:
    """Rounds of each run and whether it has to stop."""
    return (
        runs.groupBy("run")
        .agg(F.max("round").alias("rounds"))
        .withColumn("stop", F.col("rounds") >= n)
    )


def scope_violations(changes: DataFrame, allowed: DataFrame, frozen: DataFrame) -> DataFrame:
    """Changed paths outside the task's allowed prefixes, and frozen files whose hash changed.

    ``changes(task, path, sha256)``, ``allowed(task, prefix)``, ``frozen(path, sha256)``; paths are absolute.
    """
    changed = changes.groupBy("task", "path").agg(F.collect_set(F.struct("sha256")).alias("hashes"))
    inside = (
        changed.select("task", "path", F.explode(paths.self_and_ancestors(F.col("path"))).alias("prefix"))
        .join(allowed.select("task", "prefix"), ["task", "prefix"], "left_semi")
        .select("task", "path")
        .distinct()
    )
    outside = changed.select("task", "path").join(inside, ["task", "path"], "left_anti")
    touched = (
        changed.join(frozen.select("path", F.col("sha256").alias("__frozen")), "path")
        .filter(F.exists("hashes", lambda h: ~h["sha256"].eqNullSafe(F.col("__frozen"))))
        .select("task", "path")
        .distinct()
    )
    return outside.withColumn("violation", F.lit("outside allowed paths")).unionByName(
        touched.withColumn("violation", F.lit("frozen file changed"))
    )


def territory_overlap(allowed: DataFrame) -> DataFrame:
    """Territories ``allowed(task, prefix)`` that lie in, or equal, one of another task.

    One row per territory and the prefix around it, with the number of other tasks there and one of
    them, so that a prefix many tasks share does not turn into all their pairs.
    """
    own = allowed.select("task", "prefix").distinct()
    holders = own.groupBy(F.col("prefix").alias("around")).agg(
        F.count(F.lit(1)).alias("tasks"), F.min("task").alias("first"), F.max("task").alias("last")
    )
    mine = own.select("task", "prefix", F.explode(paths.self_and_ancestors(F.col("prefix"))).alias("around"))
    held = own.select("task", F.col("prefix").alias("around"), F.lit(1).alias("self"))
    return (
        mine.transform(even_join, holders, ["around"])
        .transform(even_join, held, ["task", "around"])
        .withColumn("other_tasks", F.col("tasks") - F.coalesce("self", F.lit(0)))
        .filter(F.col("other_tasks") > 0)
        .select(
            "task",
            "prefix",
            "around",
            "other_tasks",
            F.when(F.col("first") < F.col("task"), F.col("first")).otherwise(F.col("last")).alias("other"),
        )
    )


# Limits of a task book and its sections; N stands for the numbers of the tasks, from 1.
BOOK_CHARS = 4000
BOOK_QUESTIONS = 5
BOOK_SECTIONS = ("我替领导拍的板", "界限", "现状与任务 0", "任务 N", "规矩", "完成条件")


def book_contract(
    books: DataFrame,
    *,
    sections: Sequence[str] = BOOK_SECTIONS,
    banned: Sequence[str] = ("来找我",),
    max_chars: int = BOOK_CHARS,
    max_questions: int = BOOK_QUESTIONS,
) -> DataFrame:
    """Broken rules of task books ``(book_id, text, questions)``: ``book_id, rule, detail``.

    ``questions`` is an array of arrays of options; each question has 2 to 4 of them. Sections are
    headings; a mention in the text is none. ``N`` at the end of a name is a number from 1.
    """
    text = F.col("text")

    def heading(name: str) -> str:
        exact = re.escape(name.removesuffix("N")) + "[1-9][0-9]*" if name.endswith(" N") else re.escape(name)
        return rf"(?m)^#{{1,6}}[ \t]+{exact}"

    places = F.array(*[F.regexp_instr(text, F.lit(heading(s))) for s in sections])
    first_absent = F.array_position(F.transform(places, lambda p: p == 0), True).cast("int")
    in_order = F.col("__places") == F.array_sort(F.col("__places"))
    names = F.array(*[F.lit(s) for s in sections])
    odd = F.size(F.filter("questions", lambda q: ~F.size(q).between(2, 4)))

    def broken(rule: str, condition: Column, detail: Column) -> Column:
        return F.when(
            condition, F.struct(F.lit(rule).alias("rule"), detail.cast("string").alias("detail"))
        )

    checks = [
        broken("too long", F.length(text) > max_chars, F.length(text)),
        broken(
            "section missing", first_absent > 0, F.try_element_at(names, F.greatest(first_absent, F.lit(1)))
        ),
        broken("sections out of order", (first_absent == 0) & ~in_order, F.lit(None)),
        broken("too many questions", F.size("questions") > max_questions, F.size("questions")),
        broken("question options", odd > 0, odd),
        *[broken("banned wording", F.contains(text, F.lit(b)), F.lit(b)) for b in banned],
    ]
    return books.withColumn("__places", places).select(
        "book_id", F.inline(F.filter(F.array(*checks), lambda c: c.isNotNull()))
    )
