"""Knowledge and governance audits over the files of many projects.

``files(project, path, ...)`` has absolute paths and, as an operator needs them, ``root`` (of the
project), ``text``, ``is_symlink``, ``target``, ``is_dir`` and ``sha256``. Every operator reports; none changes a file.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import lexicon as lx
from tidemark.functions import paths
from tidemark.functions import text as tx
from tidemark.functions.real_paths import resolved_links
from tidemark.functions.skew import even_join
from tidemark.operators.feed import related
from tidemark.operators.style import Phrase, phrase_hits

# Directories that are never inventoried.
EXCLUDED_DIRS = (
    ".git", "node_modules", ".next", "dist", "build", ".venv", "venv", "__pycache__", "target", "vendor",
    ".turbo", ".cache",
)
# Names of rule files in a directory, in the order they are looked for.
RULE_FILES = ("AGENTS.override.md", "AGENTS.md", "CLAUDE.md", "CLAUDE.local.md", ".claude/CLAUDE.md")
USER_RULE_FILES = (".codex/AGENTS.override.md", ".codex/AGENTS.md", ".claude/CLAUDE.md")
HISTORY = r"(?i)(^|/)(changelog|history|incidents?|archive)([^/]*\.mdx?$|/)"
SURFACES = ("code", "runtime", "docs", "rules", "memory")
FACES = (*SURFACES, "workspace")
AUTHORITY = ("code", "runtime")
# Words for relative dates.
RELATIVE_DATES = tuple(
    Phrase(f"d{i}", word)
    for i, word in enumerate(
        ("今天", "昨天", "前天", "明天", "最近", "近期", "刚刚", "上周", "本周", "下周", "上个月", "这个月", "下个月", "去年", "今年", "明年"), 1
    )
)


class Reason(NamedTuple):
    """A pattern on the path and why it is a residue candidate."""

    pattern: str
    reason: str


# Leftovers of work sessions.
RESIDUE = (
    Reason(r"(^|/)(PLAN|implementation-notes)[^/]*\.md$", "one-off plan"),
    Reason(r"(^|/)TODO[^/]*\.md$", "to-do list"),
    Reason(r"(^|/)notes/[^/]+\.md$", "session notes"),
    Reason(r"_old(\.[^/.]+)?(/|$)", "replaced copy"),
    Reason(r"_backup(\.[^/.]+)?(/|$)", "backup copy"),
    Reason(r"_v[0-9]+(\.[^/.]+)?(/|$)", "numbered copy"),
    Reason(r"(^|/)debug[-_][^/]*\.(js|ts|py|sh)$", "debug script"),
)


class SizeBudget(NamedTuple):
    """How large a kind of file may be on a platform; None means no limit on that side."""

    platform: str
    kind: str
    max_lines: int | None
    max_bytes: int | None


# Size budgets; a merged rule chain is one unit.
SIZE_BUDGETS = (
    SizeBudget("claude", "rules", 200, None),
    SizeBudget("claude", "auto", 200, 25 * 1024),
    SizeBudget("codex", "chain", None, 32 * 1024),
)
REPORT_SHARE = 70
# The surfaces a kind of change touches.
CHANGE_MATRIX: Mapping[str, tuple[str, ...]] = {
    "api": ("integration contract", "architecture", "auth", "examples", "consumer docs", "smoke"),
    "env": ("example env", "runbook", "defaults", "downstream config", "cost and fallback"),
    "schema": ("data model", "migration and rollback", "derived and cache", "access boundary", "tests"),
    "user flow": ("readme", "architecture", "operations manual", "visual acceptance"),
    "scoring": ("algorithm docs", "thresholds", "backtest", "fallback chain", "display"),
    "service": ("runbook", "service name", "marker", "cache", "rollback", "live acceptance"),
    "job": ("job docs", "schedule", "failure handling", "alert routing", "decision surface"),
    "retirement": ("old symbols", "consumers", "rules", "skills", "memory"),
    "release process": ("sop", "merge and deploy scripts", "receipts", "cleanup gate", "workspace audit"),
}


def _in_excluded(path: Column) -> Column:
    folders = F.slice(paths.parts(path), F.lit(1), F.size(paths.parts(path)) - 1)
    return F.arrays_overlap(folders, F.array(*[F.lit(d) for d in EXCLUDED_DIRS]))


def markdown_inventory(files: DataFrame) -> DataFrame:
    """Markdown files outside dependency and build directories with line and byte counts, in byte order."""
    kept = files.filter(F.col("path").rlike(r"\.mdx?$") & ~_in_excluded(F.col("path")))
    for flag in ("is_dir", "is_symlink"):
        if flag in files.columns:
            kept = kept.filter(~F.coalesce(flag, F.lit(False)))
    return with_size_facts(kept).select("project", "path", "lines", "bytes").orderBy("project", "path")


def with_size_facts(files: DataFrame) -> DataFrame:
    """Add ``lines`` (line ends, as a line counter sees them) and ``bytes``."""
    return files.withColumn("lines", tx.count_pattern(F.col("text"), "\n")).withColumn(
        "bytes", F.octet_length("text").cast("long")
    )


def markdown_count(inventory: DataFrame) -> DataFrame:
    return inventory.groupBy("project").agg(
        F.count(F.lit(1)).alias("files"), F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes")
    )


def rule_chain(files: DataFrame, projects: DataFrame, *, home: str | None = None) -> DataFrame:
    """The rule files in force for each ``projects(project, root)``, nearest directory first.

    All five names are looked for from the root up to ``/``, then the user's own files under ``home``.
    A file found twice keeps its first place.
    """
    here = F.concat(F.array(F.lit("")), paths.self_and_ancestors(F.col("root")))
    names = F.array(*[F.lit(n) for n in RULE_FILES])
    named = [
        F.struct(F.lit(i).alias("nth"), F.substring("path", F.lit(1), F.length("path") - len(n) - 1).alias("dir"), F.endswith("path", F.lit(f"/{n}")).alias("fits"))
        for i, n in enumerate(RULE_FILES)
    ]
    # Folders look for the few files that are there, instead of every name on every level of every project.
    there = files.select(F.inline(F.filter(F.array(*named), lambda r: r.fits))).select("dir", "nth").distinct()
    found = (
        projects.select("project", F.posexplode(F.reverse(here)).alias("depth", "dir"))
        .join(there.hint("merge"), "dir")
        .select("project", "depth", "nth", F.concat("dir", F.lit("/"), names[F.col("nth")]).alias("path"))
    )
    if home is not None:
        own = [f"{home.rstrip('/')}/{n}" for n in USER_RULE_FILES]
        # At most as many rows as there are names, so every task gets them.
        listed = files.filter(F.col("path").isin(own)).select("path").distinct()
        nth = F.array_position(F.array(*[F.lit(p) for p in own]), F.col("path")).cast("int") - 1
        last = projects.select("project").crossJoin(F.broadcast(listed.select(nth.alias("nth"), "path")))
        found = found.unionByName(last.withColumn("depth", F.lit(1 << 20)))
    first = found.groupBy("project", "path").agg(F.min(F.struct("depth", "nth")).alias("at"))
    order = W.partitionBy("project").orderBy("at")
    return first.withColumn("position", F.row_number().over(order).cast("long")).select("project", "position", "path")


def symlink_state(files: DataFrame) -> DataFrame:
    """Symlinks with their target, and whether that leads to something in the end.

    ``valid`` if the target's real path is a listed file or a folder with listed entries, links in the middle
    of the target and chains of links included; ``broken`` if not, or if the way runs in a circle.
    """
    linked = files.filter("is_symlink").select(
        "path", F.col("target").alias("given"), paths.resolved(F.col("target"), paths.parent(F.col("path"))).alias("target")
    )
    ends = resolved_links(linked.select("path", F.col("given").alias("target"))).withColumnRenamed("link", "path")
    real = files.filter(~F.coalesce("is_symlink", F.lit(False))).select(F.col("path").alias("real"))
    folders = files.select(paths.parent(F.col("path")).alias("path")).distinct()
    folders = folders.select(F.explode(paths.self_and_ancestors(F.col("path"))).alias("real"))
    there = real.union(folders).distinct().withColumn("__there", F.lit(True))
    return (
        linked.join(ends, "path", "left")
        .join(there, "real", "left")
        .select(
            "path",
            "target",
            F.when(F.col("closed") & F.col("__there"), "valid").otherwise("broken").alias("state"),
        )
    )


def references(files: DataFrame) -> DataFrame:
    """Files each Markdown file points to: links from its folder, backticked paths from the project root."""
    link = F.transform(
        F.regexp_extract_all("text", F.lit(r"\]\(([^()\s]+)\)"), F.lit(1)),
        lambda t: F.struct(paths.parent(F.col("path")).alias("base"), t.alias("ref")),
    )
    ticked = F.transform(
        F.regexp_extract_all("text", F.lit(r"`([^`\s]*/[^`\s]*\.[A-Za-z0-9]+)`"), F.lit(1)),
        lambda t: F.struct(F.col("root").alias("base"), t.alias("ref")),
    )
    local = F.regexp_replace("ref", r"[#?].*$", "")
    return (
        files.filter(F.col("path").rlike(r"\.mdx?$"))
        .select("project", "path", F.inline(F.concat(link, ticked)))
        .filter(~F.col("ref").rlike("^([a-zA-Z][a-zA-Z0-9+.-]*:|#)"))
        .select("project", "path", "ref", paths.resolved(local, F.col("base")).alias("target"))
        .distinct()
    )


def dead_links(files: DataFrame) -> DataFrame:
    """References to files that do not exist."""
    existing = files.select(F.col("path").alias("target"))
    return references(files).join(existing, "target", "left_anti").select("project", "path", "ref", "target")


def _one_sided(left: DataFrame, right: DataFrame, keys: list[str], only_left: str, only_right: str) -> DataFrame:
    """Keys that occur on one side only, with one shuffle and partial aggregation of both sides."""
    both = left.select(*keys, F.lit(True).alias("__left")).unionByName(
        right.select(*keys, F.lit(False).alias("__left"))
    )
    return (
        both.groupBy(*keys)
        .agg(F.bool_or("__left").alias("__in_left"), F.bool_and("__left").alias("__only_left"))
        .filter(F.col("__only_left") | ~F.col("__in_left"))
        .select(*keys, F.when(F.col("__only_left"), only_left).otherwise(only_right).alias("finding"))
    )


def index_diff(index_links: DataFrame, files: DataFrame) -> DataFrame:
    """Index entries without a file and files without an entry, per ``project, file``."""
    return _one_sided(index_links, files, ["project", "file"], "entry without file", "file without entry")


def fact_conflicts(facts: DataFrame, *, authority: Sequence[str] = AUTHORITY) -> DataFrame:
    """State of each ``facts(topic, surface, value)`` against the best authority that knows the topic.

    Equal to it is ``verified-current``, different is ``stale``; without any authority it is ``pending``.
    The same fact stated many times is one row.
    """
    facts = facts.select("topic", "surface", "value").distinct()
    rank = F.array_position(F.array(*[F.lit(s) for s in authority]), F.col("surface"))
    decided = (
        facts.withColumn("__rank", rank)
        .groupBy("topic")
        .agg(
            F.min_by("value", F.when(F.col("__rank") > 0, F.col("__rank"))).alias("__ruling"),
            F.min(F.when(F.col("__rank") > 0, F.col("__rank"))).alias("__known"),
            (F.min("value") != F.max("value")).alias("conflict"),
        )
    )
    return even_join(facts, decided, ["topic"]).select(
        "topic",
        "surface",
        "value",
        "conflict",
        F.when(F.col("__known").isNull(), "pending")
        .when(F.col("value").eqNullSafe(F.col("__ruling")), "verified-current")
        .otherwise("stale")
        .alias("status"),
    )


def status_matrix(status: DataFrame, *, surfaces: Sequence[str] = FACES) -> DataFrame:
    """``status(topic, surface, status)`` with a column per surface; what is not set does not apply."""
    wide = status.groupBy("topic").pivot("surface", list(surfaces)).agg(F.max("status"))
    return wide.fillna("not-applicable", list(surfaces))


def symbols(files: DataFrame, patterns: Mapping[str, str]) -> DataFrame:
    """Distinct ``project, kind, symbol``; each pattern of ``{kind: pattern}`` marks the symbol with group 1."""

    def of_kind(kind: str, pattern: str) -> Column:
        marks = F.regexp_extract_all("text", F.lit(pattern), F.lit(1))
        return F.transform(marks, lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("symbol")))

    found = [of_kind(kind, pattern) for kind, pattern in patterns.items()]
    return files.select("project", F.inline(F.concat(*found))).distinct()


def routes(files: DataFrame) -> DataFrame:
    """HTTP routes as ``METHOD /path``, from route calls in code and from documents."""
    call = r"\.(get|post|put|patch|delete)\(\s*['\"`](/[^'\"`]*)['\"`]"
    prose = r"\b(GET|POST|PUT|PATCH|DELETE)[ \t|`]+(/[^\s|`?]*)"
    both = [
        F.arrays_zip(
            F.regexp_extract_all("text", F.lit(p), F.lit(1)).alias("m"),
            F.regexp_extract_all("text", F.lit(p), F.lit(2)).alias("p"),
        )
        for p in (call, prose)
    ]
    return files.select("project", F.inline(F.concat(*both))).select(
        "project", F.lit("route").alias("kind"), F.concat_ws(" ", F.upper("m"), "p").alias("symbol")
    ).distinct()


# How environment variables and tables look in code.
CODE_SYMBOLS = {
    "env": r"(?:process\.env\.|os\.environ\[['\"]|getenv\(['\"])([A-Z][A-Z0-9_]*)",
    "table": r"(?i)create table (?:if not exists )?([a-z_][a-z0-9_]*)",
}


def coverage(code_symbols: DataFrame, doc_symbols: DataFrame) -> DataFrame:
    """Symbols only in code or only in documents, per project and kind."""
    keys = ["project", "kind", "symbol"]
    return _one_sided(code_symbols, doc_symbols, keys, "undocumented", "not in code")


def retired_refs(files: DataFrame, retired: Sequence[str] | DataFrame, *, history: str = HISTORY) -> DataFrame:
    """Files outside the history that still name a retired symbol, with the number of mentions.

    ``retired`` may be a table ``symbol`` of any length (``functions.lexicon``).
    """
    if isinstance(retired, DataFrame):
        named = files.filter(~F.col("path").rlike(history)).select(F.struct("project", "path").alias("file"), "text")
        found = lx.counts(named, retired.select("symbol", F.col("symbol").alias("phrase")), "file")
        return found.select("file.project", "file.path", "symbol", F.col("hits").alias("mentions"))
    rows = [
        F.struct(F.lit(s).alias("symbol"), tx.count_literal(F.col("text"), s).alias("mentions"))
        for s in retired
    ]
    return files.filter(~F.col("path").rlike(history)).select(
        "project", "path", F.inline(F.filter(F.array(*rows), lambda r: r.mentions > 0))
    )


class StageGate(NamedTuple):
    """A release stage and the condition under which it is reached."""

    stage: str
    condition: str


# The release stages in order.
RELEASE_GATES = (
    StageGate("implemented", "implemented"),
    StageGate("locally verified", "locally_verified"),
    StageGate("pr opened", "pr IS NOT NULL"),
    StageGate("checks passed", "checks_passed"),
    StageGate("merged", "upper(pr_state) = 'MERGED' AND merge_commit IS NOT NULL"),
    StageGate("deployed", "production_marker = merge_commit AND web = 'active' AND worker = 'active'"),
    StageGate("live verified", "live_release = merge_commit"),
    StageGate("knowledge closed", "knowledge_receipt"),
    StageGate("reported", "reported"),
    StageGate("cleanup approved", "cleanup_approved"),
    StageGate("cleaned", "cleaned"),
    StageGate("audited", "audited"),
    StageGate("appended", "result_appended"),
)


def release_stage(states: DataFrame, gates: Sequence[StageGate] = RELEASE_GATES) -> DataFrame:
    """The furthest stage each project reached without a gap, and the first gate that fails.

    A column ``skips`` (an array of stages) names what the rules of a project allow it to leave out.
    """
    skips = F.col("skips") if "skips" in states.columns else F.array().cast("array<string>")
    allowed = F.coalesce(skips, F.array().cast("array<string>"))
    passed = F.array(
        *[F.coalesce(F.expr(g.condition), F.lit(False)) | F.array_contains(allowed, g.stage) for g in gates]
    )
    names = F.array(*[F.lit(g.stage) for g in gates])
    failing = F.array_position(passed, False).cast("int")
    reached = F.when(failing == 0, len(gates)).otherwise(failing - 1)
    return states.select(
        "project",
        reached.cast("long").alias("gates_passed"),
        F.when(reached > 0, F.try_element_at(names, F.greatest(reached, F.lit(1)))).alias("stage"),
        F.when(failing > 0, F.try_element_at(names, F.greatest(failing, F.lit(1)))).alias("failing_gate"),
    )


# What must have happened, in this order, before a workspace is cleaned.
CLEANUP_STEPS = (
    "integrated", "knowledge synced", "receipt", "preview", "dirty check", "reported", "approved", "approval recorded",
)


def cleanup_ready(events: DataFrame, steps: Sequence[str] = CLEANUP_STEPS) -> DataFrame:
    """Whether all steps of ``events(project, step, ts)`` were taken, none before the one in front of it.

    The last time of each step counts; the approval must be later than the report, not just as late.
    ``blocked_by`` is the first step that is missing or too early.
    """
    last = events.groupBy("project").agg(
        *[F.max(F.when(F.col("step") == s, F.col("ts"))).alias(f"__{i}") for i, s in enumerate(steps)]
    )
    blocked = F.lit(None).cast("string")
    for i in reversed(range(len(steps))):
        here = F.col(f"__{i}")
        bad = here.isNull()
        if i > 0:
            before = F.col(f"__{i - 1}")
            bad = bad | ((here <= before) if steps[i] == "approved" else (here < before))
        blocked = F.when(bad, steps[i]).otherwise(blocked)
    return last.select("project", blocked.alias("blocked_by")).withColumn("ready", F.col("blocked_by").isNull())


def residue(files: DataFrame, patterns: Sequence[Reason] = RESIDUE) -> DataFrame:
    """Candidates for removal with the first reason that applies."""
    reason = F.lit(None).cast("string")
    for p in reversed(patterns):
        reason = F.when(F.col("path").rlike(p.pattern), p.reason).otherwise(reason)
    return files.select("project", "path", reason.alias("reason")).filter(F.col("reason").isNotNull())


def missing_required(projects: DataFrame, files: DataFrame, required: Sequence[str]) -> DataFrame:
    """Required files ``projects(project, root)`` do not have."""
    names = F.array(*[F.lit(n) for n in required])
    wanted = projects.select("project", "root", F.explode(names).alias("missing"))
    return (
        wanted.withColumn("path", F.concat("root", F.lit("/"), "missing"))
        .join(files.select("path"), "path", "left_anti")
        .select("project", "missing")
    )


def naming_violations(
    projects: DataFrame, *, rule: str = "^[a-z0-9]+(-[a-z0-9]+)*$", exceptions: Sequence[str] = ()
) -> DataFrame:
    """Directory names of ``projects(project, name)`` that break the rule and are no exception."""
    broken = ~F.col("name").rlike(rule)
    if exceptions:
        broken = broken & ~F.col("name").isin(*exceptions)
    return projects.filter(broken).select("project", "name")


def repeat_violations(violations: DataFrame, *, n: int = 3) -> DataFrame:
    """Kinds of violation seen at least ``n`` times in a project; prose did not stop them."""
    return (
        violations.groupBy("project", "kind").agg(F.count(F.lit(1)).alias("times")).filter(F.col("times") >= n)
    )


def duplicate_rules(files: DataFrame, *, min_chars: int = 1) -> DataFrame:
    """Lines that stand in more than one file, whatever their case, spacing and list marks."""
    bare = F.transform(
        tx.lines(F.col("text")),
        lambda line: F.trim(
            F.regexp_replace(F.regexp_replace(F.lower(line), r"^[ \t]*[-*+>#]+[ \t]*", ""), r"[ \t]+", " ")
        ),
    )
    kept = F.array_distinct(F.filter(bare, lambda line: F.length(line) >= min_chars))
    return (
        files.select("path", F.explode(kept).alias("line"))
        .groupBy(F.sha2("line", 256).alias("line_hash"))
        .agg(F.count(F.lit(1)).alias("files"), F.min("line").alias("line"), F.min("path").alias("first_path"))
        .filter(F.col("files") > 1)
    )


def budget_check(
    files: DataFrame, budgets: Sequence[SizeBudget] = SIZE_BUDGETS, *, share: int = REPORT_SHARE
) -> DataFrame:
    """Files and rule chains above ``share`` percent of their budget.

    ``files(project, path, platform, kind, lines, bytes)``. Kind ``chain`` is summed per project and
    platform, kind ``generated`` has no budget.
    """
    chained = F.col("kind") == "chain"
    single = files.filter(~chained).select("project", "path", "platform", "kind", "lines", "bytes")
    chains = (
        files.filter(chained)
        .groupBy("project", "platform", "kind")
        .agg(F.sum("lines").alias("lines"), F.sum("bytes").alias("bytes"))
        .withColumn("path", F.lit(None).cast("string"))
    )
    used = F.lit(None).cast("double")
    for b in budgets:
        parts = [
            F.col(column) * 100.0 / limit
            for column, limit in (("lines", b.max_lines), ("bytes", b.max_bytes))
            if limit is not None
        ]
        most = F.greatest(*parts) if len(parts) > 1 else parts[0]
        here = (F.col("platform") == b.platform) & (F.col("kind") == b.kind)
        used = F.when(here, most).otherwise(used)
    return (
        single.unionByName(chains)
        .filter(F.col("kind") != "generated")
        .withColumn("used_pct", used)
        .filter(F.col("used_pct") > share)
        .select("project", "path", "platform", "kind", "lines", "bytes", F.floor("used_pct").alias("used_pct"))
    )


def memory_class(files: DataFrame, rules: Sequence[tuple[str, str]]) -> DataFrame:
    """Class of each file from ``(pattern, class)`` rules: manual, auto or generated.

    The first rule wins; a file no rule knows is generated, and generated files are read-only.
    """
    kind = F.lit("generated")
    for pattern, name in reversed(rules):
        kind = F.when(F.col("path").rlike(pattern), name).otherwise(kind)
    return files.select("project", "path", kind.alias("memory_class")).withColumn(
        "write_state",
        F.when(F.col("memory_class") == "generated", "generated-read-only").otherwise("by authorization"),
    )


def route_changes(
    changes: DataFrame, done: DataFrame, *, matrix: Mapping[str, Sequence[str]] = CHANGE_MATRIX
) -> DataFrame:
    """Surfaces each ``changes(change_id, change_type)`` still has to be checked on, after ``done``."""
    surfaces = F.lit(None).cast("array<string>")
    for kind, names in matrix.items():
        surfaces = F.when(
            F.col("change_type") == kind, F.array(*[F.lit(n) for n in names])
        ).otherwise(surfaces)
    return changes.select("change_id", "change_type", F.explode(surfaces).alias("surface")).join(
        done.select("change_id", "surface"), ["change_id", "surface"], "left_anti"
    )


def consumers(changes: DataFrame, deps: DataFrame, *, hops: int = 1) -> DataFrame:
    """Projects that use what changed: ``changes(symbol)``, ``deps(symbol, consumer)``, up to ``hops`` away."""
    edges = deps.select(F.col("symbol").alias("story_id"), F.col("consumer").alias("related_id"))
    start = changes.select(F.col("symbol").alias("story_id"))
    return related(start, edges, hops=hops).select(
        F.col("story_id").alias("symbol"), F.col("related_id").alias("consumer"), "hops"
    )


def triage(findings: DataFrame, scope: Sequence[str]) -> DataFrame:
    """Scope and action of each finding.

    ``findings(path, safe, reversible, side_effect, authorized, verified, generated, report_only)``.
    A fix needs all conditions; what is outside, generated, unverified or only to be reported stays
    read-only; everything else is reported first. Unknown flags count against the fix.
    """
    inside = F.lit(False)
    for root in scope:
        inside = inside | (F.col("path") == root) | F.startswith(F.col("path"), F.lit(f"{root.rstrip('/')}/"))

    def yes(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(False))

    place = F.when(~inside, "out-of-scope").when(~yes("verified"), "pending").otherwise("in-scope")
    read_only = ~inside | ~yes("verified") | yes("generated") | yes("report_only")
    may_fix = yes("safe") & yes("reversible") & ~F.coalesce("side_effect", F.lit(True)) & yes("authorized")
    return findings.withColumn("scope", place).withColumn(
        "action", F.when(read_only, "read-only").when(may_fix, "fix").otherwise("report first")
    )


def relative_dates(
    notes: DataFrame, lexicon: Sequence[Phrase] | DataFrame = RELATIVE_DATES, *, history: str = HISTORY
) -> DataFrame:
    """Words for relative dates in notes outside the history: ``path, rule_id, hits``."""
    current = notes.filter(~F.col("path").rlike(history)).withColumnRenamed("path", "doc_id")
    return phrase_hits(current, lexicon).select(F.col("doc_id").alias("path"), "rule_id", "hits")


def duplicate_installs(installs: DataFrame) -> DataFrame:
    """Names of ``installs(name, realpath)`` that stand for more than one real path."""
    return (
        installs.groupBy("name")
        .agg(
            F.count_distinct("realpath").alias("places"),
            F.min("realpath").alias("first_path"),
            F.max("realpath").alias("last_path"),
        )
        .filter(F.col("places") > 1)
    )


# Fixed value: how a line of a checksum manifest is written.
MANIFEST_LINE = r"^([0-9a-f]{64})\s\s([A-Za-z0-9._/-]+)$"


def _package_paths(
    manifest: DataFrame, files: DataFrame, allowed: Sequence[str], required: Sequence[str] | None
) -> DataFrame:
    """Lines, files and required names meet in one aggregation per package and path.

    ``package, path, lines`` (well-formed ones) ``, stated`` (lines at all) ``, problems``.
    """
    none = F.lit(None).cast("string")
    formed = F.col("line").rlike(MANIFEST_LINE)
    lines = manifest.select(
        "package",
        F.when(formed, F.substring("line", 67, 1 << 30)).otherwise(F.col("line")).alias("path"),
        F.when(formed, F.substring("line", 1, 64)).alias("wanted"),
        (~formed).alias("malformed"),
        none.alias("sha256"),
        F.lit(False).alias("needed"),
        F.lit(1).alias("line"),
    )
    names = F.array(*[F.lit(n) for n in (allowed if required is None else required)])
    rest = {"wanted": none, "malformed": F.lit(False), "line": F.lit(0)}
    there = files.select("package", "path", "sha256").withColumns({**rest, "needed": F.lit(False)})
    needed = (
        manifest.select("package").distinct().select("package", F.explode(names).alias("path"))
        .withColumns({**rest, "sha256": none, "needed": F.lit(True)})
    )
    per_path = (
        lines.unionByName(there)
        .unionByName(needed)
        .groupBy("package", "path", "malformed")
        .agg(
            F.count("wanted").alias("lines"),
            F.sum("line").alias("stated"),
            F.min("wanted").alias("first"),
            F.max("wanted").alias("last"),
            F.max("sha256").alias("sha256"),
            F.bool_or("needed").alias("needed"),
        )
    )
    unsafe = F.startswith("path", F.lit("/")) | F.contains("path", F.lit("..")) | F.contains("path", F.lit("//"))
    listed, absent = F.col("lines") > 0, F.col("sha256").isNull()
    found = F.array(
        F.when(F.col("malformed"), "malformed line"),
        F.when(listed & unsafe, "unsafe path"),
        F.when(listed & ~unsafe & ~F.col("path").isin(*allowed), "path not allowed"),
        F.when(F.col("lines") > 1, "path listed twice"),
        F.when(listed & absent, "file missing"),
        F.when(listed & ((F.col("sha256") != F.col("first")) | (F.col("sha256") != F.col("last"))), "hash differs"),
        F.when(F.col("needed") & absent, "required file absent"),
    )
    problems = F.filter(found, lambda p: p.isNotNull())
    return per_path.select("package", "path", "lines", "stated", problems.alias("problems"))


def manifest_problems(
    manifest: DataFrame, files: DataFrame, *, allowed: Sequence[str], required: Sequence[str] | None = None
) -> DataFrame:
    """Everything wrong with packages: ``package, problem, path``.

    ``manifest(package, line)`` holds checksum lines, ``files(package, path, sha256)`` what is there.
    """
    return _package_paths(manifest, files, allowed, required).select(
        "package", F.explode("problems").alias("problem"), "path"
    )


def verify_manifest(
    manifest: DataFrame,
    files: DataFrame,
    *,
    allowed: Sequence[str],
    required: Sequence[str] | None = None,
    exactly: int = 6,
) -> DataFrame:
    """Per package the number of listed files, of problems, and whether it may be installed."""
    return (
        _package_paths(manifest, files, allowed, required)
        .groupBy("package")
        .agg(
            F.sum("lines").alias("listed"),
            F.sum(F.size("problems")).alias("problems"),
            F.sum("stated").alias("stated"),
        )
        .filter("stated > 0")
        .drop("stated")
        .withColumn("ok", (F.col("problems") == 0) & (F.col("listed") == exactly))
    )


# Files that must not be tracked, and the ignore patterns that keep them out.
SENSITIVE = {
    ".env": r"(^|/)\.env(\.[^/]+)?$",
    "*.pem": r"\.pem$",
    "*.key": r"\.key$",
    "credentials*": r"(^|/)credentials[^/]*$",
}


def secret_hygiene(
    files: DataFrame, ignores: DataFrame, *, sensitive: Mapping[str, str] = SENSITIVE
) -> DataFrame:
    """Per project and ignore pattern: tracked files it should keep out, and whether it is set.

    Only counts are reported. ``ignores(project, pattern)``; rows without a finding are left out.
    """
    projects = files.select("project").distinct()
    rules = F.array(
        *[F.struct(F.lit(p).alias("pattern"), F.lit(r).alias("regex")) for p, r in sensitive.items()]
    )
    wanted = projects.select("project", F.inline(rules)).select("project", "pattern")
    hits = F.array(
        *[F.when(F.col("path").rlike(r), F.lit(p)) for p, r in sensitive.items()]
    )
    tracked = (
        files.select("project", F.explode(F.filter(hits, lambda p: p.isNotNull())).alias("pattern"))
        .groupBy("project", "pattern")
        .agg(F.count(F.lit(1)).alias("tracked"))
    )
    ignored = ignores.select("project", "pattern").distinct().withColumn("ignored", F.lit(True))
    return (
        wanted.join(tracked, ["project", "pattern"], "left")
        .join(ignored, ["project", "pattern"], "left")
        .fillna({"tracked": 0, "ignored": False})
        .filter((F.col("tracked") > 0) | ~F.col("ignored"))
    )
