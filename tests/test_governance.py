from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import governance as gov
from tidemark.sources import tables

FILE = "project STRING, root STRING, path STRING, text STRING"


def files(spark, *rows):
    return spark.createDataFrame([("p", "/p", path, text) for path, text in rows], FILE)


def test_inventory(spark):
    given = files(spark, ("/p/README.md", "a\nb"), ("/p/docs/x.mdx", "é\n"), ("/p/node_modules/y.md", ""), ("/p/vendor/z.md", ""), ("/p/build.md", ""), ("/p/a.txt", ""))
    inventory = gov.markdown_inventory(given)
    assert [(r.path, r.lines, r.bytes) for r in inventory.collect()] == [("/p/README.md", 1, 3), ("/p/build.md", 0, 0), ("/p/docs/x.mdx", 1, 3)]
    assert gov.markdown_count(inventory).collect()[0].files == 3


def test_rule_chain(spark):
    there = ["/w/p/CLAUDE.md", "/w/p/AGENTS.md", "/w/p/.claude/CLAUDE.md", "/w/AGENTS.override.md", "/AGENTS.md", "/other/AGENTS.md", "/home/u/.codex/AGENTS.md"]
    projects = spark.createDataFrame([("p", "/w/p"), ("home", "/home/u/.codex")], "project STRING, root STRING")
    chain = gov.rule_chain(files(spark, *[(p, "") for p in there]), projects, home="/home/u").orderBy("project", "position").collect()
    assert [r.path for r in chain if r.project == "p"] == [
        "/w/p/AGENTS.md", "/w/p/CLAUDE.md", "/w/p/.claude/CLAUDE.md", "/w/AGENTS.override.md", "/AGENTS.md", "/home/u/.codex/AGENTS.md",
    ]
    assert [r.path for r in chain if r.project == "home"] == ["/home/u/.codex/AGENTS.md", "/AGENTS.md"]


def test_rule_chain_looks_before_it_ranks(spark):
    there = files(spark, *[(p, "") for p in ("/w/AGENTS.md", "/w/AGENTS.md", "/w/.claude/CLAUDE.md", "/h/.claude/CLAUDE.md", "/h/.codex/AGENTS.md", "/wAGENTS.md")])
    projects = spark.createDataFrame([("p", "/w"), ("p", "/w"), ("q", "/h"), ("none", None)], "project STRING, root STRING")
    chain = gov.rule_chain(there, projects, home="/h")
    assert sorted(map(tuple, chain.collect())) == [
        ("none", 1, "/h/.codex/AGENTS.md"), ("none", 2, "/h/.claude/CLAUDE.md"),
        ("p", 1, "/w/AGENTS.md"), ("p", 2, "/w/.claude/CLAUDE.md"), ("p", 3, "/h/.codex/AGENTS.md"), ("p", 4, "/h/.claude/CLAUDE.md"),
        ("q", 1, "/h/.claude/CLAUDE.md"), ("q", 2, "/h/.codex/AGENTS.md"),
    ]
    # Only files that are there are grouped by project, not every name on every level.
    plan = chain._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [project") < plan.index("Join")


def test_symlinks(spark):
    rows = [("/a/real", False, None), ("/a/one", True, "real"), ("/b/two", True, "../a/one"), ("/b/dead", True, "/none"), ("/c/x", True, "y"), ("/c/y", True, "x"), ("/c/self", True, "self")]
    linked = spark.createDataFrame(rows, "path STRING, is_symlink BOOLEAN, target STRING")
    got = {r.path: r.state for r in gov.symlink_state(linked).collect()}
    assert got == {"/a/one": "valid", "/b/two": "valid", "/b/dead": "broken", "/c/x": "broken", "/c/y": "broken", "/c/self": "broken"}


def test_dead_references(spark):
    text = "[a](b.md) [c](../up.md#x) [w](https://x.test/a.md) [m](mailto:a@b.c) `src/gone.ts` `src/here.ts` `npm run x`\n[t](#top)"
    given = files(spark, ("/p/docs/a.md", text), ("/p/docs/b.md", ""), ("/p/src/here.ts", ""))
    assert {r.target for r in gov.dead_links(given).collect()} == {"/p/up.md", "/p/src/gone.ts"}
    index = spark.createDataFrame([("p", "streaming.md"), ("p", "ocr-plan.md")], "project STRING, file STRING")
    notes = spark.createDataFrame([("p", "streaming.md"), ("p", "extra.md")], "project STRING, file STRING")
    got = {r.file: r.finding for r in gov.index_diff(index, notes).collect()}
    assert got == {"ocr-plan.md": "entry without file", "extra.md": "file without entry"}


def test_facts(spark):
    rows = [("port", "docs", "3000"), ("port", "code", "3005"), ("port", "code", "3005"), ("db", "runtime", "pg"), ("db", "memory", "pg"), ("who", "docs", "x"), ("who", "memory", "y")]
    facts = spark.createDataFrame(rows, "topic STRING, surface STRING, value STRING")
    got = {(r.topic, r.surface): (r.status, r.conflict) for r in gov.fact_conflicts(facts).collect()}
    assert got == {
        ("port", "docs"): ("stale", True), ("port", "code"): ("verified-current", True), ("db", "runtime"): ("verified-current", False),
        ("db", "memory"): ("verified-current", False), ("who", "docs"): ("pending", True), ("who", "memory"): ("pending", True),
    }
    wide = gov.status_matrix(facts.select("topic", "surface", F.lit("pending").alias("status"))).filter("topic = 'db'").first()
    assert (wide.runtime, wide.code, wide.workspace) == ("pending", "not-applicable", "not-applicable")


def test_hot_topic_is_split_by_the_engine(spark):
    """The rows of a topic that holds most facts are joined by several tasks."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10KB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        topic = F.when(F.col("id") % 3 > 0, -1).otherwise(F.col("id"))
        surface = F.when(F.col("id") % 2 > 0, "docs").otherwise("code")
        facts = spark.range(60000).select(topic.alias("topic"), surface.alias("surface"), F.col("id").cast("string").alias("value"))
        judged = gov.fact_conflicts(facts)
        assert len(judged.collect()) == 60000
        assert "skew=true" in judged._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_routes_and_environment(spark):
    code = files(spark, ("/p/d.ts", "app.post('/device/code', x); app.get('/device/verify'); ttl: process.env.DEVICE_CODE_TTL ?? 600"), ("/p/m.sql", "CREATE TABLE device_codes ("))
    docs = files(spark, ("/p/g.md", "| GET | /authorize | x |\n`POST /token`\nGET /device/verify"))
    got = {(r.symbol, r.finding) for r in gov.coverage(gov.routes(code), gov.routes(docs)).collect()}
    assert got == {("POST /device/code", "undocumented"), ("GET /authorize", "not in code"), ("POST /token", "not in code")}
    assert {(r.kind, r.symbol) for r in gov.symbols(code, gov.CODE_SYMBOLS).collect()} == {("env", "DEVICE_CODE_TTL"), ("table", "device_codes")}
    old = files(spark, ("/p/a.md", "use NextAuth, NextAuth"), ("/p/CHANGELOG.md", "NextAuth"), ("/p/history/b.md", "NextAuth"))
    assert [(r.path, r.mentions) for r in gov.retired_refs(old, ("NextAuth",)).collect()] == [("/p/a.md", 2)]


def test_release_stage(spark, tmp_path):
    (tmp_path / "s.json").write_text(
        '{"project": "p", "implemented": true, "locally_verified": true, "checks_passed": true, "pr": 42, "pr_state": "MERGED", "merge_commit": "bb",'
        ' "production_marker": "aa", "web": "active", "worker": "active", "live_release": "bb", "knowledge_receipt": true}'
    )
    schema = (
        "project STRING, implemented BOOLEAN, locally_verified BOOLEAN, checks_passed BOOLEAN, pr INT, pr_state STRING, merge_commit STRING, production_marker STRING,"
        " web STRING, worker STRING, live_release STRING, knowledge_receipt BOOLEAN, reported BOOLEAN, cleanup_approved BOOLEAN, cleaned BOOLEAN, audited BOOLEAN, result_appended BOOLEAN"
    )
    states = tables.read_json(spark, str(tmp_path), schema)
    row = gov.release_stage(states).first()
    assert (row.stage, row.failing_gate, row.gates_passed) == ("merged", "deployed", 5)
    live = gov.release_stage(states.withColumn("production_marker", F.lit("bb"))).first()
    assert (live.stage, live.failing_gate) == ("knowledge closed", "reported")
    none = gov.release_stage(states.withColumn("implemented", F.lit(None).cast("boolean"))).first()
    assert (none.stage, none.failing_gate) == (None, "implemented")


def test_cleanup_needs_approval_after_the_report(spark):
    t = dt.datetime(2026, 1, 1)

    def events(project, times):
        return [(project, s, t + dt.timedelta(hours=h)) for s, h in zip(gov.CLEANUP_STEPS, times) if h is not None]

    rows = events("ok", range(8)) + events("same", [0, 0, 0, 0, 0, 5, 5, 6]) + events("early", [0, 1, 2, 3, 4, 9, 6, 10]) + events("gap", [0, 1, None, 3, 4, 5, 6, 7])
    ready = gov.cleanup_ready(spark.createDataFrame(rows, "project STRING, step STRING, ts TIMESTAMP"))
    assert {r.project: r.blocked_by for r in ready.collect()} == {"ok": None, "same": "approved", "early": "approved", "gap": "receipt"}


def test_residue_and_missing_and_naming(spark):
    names = ["PLAN.md", "TODO-fix-bug.md", "server_old.js", "notes/debug-notes.md", "server.js", "data_backup/x", "a_v2.py", "README.md"]
    found = {r.path.removeprefix("/p/") for r in gov.residue(files(spark, *[(f"/p/{n}", "") for n in names])).collect()}
    assert found == {"PLAN.md", "TODO-fix-bug.md", "server_old.js", "notes/debug-notes.md", "data_backup/x", "a_v2.py"}
    projects = spark.createDataFrame([("p", "/p", "my-app"), ("q", "/q", "Legacy_App"), ("r", "/r", "Old_Lib")], "project STRING, root STRING, name STRING")
    missing = gov.missing_required(projects, files(spark, ("/p/README.md", "")), ("README.md",))
    assert {r.project for r in missing.collect()} == {"q", "r"}
    assert [r.name for r in gov.naming_violations(projects, exceptions=("Old_Lib",)).collect()] == ["Legacy_App"]


def test_budgets_and_memory(spark):
    rows = [("p", "/a", "claude", "rules", 140, 1), ("p", "/b", "claude", "rules", 141, 1), ("p", "/c", "claude", "auto", 1, 17921), ("p", "/d", "codex", "chain", 1, 12000),
            ("p", "/e", "codex", "chain", 1, 12000), ("p", "/f", "codex", "generated", 9999, 9999999), ("p", "/g", "other", "rules", 9999, 1)]
    given = spark.createDataFrame(rows, "project STRING, path STRING, platform STRING, kind STRING, lines BIGINT, bytes BIGINT")
    got = {(r.path, r.kind): r.used_pct for r in gov.budget_check(given).collect()}
    assert got == {("/b", "rules"): 70, ("/c", "auto"): 70, (None, "chain"): 73}
    kinds = gov.memory_class(files(spark, ("/p/CLAUDE.md", ""), ("/p/memories/x.md", "")), ((r"CLAUDE\.md$", "manual"),)).collect()
    assert {r.path: r.write_state for r in kinds} == {"/p/CLAUDE.md": "by authorization", "/p/memories/x.md": "generated-read-only"}


def test_routing_consumers_triage(spark):
    changes = spark.createDataFrame([(1, "env"), (2, "unknown")], "change_id INT, change_type STRING")
    done = spark.createDataFrame([(1, "runbook")], "change_id INT, surface STRING")
    assert {r.surface for r in gov.route_changes(changes, done).collect()} == {"example env", "defaults", "downstream config", "cost and fallback"}
    deps = spark.createDataFrame([("auth", "hub"), ("hub", "web"), ("web", "auth")], "symbol STRING, consumer STRING")
    got = {(r.consumer, r.hops) for r in gov.consumers(spark.createDataFrame([("auth",)], "symbol STRING"), deps, hops=2).collect()}
    assert got == {("hub", 1), ("web", 2)}
    flags = "safe BOOLEAN, reversible BOOLEAN, side_effect BOOLEAN, authorized BOOLEAN, verified BOOLEAN, generated BOOLEAN, report_only BOOLEAN"
    rows = [("/p/a", True, True, False, True, True, False, False), ("/pb/a", True, True, False, True, True, False, False), ("/p/b", True, True, None, True, True, False, False),
            ("/p/c", True, True, False, True, False, False, False), ("/p/d", True, True, False, True, True, True, False)]
    got = {r.path: (r.scope, r.action) for r in gov.triage(spark.createDataFrame(rows, "path STRING, " + flags), ("/p",)).collect()}
    assert got == {
        "/p/a": ("in-scope", "fix"), "/pb/a": ("out-of-scope", "read-only"), "/p/b": ("in-scope", "report first"),
        "/p/c": ("pending", "read-only"), "/p/d": ("in-scope", "read-only"),
    }


def test_repeats_duplicates_dates_installs(spark):
    seen = spark.createDataFrame([("p", "a")] * 2 + [("p", "b")] * 3, "project STRING, kind STRING")
    assert [(r.kind, r.times) for r in gov.repeat_violations(seen).collect()] == [("b", 3)]
    rules = files(spark, ("/p/a", "- Never  push\nx\nx"), ("/p/b", "never push "), ("/p/c", "other"))
    assert [(r.line, r.files) for r in gov.duplicate_rules(rules).collect()] == [("never push", 2)]
    notes = files(spark, ("/p/n.md", "上周定了，最近再说"), ("/p/changelog.md", "上周"))
    assert {(r.path, r.hits) for r in gov.relative_dates(notes).collect()} == {("/p/n.md", 1)}
    installs = spark.createDataFrame([("s", "/a"), ("s", "/b"), ("t", "/c"), ("t", "/c")], "name STRING, realpath STRING")
    assert [(r.name, r.places) for r in gov.duplicate_installs(installs).collect()] == [("s", 2)]


@pytest.fixture
def package(spark, tmp_path):
    from hashlib import sha256

    names = ("a.md", "b/c.md")
    digest = {n: sha256(n.encode()).hexdigest() for n in names}
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "manifest").write_text("".join(f"{digest[n]}  {n}\n" for n in names))
    manifest = tables.manifest_lines(spark, str(tmp_path / "m")).withColumn("package", F.lit("k"))
    there = spark.createDataFrame([("k", n, digest[n]) for n in names], "package STRING, path STRING, sha256 STRING")
    return manifest, there, names


def test_manifest(spark, package):
    manifest, there, names = package
    good = gov.verify_manifest(manifest, there, allowed=names, exactly=2).collect()
    assert [(r.listed, r.problems, r.ok) for r in good] == [(2, 0, True)]
    assert not gov.verify_manifest(manifest, there, allowed=names).first().ok

    def problems(lines=manifest, held=there, **options):
        return {(r.path, r.problem) for r in gov.manifest_problems(lines, held, **{"allowed": names, **options}).collect()}

    assert problems(held=there.withColumn("sha256", F.lit("0"))) == {(n, "hash differs") for n in names}
    assert problems(held=there.filter("path = 'a.md'")) == {("b/c.md", "file missing"), ("b/c.md", "required file absent")}
    assert problems(allowed=("a.md",)) == {("b/c.md", "path not allowed")}
    odd = spark.createDataFrame([("k", "0" * 64 + "  ../x"), ("k", "short  a.md")], "package STRING, line STRING")
    assert problems(lines=manifest.select("package", "line").union(odd)) == {
        ("../x", "unsafe path"), ("../x", "file missing"), ("short  a.md", "malformed line"),
    }
    assert ("a.md", "path listed twice") in problems(lines=manifest.union(manifest))


def test_secrets_are_counted_not_copied(spark):
    given = files(spark, ("/p/.env", "KEY=1"), ("/p/x/.env.local", ""), ("/p/key.pem", ""), ("/p/env.md", ""))
    ignores = spark.createDataFrame([("p", ".env"), ("p", "*.key")], "project STRING, pattern STRING")
    got = {r.pattern: (r.tracked, r.ignored) for r in gov.secret_hygiene(given, ignores).collect()}
    assert got == {".env": (2, True), "*.pem": (1, False), "credentials*": (0, False)}
