"""Registered governance queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import governance
from tidemark.operators.style import Phrase
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.tables import table

INVENTORY = r"""
    SELECT project, path, length(text) - length(replace(text, chr(10), '')) AS lines, strlen(text) AS bytes FROM files
    WHERE regexp_matches(path, '\.mdx?$') AND NOT contains(path, '/vendor/')"""


@query("governance_markdown_inventory", "files", sql=INVENTORY)
def _(spark, folder):
    return governance.markdown_inventory(derived.files(spark, folder))


@query("governance_markdown_count", "files", sql=f"""
    SELECT project, count(*) AS files, CAST(sum(lines) AS BIGINT) AS lines, CAST(sum(bytes) AS BIGINT) AS bytes FROM ({INVENTORY}) GROUP BY project""")
def _(spark, folder):
    return governance.markdown_count(governance.markdown_inventory(derived.files(spark, folder)))


@query("governance_size_facts", "files", sql="""
    SELECT path, length(text) - length(replace(text, chr(10), '')) AS lines, strlen(text) AS bytes FROM files""")
def _(spark, folder):
    return governance.with_size_facts(derived.files(spark, folder)).select("path", "lines", "bytes")


def rule_files(spark, folder):
    """Rule files on the levels of the customer directories, and one of a user's own."""
    dirs = derived.customer_dirs(spark, folder)
    region = dirs.select(F.concat(F.lit("/"), "r_name", F.lit("/AGENTS.md")).alias("path")).distinct()
    nation = dirs.select(F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name", F.lit("/CLAUDE.md")).alias("path")).distinct()
    own = dirs.filter("c_mktsegment = 'BUILDING'").select(
        F.explode(F.array(F.concat("path", F.lit("/AGENTS.override.md")), F.concat("path", F.lit("/.claude/CLAUDE.md")))).alias("path")
    )
    home = table(spark, folder, "region").filter("r_name = 'ASIA'").select(F.lit("/home/u/.codex/AGENTS.md").alias("path"))
    return region.union(nation).union(own).union(home)


@query("governance_rule_chain", "customer_dirs", sql="""
    WITH found AS (
        SELECT c_custkey AS project, 0 AS depth, 0 AS nth, path || '/AGENTS.override.md' AS path FROM customer_dirs WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT c_custkey, 0, 4, path || '/.claude/CLAUDE.md' FROM customer_dirs WHERE c_mktsegment = 'BUILDING'
        UNION ALL SELECT c_custkey, 1, 2, '/' || r_name || '/' || n_name || '/CLAUDE.md' FROM customer_dirs
        UNION ALL SELECT c_custkey, 2, 1, '/' || r_name || '/AGENTS.md' FROM customer_dirs
        UNION ALL SELECT c_custkey, 99, 1, '/home/u/.codex/AGENTS.md' FROM customer_dirs)
    SELECT project, row_number() OVER (PARTITION BY project ORDER BY depth, nth) AS position, path FROM found""")
def _(spark, folder):
    projects = derived.customer_dirs(spark, folder).select(F.col("c_custkey").alias("project"), F.col("path").alias("root"))
    return governance.rule_chain(rule_files(spark, folder), projects, home="/home/u")


@query("governance_symlink_state", sql="""
    WITH RECURSIVE links AS (SELECT c_custkey AS id, c_custkey // 2 AS target FROM customer WHERE c_mktsegment <> 'BUILDING'),
    chain(id, place, hops) AS (SELECT id, target, 1 FROM links
        UNION ALL SELECT chain.id, links.target, hops + 1 FROM chain JOIN links ON place = links.id WHERE hops < 40)
    SELECT '/link/c' || l.id AS path, '/link/c' || l.target AS target,
           CASE WHEN bool_or(c_mktsegment = 'BUILDING') THEN 'valid' ELSE 'broken' END AS state
    FROM links l JOIN chain USING (id) LEFT JOIN customer ON c_custkey = place GROUP BY l.id, l.target""")
def _(spark, folder):
    # Customers outside one segment are links to the customer with half their number.
    half = F.floor(F.col("c_custkey") / 2).cast("string")
    linked = F.col("c_mktsegment") != "BUILDING"
    files = table(spark, folder, "customer").select(
        F.concat(F.lit("/link/c"), F.col("c_custkey").cast("string")).alias("path"),
        linked.alias("is_symlink"),
        F.when(linked, F.concat(F.lit("./../link/c"), half)).alias("target"),
    )
    return governance.symlink_state(files)


@query("governance_linked_state", "link_ends", sql="""
    WITH ends AS (
        SELECT n, dir, c_mktsegment <> 'BUILDING' AND end_key % 3 <> 0 AS there
        FROM link_ends JOIN customer ON c_custkey = end_key)
    SELECT '/links/c' || n AS path, CASE WHEN n % 2 = 1 OR n = 0 THEN dir ELSE '/links/c' || (n // 2) END AS target,
           CASE WHEN there THEN 'valid' ELSE 'broken' END AS state FROM ends
    UNION ALL SELECT '/hop/n' || n_nationkey, '/links', 'valid' FROM nation
    UNION ALL SELECT '/links/r' || n, '/links/s' || n || '/x', 'broken' FROM ends WHERE n % 40 = 7
    UNION ALL SELECT '/links/s' || n, '/links/r' || n, 'broken' FROM ends WHERE n % 40 = 7
    UNION ALL SELECT '/index/f' || n, '/hop/n' || (n % 25) || '/c' || n || '/readme.md',
           CASE WHEN there THEN 'valid' ELSE 'broken' END FROM ends""")
def _(spark, folder):
    # Some customers' folders hold a file, and every customer has a link to it through a linked folder.
    own = derived.customer_dirs(spark, folder)
    readme = own.filter("c_mktsegment <> 'BUILDING' AND c_custkey % 3 <> 0").select(
        F.concat("path", F.lit("/readme.md")).alias("path"), F.lit(False).alias("is_symlink"), F.lit(None).cast("string").alias("target")
    )
    n = F.col("c_custkey")
    index = own.select(
        F.concat(F.lit("/index/f"), n).alias("path"),
        F.concat(F.lit("../hop/n"), n % 25, F.lit("/c"), n, F.lit("/readme.md")).alias("target"),
    )
    linked = derived.links(spark, folder).union(index).select("path", F.lit(True).alias("is_symlink"), "target")
    return governance.symlink_state(readme.union(linked))


@query("governance_dead_links", "files", sql=r"""
    WITH numbered AS (SELECT project, path, CAST(regexp_extract(path, '/d([0-9]+)[._]', 1) AS BIGINT) AS id FROM files WHERE regexp_matches(path, '\.mdx?$')),
    refs AS (
        SELECT project, path, 'd' || (id + 1) || '.md' AS ref, regexp_replace(path, '/[^/]*$', '') || '/d' || (id + 1) || '.md' AS target FROM numbered
        UNION ALL SELECT project, path, 'docs/d' || (id + 2) || '.md', '/corpus/docs/d' || (id + 2) || '.md' FROM numbered)
    SELECT * FROM refs WHERE target NOT IN (SELECT path FROM files)""")
def _(spark, folder):
    return governance.dead_links(derived.files(spark, folder))


@query("governance_index_diff", sql="""
    SELECT 'corpus' AS project, coalesce(page_id, doc_id) AS file,
           CASE WHEN doc_id IS NULL THEN 'entry without file' ELSE 'file without entry' END AS finding
    FROM pages FULL JOIN labels ON page_id = doc_id WHERE page_id IS NULL OR doc_id IS NULL""")
def _(spark, folder):
    index = table(spark, folder, "pages").select(F.lit("corpus").alias("project"), F.col("page_id").alias("file"))
    files = table(spark, folder, "labels").select(F.lit("corpus").alias("project"), F.col("doc_id").alias("file"))
    return governance.index_diff(index, files)


LATEST = "latest AS (SELECT topic, surface, arg_max(value, seq) AS value FROM facts GROUP BY ALL)"


def latest_facts(spark, folder):
    return derived.facts(spark, folder).groupBy("topic", "surface").agg(F.max_by("value", "seq").alias("value"))


@query("governance_fact_conflicts", "facts", sql=f"""
    WITH {LATEST}, ruled AS (SELECT topic, count(DISTINCT value) > 1 AS conflict,
        coalesce(max(value) FILTER (surface = 'code'), max(value) FILTER (surface = 'runtime')) AS ruling FROM latest GROUP BY topic)
    SELECT topic, surface, value, conflict, CASE WHEN ruling IS NULL THEN 'pending' WHEN value = ruling THEN 'verified-current' ELSE 'stale' END AS status
    FROM latest JOIN ruled USING (topic)""")
def _(spark, folder):
    return governance.fact_conflicts(latest_facts(spark, folder))


@query("governance_status_matrix", "facts", sql=f"""
    WITH {LATEST}, s AS (SELECT topic, surface, CASE value WHEN 'O' THEN 'verified-current' WHEN 'F' THEN 'changed-and-verified' ELSE 'pending' END AS status FROM latest)
    SELECT topic, """ + ", ".join(
        f"coalesce(max(status) FILTER (surface = '{s}'), 'not-applicable') AS {s}" for s in governance.FACES
    ) + " FROM s GROUP BY topic")
def _(spark, folder):
    status = derived.mapped(F.col("value"), {"O": "verified-current", "F": "changed-and-verified"}, "pending")
    facts = latest_facts(spark, folder).select("topic", "surface", status.alias("status"))
    return governance.status_matrix(facts)


@query("governance_symbol_coverage", "files", sql="""
    WITH s AS (SELECT DISTINCT project, path LIKE '%.js' AS code, unnest(regexp_extract_all(text, '[A-Z][a-zäöü]{7,}')) AS symbol FROM files),
         g AS (SELECT project, symbol, bool_or(code) AS in_code, bool_or(NOT code) AS in_docs FROM s GROUP BY ALL)
    SELECT project, 'name' AS kind, symbol, CASE WHEN in_code THEN 'undocumented' ELSE 'not in code' END AS finding FROM g WHERE NOT (in_code AND in_docs)""")
def _(spark, folder):
    files = derived.files(spark, folder)
    pattern = {"name": "([A-Z][a-zäöü]{7,})"}
    code = governance.symbols(files.filter(F.col("path").endswith(".js")), pattern)
    return governance.coverage(code, governance.symbols(files.filter(~F.col("path").endswith(".js")), pattern))


@query("governance_retired_refs", "files", sql="""
    SELECT * FROM (SELECT project, path, symbol, len(string_split(text, symbol)) - 1 AS mentions
        FROM files, (SELECT unnest(['token', 'heit', 'The ']) AS symbol) WHERE NOT contains(path, '/guides/')) WHERE mentions > 0""")
def _(spark, folder):
    return governance.retired_refs(derived.files(spark, folder), ("token", "heit", "The "), history="/guides/")


@query("governance_retired_symbols", "files", sql="""
    WITH symbols AS (SELECT DISTINCT split_part(text, ' ', 3) AS symbol FROM documents WHERE lang = 'es')
    SELECT project, path, symbol, (length(text) - length(replace(text, symbol, ''))) // length(symbol) AS mentions
    FROM files JOIN symbols ON symbol <> '' AND contains(text, symbol) WHERE NOT contains(path, '/guides/')""")
def _(spark, folder):
    symbols = table(spark, folder, "documents").filter("lang = 'es'")
    symbols = symbols.select(F.split_part("text", F.lit(" "), F.lit(3)).alias("symbol")).distinct()
    return governance.retired_refs(derived.files(spark, folder), symbols, history="/guides/")


@query("governance_release_stage", sql="""
    WITH s AS (SELECT o_orderkey AS project, [true, o_totalprice > 5000, o_custkey IS NOT NULL, o_totalprice > 20000, o_orderstatus = 'F',
            o_totalprice > 50000 AND o_orderpriority <> '5-LOW', o_totalprice > 80000, o_totalprice > 100000, o_totalprice > 120000,
            o_totalprice > 140000, o_totalprice > 160000, o_totalprice > 180000, o_totalprice > 200000] AS ok FROM orders),
         names AS (SELECT ['implemented', 'locally verified', 'pr opened', 'checks passed', 'merged', 'deployed', 'live verified', 'knowledge closed',
            'reported', 'cleanup approved', 'cleaned', 'audited', 'appended'] AS names),
         f AS (SELECT project, coalesce(list_position(ok, false), 0) AS failing FROM s)
    SELECT project, CAST(CASE WHEN failing = 0 THEN 13 ELSE failing - 1 END AS BIGINT) AS gates_passed,
           names[CASE WHEN failing = 0 THEN 13 ELSE failing - 1 END] AS stage, CASE WHEN failing > 0 THEN names[failing] END AS failing_gate
    FROM f, names""")
def _(spark, folder):
    price = F.col("o_totalprice")
    flags = {
        "implemented": F.lit(True), "locally_verified": price > 5000, "checks_passed": price > 20000, "knowledge_receipt": price > 100000,
        "reported": price > 120000, "cleanup_approved": price > 140000, "cleaned": price > 160000, "audited": price > 180000,
        "result_appended": price > 200000,
    }
    states = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("project"), F.col("o_custkey").alias("pr"),
        F.when(F.col("o_orderstatus") == "F", "merged").otherwise("open").alias("pr_state"),
        F.md5("o_orderpriority").alias("merge_commit"),
        F.when(price > 50000, F.md5("o_orderpriority")).alias("production_marker"),
        F.lit("active").alias("web"), F.when(F.col("o_orderpriority") == "5-LOW", "failed").otherwise("active").alias("worker"),
        F.when(price > 80000, F.md5("o_orderpriority")).alias("live_release"),
        *[flag.alias(name) for name, flag in flags.items()],
    )
    return governance.release_stage(states)


STEP = "least(CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS INTEGER) // 12, 7)"


@query("governance_cleanup_ready", sql=f"""
    WITH last AS (SELECT user_id AS project, {STEP} AS step, max(ts) AS ts FROM events GROUP BY ALL),
         grid AS (SELECT p.user_id AS project, s.step, ts FROM (SELECT DISTINCT user_id FROM events) p
                  CROSS JOIN (SELECT unnest(range(8)) AS step) s LEFT JOIN last l ON l.project = p.user_id AND l.step = s.step),
         judged AS (SELECT *, ts IS NULL OR (step = 6 AND ts <= lag(ts) OVER w) OR coalesce(ts < lag(ts) OVER w, false) AS bad
                    FROM grid WINDOW w AS (PARTITION BY project ORDER BY step))
    SELECT project, ['integrated', 'knowledge synced', 'receipt', 'preview', 'dirty check', 'reported', 'approved', 'approval recorded']
                    [min(step) FILTER (bad) + 1] AS blocked_by, NOT bool_or(bad) AS ready FROM judged GROUP BY project""")
def _(spark, folder):
    number = F.least(F.floor(F.from_json("props", "k INT").k / 12), F.lit(7))
    steps = F.array(*[F.lit(s) for s in governance.CLEANUP_STEPS])
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("project"), F.element_at(steps, (number + 1).cast("int")).alias("step"), "ts"
    )
    return governance.cleanup_ready(events)


@query("governance_residue", "files", sql="""
    SELECT project, path, 'replaced copy' AS reason FROM files WHERE path LIKE '%!_old.js' ESCAPE '!'""")
def _(spark, folder):
    return governance.residue(derived.files(spark, folder))


@query("governance_missing_required", "customer_dirs", sql="""
    SELECT c_custkey AS project, unnest(CASE WHEN c_mktsegment = 'BUILDING' THEN ['README.md'] ELSE ['README.md', 'AGENTS.override.md'] END) AS missing FROM customer_dirs""")
def _(spark, folder):
    projects = derived.customer_dirs(spark, folder).select(F.col("c_custkey").alias("project"), F.col("path").alias("root"))
    return governance.missing_required(projects, rule_files(spark, folder), ("README.md", "AGENTS.override.md"))


@query("governance_naming_violations", sql="""
    SELECT p_partkey AS project, name FROM (SELECT p_partkey, CASE WHEN p_size > 25 THEN replace(p_name, ' ', '-') WHEN p_size > 10 THEN p_name ELSE upper(p_name) END AS name FROM part)
    WHERE NOT regexp_full_match(name, '[a-z0-9]+(-[a-z0-9]+)*') AND name NOT IN ('red widget', 'BLUE BOLT')""")
def _(spark, folder):
    size = F.col("p_size")
    name = F.when(size > 25, F.replace("p_name", F.lit(" "), F.lit("-"))).when(size > 10, F.col("p_name")).otherwise(F.upper("p_name"))
    projects = table(spark, folder, "part").select(F.col("p_partkey").alias("project"), name.alias("name"))
    return governance.naming_violations(projects, exceptions=("red widget", "BLUE BOLT"))


@query("governance_repeat_violations", "runs", sql="""
    SELECT run AS project, "check" AS kind, count(*) AS times FROM runs WHERE NOT ok GROUP BY ALL HAVING count(*) >= 3""")
def _(spark, folder):
    violations = derived.runs(spark, folder).filter("NOT ok").select(F.col("run").alias("project"), F.col("check").alias("kind"))
    return governance.repeat_violations(violations)


@query("governance_duplicate_rules", "files", sql=r"""
    WITH l AS (SELECT DISTINCT path, trim(regexp_replace(regexp_replace(lower(line), '^[ \t]*[-*+>#]+[ \t]*', ''), '[ \t]+', ' ', 'g')) AS line
               FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM files))
    SELECT sha256(line) AS line_hash, count(*) AS files, min(line) AS line, min(path) AS first_path FROM l WHERE length(line) >= 10
    GROUP BY line HAVING count(*) > 1""")
def _(spark, folder):
    return governance.duplicate_rules(derived.files(spark, folder, spread=True), min_chars=10)


KINDS = {"en": ("claude", "rules"), "fr": ("claude", "auto"), "de": ("codex", "chain"), "es": ("codex", "generated")}


@query("governance_budget_check", sql="""
    WITH f AS (SELECT source AS project, '/d' || doc_id AS path, lang, (length(text) - length(replace(text, chr(10), ''))) * 30 AS lines, strlen(text) AS bytes FROM documents),
    u AS (SELECT project, path, 'claude' AS platform, 'rules' AS kind, lines, bytes, floor(lines * 100.0 / 200) AS used FROM f WHERE lang = 'en'
        UNION ALL SELECT project, path, 'claude', 'auto', lines, bytes, floor(greatest(lines * 100.0 / 200, bytes * 100.0 / 25600)) FROM f WHERE lang = 'fr'
        UNION ALL SELECT project, NULL, 'codex', 'chain', sum(lines), sum(bytes), floor(sum(bytes) * 100.0 / 32768) FROM f WHERE lang = 'de' GROUP BY project)
    SELECT project, path, platform, kind, CAST(lines AS BIGINT) AS lines, CAST(bytes AS BIGINT) AS bytes, CAST(used AS BIGINT) AS used_pct FROM u
    WHERE (kind = 'chain' AND bytes * 100.0 / 32768 > 70) OR (kind = 'rules' AND lines * 100.0 / 200 > 70)
       OR (kind = 'auto' AND greatest(lines * 100.0 / 200, bytes * 100.0 / 25600) > 70)""")
def _(spark, folder):
    sized = governance.with_size_facts(table(spark, folder, "documents"))
    files = sized.select(
        F.col("source").alias("project"), F.concat(F.lit("/d"), F.col("doc_id").cast("string")).alias("path"),
        derived.mapped(F.col("lang"), {k: v[0] for k, v in KINDS.items()}).alias("platform"),
        derived.mapped(F.col("lang"), {k: v[1] for k, v in KINDS.items()}).alias("kind"),
        (F.col("lines") * 30).alias("lines"), "bytes",
    )
    return governance.budget_check(files)


@query("governance_memory_class", "files", sql="""
    SELECT project, path, CASE WHEN path LIKE '/corpus/docs/%' THEN 'manual' WHEN path LIKE '/corpus/guides/%' THEN 'auto' ELSE 'generated' END AS memory_class,
           CASE WHEN path LIKE '/corpus/docs/%' OR path LIKE '/corpus/guides/%' THEN 'by authorization' ELSE 'generated-read-only' END AS write_state FROM files""")
def _(spark, folder):
    rules = (("^/corpus/docs/", "manual"), ("^/corpus/guides/", "auto"))
    return governance.memory_class(derived.files(spark, folder), rules)


CHANGE_TYPE = {"1-URGENT": "api", "2-HIGH": "env", "3-MEDIUM": "schema", "4-NOT SPECIFIED": "release process", "5-LOW": "typo"}
TOUCHED = {"A": "architecture", "N": "tests", "R": "runbook"}


def sql_case(column: str, values: dict[str, str]) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in values.items()) + " END"


@query("governance_route_changes", sql=f"""
    WITH matrix(change_type, surface) AS (VALUES {", ".join(f"('{t}', '{s}')" for t, ss in governance.CHANGE_MATRIX.items() for s in ss)}),
         done AS (SELECT DISTINCT l_orderkey AS change_id, {sql_case('l_returnflag', TOUCHED)} AS surface FROM lineitem)
    SELECT o_orderkey AS change_id, change_type, surface FROM (SELECT o_orderkey, {sql_case('o_orderpriority', CHANGE_TYPE)} AS change_type FROM orders)
    JOIN matrix USING (change_type) WHERE (o_orderkey, surface) NOT IN (SELECT change_id, surface FROM done)""")
def _(spark, folder):
    changes = table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("change_id"), derived.mapped(F.col("o_orderpriority"), CHANGE_TYPE).alias("change_type")
    )
    done = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("change_id"), derived.mapped(F.col("l_returnflag"), TOUCHED).alias("surface")
    )
    return governance.route_changes(changes, done)


@query("governance_consumers", sql="""
    WITH deps AS (SELECT l_partkey AS a, arg_max(l_suppkey, (l_quantity, l_orderkey, l_linenumber, l_suppkey)) AS b
                  FROM lineitem GROUP BY l_partkey),
         hop1 AS (SELECT p_partkey AS s, b, 1 AS hops FROM part JOIN deps ON a = p_partkey),
         hop2 AS (SELECT s, deps.b, 2 AS hops FROM hop1 JOIN deps ON a = hop1.b)
    SELECT s AS symbol, b AS consumer, min(hops) AS hops FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)
    WHERE s <> b GROUP BY ALL""")
def _(spark, folder):
    # The consumer of a part is the supplier of its largest line; suppliers share numbers with parts.
    largest = F.max_by("l_suppkey", F.struct("l_quantity", "l_orderkey", "l_linenumber", "l_suppkey"))
    deps = table(spark, folder, "lineitem").groupBy(F.col("l_partkey").alias("symbol")).agg(largest.alias("consumer"))
    changed = table(spark, folder, "part").select(F.col("p_partkey").alias("symbol"))
    return governance.consumers(changed, deps, hops=2)


@query("governance_consumers_two_hops", sql="""
    WITH deps AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem),
         hop1 AS (SELECT p_partkey AS s, b, 1 AS hops FROM part JOIN deps ON a = p_partkey),
         hop2 AS (SELECT DISTINCT s, deps.b, 2 AS hops FROM hop1 JOIN deps ON a = hop1.b)
    SELECT s AS symbol, b AS consumer, min(hops) AS hops FROM (SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)
    WHERE s <> b GROUP BY ALL""")
def _(spark, folder):
    deps = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("symbol"), F.col("l_suppkey").alias("consumer"))
    changed = table(spark, folder, "part").select(F.col("p_partkey").alias("symbol"))
    return governance.consumers(changed, deps, hops=2)


@query("governance_triage", sql="""
    SELECT doc_id, CASE WHEN lang NOT IN ('en', 'fr') THEN 'out-of-scope' WHEN n_chars <= 300 THEN 'pending' ELSE 'in-scope' END AS scope,
           CASE WHEN lang NOT IN ('en', 'fr') OR n_chars <= 300 OR source = 'src4' OR source = 'src3' THEN 'read-only'
                WHEN coalesce(quality = 1, false) AND coalesce(toxic = 0, false) AND n_chars <= 5000 AND lang = 'en' THEN 'fix' ELSE 'report first' END AS action
    FROM documents LEFT JOIN labels USING (doc_id)""")
def _(spark, folder):
    place = derived.mapped(F.col("lang"), {"en": "/corpus/docs/d", "fr": "/corpus/guides/d"}, "/corpus/docs2/d")
    findings = (
        table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id", "left")
        .select(
            "doc_id", F.concat(place, F.col("doc_id").cast("string")).alias("path"), (F.col("quality") == 1).alias("safe"),
            (F.col("toxic") == 0).alias("reversible"), (F.col("n_chars") > 5000).alias("side_effect"), (F.col("lang") == "en").alias("authorized"),
            (F.col("n_chars") > 300).alias("verified"), (F.col("source") == "src4").alias("generated"), (F.col("source") == "src3").alias("report_only"),
        )
    )
    return governance.triage(findings, ("/corpus/docs", "/corpus/guides")).select("doc_id", "scope", "action")


@query("governance_relative_dates", "files", sql="""
    SELECT * FROM (SELECT path, word AS rule_id, len(string_split(text, word)) - 1 AS hits
        FROM files, (SELECT unnest(['That', 'Der', 'Les']) AS word) WHERE NOT contains(path, '/vendor/')) WHERE hits > 0""")
def _(spark, folder):
    lexicon = tuple(Phrase(w, w) for w in ("That", "Der", "Les"))
    return governance.relative_dates(derived.files(spark, folder), lexicon, history="/vendor/")


@query("governance_duplicate_installs", sql="""
    SELECT name, count(DISTINCT p_type) AS places, min(p_type) AS first_path, max(p_type) AS last_path
    FROM (SELECT p_name || '/' || p_size AS name, p_type FROM part) GROUP BY name HAVING count(DISTINCT p_type) > 1""")
def _(spark, folder):
    installs = table(spark, folder, "part").select(F.concat_ws("/", "p_name", "p_size").alias("name"), F.col("p_type").alias("realpath"))
    return governance.duplicate_installs(installs)


ALLOWED = tuple(f"f{n}.md" for n in range(1, 7))
PACKAGES = """
    lines AS (SELECT l_orderkey AS package, 'f' || l_linenumber || '.md' AS path, sha256(CAST(l_suppkey AS VARCHAR)) AS wanted, l_discount >= 0.095 AS malformed FROM lineitem),
    present AS (SELECT l_orderkey AS package, 'f' || l_linenumber || '.md' AS path, min(sha256(CAST(CASE WHEN l_tax >= 0.075 THEN -1 ELSE l_suppkey END AS VARCHAR))) AS sha256
                FROM lineitem WHERE l_returnflag <> 'R' GROUP BY ALL),
    listed AS (SELECT package, path, count(*) AS n, min(wanted) AS lo, max(wanted) AS hi FROM lines WHERE NOT malformed GROUP BY ALL),
    matched AS (SELECT listed.*, sha256 FROM listed LEFT JOIN present USING (package, path)),
    problems AS (
        SELECT package, 'path not allowed' AS problem, path FROM matched WHERE path = 'f7.md'
        UNION ALL SELECT package, 'path listed twice', path FROM matched WHERE n > 1
        UNION ALL SELECT package, 'file missing', path FROM matched WHERE sha256 IS NULL
        UNION ALL SELECT package, 'hash differs', path FROM matched WHERE sha256 <> lo OR sha256 <> hi
        UNION ALL SELECT DISTINCT package, 'malformed line', upper(wanted) || '  ' || path FROM lines WHERE malformed
        UNION ALL SELECT package, 'required file absent', path FROM (SELECT DISTINCT package FROM lines), (SELECT unnest(['f1.md', 'f2.md']) AS path)
            WHERE (package, path) NOT IN (SELECT package, path FROM present))"""


def packages(spark, folder):
    """Orders as packages: their lines are the manifest, the lines not returned are the files."""
    lines = table(spark, folder, "lineitem")
    path = F.concat(F.lit("f"), F.col("l_linenumber").cast("string"), F.lit(".md"))
    digest = F.sha2(F.col("l_suppkey").cast("string"), 256)
    written = F.when(F.col("l_discount") >= 0.095, F.upper(digest)).otherwise(digest)
    manifest = lines.select(F.col("l_orderkey").alias("package"), F.concat(written, F.lit("  "), path).alias("line"))
    there = F.sha2(F.when(F.col("l_tax") >= 0.075, -1).otherwise(F.col("l_suppkey")).cast("string"), 256)
    files = (
        lines.filter("l_returnflag <> 'R'")
        .groupBy(F.col("l_orderkey").alias("package"), path.alias("path"))
        .agg(F.min(there).alias("sha256"))
    )
    return manifest, files


@query("governance_manifest_problems", sql=f"WITH {PACKAGES} SELECT * FROM problems")
def _(spark, folder):
    manifest, files = packages(spark, folder)
    return governance.manifest_problems(manifest, files, allowed=ALLOWED, required=("f1.md", "f2.md"))


@query("governance_verify_manifest", sql=f"""
    WITH {PACKAGES}
    SELECT package, count(*) FILTER (NOT malformed) AS listed, coalesce(any_value(n), 0) AS problems,
           coalesce(any_value(n), 0) = 0 AND count(*) FILTER (NOT malformed) = 2 AS ok
    FROM lines LEFT JOIN (SELECT package, count(*) AS n FROM problems GROUP BY package) USING (package) GROUP BY package""")
def _(spark, folder):
    manifest, files = packages(spark, folder)
    return governance.verify_manifest(manifest, files, allowed=ALLOWED, required=("f1.md", "f2.md"), exactly=2)


@query("governance_secret_hygiene", sql="""
    WITH f AS (SELECT source AS project, CASE WHEN n_chars < 300 THEN '.env' WHEN lang = 'de' AND n_chars < 900 THEN '*.pem' END AS pattern FROM documents),
         t AS (SELECT project, pattern, count(*) AS tracked FROM f WHERE pattern IS NOT NULL GROUP BY ALL),
         i AS (SELECT DISTINCT source AS project, CASE lang WHEN 'fr' THEN '.env' ELSE '*.pem' END AS pattern FROM documents WHERE lang IN ('fr', 'es') AND n_chars > 9000)
    SELECT p.project, w.pattern, coalesce(tracked, 0) AS tracked, i.project IS NOT NULL AS ignored
    FROM (SELECT DISTINCT source AS project FROM documents) p CROSS JOIN (SELECT unnest(['.env', '*.pem', '*.key', 'credentials*']) AS pattern) w
    LEFT JOIN t ON t.project = p.project AND t.pattern = w.pattern LEFT JOIN i ON i.project = p.project AND i.pattern = w.pattern
    WHERE coalesce(tracked, 0) > 0 OR i.project IS NULL""")
def _(spark, folder):
    docs = table(spark, folder, "documents")
    name = F.when(F.col("n_chars") < 300, "/.env").when((F.col("lang") == "de") & (F.col("n_chars") < 900), ".pem").otherwise(".txt")
    files = docs.select(F.col("source").alias("project"), F.concat(F.lit("/d"), F.col("doc_id").cast("string"), name).alias("path"))
    ignores = docs.filter("lang IN ('fr', 'es') AND n_chars > 9000").select(
        F.col("source").alias("project"), F.when(F.col("lang") == "fr", ".env").otherwise("*.pem").alias("pattern")
    )
    return governance.secret_hygiene(files, ignores)
