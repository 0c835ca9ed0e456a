"""Registered queries over evaluation sets and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evals
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.tables import table

CASES = """
    cases AS (SELECT conv_id AS set_id, CASE WHEN role = 'system' THEN 0 ELSE turn END AS id, role AS name, text,
                     list_filter(string_split(text, chr(10)), lambda l: ends_with(l, '.')) AS expectations FROM conversations)"""


def cases(spark, folder):
    """Conversations as evaluation sets: a case per turn, its lines that end a sentence are the expectations."""
    return table(spark, folder, "conversations").select(
        F.col("conv_id").alias("set_id"),
        F.when(F.col("role") == "system", 0).otherwise(F.col("turn")).alias("id"),
        F.col("role").alias("name"),
        F.filter(F.split("text", "\n", -1), lambda line: line.endswith(".")).alias("expectations"),
    )


@query("evals_check", sql=f"""
    WITH {CASES}
    SELECT set_id, 'duplicate id' AS rule, CAST(id AS VARCHAR) AS detail FROM cases GROUP BY set_id, id HAVING count(*) > 1
    UNION ALL SELECT set_id, 'too few evals', CAST(count(*) AS VARCHAR) FROM cases GROUP BY set_id HAVING count(*) < 6
    UNION ALL SELECT set_id, 'no expectations', CAST(id AS VARCHAR) FROM cases WHERE len(expectations) = 0
    UNION ALL SELECT set_id, 'required name missing', name FROM (SELECT DISTINCT set_id FROM cases), (SELECT unnest(['system', 'assistant']) AS name)
        WHERE (set_id, name) NOT IN (SELECT set_id, name FROM cases)""")
def _(spark, folder):
    return evals.check_evals(cases(spark, folder), required=("system", "assistant"), minimum=6)


@query("evals_fixtures", sql="""
    WITH w AS (SELECT page_id AS id, unnest(['docs/d' || page_id || '.md', 'docs', CASE WHEN url LIKE 'https%' THEN '/abs/' || page_id ELSE 'gone/' || page_id END]) AS fixture FROM pages)
    SELECT 0 AS set_id, id, fixture, CASE WHEN fixture LIKE '/%' THEN 'not portable' ELSE 'missing' END AS problem FROM w
    WHERE fixture <> 'docs' AND fixture NOT IN (SELECT 'docs/d' || doc_id || '.md' FROM documents WHERE lang = 'en')""")
def _(spark, folder):
    own = F.concat(F.lit("docs/d"), F.col("page_id").cast("string"), F.lit(".md"))
    odd = F.when(F.col("url").startswith("https"), "/abs/").otherwise("gone/")
    wanted = table(spark, folder, "pages").select(
        F.lit(0).alias("set_id"), F.col("page_id").alias("id"),
        F.array(own, F.lit("docs/"), F.concat(odd, F.col("page_id").cast("string"))).alias("files"),
    )
    files = table(spark, folder, "documents").filter("lang = 'en'").select(
        F.concat(F.lit("docs/d"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path")
    )
    return evals.check_fixtures(wanted, files)


@query("evals_label_balance", "trigger_labels", sql="""
    SELECT lang AS set_id, count(*) AS rows, count(*) FILTER (should_trigger) AS positives, count(*) >= 20 AS enough,
           count(*) FILTER (should_trigger) BETWEEN 8 AND count(*) - 8 AS balanced FROM trigger_labels GROUP BY lang""")
def _(spark, folder):
    return evals.label_balance(derived.trigger_labels(spark, folder).withColumnRenamed("lang", "set_id"))


MARKED = "(contains(query, 'token') OR contains(query, '%%%'))"


@query("evals_marker_contract", "trigger_labels", sql=f"""
    SELECT *, violations = 0 AND intent_positives >= 4 AND bare_negatives >= 6 AS holds FROM (
        SELECT lang AS set_id, count(*) FILTER ({MARKED} AND NOT should_trigger) AS violations,
               count(*) FILTER (NOT {MARKED} AND should_trigger) AS intent_positives,
               count(*) FILTER (NOT {MARKED} AND NOT should_trigger) AS bare_negatives FROM trigger_labels GROUP BY lang)""")
def _(spark, folder):
    labels = derived.trigger_labels(spark, folder).withColumnRenamed("lang", "set_id")
    return evals.marker_contract(labels, ("token", "%%%"))


@query("evals_marker_violations", "trigger_labels", sql=f"SELECT doc_id, lang FROM trigger_labels WHERE {MARKED} AND NOT should_trigger")
def _(spark, folder):
    return evals.marker_violations(derived.trigger_labels(spark, folder), ("token", "%%%")).select("doc_id", "lang")


def specs(spark, folder, spread=False):
    """Documents with front matter: their first line is the description, in two lines for one language."""
    docs = derived.texts(spark, folder, spread)
    about = F.when(F.col("lang") == "fr", F.concat(F.lit(">-\n  "), F.col("lang"), F.lit("\n  "), F.col("source"))).when(
        F.col("lang") == "es", F.lit("")
    ).otherwise(F.regexp_replace(F.split("text", "\n")[0], "-", "_"))
    head = F.concat(F.lit("---\nname: d"), F.col("doc_id").cast("string"), F.lit("\ndescription: "), about, F.lit("\ntype: "), "lang", F.lit("\n---\n"))
    links = F.concat(F.lit("\n[a](references/"), "lang", F.lit(".md)"))
    return docs.select("doc_id", F.concat(head, "text", links).alias("text"))


SPECS = r"""
    parts AS (SELECT doc_id, lang, text AS body, CASE lang WHEN 'fr' THEN lang || ' ' || source WHEN 'es' THEN ''
                  ELSE trim(replace(string_split(text, chr(10))[1], '-', '_')) END AS about,
              CASE lang WHEN 'fr' THEN '>-' || chr(10) || '  ' || lang || chr(10) || '  ' || source WHEN 'es' THEN ''
                  ELSE replace(string_split(text, chr(10))[1], '-', '_') END AS raw FROM documents),
    specs AS (SELECT doc_id, lang, about, '---' || chr(10) || 'name: d' || doc_id || chr(10) || 'description: ' || raw || chr(10) || 'type: ' || lang
                  || chr(10) || '---' || chr(10) || body || chr(10) || '[a](references/' || lang || '.md)' AS text FROM parts)"""


@query("evals_spec_contract", sql=f"""
    WITH {SPECS}, v AS (SELECT doc_id, lang, about, CASE WHEN doc_id % 2 = 0
        THEN '---' || chr(10) || 'version: "1.0.0"' || substr(text, 4) ELSE text END AS text FROM specs),
    n AS (SELECT *, length(text) - length(replace(text, chr(10), '')) + 1 AS n_lines FROM v)
    SELECT doc_id, 'no version' AS rule, NULL AS detail FROM n WHERE doc_id % 2 = 1
    UNION ALL SELECT doc_id, 'reference file missing', 'references/' || lang || '.md' FROM n WHERE lang NOT IN ('en', 'fr')
    UNION ALL SELECT doc_id, 'no description' AS rule, NULL AS detail FROM n WHERE about = ''
    UNION ALL SELECT doc_id, 'description too long', CAST(length(about) AS VARCHAR) FROM n WHERE length(about) > 1024
    UNION ALL SELECT doc_id, 'description near limit', CAST(length(about) AS VARCHAR) FROM n WHERE length(about) > 850
    UNION ALL SELECT doc_id, 'too many lines', CAST(n_lines AS VARCHAR) FROM n WHERE n_lines >= 15
    UNION ALL SELECT doc_id, 'too many tokens', CAST(length(text) AS VARCHAR) FROM n WHERE length(text) >= 20000
    UNION ALL SELECT doc_id, 'phrase missing', 'The' FROM n WHERE NOT contains(text, 'The')
    UNION ALL SELECT doc_id, 'phrase missing in description', 'e' FROM n WHERE NOT contains(about, 'e')
    UNION ALL SELECT doc_id, 'forbidden token', '@' FROM n WHERE contains(text, '@')
    UNION ALL SELECT doc_id, 'reference missing', 'references/en.md' FROM n WHERE lang <> 'en'
    UNION ALL SELECT doc_id, 'reference unexpected', 'references/' || lang || '.md' FROM n WHERE lang <> 'en'""")
def _(spark, folder):
    rules = evals.SpecRules(
        max_lines=15, description_phrases=("e",), required=("The",), forbidden=("@",), references=("references/en.md",)
    )
    versioned = F.regexp_replace("text", "^---\n", '---\nversion: "1.0.0"\n')
    docs = specs(spark, folder, spread=True).withColumn("text", F.when(F.col("doc_id") % 2 == 0, versioned).otherwise(F.col("text")))
    known = table(spark, folder, "documents").filter(F.col("lang").isin("en", "fr")).select("lang").distinct()
    files = known.select(F.concat(F.lit("references/"), "lang", F.lit(".md")).alias("path"))
    return evals.spec_contract(docs, rules, files)


@query("evals_front_matter", sql=f"""
    WITH {SPECS} SELECT doc_id, 'name' AS key, 'd' || doc_id AS value FROM specs
    UNION ALL SELECT doc_id, 'description', about FROM specs UNION ALL SELECT doc_id, 'type', lang FROM specs""")
def _(spark, folder):
    return evals.front_matter(specs(spark, folder))


@query("evals_missing_keys", sql="""
    SELECT doc_id, unnest(CASE lang WHEN 'es' THEN ['description', 'license'] ELSE ['license'] END) AS key FROM documents""")
def _(spark, folder):
    return evals.missing_keys(specs(spark, folder), ("name", "description", "license"))


STREAKS = """
    WITH marked AS (SELECT *, count(*) FILTER (ok) OVER (PARTITION BY run, "check" ORDER BY seq) AS island FROM runs)
    SELECT run, "check", min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS failures FROM marked WHERE NOT ok
    GROUP BY run, "check", island HAVING count(*) >= 3"""


@query("evals_failure_streaks", "runs", sql=STREAKS)
def _(spark, folder):
    return evals.failure_streaks(derived.runs(spark, folder), slice_size=1000)


HALF = "TIMESTAMP_NTZ '2024-01-15 00:00:00'"


@query("evals_baseline_check", sql="""
    WITH r AS (SELECT user_id AS run, 'c' || (CAST(regexp_extract(props, '"k": *([0-9]+)', 1) AS INTEGER) // 20) AS metric,
                      event_type NOT IN ('error', 'view') AS ok, ts < TIMESTAMP '2024-01-15 00:00:00' AS early FROM events),
         b AS (SELECT run, metric, count(*) FILTER (ok) AS base, CASE metric WHEN 'c0' THEN 'equal' WHEN 'c1' THEN 'down' ELSE 'up' END AS direction
               FROM r WHERE early GROUP BY ALL),
         m AS (SELECT run, metric, count(*) FILTER (ok) AS value FROM r WHERE NOT early GROUP BY ALL)
    SELECT run, metric, coalesce(value, -1) AS value, base, CASE WHEN coalesce(CASE direction WHEN 'up' THEN value >= base WHEN 'down' THEN value <= base ELSE value = base END, false)
        THEN 'ok' ELSE 'rollback' END AS verdict FROM b LEFT JOIN m USING (run, metric)""")
def _(spark, folder):
    # The first half of the month is the baseline of the second, per user and check.
    events = table(spark, folder, "events")

    def passed(part, name):
        return derived.run_rows(part).groupBy("run", F.col("check").alias("metric")).agg(F.count_if("ok").alias(name))

    direction = derived.mapped(F.col("metric"), {"c0": "equal", "c1": "down"}, "up")
    baseline = passed(events.filter(f"ts < {HALF}"), "base").withColumn("direction", direction)
    return evals.baseline_check(passed(events.filter(f"ts >= {HALF}"), "value"), baseline).fillna(-1, ["value"])


@query("evals_round_limit", sql="""
    SELECT conv_id AS run, max(turn) AS rounds, max(turn) >= 5 AS stop FROM conversations GROUP BY conv_id""")
def _(spark, folder):
    turns = table(spark, folder, "conversations").select(F.col("conv_id").alias("run"), F.col("turn").alias("round"))
    return evals.round_limit(turns, n=5)


@query("evals_scope_violations", "customer_dirs", "fs_entry", sql="""
    WITH changes AS (SELECT o_orderpriority AS task, path, o_totalprice FROM orders JOIN customer_dirs ON o_custkey = c_custkey),
         outside AS (SELECT DISTINCT task, path FROM changes WHERE NOT (task = '1-URGENT' AND path LIKE '/ASIA/%')
                     AND NOT (task = '2-HIGH' AND path LIKE '/EUROPE/NATION!_3/%' ESCAPE '!') AND task <> '5-LOW'),
         frozen AS (SELECT path, sha256(c_mktsegment) AS sha256 FROM customer_dirs WHERE c_mktsegment = 'BUILDING')
    SELECT task, path, 'outside allowed paths' AS violation FROM outside
    UNION ALL SELECT DISTINCT task, path, 'frozen file changed' FROM changes JOIN frozen USING (path) WHERE o_totalprice > 100000""")
def _(spark, folder):
    dirs = derived.customer_dirs(spark, folder)
    digest = F.when(F.col("o_totalprice") > 100000, F.sha2("path", 256)).otherwise(F.sha2("c_mktsegment", 256))
    changes = table(spark, folder, "orders").join(dirs, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderpriority").alias("task"), "path", digest.alias("sha256")
    )
    regions = table(spark, folder, "region")
    allowed = (
        regions.select(F.lit("5-LOW").alias("task"), F.concat(F.lit("/"), "r_name").alias("prefix"))
        .union(regions.filter("r_name = 'ASIA'").select(F.lit("1-URGENT"), F.lit("/ASIA")))
        .union(regions.filter("r_name = 'EUROPE'").select(F.lit("2-HIGH"), F.lit("/EUROPE/NATION_3")))
    )
    frozen = dirs.filter("c_mktsegment = 'BUILDING'").select("path", F.sha2("c_mktsegment", 256).alias("sha256"))
    return evals.scope_violations(changes, allowed, frozen)


@query("evals_territory_overlap", "customer_dirs", sql="""
    WITH own AS (SELECT DISTINCT o_orderpriority AS task, CASE WHEN o_totalprice > 200000 THEN '/' || r_name || '/' || n_name ELSE path END AS prefix,
                        '/' || r_name || '/' || n_name AS nation FROM orders JOIN customer_dirs ON o_custkey = c_custkey),
         pairs AS (SELECT DISTINCT a.task, a.prefix, b.prefix AS around, b.task AS other FROM own a
                   JOIN own b ON b.task <> a.task AND b.prefix IN (a.prefix, a.nation) AND a.nation = b.nation)
    SELECT task, prefix, around, count(*) AS other_tasks, CASE WHEN min(other) < task THEN min(other) ELSE max(other) END AS other
    FROM pairs GROUP BY task, prefix, around""")
def _(spark, folder):
    dirs = derived.customer_dirs(spark, folder)
    prefix = F.when(F.col("o_totalprice") > 200000, F.concat(F.lit("/"), "r_name", F.lit("/"), "n_name")).otherwise(F.col("path"))
    allowed = table(spark, folder, "orders").join(dirs, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderpriority").alias("task"), prefix.alias("prefix")
    )
    return evals.territory_overlap(allowed)


BOOK = r"""
    SELECT doc_id, lang, n_chars, 'see 任务 1 and end' || chr(10) || CASE WHEN lang = 'es' THEN '## end' ELSE '## start' END || chr(10) || text
        || chr(10) || '### 任务 ' || doc_id % 3 || chr(10) || CASE WHEN lang = 'es' THEN '## start' ELSE '## end' END AS text,
        CASE WHEN lang = 'de' THEN 1 WHEN n_chars > 3000 THEN 6 ELSE 3 END AS options, CASE lang WHEN 'fr' THEN 6 ELSE 2 END AS questions
    FROM documents"""


@query("evals_book_contract", sql=f"""
    WITH b AS ({BOOK})
    SELECT doc_id AS book_id, 'too long' AS rule, CAST(length(text) AS VARCHAR) AS detail FROM b WHERE length(text) > 4000
    UNION ALL SELECT doc_id, 'section missing', '任务 N' FROM b WHERE doc_id % 3 = 0
    UNION ALL SELECT doc_id, 'sections out of order', NULL FROM b WHERE doc_id % 3 > 0 AND lang = 'es'
    UNION ALL SELECT doc_id, 'too many questions', CAST(questions AS VARCHAR) FROM b WHERE questions > 5
    UNION ALL SELECT doc_id, 'question options', CAST(questions AS VARCHAR) FROM b WHERE options NOT BETWEEN 2 AND 4
    UNION ALL SELECT doc_id, 'banned wording', 'token' FROM b WHERE contains(text, 'token')""")
def _(spark, folder):
    """Documents as task books: a mention of sections comes first, every third book has only a task 0."""
    count = F.when(F.col("lang") == "de", 1).when(F.col("n_chars") > 3000, 6).otherwise(3)
    question = F.transform(F.sequence(F.lit(1), count), lambda n: F.concat(F.lit("option "), n.cast("string")))
    odd = F.col("lang") == "es"
    text = F.concat_ws(
        "\n", F.lit("see 任务 1 and end"), F.when(odd, "## end").otherwise("## start"), "text",
        F.concat(F.lit("### 任务 "), (F.col("doc_id") % 3).cast("string")), F.when(odd, "## start").otherwise("## end"),
    )
    books = table(spark, folder, "documents").select(
        F.col("doc_id").alias("book_id"), text.alias("text"),
        F.array_repeat(question, F.when(F.col("lang") == "fr", 6).otherwise(2)).alias("questions"),
    )
    return evals.book_contract(books, sections=("start", "任务 N", "end"), banned=("token",))
