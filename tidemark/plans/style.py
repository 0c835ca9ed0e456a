"""Registered style queries. The given corpus is Latin, so they use phrases that occur in it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import style
from tidemark.plans.registry import query
from tidemark.sources import derived
from tidemark.sources.tables import table

PHRASES = (
    style.Phrase("the", " the ", "this "), style.Phrase("of", "of the", "of this"), style.Phrase("de la", "de la"),
    style.Phrase("der", " der "), style.Phrase("and", "And"), style.Phrase("token", "token ="),
)
MARKS = (style.Phrase("bold", "**"), style.Phrase("quote", '"'), style.Phrase("at", "@"), style.Phrase("pipe", "|"))
PATTERNS = (
    style.Ordered("chain", ("the", "of", "and")),
    style.Pattern("dated", "In [^.\n]*? the"),
    style.Pattern("opening", "^[A-Z][a-z]+ and", opener=True),
)
WORDS = ("The ", "and ", "of ", "in ", "that ", "is ", "Der ", "und ", "Le ", "les ", "que ", "los ", "para ", "De ")


def documents(spark, folder):
    return table(spark, folder, "documents")


def found_in(table_name: str, phrases) -> str:
    parts = [
        f"SELECT doc_id, '{p.rule_id}' AS rule_id, len(string_split(text, '{p.phrase}')) - 1 AS hits FROM {table_name}"
        for p in phrases
    ]
    return "SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE hits > 0"


@query("style_phrase_hits", sql=found_in("documents", PHRASES))
def _(spark, folder):
    return style.phrase_hits(derived.texts(spark, folder, spread=True), PHRASES).select("doc_id", "rule_id", "hits")


LEXICON = """(
    SELECT DISTINCT phrase FROM (
        SELECT split_part(text, ' ', 1) || ' ' || split_part(text, ' ', 2) AS phrase FROM documents
        UNION ALL SELECT split_part(text, ' ', 4) FROM documents UNION ALL SELECT substr(text, 1, 30) FROM benchmark)
    WHERE phrase <> '')"""


def lexicon(spark, folder):
    """A lexicon of the corpus's own: what documents begin with, a word of each, and the heads of benchmark items."""
    head = F.substring_index("text", " ", 4)  # a split of the whole text would cost many times as much
    word = [F.split_part(head, F.lit(" "), F.lit(i)) for i in (1, 2, 4)]
    rows = documents(spark, folder).select(F.explode(F.array(F.concat(word[0], F.lit(" "), word[1]), word[2])).alias("phrase"))
    heads = table(spark, folder, "benchmark").select(F.substring("text", 1, 30).alias("phrase"))
    return rows.union(heads).filter("phrase <> ''").distinct()


@query("style_lexicon_hits", sql=f"""
    SELECT doc_id, phrase AS rule_id, (length(text) - length(replace(text, phrase, ''))) // length(phrase) AS hits
    FROM documents JOIN {LEXICON} ON contains(text, phrase)""")
def _(spark, folder):
    listed = lexicon(spark, folder).select(F.col("phrase").alias("rule_id"), "phrase", F.lit(None).cast("string").alias("replacement"))
    return style.phrase_hits(documents(spark, folder), listed).select("doc_id", "rule_id", "hits")


@query("style_lexicon_variety", sql=r"""
    WITH l AS (
        SELECT DISTINCT split_part(text, ' ', 1) AS a, split_part(text, ' ', 3) AS b FROM benchmark),
    p AS (SELECT regexp_escape(a) || '[^。！？\n]*?' || regexp_escape(b) AS rule FROM l UNION ALL SELECT DISTINCT regexp_escape(b) FROM l)
    SELECT doc_id, count(rule) AS phrases, count(rule) >= 20 AS enough
    FROM documents LEFT JOIN p ON regexp_matches(text, rule) GROUP BY doc_id""")
def _(spark, folder):
    first, third = (F.split_part("text", F.lit(" "), F.lit(i)) for i in (1, 3))
    listed = table(spark, folder, "benchmark").select(
        F.explode(F.array(F.concat(first, F.lit("xxx"), third), third)).alias("phrase")
    )
    return style.phrase_variety(documents(spark, folder), listed, minimum=20)


@query("style_punct_hits", sql=found_in("(SELECT * FROM documents WHERE lang <> 'de')", MARKS))
def _(spark, folder):
    docs = documents(spark, folder).withColumn("genre", F.when(F.col("lang") == "de", "report"))
    return style.punct_hits(docs, MARKS).select("doc_id", "rule_id", "hits")


@query("style_pattern_hits", "articles", sql=r"""
    SELECT * FROM (
        SELECT doc_id, 'chain' AS rule_id, len(regexp_extract_all(text, '(?s)the.*?of.*?and')) AS hits FROM articles
        UNION ALL SELECT doc_id, 'dated', len(regexp_extract_all(text, 'In [^.\n]*? the')) FROM articles
        UNION ALL SELECT doc_id, 'opening', len(regexp_extract_all(
            coalesce(list_filter(string_split_regex(text, '\n[ \t]*\n'), lambda p: trim(p) <> '')[1], ''), '^[A-Z][a-z]+ and')) FROM articles)
    WHERE hits > 0""")
def _(spark, folder):
    return style.pattern_hits(derived.articles(spark, folder), PATTERNS)


@query("style_vague_names", sql=found_in("documents", (style.Phrase("v1", "ons"), style.Phrase("v2", "ment"))))
def _(spark, folder):
    lexicon = (style.Phrase("v1", "ons"), style.Phrase("v2", "ment"))
    return style.vague_names(documents(spark, folder), lexicon).select("doc_id", "rule_id", "hits")


RUNS = r"""
    WITH marked AS (SELECT doc_id, n, regexp_matches(line, '^\s*(([-*+•]|[0-9]+[.)])\s+|[0-9]+、)') AS bullet FROM article_lines),
         runs AS (SELECT doc_id, count(*) AS length FROM
            (SELECT doc_id, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM marked WHERE bullet)
            GROUP BY doc_id, island HAVING count(*) > 3)"""


@query("style_bullet_runs", "article_lines", sql=RUNS + """
    SELECT doc_id, count(*) AS runs, max(length) AS longest FROM runs GROUP BY doc_id""")
def _(spark, folder):
    return style.bullet_runs(derived.articles(spark, folder))


@query("style_bold_spans", "articles", sql=r"""
    SELECT doc_id, count(*) AS spans FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)\*\*(.+?)\*\*', 1)) AS span FROM articles)
    WHERE length(span) - length(replace(span, chr(10), '')) >= 2 GROUP BY doc_id""")
def _(spark, folder):
    return style.bold_spans(derived.articles(spark, folder))


@query("style_flat_rhythm", "article_sentences", sql="""
    SELECT doc_id, count(*) AS flat_places FROM (
        SELECT doc_id, n, length(sentence) AS a, lag(length(sentence), 1) OVER w AS b, lag(length(sentence), 2) OVER w AS c
        FROM article_sentences WINDOW w AS (PARTITION BY doc_id ORDER BY n))
    WHERE c IS NOT NULL AND (greatest(a, b, c) - least(a, b, c)) * 100 <= greatest(a, b, c) * 15 GROUP BY doc_id""")
def _(spark, folder):
    return style.flat_rhythm(derived.articles(spark, folder, spread=True))


@query("style_break_paragraphs", "article_paragraphs", sql=r"""
    SELECT doc_id, coalesce(breaks, 0) AS breaks, coalesce(breaks, 0) >= 3 AS enough FROM articles LEFT JOIN (
        SELECT doc_id, count(*) AS breaks FROM article_paragraphs
        WHERE len(list_filter(regexp_extract_all(paragraph, '[^。！？.!?\n]+[。！？.!?]*'), lambda s: trim(s) <> '')) = 1 GROUP BY doc_id)
    USING (doc_id)""")
def _(spark, folder):
    return style.break_paragraphs(derived.articles(spark, folder))


@query("style_has_question", "article_sentences", sql="""
    SELECT doc_id, count(*) FILTER (regexp_matches(sentence, '[?？]$')) AS questions,
           count(*) FILTER (regexp_matches(sentence, '[?？]$')) > 0 AS present
    FROM articles LEFT JOIN article_sentences USING (doc_id) GROUP BY doc_id""")
def _(spark, folder):
    return style.has_question(derived.articles(spark, folder))


@query("style_heading_hits", "article_lines", sql=r"""
    SELECT doc_id, count(*) AS headings FROM article_lines
    WHERE regexp_matches(line, '^(#{1,6} |\*\*[^*]+\*\*\s*$)') AND lang <> 'es' GROUP BY doc_id""")
def _(spark, folder):
    return style.heading_hits(derived.articles(spark, folder), itemised=F.col("lang") == "es")


@query("style_phrase_variety", sql=f"""
    SELECT doc_id, count(*) FILTER (contains(text, word)) AS phrases, count(*) FILTER (contains(text, word)) >= 6 AS enough
    FROM documents, (SELECT unnest({list(WORDS)}) AS word) GROUP BY doc_id""")
def _(spark, folder):
    return style.phrase_variety(documents(spark, folder), WORDS, minimum=6)


@query("style_emotion_marks", sql="SELECT doc_id, contains(text, '&&&') OR contains(text, '$$$') AS present FROM documents")
def _(spark, folder):
    return style.emotion_marks(documents(spark, folder), ("&&&", "$$$"))


def checks(spark, folder):
    """The corpus' own checks and the labels as judged ones."""
    own = style.style_checks(
        derived.articles(spark, folder, spread=True), banned=PHRASES[3:], punctuation=MARKS, cliches=PATTERNS[:2], openers=PATTERNS[2:],
        vague=(style.Phrase("v1", "ons"),), colloquial=WORDS, emotion=("？？", "!"),
    )
    judged = table(spark, folder, "labels").select(
        "doc_id",
        F.inline(F.array(
            F.struct(F.lit("L3-1").alias("layer"), F.lit("support").alias("rule"), (1 - F.col("quality")).cast("long").alias("hits"), (F.col("quality") == 1).alias("passed")),
            F.struct(F.lit("L3-2").alias("layer"), F.lit("delivery").alias("rule"), F.col("toxic").cast("long").alias("hits"), (F.col("toxic") == 0).alias("passed")),
        )),
    )
    return own.unionByName(judged)


def count_of(word: str) -> str:
    return f"(len(string_split(text, '{word}')) - 1)"


CHECKS = rf"""
    bullets AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id FROM (SELECT doc_id, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island
            FROM article_lines WHERE regexp_matches(line, '^\s*(([-*+•]|[0-9]+[.)])\s+|[0-9]+、)')) GROUP BY doc_id, island HAVING count(*) > 3) GROUP BY doc_id),
    bolds AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?s)\*\*(.+?)\*\*', 1)) AS span FROM articles)
            WHERE length(span) - length(replace(span, chr(10), '')) >= 2 GROUP BY doc_id),
    flats AS (SELECT doc_id, count(*) AS n FROM (SELECT doc_id, length(sentence) AS a, lag(length(sentence), 1) OVER w AS b, lag(length(sentence), 2) OVER w AS c
            FROM article_sentences WINDOW w AS (PARTITION BY doc_id ORDER BY n))
            WHERE c IS NOT NULL AND (greatest(a, b, c) - least(a, b, c)) * 100 <= greatest(a, b, c) * 15 GROUP BY doc_id),
    heads AS (SELECT doc_id, count(*) AS n FROM article_lines WHERE regexp_matches(line, '^(#{{1,6}} |\*\*[^*]+\*\*\s*$)') GROUP BY doc_id),
    breaks AS (SELECT doc_id, count(*) AS n FROM article_paragraphs
            WHERE len(list_filter(regexp_extract_all(paragraph, '[^。！？.!?\n]+[。！？.!?]*'), lambda s: trim(s) <> '')) = 1 GROUP BY doc_id),
    asks AS (SELECT doc_id, count(*) AS n FROM article_sentences WHERE regexp_matches(sentence, '[?？]$') GROUP BY doc_id),
    opens AS (SELECT doc_id, regexp_matches(paragraph, '^[A-Z][a-z]+ and') AS hit
            FROM article_paragraphs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n) = 1),
    words AS (SELECT doc_id, count(*) AS n FROM articles, (SELECT unnest({list(WORDS)}) AS word) WHERE contains(text, word) GROUP BY doc_id),
    marks AS (SELECT doc_id, {count_of('**')} + {count_of('"')} + {count_of('@')} + {count_of('|')} AS n FROM articles),
    counted AS (
        SELECT doc_id, 'L1' AS layer, 'banned phrases' AS rule, {count_of(' der ')} + {count_of('And')} + {count_of('token =')} AS hits, NULL AS need FROM articles
        UNION ALL SELECT doc_id, 'L1', 'banned marks', n, NULL FROM marks
        UNION ALL SELECT doc_id, 'L1', 'structure', len(regexp_extract_all(text, '(?s)the.*?of.*?and'))
            + len(regexp_extract_all(text, 'In [^.\n]*? the')) + coalesce(bullets.n, 0) + coalesce(bolds.n, 0), NULL
            FROM articles LEFT JOIN bullets USING (doc_id) LEFT JOIN bolds USING (doc_id)
        UNION ALL SELECT doc_id, 'L1', 'vague names', {count_of('ons')}, NULL FROM articles
        UNION ALL SELECT doc_id, 'L2-1', 'textbook opener', CASE WHEN hit THEN 1 ELSE 0 END, NULL FROM articles LEFT JOIN opens USING (doc_id)
        UNION ALL SELECT doc_id, 'L2-2', 'flat rhythm', coalesce(n, 0), NULL FROM articles LEFT JOIN flats USING (doc_id)
        UNION ALL SELECT doc_id, 'L2-2', 'headings', coalesce(n, 0), NULL FROM articles LEFT JOIN heads USING (doc_id)
        UNION ALL SELECT doc_id, 'L2-2', 'breaks', coalesce(n, 0), 3 FROM articles LEFT JOIN breaks USING (doc_id)
        UNION ALL SELECT doc_id, 'L2-2', 'questions', coalesce(n, 0), 1 FROM articles LEFT JOIN asks USING (doc_id)
        UNION ALL SELECT doc_id, 'L2-3', 'colloquial phrases', coalesce(n, 0), 8 FROM articles LEFT JOIN words USING (doc_id)
        UNION ALL SELECT doc_id, 'L2-3', 'emotion marks', CASE WHEN contains(text, '？？') OR contains(text, '!') THEN 1 ELSE 0 END, 1 FROM articles
        UNION ALL SELECT doc_id, 'L2-4', 'banned marks again', n, NULL FROM marks),
    checks AS (SELECT doc_id, layer, rule, hits, CASE WHEN need IS NULL THEN hits = 0 ELSE hits >= need END AS passed FROM counted
        UNION ALL SELECT doc_id, 'L3-1', 'support', 1 - quality, quality = 1 FROM labels
        UNION ALL SELECT doc_id, 'L3-2', 'delivery', toxic, toxic = 0 FROM labels),
    gated AS (SELECT doc_id, layer, count(*) FILTER (passed) AS passed, count(*) AS checks,
                     count(*) FILTER (passed) >= least(CASE WHEN layer IN ('L2-2', 'L2-3') THEN 3 ELSE count(*) END, count(*)) AS holds
              FROM checks GROUP BY doc_id, layer)"""
VIEWS = ("article_lines", "article_paragraphs", "article_sentences")


@query("style_checks", *VIEWS, sql=f"WITH {CHECKS} SELECT doc_id, layer, rule, CAST(hits AS BIGINT) AS hits, passed FROM checks")
def _(spark, folder):
    return checks(spark, folder)


@query("style_layer_gate", *VIEWS, sql=f"WITH {CHECKS} SELECT * FROM gated")
def _(spark, folder):
    return style.layer_gate(checks(spark, folder))


@query("style_qc_report", *VIEWS, sql=f"""
    WITH {CHECKS}
    SELECT doc_id, bool_and(holds) FILTER (layer = 'L1') AS l1, bool_and(holds) FILTER (layer = 'L2-2') AS l2_2,
           coalesce(CAST(bool_and(holds) FILTER (layer = 'L3-1') AS VARCHAR), 'not checked') AS l3_1, count(*) FILTER (NOT holds) AS layers_to_redo, coalesce(any_value(repairs), '') AS repairs
    FROM gated LEFT JOIN (
        SELECT doc_id, string_agg(rule, '; ' ORDER BY layer, hits DESC, rule) AS repairs FROM (
            SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY layer, hits DESC, rule) AS place FROM checks WHERE NOT passed)
        WHERE place <= 3 GROUP BY doc_id) USING (doc_id)
    GROUP BY doc_id""")
def _(spark, folder):
    report = style.qc_report(checks(spark, folder))
    return report.select(
        "doc_id", F.col("L1").alias("l1"), F.col("`L2-2`").alias("l2_2"), 
        F.coalesce(F.col("`L3-1`").cast("string"), F.lit("not checked")).alias("l3_1"), "layers_to_redo", "repairs",
    )


@query("style_reintroduced", "articles", sql=f"""
    WITH v1 AS ({found_in('documents', MARKS)}), v2 AS ({found_in('articles', MARKS)})
    SELECT doc_id, rule_id, v2.hits AS hits_v2 FROM v2 LEFT JOIN v1 USING (doc_id, rule_id) WHERE v1.hits IS NULL""")
def _(spark, folder):
    before = style.phrase_hits(documents(spark, folder), MARKS)
    return style.reintroduced(before, style.phrase_hits(derived.articles(spark, folder), MARKS))


@query("style_length_bands", sql="""
    SELECT doc_id, genre, section, chars, CASE WHEN chars < low THEN 'below' WHEN chars > high THEN 'above' ELSE 'in' END AS band
    FROM (SELECT doc_id, CASE WHEN lang = 'en' THEN 'article' ELSE 'report' END AS genre,
                 CASE lang WHEN 'de' THEN 'vertical' WHEN 'fr' THEN 'crossing' ELSE 'total' END AS section, length(text) AS chars FROM documents)
    JOIN (VALUES ('article', 'total', 4000, 8000), ('report', 'vertical', 6000, 15000), ('report', 'horizontal', 3000, 10000),
                 ('report', 'crossing', 1500, 3000), ('report', 'total', 10000, 30000)) b(genre, section, low, high) USING (genre, section)""")
def _(spark, folder):
    sections = documents(spark, folder).select(
        "doc_id", "text", F.when(F.col("lang") == "en", "article").otherwise("report").alias("genre"),
        derived.mapped(F.col("lang"), {"de": "vertical", "fr": "crossing"}, "total").alias("section"),
    )
    return style.length_bands(sections)


@query("style_hkr", sql="""
    SELECT *, CASE score WHEN 3 THEN 'S' WHEN 2 THEN 'pass' WHEN 1 THEN 'reconsider' ELSE 'drop' END AS grade
    FROM (SELECT doc_id, CAST(quality + (1 - toxic) + CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS BIGINT) AS score FROM labels JOIN documents USING (doc_id))""")
def _(spark, folder):
    topics = table(spark, folder, "labels").join(documents(spark, folder), "doc_id").select(
        "doc_id", (F.col("n_chars") > 2000).alias("happy"), (F.col("quality") == 1).alias("knowledge"), (F.col("toxic") == 0).alias("resonance")
    )
    return style.hkr(topics).select("doc_id", "score", "grade")


@query("style_report_index", "article_lines", sql=r"""
    SELECT doc_id, source, nullif(trim(regexp_extract(text, '(?m)^#[ \t]+(.*)$', 1)), '') AS title, meta_line
    FROM articles LEFT JOIN (SELECT doc_id, arg_min(trim(line), n) AS meta_line FROM article_lines
        WHERE contains(line, 'token') OR contains(line, '@') GROUP BY doc_id) USING (doc_id)""")
def _(spark, folder):
    return style.report_index(derived.articles(spark, folder), markers=("token", "@"))


@query("style_index_gaps", "article_lines", sql=r"""
    SELECT source, count(*) AS docs, count(*) FILTER (NOT regexp_matches(text, '(?m)^#[ \t]+[^ \n]')) AS no_title,
           count(*) FILTER (NOT contains(text, 'token') AND NOT contains(text, '@')) AS no_meta FROM articles GROUP BY source""")
def _(spark, folder):
    return style.index_gaps(style.report_index(derived.articles(spark, folder), markers=("token", "@")))


@query("style_tail_present", sql=r"""
    SELECT doc_id, ends_with(regexp_replace(text, '\s+$', ''), '.') AS present FROM documents WHERE lang <> 'fr'""")
def _(spark, folder):
    docs = documents(spark, folder).withColumn("genre", F.when(F.col("lang") == "fr", "report"))
    return style.tail_present(docs, tail=".\n")
