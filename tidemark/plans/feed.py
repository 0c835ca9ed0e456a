"""Registered feed queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import feed
from tidemark.operators.reuse import reused
from tidemark.plans.registry import day_text, query, ts_text
from tidemark.session import work_dir
from tidemark.sources import derived
from tidemark.sources.tables import table

WINDOW_SQL = "SELECT id, strftime(timeline_ts, '%Y-%m-%d %H:%M:%S.%f') AS timeline_ts FROM timeline_items WHERE "


def now(spark, folder):
    return table(spark, folder, "events").agg(F.max("ts")).scalar()


def stamped(df):
    return df.select("id", ts_text("timeline_ts").alias("timeline_ts"))


@query("feed_timeline_ts", "timeline_items", sql="""
    SELECT id, strftime(timeline_ts, '%Y-%m-%d %H:%M:%S.%f') AS timeline_ts FROM timeline_items""")
def _(spark, folder):
    return stamped(feed.with_timeline_ts(derived.feed_entries(spark, folder)))


@query("feed_window_24h_timeline", "timeline_items", sql=WINDOW_SQL + "timeline_ts >= now - INTERVAL 24 HOUR")
def _(spark, folder):
    return stamped(feed.feed_window(derived.feed_entries(spark, folder), now=now(spark, folder), window="24h", mode="all"))


@query("feed_window_7d_published", "timeline_items", sql="""
    SELECT id, strftime(published_at, '%Y-%m-%d %H:%M:%S.%f') AS timeline_ts FROM timeline_items
    WHERE published_at >= now - INTERVAL 168 HOUR""")
def _(spark, folder):
    items = derived.feed_entries(spark, folder)
    return stamped(feed.feed_window(items, now=now(spark, folder), by="published", mode="all"))


@query("feed_selected_mode", "timeline_items", sql=WINDOW_SQL + "selected AND timeline_ts >= now - INTERVAL 168 HOUR")
def _(spark, folder):
    return stamped(feed.feed_window(derived.feed_entries(spark, folder), now=now(spark, folder)))


@query("feed_category", "timeline_items", sql=WINDOW_SQL
       + "selected AND category = 'paper' AND timeline_ts >= now - INTERVAL 168 HOUR")
def _(spark, folder):
    items = derived.feed_entries(spark, folder)
    return stamped(feed.feed_window(items, now=now(spark, folder), category="paper"))


@query("feed_search", "feed_items", sql="""
    SELECT id, title FROM feed_items
    WHERE contains(lower(title), 'is the') OR contains(lower(original_title), 'is the')
       OR contains(lower(summary), 'is the')""")
def _(spark, folder):
    texts = derived.feed_texts(spark, folder)
    return feed.feed_search(derived.feed_entries(spark, folder), "Is The", texts).select("id", "title")


FALLBACK_SQL = """
    WITH hits AS (SELECT * FROM timeline_items WHERE timeline_ts >= now - INTERVAL 168 HOUR
        AND (contains(lower(title), '{q}') OR coalesce(contains(lower(original_title), '{q}'), false)
             OR coalesce(contains(lower(summary), '{q}'), false)))
    SELECT id, NOT selected AS outside_selection FROM hits
    WHERE selected OR NOT EXISTS (SELECT 1 FROM hits WHERE selected)"""


@query("feed_search_fallback", "timeline_items", sql=FALLBACK_SQL.format(q="error by user 14"))
def _(spark, folder):
    items = derived.feed_entries(spark, folder)
    hits = feed.search_with_fallback(items, "error by user 14", now=now(spark, folder), texts=derived.feed_texts(spark, folder))
    return hits.select("id", "outside_selection")


@query("feed_search_fallback_outside", "timeline_items", sql=FALLBACK_SQL.format(q="error by user 149"))
def _(spark, folder):
    items = derived.feed_entries(spark, folder)
    hits = feed.search_with_fallback(items, "error by user 149", now=now(spark, folder), texts=derived.feed_texts(spark, folder))
    return hits.select("id", "outside_selection")


@query("feed_top_24h", "timeline_items", sql="""
    SELECT id, title, strftime(timeline_ts, '%Y-%m-%d %H:%M:%S.%f') AS timeline_ts,
           least(count(*) OVER (), 10) AS page_count, count(*) OVER () > 10 AS has_more
    FROM timeline_items WHERE selected AND timeline_ts >= now - INTERVAL 24 HOUR
    ORDER BY timeline_ts DESC, id DESC LIMIT 10""")
def feed_top_24h(spark, folder):
    items = derived.feed_entries(spark, folder)
    page = feed.feed_page(feed.feed_window(items, now=now(spark, folder), window="24h"), limit=10)
    return page.select("id", "title", ts_text("timeline_ts").alias("timeline_ts"), "page_count", "has_more")


@query("feed_page_after", "timeline_items", sql="""
    SELECT id, count(*) OVER () > 100 AS has_more
    FROM timeline_items WHERE selected AND timeline_ts >= now - INTERVAL 168 HOUR
      AND (timeline_ts, id) < (TIMESTAMP '2024-01-28 00:00:00', 9000)
    ORDER BY timeline_ts DESC, id DESC LIMIT 100""")
def _(spark, folder):
    recent = feed.feed_window(derived.feed_entries(spark, folder), now=now(spark, folder))
    last_seen = F.to_timestamp_ntz(F.lit("2024-01-28 00:00:00"))
    return feed.feed_page(recent, limit=100, after=(last_seen, 9000)).select("id", "has_more")


@query("feed_narrow_3d", "timeline_items", sql=WINDOW_SQL + "timeline_ts >= now - INTERVAL 72 HOUR")
def _(spark, folder):
    return stamped(feed.narrow(derived.feed_entries(spark, folder), days=3, now=now(spark, folder), mode="all"))


@query("feed_public_pool", "feed_items", sql="""
    SELECT f.id, source_name FROM feed_items f WHERE category <> 'paper' AND score IS NOT NULL AND score >= 20
      AND id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def _(spark, folder):
    items = derived.feed_entries(spark, folder).select(
        "*",
        F.when(F.col("category") == "paper", "mp_hot").otherwise("mp_account").alias("source_type"),
        F.col("score").isNotNull().alias("reviewed"),
        F.col("score").alias("relevance"),
    )
    merged = table(spark, folder, "labels").filter("toxic = 1").select(F.col("doc_id").alias("id"))
    pool = feed.public_pool(items, merged, min_relevance=20)
    return pool.select("id", F.col("source.name").alias("source_name"))


@query("feed_hot_topics", sql="""
    SELECT c_custkey AS topic_id, rank, source_count, signal_count, source_names, strftime(latest_at, '%Y-%m-%d %H:%M:%S.%f') AS latest_at
    FROM (SELECT c_custkey, rank() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) t
    LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderpriority) AS source_count, count(*) AS signal_count,
                      array_to_string(list_sort(list(DISTINCT o_orderpriority)), '|') AS source_names, max(o_orderdate) AS latest_at
               FROM orders GROUP BY o_custkey) s ON o_custkey = c_custkey
    WHERE rank <= 10""")
def _(spark, folder):
    # The rank is given, not computed: here it comes from the account balances.
    best = table(spark, folder, "customer").orderBy(F.desc("c_acctbal"), "c_custkey").limit(10)
    topics = best.agg(F.sort_array(F.collect_list(F.struct((-F.col("c_acctbal")).alias("b"), "c_custkey"))).alias("t"))
    topics = topics.select(F.posexplode("t").alias("pos", "t")).select(
        F.col("t.c_custkey").alias("topic_id"), (F.col("pos") + 1).cast("long").alias("rank")
    )
    signals = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("topic_id"), F.col("o_orderpriority").alias("source_name"), F.col("o_orderdate").alias("ts")
    )
    return feed.hot_topics(topics, signals).select(
        "topic_id", "rank", "source_count", "signal_count",
        F.array_join("source_names", "|").alias("source_names"), ts_text("latest_at").alias("latest_at"),
    )


@query("feed_story_timeline", "story_reports", sql="""
    SELECT story_id, report_id, row_number() OVER (PARTITION BY story_id ORDER BY ts DESC, report_id DESC) AS position,
           count(*) OVER (PARTITION BY story_id) AS report_count,
           first_value(report_id) OVER (PARTITION BY story_id ORDER BY ts DESC, report_id DESC) AS latest,
           CASE WHEN max(ts) OVER (PARTITION BY story_id) < max(ts) OVER () - INTERVAL 48 HOUR THEN 'settled' ELSE 'developing' END AS status
    FROM story_reports""")
def _(spark, folder):
    told = feed.story_timeline(derived.story_reports(spark, folder), now=now(spark, folder), slice_minutes=60)
    return told.select("story_id", "report_id", "position", "report_count", "latest", "status")


@query("feed_resolve_story", "story_alias", sql="""
    WITH RECURSIVE chain(id, story) AS (SELECT c_custkey, c_custkey FROM customer
        UNION ALL SELECT id, new_id FROM chain JOIN story_alias ON story = old_id)
    SELECT id, min(story) AS story_id, true AS closed FROM chain GROUP BY id""")
def _(spark, folder):
    ids = table(spark, folder, "customer").select(F.col("c_custkey").alias("id"))
    return feed.resolve_story(derived.story_alias(spark, folder), ids)


@query("feed_related_stories", sql="""
    WITH edges AS (SELECT o_custkey AS a, arg_max(l_suppkey, (l_extendedprice, l_orderkey, l_linenumber, l_suppkey)) AS b
                   FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey),
         stories AS (SELECT c_custkey AS s FROM customer),
         hop1 AS (SELECT s, b, 1 AS hops FROM stories JOIN edges ON a = s),
         hop2 AS (SELECT s, edges.b, 2 AS hops FROM hop1 JOIN edges ON a = hop1.b)
    SELECT s AS story_id, b AS related_id, min(hops) AS hops FROM
        (SELECT s, s AS b, 0 AS hops FROM stories UNION ALL SELECT * FROM hop1 UNION ALL SELECT * FROM hop2)
    GROUP BY ALL HAVING min(hops) > 0""")
def _(spark, folder):
    # From every customer, over the supplier of its dearest line; suppliers share numbers with customers.
    lines = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    dearest = F.max_by("l_suppkey", F.struct("l_extendedprice", "l_orderkey", "l_linenumber", "l_suppkey"))
    edges = lines.groupBy(F.col("o_custkey").alias("story_id")).agg(dearest.alias("related_id"))
    stories = table(spark, folder, "customer").select(F.col("c_custkey").alias("story_id"))
    return feed.related(stories, edges.withColumn("kind", F.lit("related")), hops=2)


@query("feed_related_stories_all", sql="""
    SELECT DISTINCT o_custkey AS story_id, l_suppkey AS related_id, 1 AS hops
    FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE l_suppkey <> c_custkey""")
def _(spark, folder):
    edges = (
        table(spark, folder, "lineitem")
        .join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .select(F.col("o_custkey").alias("story_id"), F.col("l_suppkey").alias("related_id"), F.lit("related").alias("kind"))
    )
    stories = table(spark, folder, "customer").select(F.col("c_custkey").alias("story_id"))
    return feed.related(stories, edges, hops=1)


@query("feed_story_links", sql=r"""
    WITH t AS (SELECT page_id, CASE WHEN regexp_matches(url, '^https://') THEN 'https://site.test/story/p' || page_id
                                    ELSE url END AS link FROM pages)
    SELECT page_id AS topic_id, nullif(regexp_extract(link, '^https://site\.test/story/([^/?#\s]+)/?$', 1), '') AS public_id,
           regexp_matches(link, '^https://site\.test/story/') AND page_id IN (SELECT doc_id FROM labels) AS resolved FROM t""")
def _(spark, folder):
    link = F.when(
        F.col("url").startswith("https://"), F.concat(F.lit("https://site.test/story/p"), F.col("page_id").cast("string"))
    ).otherwise(F.col("url"))
    topics = table(spark, folder, "pages").select(F.col("page_id").alias("topic_id"), link.alias("story_link"))
    stories = table(spark, folder, "labels").select(F.concat(F.lit("p"), F.col("doc_id").cast("string")).alias("public_id"))
    found = feed.resolve_story_links(topics, stories, host="https://site.test")
    return found.select("topic_id", "public_id", "resolved")


DAILY_SQL = """
    SELECT strftime(day, '%Y-%m-%d') AS date, count(*) AS item_count, count(*) FILTER (selected) AS selected_count
    FROM (SELECT *, CAST(discovered_at AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai' AS DATE) AS day FROM feed_items)
    GROUP BY day ORDER BY day DESC LIMIT 7"""


@query("feed_daily_index", "feed_items", sql=DAILY_SQL)
def _(spark, folder):
    index = feed.daily_index(derived.feed_entries(spark, folder))
    return index.select(day_text("date").alias("date"), "item_count", "selected_count")


@query("feed_daily", "feed_items", sql="""
    SELECT id, category FROM feed_items
    WHERE CAST(discovered_at AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai' AS DATE) = DATE '2024-01-15'""")
def _(spark, folder):
    return feed.daily(derived.feed_entries(spark, folder), "2024-01-15").select("id", "category")


@query("feed_daily_or_nearest", "feed_items", sql="""
    SELECT strftime(max(day), '%Y-%m-%d') AS date, count(*) AS item_count, false AS exact
    FROM (SELECT CAST(discovered_at AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai' AS DATE) AS day FROM feed_items)
    GROUP BY day ORDER BY day DESC LIMIT 1""")
def _(spark, folder):
    index = feed.daily_index(derived.feed_entries(spark, folder), n=7)
    day = feed.daily_or_nearest(index, F.to_date(F.lit("2024-03-01")))
    return day.select(day_text("date").alias("date"), "item_count", "exact")


@query("feed_daily_entries", "feed_items", sql="""
    WITH o AS (SELECT o_orderdate, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag
               FROM orders JOIN lineitem ON l_orderkey = o_orderkey)
    SELECT o_orderkey AS daily, 'section' AS part, l_returnflag AS section,
           row_number() OVER (PARTITION BY o_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS item_no,
           CASE WHEN l_linenumber > 3 THEN 'https://site.test/' ELSE 'https://origin.test/' END || l_partkey || '-' || l_suppkey AS link FROM o
    UNION ALL
    SELECT o_orderkey, 'flash', NULL, 0, 'https://origin.test/order' FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)""")
def _(spark, folder):
    # Orders as dailies: a section per return flag, one flash each.
    link = F.concat_ws("-", "l_partkey", "l_suppkey")
    item = F.struct(
        F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("at"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("title"),
        F.struct(
            F.when(F.col("l_linenumber") > 3, F.concat(F.lit("https://site.test/"), link)).alias("site"),
            F.concat(F.lit("https://origin.test/"), link).alias("original"),
        ).alias("links"),
    )
    sections = (
        table(spark, folder, "lineitem").groupBy("l_orderkey", "l_returnflag")
        .agg(F.sort_array(F.collect_list(item)).alias("items"))
        .groupBy("l_orderkey")
        .agg(F.collect_list(F.struct(F.col("l_returnflag").alias("title"), "items")).alias("sections"))
    )
    flash = F.struct(
        F.lit("flash").alias("title"),
        F.struct(F.lit(None).cast("string").alias("site"), F.lit("https://origin.test/order").alias("original")).alias("links"),
    )
    dailies = sections.select(F.col("l_orderkey").alias("date"), "sections", F.array(flash).alias("flashes"))
    return feed.daily_entries(dailies).select(
        F.col("date").alias("daily"), "part", "section", F.col("item_no").cast("long").alias("item_no"), "link"
    )


@query("feed_display_time", "feed_items", sql="""
    SELECT id, strftime(coalesce(published_at, discovered_at) AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai', '%Y-%m-%d %H:%M:%S.%f') AS shown_at,
           CASE WHEN published_at IS NULL THEN 'indexed time' ELSE 'published' END AS shown_as FROM feed_items""")
def _(spark, folder):
    shown = feed.display_time(derived.feed_entries(spark, folder))
    return shown.select("id", ts_text("shown_at").alias("shown_at"), "shown_as")


@query("feed_brief", "timeline_items", sql="""
    SELECT id, title, count(*) OVER () AS total FROM timeline_items
    WHERE selected AND timeline_ts >= now - INTERVAL 168 HOUR ORDER BY timeline_ts DESC, id DESC LIMIT 8""")
def _(spark, folder):
    recent = feed.feed_window(derived.feed_entries(spark, folder), now=now(spark, folder))
    return feed.brief(recent).select("id", "title", "total")


@query("feed_snapshot_minimal", "feed_items", sql="""
    SELECT id, title, link_site AS link, category FROM feed_items WHERE selected""")
def _(spark, folder):
    return feed.snapshot(derived.feed_entries(spark, folder), fields="minimal")


@query("feed_check_pages", sql="""
    WITH p AS (SELECT conv_id, turn + 1 AS page, CASE WHEN role = 'system' THEN 'y' ELSE 'x' END AS cursor, role = 'user' AS has_more FROM conversations),
         s AS (SELECT conv_id AS snapshot, count(DISTINCT page) AS pages, count(*) AS responses, min(page) AS lo, max(page) AS hi,
                      count(DISTINCT cursor) = 1 AS one_cursor, count(*) FILTER (has_more) AS open,
                      bool_or(has_more) FILTER (last) AS end_open
               FROM (SELECT *, page = max(page) OVER (PARTITION BY conv_id) AS last FROM p) GROUP BY conv_id)
    SELECT snapshot, pages, one_cursor, lo = 1 AND hi = pages AS no_gap, pages = responses AS no_repeat,
           NOT end_open AND open = responses - 1 AS closed,
           one_cursor AND lo = 1 AND hi = pages AND pages = responses AND NOT end_open AND open = responses - 1 AS complete FROM s""")
def _(spark, folder):
    pages = table(spark, folder, "conversations").select(
        F.col("conv_id").alias("snapshot"), (F.col("turn") + 1).alias("page"),
        F.when(F.col("role") == "system", "y").otherwise("x").alias("cursor"), (F.col("role") == "user").alias("has_more"),
    )
    return feed.check_pages(pages)


@query("feed_fingerprint", sql="""
    SELECT count(*) AS rows, """ + ", ".join(
        f"CAST(sum(CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)) AS BIGINT) AS digest_{i}" for i in range(4)
    ) + r"""
    FROM (SELECT sha256('{"event_id":' || event_id || ',"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events)""")
def _(spark, folder):
    printed = feed.fingerprint(table(spark, folder, "events").select("event_id", "user_id", "event_type"))
    return printed.select(*[F.col(c).cast("long").alias(c) for c in printed.columns])


@query("feed_check_items", "feed_items", sql="""
    SELECT * FROM (
        SELECT 'id present' AS rule, count(*) FILTER (id IS NULL) AS violations FROM feed_items
        UNION ALL SELECT 'title present', count(*) FILTER (title IS NULL) FROM feed_items
        UNION ALL SELECT 'source_name present', count(*) FILTER (source_name IS NULL) FROM feed_items
        UNION ALL SELECT 'link_site present', count(*) FILTER (link_site IS NULL) FROM feed_items
        UNION ALL SELECT 'link_original present', count(*) FILTER (link_original IS NULL) FROM feed_items
        UNION ALL SELECT 'discovered_at present', count(*) FILTER (discovered_at IS NULL) FROM feed_items
        UNION ALL SELECT 'selected present', count(*) FILTER (selected IS NULL) FROM feed_items
        UNION ALL SELECT 'score in 0..100', count(*) FILTER (score NOT BETWEEN 0 AND 100) FROM feed_items)""")
def _(spark, folder):
    return feed.check_items(derived.feed_entries(spark, folder))


@query("feed_reused_index", "feed_items", sql="""
    WITH days AS (
        SELECT CAST(discovered_at AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Shanghai' AS DATE) AS day, selected, id FROM feed_items),
    newest AS (SELECT day, count(*) AS n, count(*) FILTER (selected) AS chosen FROM days GROUP BY day ORDER BY day DESC LIMIT 7),
    fewer AS (
        SELECT day, count(*) AS n, count(*) FILTER (selected) AS chosen FROM days WHERE id <> (SELECT max(id) FROM days)
        GROUP BY day ORDER BY day DESC LIMIT 7)
    SELECT * FROM (
        SELECT 1 AS call, false AS reused, * FROM newest UNION ALL SELECT 2, true, * FROM newest
        UNION ALL SELECT 3, false, * FROM fewer UNION ALL SELECT 4, true, * FROM newest)
        AS r(call, reused, day, item_count, selected_count)""".replace("SELECT * FROM (", "SELECT call, reused, strftime(day, '%Y-%m-%d') AS date, item_count, selected_count FROM (", 1))
def _(spark, folder):
    # The same question four times: new, unchanged, without the last item, unchanged against the first.
    items = derived.feed_entries(spark, folder)
    fewer = items.filter(F.col("id") != items.agg(F.max("id")).scalar())
    store = work_dir(spark, "reuse")
    answers = []
    for call, asked in enumerate((items, items, fewer, items), 1):
        index, found = reused(store, "daily-index", {"items": asked}, {"n": 7}, feed.daily_index)
        answers.append(index.select(
            F.lit(call).alias("call"), F.lit(found).alias("reused"), day_text("date").alias("date"), "item_count", "selected_count"
        ))
    return reduce(DataFrame.unionByName, answers)


@query("feed_source_estimates", sql="""
    SELECT o_orderpriority AS topic_id, count(DISTINCT o_custkey) AS exact, true AS within_bound FROM orders
    WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-01' AND DATE '1997-06-30' GROUP BY 1""")
def _(spark, folder):
    signals = table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("topic_id"), F.col("o_custkey").cast("string").alias("source_name"), F.col("o_orderdate").alias("ts")
    )
    estimates = feed.source_estimates(feed.source_sketches(signals), first="1996-01-01", last="1997-06-30")
    inside = signals.filter(F.to_date("ts").between("1996-01-01", "1997-06-30"))
    exact = inside.groupBy("topic_id").agg(F.count_distinct("source_name").alias("exact"))
    close = F.abs(F.col("sources") - F.col("exact")) <= feed.SKETCH_ERROR * F.col("exact")
    return exact.join(estimates, "topic_id").select("topic_id", "exact", close.alias("within_bound"))
