"""Feed queries: time basis, windows, search, pages, topics, stories and dailies.

``now`` is always a parameter, as a datetime or a column (a scalar subquery will do).
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql import types as T

from tidemark.functions.links import follow
from tidemark.functions.ordered import minutes, rank_in_order

# The backfill limit, the windows offered, the silence after which a story is settled.
BACKFILL_HOURS = 72
WINDOW_HOURS = {"24h": 24, "7d": 168}
SETTLED_HOURS = 48
# The size of a source sketch, as a power of two, and three times its standard error.
SKETCH_BITS, SKETCH_ERROR = 12, 0.05
DISPLAY_ZONE = "Asia/Shanghai"


def _at(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now)


def _hours_before(moment: Column, hours: int) -> Column:
    return moment - F.make_dt_interval(hours=F.lit(hours))


def timeline_ts() -> Column:
    """Discovery time, but the publication time of items found more than 72 hours after it."""
    late = F.col("discovered_at") - F.col("published_at") > F.make_dt_interval(hours=F.lit(BACKFILL_HOURS))
    return F.when(F.col("published_at").isNotNull() & late, F.col("published_at")).otherwise(
        F.col("discovered_at")
    )


def with_timeline_ts(items: DataFrame) -> DataFrame:
    return items.withColumn("timeline_ts", timeline_ts())


def _time_basis(by: str) -> Column:
    if by not in ("timeline", "published"):
        raise ValueError(f"unknown time basis {by!r}")
    return timeline_ts() if by == "timeline" else F.col("published_at")


def _since(items: DataFrame, hours: int, by: str, now: Column) -> DataFrame:
    # In the type of the column, because a cast of the column would keep the bound from the scan.
    start = _hours_before(now, hours).cast(items.schema["discovered_at"].dataType)
    # A scan cannot use the computed column, but the timeline time is never later than the
    # discovery time, so the raw column carries the same bound down to the files.
    raw = F.col("discovered_at" if by == "timeline" else "published_at")
    return (
        items.filter(raw >= start)
        .withColumn("timeline_ts", _time_basis(by))
        .filter(F.col("timeline_ts") >= start)
    )


def feed_window(
    items: DataFrame,
    *,
    now: datetime | Column,
    window: str = "7d",
    by: str = "timeline",
    mode: str = "selected",
    category: str | None = None,
) -> DataFrame:
    """Items of the last 24 hours or 7 days (lower edge included) with ``timeline_ts``."""
    if mode not in ("selected", "all"):
        raise ValueError(f"unknown mode {mode!r}")
    recent = _since(items, WINDOW_HOURS[window], by, _at(now))
    if mode == "selected":
        recent = recent.filter("selected")
    if category is not None:
        recent = recent.filter(F.col("category") == category)
    return recent


def narrow(
    items: DataFrame, *, days: int, now: datetime | Column, by: str = "timeline", mode: str = "selected"
) -> DataFrame:
    """A range of 1 to 7 days: the smallest window that covers it, cut with the same time basis."""
    if not 1 <= days <= 7:
        raise ValueError("only ranges of 1 to 7 days are served")
    window = "24h" if days == 1 else "7d"
    return _since(feed_window(items, now=now, window=window, by=by, mode=mode), 24 * days, by, _at(now))


def matches(q: str, columns: tuple[str, ...] = ("title", "original_title", "summary")) -> Column:
    if not 2 <= len(q) <= 200:
        raise ValueError("q takes 2 to 200 characters")
    needle = F.lit(q.lower())
    hit = F.lit(False)
    for column in columns:
        hit = hit | F.coalesce(F.contains(F.lower(column), needle), F.lit(False))
    return hit


def feed_search(items: DataFrame, q: str, texts: DataFrame | None = None) -> DataFrame:
    """Items whose title, original title or summary holds ``q``, whatever its case.

    If the texts are a table of their own, ``texts(id, original_title, summary)``, they are searched
    where they lie and only the ids found are joined.
    """
    if texts is None:
        return items.filter(matches(q))
    found = texts.filter(matches(q, ("original_title", "summary"))).select("id").distinct()
    marked = items.join(found.withColumn("__found", F.lit(True)), "id", "left")
    return marked.filter(matches(q, ("title",)) | F.col("__found").isNotNull()).select(*items.columns)


def search_with_fallback(
    items: DataFrame, q: str, *, now: datetime | Column, texts: DataFrame | None = None, **window
) -> DataFrame:
    """Selected hits; when there are none, the hits of the whole pool. ``outside_selection`` tells which."""
    pool = feed_search(feed_window(items, now=now, mode="all", **window), q, texts)
    any_selected = pool.filter("selected").select(F.lit(1)).exists()
    return pool.filter(F.col("selected") | ~any_selected).withColumn(
        "outside_selection", ~F.col("selected")
    )


def feed_page(windowed: DataFrame, *, limit: int = 50, after: tuple | None = None) -> DataFrame:
    """One page, newest first. ``after`` is the last row's ``(timeline_ts, id)`` of the page before.

    Every row carries ``page_count`` and ``has_more`` of its page.
    """
    if not 1 <= limit <= 100:
        raise ValueError("limit takes 1 to 100")
    rows = windowed
    if after is not None:
        ts, key = F.lit(after[0]), F.lit(after[1])
        rows = rows.filter(
            (F.col("timeline_ts") < ts) | ((F.col("timeline_ts") == ts) & (F.col("id") < key))
        )
    newest = (F.desc("timeline_ts"), F.desc("id"))
    # The window runs over at most limit + 1 rows.
    peek = rows.orderBy(*newest).limit(limit + 1).withColumn(
        "__found", F.count(F.lit(1)).over(W.partitionBy(F.lit(0)))
    )
    return (
        peek.withColumn("page_count", F.least("__found", F.lit(limit)).cast("long"))
        .withColumn("has_more", F.col("__found") > limit)
        .drop("__found")
        .orderBy(*newest)
        .limit(limit)
    )


def brief(windowed: DataFrame, *, k: int = 8) -> DataFrame:
    """The first 3 to 8 items in feed order and ``total``, the size of the whole window."""
    if not 3 <= k <= 8:
        raise ValueError("a brief has 3 to 8 items")
    total = windowed.agg(F.count(F.lit(1))).scalar()
    return windowed.orderBy(F.desc("timeline_ts"), F.desc("id")).limit(k).withColumn("total", total)


def public_pool(
    raw: DataFrame, merged: DataFrame, *, min_relevance: float, barred: tuple[str, ...] = ("mp_hot",)
) -> DataFrame:
    """Reviewed, relevant items from public source types that are not merged into another item.

    ``raw`` adds ``source_type, reviewed, relevance``; ``merged`` lists the ``id`` of merged items.
    """
    return raw.filter(
        ~F.col("source_type").isin(*barred) & F.col("reviewed") & (F.col("relevance") >= min_relevance)
    ).join(merged.select("id"), "id", "left_anti")


def hot_topics(topics: DataFrame, signals: DataFrame) -> DataFrame:
    """The board: at most ten topics in their given rank, with counts from ``signals(topic_id, source_name, ts)``."""
    board = topics.filter(F.col("rank") <= 10)
    per_source = (
        signals.join(board.select("topic_id"), "topic_id", "left_semi")
        .groupBy("topic_id", "source_name")
        .agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("ts"))
    )
    stats = per_source.groupBy("topic_id").agg(
        F.count("source_name").alias("source_count"),
        F.sum("n").alias("signal_count"),
        F.sort_array(F.collect_list("source_name")).alias("source_names"),
        F.max("ts").alias("latest_at"),
    )
    return (
        board.join(stats, "topic_id", "left")
        .fillna(0, ["source_count", "signal_count"])
        .orderBy("rank")
        .limit(10)
    )


def source_sketches(signals: DataFrame) -> DataFrame:
    """Sketches of the sources of ``signals(topic_id, source_name, ts)`` per topic and day: ``topic_id, date, sources``.

    A sketch has a bounded size and is merged with others for any range of days, so a range costs a row per
    topic and day, not the signals again.
    """
    return signals.groupBy("topic_id", F.to_date("ts").alias("date")).agg(
        F.hll_sketch_agg("source_name", SKETCH_BITS).alias("sources")
    )


def source_estimates(sketches: DataFrame, *, first=None, last=None) -> DataFrame:
    """Distinct sources per topic in the days ``first`` to ``last`` from ``source_sketches``: ``topic_id, sources``.

    The estimate is within ``SKETCH_ERROR`` of the exact count in more than 99 of 100 cases.
    """
    days = sketches
    if first is not None:
        days = days.filter(F.col("date") >= F.lit(first).cast("date"))
    if last is not None:
        days = days.filter(F.col("date") <= F.lit(last).cast("date"))
    merged = days.groupBy("topic_id").agg(F.hll_union_agg("sources").alias("sources"))
    return merged.select("topic_id", F.hll_sketch_estimate("sources").alias("sources"))


def story_timeline(reports: DataFrame, *, now: datetime | Column, slice_minutes: int = 60) -> DataFrame:
    """Every report with its place in the story, newest first; ``status`` and ``latest`` of the story.

    A story is settled when its last report is more than 48 hours old. Stories are numbered in slices of
    ``slice_minutes``; choose them so that the reports of a slice fit a task.
    """
    stories = reports.groupBy("story_id").agg(
        F.max(F.struct("ts", "report_id")).alias("last"), F.count(F.lit(1)).alias("report_count")
    )
    settled = F.col("last.ts") < _hours_before(_at(now), SETTLED_HOURS)
    facts = stories.select(
        "story_id",
        "report_count",
        F.col("last.report_id").alias("latest"),
        F.when(settled, "settled").otherwise("developing").alias("status"),
    )
    order = ["ts", "report_id"]
    return rank_in_order(
        reports, ["story_id"], order, minutes("ts", slice_minutes), "position", descending=True, facts=facts
    )


def resolve_story(alias: DataFrame, ids: DataFrame) -> DataFrame:
    """The surviving story of every id: ``id, story_id, closed``; merges may be chained."""
    ends = follow(alias, "old_id", "new_id").withColumnRenamed("source", "id")
    return ids.join(ends, "id", "left").select(
        "id",
        F.coalesce("root", "id").alias("story_id"),
        F.coalesce("closed", F.lit(True)).alias("closed"),
    )


#: Steps of all ways from a story up to which its related stories are held in one row; others are expanded pair by pair.
ROW = 1 << 16


def related(stories: DataFrame, edges: DataFrame, *, hops: int = 1) -> DataFrame:
    """Stories reached from the given ``stories`` over ``edges(story_id, related_id, kind)``, with the smallest number of hops.

    Each hop expands only what the hop before reached for the first time. Over several hops a story's way on travels
    as whole lists, which are far fewer than the pairs they hold. Edges with a null end lead nowhere.
    """
    links = edges.select(F.col("story_id").alias("__from"), F.col("related_id").alias("__to"))
    links = links.filter("__from IS NOT NULL AND __to IS NOT NULL").distinct()
    start = stories.select("story_id").distinct()
    if hops < 2:
        return _related_by_pairs(start, links, hops)
    degrees = links.groupBy("__from").agg(F.count(F.lit(1)).alias("__steps"))
    steps = degrees
    for _ in range(1, hops):
        # Counted no further than needed, so that no sum overflows.
        onward = steps.select(F.col("__from").alias("__to"), (F.least("__steps", F.lit(ROW)) + 1).alias("__onward"))
        steps = (
            links.join(onward.hint("merge"), "__to", "left")
            .groupBy("__from").agg(F.sum(F.coalesce("__onward", F.lit(1))).alias("__steps"))
        )
    sized = start.join(steps.hint("merge"), F.col("story_id") == F.col("__from"))
    few, many = (sized.filter(which).select("story_id") for which in (F.col("__steps") <= ROW, F.col("__steps") > ROW))
    short = degrees.filter(F.col("__steps") <= ROW).select("__from")
    return _related_by_lists(few, links.join(short.hint("merge"), "__from"), hops).unionByName(
        _related_by_pairs(many, links, hops)
    )


def _related_by_lists(start: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    """``related`` for stories whose ways have no more than ``ROW`` steps; one row per story has what each hop reached."""
    lists = links.groupBy(F.col("__from").alias("__node")).agg(F.collect_list("__to").alias("__list"))
    fronts = start.select("story_id", F.array(F.array("story_id")).alias("__fronts"))
    for _ in range(hops):
        # Dealt by story before they are put together: rows with the same list are then still side by side.
        reached = (
            fronts.select("story_id", F.explode(F.element_at("__fronts", -1)).alias("__node"))
            .join(lists.hint("merge"), "__node")
            .select("story_id", "__list")
            .repartition("story_id")
            .groupBy("story_id").agg(F.flatten(F.collect_list("__list")).alias("__reached"))
        )
        known = F.flatten("__fronts")
        new = F.array_except(F.coalesce("__reached", known), known)
        fronts = fronts.join(reached.hint("merge"), "story_id", "left").select(
            "story_id", F.array_append("__fronts", new).alias("__fronts")
        )
    return (
        fronts.select("story_id", F.posexplode("__fronts").alias("hops", "__reached"))
        .filter(F.col("hops") > 0)
        .select("story_id", F.explode("__reached").alias("related_id"), "hops")
    )


def _related_by_pairs(start: DataFrame, links: DataFrame, hops: int) -> DataFrame:
    front = start.select("story_id", F.col("story_id").alias("related_id"))
    reached = front.withColumn("hops", F.lit(0))
    for hop in range(1, hops + 1):
        front = (
            front.join(links, F.col("related_id") == F.col("__from"))
            .select("story_id", F.col("__to").alias("related_id"))
            .distinct()
            .join(reached, ["story_id", "related_id"], "left_anti")
        )
        reached = reached.unionByName(front.withColumn("hops", F.lit(hop)))
    return reached.filter(F.col("hops") > 0)


def resolve_story_links(topics: DataFrame, stories: DataFrame, *, host: str) -> DataFrame:
    """Topics with the story their link names: ``public_id`` and whether it is known.

    ``stories`` has one row per ``public_id``.
    Only ``<host>/story/<public id>`` names a story; everything else stays unresolved.
    """
    escaped = "".join("\\" + c if c in ".^$*+?()[]{}|\\" else c for c in host.rstrip("/"))
    public_id = F.regexp_extract("story_link", rf"^{escaped}/story/([^/?#\s]+)/?$", 1)
    known = stories.select(F.col("public_id"), F.lit(True).alias("__known"))
    linked = topics.withColumn("public_id", F.when(public_id != "", public_id))
    return (
        linked.join(known, "public_id", "left")
        .withColumn("resolved", F.coalesce("__known", F.lit(False)))
        .drop("__known")
    )


def _stored_zone(df: DataFrame, column: str) -> Column:
    """The zone a column shows when read as wall-clock time: UTC without a zone, else the session's."""
    naive = isinstance(df.schema[column].dataType, T.TimestampNTZType)
    return F.lit("UTC") if naive else F.current_timezone()


def _local(df: DataFrame, ts: Column, zone: str) -> Column:
    """A time of ``df`` as wall-clock time of ``zone``; its zone is that of ``discovered_at``."""
    return F.convert_timezone(_stored_zone(df, "discovered_at"), F.lit(zone), ts.cast("timestamp_ntz"))


def daily_index(items: DataFrame, *, n: int = 7) -> DataFrame:
    """The ``n`` most recent calendar days of the display zone with their item counts."""
    return (
        items.groupBy(F.to_date(_local(items, F.col("discovered_at"), DISPLAY_ZONE)).alias("date"))
        .agg(F.count(F.lit(1)).alias("item_count"), F.count_if("selected").alias("selected_count"))
        .orderBy(F.desc("date"))
        .limit(n)
    )


def daily(items: DataFrame, date) -> DataFrame:
    """Items of one calendar day of the display zone."""
    # The day as a range of the raw column, so that the predicate reaches the scan.
    zone, stored = F.lit(DISPLAY_ZONE), _stored_zone(items, "discovered_at")

    def midnight(days: int) -> Column:
        day = F.date_add(F.lit(date).cast("date"), days).cast("timestamp_ntz")
        return F.convert_timezone(zone, stored, day).cast(items.schema["discovered_at"].dataType)

    return items.filter((F.col("discovered_at") >= midnight(0)) & (F.col("discovered_at") < midnight(1)))


def daily_or_nearest(dailies: DataFrame, date: Column) -> DataFrame:
    """The daily of ``date``; where there is none, the newest of the seven latest, else nothing."""
    wanted = date.cast("date")
    present = dailies.filter(F.col("date") == wanted).select(F.lit(1)).exists()
    newest = dailies.agg(F.max("date")).scalar()
    return dailies.filter(F.col("date") == F.when(present, wanted).otherwise(newest)).withColumn(
        "exact", F.col("date") == wanted
    )


def daily_entries(dailies: DataFrame) -> DataFrame:
    """Sections and flashes of daily reports as rows in their order; a missing site link falls back."""
    link = F.coalesce("item.links.site", "item.links.original").alias("link")
    in_sections = (
        dailies.select("date", F.posexplode_outer("sections").alias("section_no", "section"))
        .select("date", "section_no", "section.title", F.posexplode_outer("section.items").alias("item_no", "item"))
        .select(
            "date", F.lit("section").alias("part"), "section_no", F.col("title").alias("section"),
            "item_no", F.col("item.title").alias("title"), link,
        )
    )
    in_flashes = dailies.select("date", F.posexplode_outer("flashes").alias("item_no", "item")).select(
        "date",
        F.lit("flash").alias("part"),
        F.lit(None).cast("int").alias("section_no"),
        F.lit(None).cast("string").alias("section"),
        "item_no",
        F.col("item.title").alias("title"),
        link,
    )
    return in_sections.unionByName(in_flashes)


def display_time(items: DataFrame, *, zone: str = DISPLAY_ZONE) -> DataFrame:
    """Add ``shown_at`` in the display zone and ``shown_as``, which time it is."""
    return items.withColumn(
        "shown_at", _local(items, F.coalesce("published_at", "discovered_at"), zone)
    ).withColumn(
        "shown_as", F.when(F.col("published_at").isNull(), "indexed time").otherwise("published")
    )


def snapshot(items: DataFrame, *, fields: str = "default") -> DataFrame:
    """The selected set, whole or reduced to id, title, site link and category."""
    chosen = items.filter("selected")
    if fields == "default":
        return chosen
    if fields == "minimal":
        return chosen.select("id", "title", F.col("links.site").alias("link"), "category")
    raise ValueError(f"unknown field set {fields!r}")


def check_pages(pages: DataFrame) -> DataFrame:
    """Per snapshot: are all pages there? ``pages(snapshot, page, cursor, has_more)``, numbered from 1."""
    page = F.struct("page", "has_more")
    return (
        pages.groupBy("snapshot")
        .agg(
            F.count_distinct("page").alias("pages"),
            F.count(F.lit(1)).alias("responses"),
            F.min("page").alias("__first"),
            F.max("page").alias("__last"),
            (F.min("cursor") == F.max("cursor")).alias("one_cursor"),
            F.max(page).alias("__end"),
            F.count_if(F.col("has_more")).alias("__open"),
        )
        .select(
            "snapshot",
            "pages",
            "one_cursor",
            ((F.col("__first") == 1) & (F.col("__last") == F.col("pages"))).alias("no_gap"),
            (F.col("pages") == F.col("responses")).alias("no_repeat"),
            (~F.col("__end.has_more") & (F.col("__open") == F.col("responses") - 1)).alias("closed"),
        )
        .withColumn(
            "complete",
            F.coalesce("one_cursor", F.lit(False)) & F.col("no_gap") & F.col("no_repeat") & F.col("closed"),
        )
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Row count and an order-free digest of all values; equal results have equal fingerprints."""
    digest = F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)

    def part(start: int) -> Column:
        return F.sum(F.conv(F.substring(digest, start, 8), 16, 10).cast("decimal(20,0)"))

    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.coalesce(part(8 * i + 1), F.lit(0)).cast("decimal(38,0)").alias(f"digest_{i}") for i in range(4)],
    )


def check_items(items: DataFrame) -> DataFrame:
    """Rows breaking the item contract, as ``(rule, violations)``: required keys and the score range."""
    required = {
        "id": "id", "title": "title", "source_name": "source.name", "link_site": "links.site",
        "link_original": "links.original", "discovered_at": "discovered_at", "selected": "selected",
    }
    rules = {f"{name} present": F.col(path).isNull() for name, path in required.items()}
    rules["score in 0..100"] = ~F.col("score").between(0, 100)
    counts = items.agg(*[F.count_if(broken).alias(rule) for rule, broken in rules.items()])
    return counts.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("violations"))
                    for rule in rules
                ]
            )
        )
    )
