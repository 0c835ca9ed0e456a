"""Readers: the given Parquet tables and the JSON/text documents the operators start from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FEED_ITEM = """
    id STRING NOT NULL, title STRING NOT NULL, original_title STRING, summary STRING,
    source STRUCT<name: STRING>, links STRUCT<site: STRING, original: STRING>,
    published_at TIMESTAMP, discovered_at TIMESTAMP, category STRING, score INT, selected BOOLEAN
"""
FEED_PAGE = """
    schemaVersion INT,
    query STRUCT<mode: STRING, category: STRING, q: STRING, window: STRING, by: STRING, ordering: STRING>,
    items ARRAY<STRUCT<
        id: STRING, title: STRING, originalTitle: STRING, summary: STRING, source: STRUCT<name: STRING>,
        links: MAP<STRING, STRING>, publishedAt: TIMESTAMP, discoveredAt: TIMESTAMP,
        category: STRING, score: INT, selected: BOOLEAN>>,
    page STRUCT<count: INT, hasMore: BOOLEAN, nextCursor: STRING>
"""
# A saved snapshot response: which snapshot it belongs to and its number in the order of fetching come with it.
SNAPSHOT_PAGE = """
    snapshot BIGINT, page BIGINT, cursor STRING, nextPage STRING, hasMore BOOLEAN, count INT,
    items ARRAY<STRUCT<
        id: STRING, title: STRING, originalTitle: STRING, summary: STRING, source: STRUCT<name: STRING>,
        links: MAP<STRING, STRING>, publishedAt: TIMESTAMP, discoveredAt: TIMESTAMP,
        category: STRING, score: INT, selected: BOOLEAN>>
"""
CHANGE_PAGE = """
    page BIGINT, cursor STRING, hasMore BOOLEAN,
    changes ARRAY<STRUCT<op: STRING, id: STRING, item: STRING>>
"""
DAILY = """
    date DATE, lead STRING,
    sections ARRAY<STRUCT<title: STRING, items: ARRAY<STRUCT<title: STRING, links: STRUCT<site: STRING, original: STRING>>>>>,
    flashes ARRAY<STRUCT<title: STRING, links: STRUCT<site: STRING, original: STRING>>>
"""
TOPIC_PAGE = """
    schemaVersion INT, count INT,
    items ARRAY<STRUCT<
        rank: BIGINT, title: STRING, sourceCount: BIGINT, signalCount: BIGINT, sourceNames: ARRAY<STRING>,
        latestAt: TIMESTAMP, links: MAP<STRING, STRING>>>
"""
# A saved story response; one that was answered by a redirect has its address and the new location instead of a story.
STORY_PAGE = """
    schemaVersion INT, asked STRING, status INT, location STRING,
    story STRUCT<
        id: STRING, title: STRING, status: STRING, latest: STRING, digest: STRING,
        reports: ARRAY<STRUCT<id: STRING, title: STRING, source: STRUCT<name: STRING>, publishedAt: TIMESTAMP, links: MAP<STRING, STRING>>>,
        storyline: ARRAY<STRUCT<title: STRING, links: MAP<STRING, STRING>>>,
        related: ARRAY<STRUCT<title: STRING, links: MAP<STRING, STRING>>>>
"""
DAILY_INDEX = """
    schemaVersion INT, count INT, items ARRAY<STRUCT<date: DATE, lead: STRING, links: MAP<STRING, STRING>>>
"""
EVAL_SET = """
    skill_name STRING,
    evals ARRAY<STRUCT<
        id: BIGINT, name: STRING, prompt: STRING, expected_output: STRING,
        files: ARRAY<STRING>, expectations: ARRAY<STRING>, assertions: ARRAY<STRING>>>
"""
SCAN = """
    generated_at STRING, scan_seconds DOUBLE,
    system STRUCT<os: STRING, disk_name: STRING, disk_total: STRING, disk_used: STRING, disk_free: STRING,
                  disks: ARRAY<STRUCT<name: STRING, total: STRING, used: STRING, free: STRING>>>,
    groups MAP<STRING, ARRAY<STRUCT<name: STRING, path: STRING, size_kb: BIGINT, size_h: STRING, denied: BOOLEAN>>>
"""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_json(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """JSON with a fixed schema: fields the schema does not name are ignored, missing ones are null."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


CHANGED_ITEM = """
    id STRING, title STRING, originalTitle STRING, summary STRING, source STRUCT<name: STRING>,
    links MAP<STRING, STRING>, publishedAt TIMESTAMP, discoveredAt TIMESTAMP,
    category STRING, score INT, selected BOOLEAN
"""


def _item_columns(site_key: str) -> list[Column]:
    item = F.col("item")
    return [
        item.id.alias("id"),
        item.title.alias("title"),
        item.originalTitle.alias("original_title"),
        item.summary.alias("summary"),
        item.source.alias("source"),
        F.struct(
            item.links[site_key].alias("site"), item.links["original"].alias("original")
        ).alias("links"),
        item.publishedAt.alias("published_at"),
        item.discoveredAt.alias("discovered_at"),
        item.category.alias("category"),
        item.score.alias("score"),
        item.selected.alias("selected"),
    ]


def feed_items(pages: DataFrame, site_key: str) -> DataFrame:
    """Items of ``FEED_PAGE`` or ``SNAPSHOT_PAGE`` documents, one row each; ``site_key`` names the link to the reading page."""
    return pages.select(F.explode("items").alias("item")).select(*_item_columns(site_key))


def snapshot_pages(responses: DataFrame) -> DataFrame:
    """The page list of ``SNAPSHOT_PAGE`` documents, as ``check_pages`` takes it."""
    return responses.select("snapshot", "page", "cursor", F.col("hasMore").alias("has_more"))


def changes(pages: DataFrame, item: str, site_key: str) -> DataFrame:
    """Rows of ``CHANGE_PAGE`` documents in the columns of ``feed_items``, with ``seq`` and ``op``.

    ``item`` is the schema of a changed item (``CHANGED_ITEM``). ``seq`` orders the changes: page first, then
    position in the page. A removal has no item but its id.
    """
    rows = pages.select("page", F.posexplode("changes").alias("pos", "change")).select(
        F.struct("page", "pos").alias("seq"),
        F.col("change.op").alias("op"),
        F.col("change.id").alias("id"),
        F.array(F.from_json("change.item", item)).alias("items"),
    )
    items = rows.select("seq", "op", F.col("id").alias("__id"), F.explode("items").alias("item"))
    return items.select("seq", "op", F.col("__id").alias("id"), *_item_columns(site_key)[1:])


def topics(responses: DataFrame) -> DataFrame:
    """Board items of ``TOPIC_PAGE`` documents with the counts they came with, one row each."""
    item = responses.select(F.explode("items").alias("i"))
    return item.select(
        "i.rank", "i.title", F.col("i.sourceCount").alias("source_count"), F.col("i.signalCount").alias("signal_count"),
        F.col("i.sourceNames").alias("source_names"), F.col("i.latestAt").alias("latest_at"), F.col("i.links")["story"].alias("story_link"),
    )


def _id_in(link: Column) -> Column:
    """The last part of an address's path; null if there is none."""
    last = F.regexp_extract(link, "/([^/?#]+)/?(?:[?#].*)?$", 1)
    return F.when(last != "", last)


def stories(responses: DataFrame) -> DataFrame:
    """``story_id, title, status, latest, digest`` of the ``STORY_PAGE`` documents that hold a story."""
    return responses.filter("story IS NOT NULL").select(
        F.col("story.id").alias("story_id"), "story.title", "story.status", "story.latest", "story.digest"
    )


def story_reports(responses: DataFrame) -> DataFrame:
    """Reports of ``STORY_PAGE`` documents as ``story_timeline`` takes them: ``story_id, report_id, ts, title, source_name``."""
    rows = responses.select(F.col("story.id").alias("story_id"), F.explode("story.reports").alias("r"))
    return rows.select(
        "story_id", F.col("r.id").alias("report_id"), F.col("r.publishedAt").alias("ts"), "r.title", F.col("r.source.name").alias("source_name")
    )


def story_edges(responses: DataFrame) -> DataFrame:
    """References of ``STORY_PAGE`` documents to other stories, as ``related`` takes them: ``story_id, related_id, kind``."""
    none = F.array().cast("array<struct<title:string,links:map<string,string>>>")
    kinds = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"story.{k}"), none).alias("to")) for k in ("storyline", "related")
    ])
    rows = responses.filter("story IS NOT NULL").select(F.col("story.id").alias("story_id"), F.inline(kinds))
    rows = rows.select("story_id", "kind", F.explode("to").alias("to"))
    named = rows.select("story_id", _id_in(F.col("to.links")["api"]).alias("related_id"), "kind")
    return named.filter("related_id IS NOT NULL").distinct()


def story_aliases(responses: DataFrame) -> DataFrame:
    """Merges told by redirected ``STORY_PAGE`` documents, as ``resolve_story`` takes them: ``old_id, new_id``."""
    moved = responses.filter("status IN (301, 308)").select(_id_in(F.col("asked")).alias("old_id"), _id_in(F.col("location")).alias("new_id"))
    return moved.dropna().filter("old_id <> new_id").distinct()


def daily_dates(responses: DataFrame, site_key: str) -> DataFrame:
    """``date, lead, link`` of the dailies that ``DAILY_INDEX`` documents list; ``site_key`` names the link."""
    return responses.select(F.explode("items").alias("i")).select("i.date", "i.lead", F.col("i.links")[site_key].alias("link"))


def scan_entries(scans: DataFrame) -> DataFrame:
    """Rows of ``SCAN`` documents: ``group, name, path, size_kb, denied``."""
    return (
        scans.select(F.explode("groups").alias("group", "entries"))
        .select("group", F.explode("entries").alias("e"))
        .select("group", "e.name", "e.path", "e.size_kb", F.coalesce("e.denied", F.lit(False)).alias("denied"))
    )


def eval_cases(documents: DataFrame) -> DataFrame:
    return documents.select("skill_name", F.explode("evals").alias("e")).select("skill_name", "e.*")


def manifest_lines(spark: SparkSession, path: str) -> DataFrame:
    """Checksum manifests as ``(package, line)``, the package being the file they stand in."""
    return spark.read.text(path).select(
        F.col("_metadata.file_path").alias("package"), F.col("value").alias("line")
    )


def file_contents(spark: SparkSession, path: str, suffix: str = "*") -> DataFrame:
    """Files below ``path`` as ``(path, bytes, sha256, text)``."""
    raw = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", suffix)
        .load(path)
    )
    return raw.select(
        "path",
        F.col("length").alias("bytes"),
        F.sha2("content", 256).alias("sha256"),
        F.try_validate_utf8(F.col("content").cast("string")).alias("text"),
    )
