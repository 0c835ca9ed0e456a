"""Storage usage over a file listing ``entries(path, size_bytes, is_symlink, denied)``.

The listing comes from a crawler or an inventory; paths are absolute, links and unreadable
entries count nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.functions import paths, sizes
from tidemark.functions.real_paths import real_paths, resolved_links, with_real
from tidemark.functions.skew import even_join
from tidemark.session import written

# Size floors in KB, the groups with the higher one, entries shown per group.
FLOOR_KB = 51200
HIGH_FLOOR_KB = 102400
HIGH_FLOOR_GROUPS = ("home", "applications", "user_profile", "program_files", "program_files_x86")
GROUP_LIMIT = 40
TIERS = ("green", "yellow", "red")
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
BUNDLE_ID = r"^[A-Za-z0-9-]+(\.[A-Za-z0-9_-]+){2,}$"
INSTALLERS = ("dmg", "pkg", "exe", "msi")


def floor_kb(group: Column) -> Column:
    return F.when(group.isin(*HIGH_FLOOR_GROUPS), HIGH_FLOOR_KB).otherwise(FLOOR_KB).cast("long")


def _readable(entries: DataFrame) -> DataFrame:
    return entries.filter(
        ~F.coalesce("is_symlink", F.lit(False)) & ~F.coalesce("denied", F.lit(False))
    )


def dir_sizes(entries: DataFrame) -> DataFrame:
    """Bytes below every directory, ``dir, size_bytes``.

    Files are summed per directory first, so only directories are spread over their ancestors.
    """
    per_dir = (
        _readable(entries)
        .groupBy(paths.parent(F.col("path")).alias("dir"))
        .agg(F.sum("size_bytes").alias("size_bytes"))
    )
    return (
        per_dir.select(F.explode(paths.self_and_ancestors(F.col("dir"))).alias("dir"), "size_bytes")
        .groupBy("dir")
        .agg(F.sum("size_bytes").alias("size_bytes"))
    )


def child_sizes(entries: DataFrame, targets: DataFrame) -> DataFrame:
    """Size of each immediate child of the ``targets(group, root, floor_kb)``, at or above the floor.

    An unreadable root gives one row of size 0 with ``denied``. The listing is read once: files right
    below a root keep their name, all others melt into their directory, and only these sums are spread
    over the directories' ancestors.
    """
    unreadable = F.coalesce("denied", F.lit(False))
    listed = entries.filter(unreadable | ~F.coalesce("is_symlink", F.lit(False))).select(
        F.when(unreadable, F.col("path")).otherwise(paths.parent(F.col("path"))).alias("dir"),
        paths.leaf(F.col("path")).alias("leaf"),
        F.when(unreadable, 0).otherwise(F.col("size_bytes")).alias("size_bytes"),
        unreadable.alias("denied"),
    )
    roots = targets.select(F.col("root").alias("dir"), F.lit(True).alias("__root")).distinct()
    is_root = F.col("__root").isNotNull()
    per_dir = (
        even_join(listed, roots, ["dir"])
        .filter(~F.col("denied") | is_root)
        .groupBy("dir", "denied", F.when(is_root & ~F.col("denied"), F.col("leaf")).alias("name"))
        .agg(F.sum("size_bytes").alias("size_bytes"))
    )

    def place(root: Column, name: Column) -> Column:
        return F.struct(root.alias("root"), name.alias("name"))

    above = F.filter(paths.self_and_ancestors(F.col("dir")), lambda a: a != F.col("dir"))
    readable = F.concat(
        F.filter(F.array(place(F.col("dir"), F.col("name"))), lambda p: p["name"].isNotNull()),
        F.transform(above, lambda a: place(a, paths.name_below(F.col("dir"), a))),
    )
    places = F.when(F.col("denied"), F.array(place(F.col("dir"), F.lit("(permission denied)")))).otherwise(readable)
    return (
        per_dir.select("denied", "size_bytes", F.inline(places))
        .join(targets, "root")
        .groupBy("group", "root", "name", "floor_kb", "denied")
        .agg(F.floor(F.sum("size_bytes") / 1024).cast("long").alias("size_kb"))
        .filter(F.col("denied") | (F.col("size_kb") >= F.col("floor_kb")))
        .select(
            "group",
            "root",
            "name",
            F.when(F.col("denied"), F.col("root")).otherwise(F.concat("root", F.lit("/"), "name")).alias("path"),
            "size_kb",
            "denied",
        )
    )


def top_children(children: DataFrame, *, limit: int = GROUP_LIMIT) -> DataFrame:
    """The largest children per group, names ascending where sizes tie, with their ``position``."""
    order = W.partitionBy("group").orderBy(F.desc("size_kb"), F.asc("name"))
    return children.withColumn("position", F.row_number().over(order)).filter(F.col("position") <= limit)


def dev_caches(entries: DataFrame, path_list: DataFrame, *, floor: int = FLOOR_KB) -> DataFrame:
    """Sizes of the listed directories ``(list_pos, path)``, largest first, ties in list order, no limit."""
    per_dir = (
        _readable(entries)
        .groupBy(paths.parent(F.col("path")).alias("dir"))
        .agg(F.sum("size_bytes").alias("size_bytes"))
    )
    return (
        per_dir.select("size_bytes", F.explode(paths.self_and_ancestors(F.col("dir"))).alias("path"))
        .join(path_list, "path")
        .groupBy("list_pos", "path")
        .agg(F.floor(F.sum("size_bytes") / 1024).cast("long").alias("size_kb"))
        .filter(F.col("size_kb") >= floor)
        .select("list_pos", paths.leaf(F.col("path")).alias("name"), "path", "size_kb")
        .orderBy(F.desc("size_kb"), F.asc("list_pos"))
    )


def denied(entries: DataFrame) -> DataFrame:
    """Unreadable entries, the places where sizes may be too small."""
    return entries.filter("denied").select(
        F.lit("(permission denied)").alias("name"), "path", F.lit(0).cast("long").alias("size_kb")
    )


def group_totals(children: DataFrame) -> DataFrame:
    return (
        children.groupBy("group")
        .agg(F.sum("size_kb").alias("size_kb"), F.count(F.lit(1)).alias("children"))
        .withColumn("size_label", sizes.label(F.col("size_kb")))
        .withColumn("size_unit", sizes.unit(F.col("size_kb")))
    )


def text_size_totals(tier_items: DataFrame, *, strict: bool = False) -> DataFrame:
    """GB per tier read from size labels; see ``sizes.gigabytes`` for KB and B."""
    return tier_items.groupBy("tier").agg(
        F.count(F.lit(1)).alias("items"), F.sum(sizes.gigabytes(F.col("size_text"), strict)).alias("gb")
    )


def label_audit(tier_items: DataFrame) -> DataFrame:
    """Size labels with a redundant estimate note per tier, and what is left without it."""
    clean = sizes.without_estimate_note(F.col("size_text"))
    redundant = clean != F.trim(F.coalesce("size_text", F.lit("")))
    return tier_items.groupBy("tier").agg(
        F.count_if(redundant).alias("redundant"),
        F.count(F.lit(1)).alias("labels"),
        F.min(F.when(redundant, clean)).alias("first_cleaned"),
    )


class TierRule(NamedTuple):
    """A path pattern and its tier; a tier of None keeps the path out of all tiers."""

    pattern: str
    tier: str | None
    priority: int = 0
    flagged: bool = False


# Which places belong to which tier. Applications are red only where ``flagged`` (they are
# duplicated or to be removed), system places have no tier.
MAC_RULES = (
    TierRule("/Library/Caches/", "green"),
    TierRule(r"/(\.cache|\.npm|\.cargo|\.gradle|\.m2)(/|$)", "green"),
    TierRule("/Library/Developer/(Xcode/DerivedData|CoreSimulator)(/|$)", "green"),
    TierRule("/Library/Containers/", "yellow"),
    TierRule("/Library/Application Support/", "yellow"),
    TierRule(r"/Downloads/[^/]*\.(dmg|pkg)$", "green"),
    TierRule(r"^/Applications/[^/]*\.app(/|$)", "red", flagged=True),
    TierRule("^/System(/|$)", None),
)
WINDOWS_RULES = (
    TierRule("/AppData/Local/", "yellow"),
    TierRule("/AppData/Local/(Temp|pip/Cache|Yarn)(/|$)", "green"),
    TierRule("/User Data/.*/Cache(/|$)", "green"),
    TierRule("/AppData/Roaming/", "yellow"),
    TierRule(r"/(\.cache|\.npm|\.gradle|\.m2|\.nuget/packages)(/|$)", "green"),
    TierRule(r"/Downloads/[^/]*\.(exe|msi)$", "green"),
    TierRule(r"/\$Recycle\.Bin(/|$)", "yellow"),
    TierRule(r"^C:/Program Files( \(x86\))?/", "red", flagged=True),
    TierRule("^[ABD-Z]:/", "yellow", -1),
    TierRule("^[A-Z]:/Windows(/|$)", None, 1),
    TierRule(r"^[A-Z]:/(hiberfil|pagefile)\.sys$", None, 1),
)


def classify(
    children: DataFrame, rules: Sequence[TierRule], column: str = "path", flagged: Column | None = None
) -> DataFrame:
    """Add ``tier``: the highest priority wins, then the longest pattern; no rule gives ``none``.

    ``flagged`` marks applications that are duplicated (see ``duplicate_apps``) or to be removed; rules
    for flagged places do not apply to others.
    """
    tier = None
    marked = F.lit(False) if flagged is None else F.coalesce(flagged, F.lit(False))
    for rule in sorted(rules, key=lambda r: (-r.priority, -len(r.pattern))):
        found = F.col(column).rlike(rule.pattern)
        if rule.flagged:
            found = found & marked
        value = F.lit(rule.tier)
        tier = F.when(found, value) if tier is None else tier.when(found, value)
    chosen = F.lit(None).cast("string") if tier is None else tier
    return children.withColumn("tier", F.coalesce(chosen, F.lit("none")))


def classify_by_prefix(children: DataFrame, prefixes: DataFrame) -> DataFrame:
    """Add ``tier`` from ``prefixes(prefix, tier, priority)``, a rule table of any size.

    A path looks its own ancestors up, so this is an equi-join and Spark broadcasts the table only
    while it is small. The highest priority wins, then the longest prefix, then the stricter tier (red,
    yellow, green, none). Paths are classified once each; every row of ``children`` is kept.
    """
    strictness = F.coalesce(F.array_position(F.array(*[F.lit(t) for t in TIERS]), F.col("tier")), F.lit(0))
    tiers = (
        children.select("path")
        .distinct()
        .withColumn("prefix", F.explode(paths.self_and_ancestors(F.col("path"))))
        .join(prefixes, "prefix")
        .groupBy("path")
        .agg(F.max_by("tier", F.struct("priority", F.length("prefix"), strictness)).alias("tier"))
    )
    return even_join(children, tiers, ["path"]).withColumn("tier", F.coalesce("tier", F.lit("none")))


def top5(classified: DataFrame) -> DataFrame:
    """The five largest entries with their rank."""
    five = classified.orderBy(F.desc("size_kb"), "path").limit(5)
    return five.withColumn(
        "rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("size_kb"), "path"))
    )


def tier_stats(classified: DataFrame, disks: DataFrame) -> DataFrame:
    """Per disk the KB of each tier, the used rest outside them, and their width in percent.

    ``classified`` carries ``disk``; ``disks(disk, total_kb, used_kb)``.
    """
    per_disk = classified.groupBy("disk").agg(
        *[
            F.coalesce(F.sum(F.when(F.col("tier") == t, F.col("size_kb"))), F.lit(0)).alias(f"{t}_kb")
            for t in TIERS
        ]
    )
    total = F.when(F.col("total_kb") == 0, 1).otherwise(F.col("total_kb"))
    wide = disks.join(per_disk, "disk", "left").fillna(0, [f"{t}_kb" for t in TIERS])
    rest = F.col("used_kb") - F.col("green_kb") - F.col("yellow_kb") - F.col("red_kb")
    wide = wide.withColumn("other_kb", F.greatest(F.lit(0).cast("long"), rest))
    return wide.select(
        "*", *[F.round(F.col(f"{t}_kb") / total * 100, 2).alias(f"{t}_pct") for t in (*TIERS, "other")]
    )


def disk_usage(disks: DataFrame, *, main_disk: str) -> DataFrame:
    """Used percent of the disks other than the main one, at most 100."""
    total = F.when(F.col("total_kb") == 0, 1).otherwise(F.col("total_kb"))
    return disks.filter(F.col("disk") != main_disk).withColumn(
        "used_pct", F.round(F.least(F.lit(100.0), F.col("used_kb") / total * 100), 1)
    )


def mystery_dirs(entries: DataFrame, bundle_map: DataFrame, *, floor: int = FLOOR_KB) -> DataFrame:
    """Directories with a UUID for a name at or above the floor, with the owner a child's name gives away.

    A name below them like ``com.vendor.app`` is looked up in ``bundle_map(bundle_id, owner)``;
    directories without such a child, or with an unknown one, are kept without an owner.
    """
    names = paths.parts(F.col("path"))
    at = F.expr(f"array_position(transform(split(path, '/', -1), n -> n rlike '{UUID}'), true)").cast("int")
    inside = F.slice(names, at + 1, F.greatest(F.size(names) - at, F.lit(0)))
    found = (
        _readable(entries)
        .filter(F.col("path").rlike("/[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-"))
        .withColumn("__at", at)
        .filter("__at > 0")
        .select(
            F.array_join(F.slice(names, F.lit(1), at), "/").alias("path"),
            F.try_element_at(F.filter(inside, lambda n: n.rlike(BUNDLE_ID)), F.lit(1)).alias("bundle_id"),
            "size_bytes",
        )
        .groupBy("path", "bundle_id")
        .agg(F.sum("size_bytes").alias("size_bytes"))
        .groupBy("path")
        .agg(
            F.floor(F.sum("size_bytes") / 1024).cast("long").alias("size_kb"),
            F.max_by("bundle_id", F.when(F.col("bundle_id").isNotNull(), F.struct("size_bytes", "bundle_id"))).alias(
                "bundle_id"
            ),
        )
        .filter(F.col("size_kb") >= floor)
    )
    return found.join(bundle_map, "bundle_id", "left").select("path", "size_kb", "bundle_id", "owner")


def installer_residue(
    entries: DataFrame, *, folder: str = "/Downloads/", suffixes: Sequence[str] = INSTALLERS
) -> DataFrame:
    """Installers left in the download folders, summed per suffix."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return (
        _readable(entries)
        .filter(F.contains(F.col("path"), F.lit(folder)) & suffix.isin(*suffixes))
        .groupBy(suffix.alias("suffix"))
        .agg(F.count(F.lit(1)).alias("files"), F.sum("size_bytes").alias("size_bytes"))
    )


def app_name(path: Column) -> Column:
    """An application's name without suffix, version and copy number."""
    bare = F.regexp_replace(F.lower(paths.leaf(path)), r"\.(app|exe)$", "")
    return F.trim(F.regexp_replace(bare, r"[ _-]*(\(?v?[0-9][0-9.]*\)?|copy)$", ""))


def duplicate_apps(apps: DataFrame, *, name: Column | None = None) -> DataFrame:
    """Applications installed at more than one path; ``name`` tells which ones are the same."""
    key = app_name(F.col("path")) if name is None else name
    return (
        apps.groupBy(key.alias("app"), "path")
        .agg(F.max("size_kb").alias("size_kb"))
        .groupBy("app")
        .agg(
            F.count(F.lit(1)).alias("installs"),
            F.sum("size_kb").alias("size_kb"),
            F.min("path").alias("first_path"),
        )
        .filter(F.col("installs") > 1)
    )


def _existing(wanted: DataFrame, entries: DataFrame) -> DataFrame:
    """The ``path`` values of ``wanted`` that are entries or directories of the listing.

    The join keeps the listing in place while the wanted paths are few enough to be broadcast.
    """
    listed = entries.select("path").union(
        entries.select(paths.parent(F.col("path")).alias("path"))
        .distinct()
        .select(F.explode(paths.self_and_ancestors(F.col("path"))))
    )
    return listed.join(wanted.select("path").distinct(), "path").distinct()


def grants(
    tier_items: DataFrame, entries: DataFrame, *, home: str | None = None, links: DataFrame | None = None
) -> DataFrame:
    """What may be done to which path, ``mode, path``; paths come out absolute (``home`` stands for ``~``).

    Green trash paths may be removed, trashed and opened, yellow ones trashed and opened. Yellow
    item paths and red application paths may be opened where they exist. With ``links(path, target)``
    every right holds for the real path (see ``functions.real_paths``), and that is where it must exist.
    """

    def may(path: Column, must_exist: bool, *modes: str) -> Column:
        return F.array(
            *[F.struct(F.lit(m).alias("mode"), path.alias("path"), F.lit(must_exist).alias("check")) for m in modes]
        )

    def each(paths_column: str, must_exist: bool, *modes: str) -> Column:
        wanted = F.coalesce(F.col(paths_column), F.array().cast("array<string>"))
        return F.flatten(F.transform(wanted, lambda p: may(p, must_exist, *modes)))

    rights = (
        F.when(F.col("tier") == "green", each("trash_paths", False, "rm", "trash", "open"))
        .when(
            F.col("tier") == "yellow",
            F.concat(each("trash_paths", False, "trash", "open"), may(F.col("path"), True, "open")),
        )
        .when(F.col("tier") == "red", each("app_paths", True, "open"))
    )
    possible = tier_items.select(F.inline(rights)).filter(F.col("path").isNotNull())
    possible = _real(possible, "path", links, home)
    opened = _existing(possible.filter("check"), entries).select(F.lit("open").alias("mode"), "path")
    return possible.filter("NOT check").select("mode", "path").unionByName(opened).distinct()


def _real(
    rows: DataFrame, column: str, links: DataFrame | None, home: str | None, name: str | None = None
) -> DataFrame:
    """``rows`` with the absolute path of ``column`` (the real one, if ``links`` are given) as ``name``."""
    if links is None:
        return rows.withColumn(name or column, paths.absolute(F.col(column), home))
    found = with_real(rows, links, column, "__real", home=home)
    return found.withColumn(name or column, F.col("__real")).drop("__real")


def request_paths(requests: DataFrame) -> DataFrame:
    """Requests with a ``paths`` array, one row per path."""
    return requests.select("request_id", "mode", F.posexplode("paths").alias("pos", "path"))


def audit_actions(
    requested: DataFrame,
    allowed: DataFrame,
    *,
    roots: Sequence[str] = ("/Applications",),
    home: str | None = None,
    links: DataFrame | None = None,
) -> DataFrame:
    """How far each path of a request got: ``done``, ``not granted``, ``outside roots`` or ``not reached``.

    ``requested(request_id, mode, pos, path)`` is worked off by ``pos`` and stops at the first path
    that is not granted for its mode or lies outside the roots; what came before stays done. A path
    that no longer exists counts as done. Requests in an unknown mode are ``rejected`` whole.

    Grants and requests are compared as absolute paths without ``.`` and ``..``, or as real paths where
    ``links(path, target)`` are given: links anywhere on the way of either are followed to their ends.
    ``home`` stands for ``~`` and is a root itself, at its real place; ``roots`` are real places.
    """
    place = F.col("__place")
    if links is not None and "real" not in links.columns:
        links = written(resolved_links(links, home=home), "links")
    if home and links is not None:
        here = requested.sparkSession.createDataFrame([(home,)], "path STRING")
        home_root = real_paths(here, links).first()["real"]
    else:
        home_root = home
    in_roots = F.lit(False)
    for root in [*roots, *([home_root] if home_root else [])]:
        in_roots = in_roots | (place == root) | F.startswith(place, F.lit(f"{root}/"))
    asked = _real(requested, "path", links, home, "__place")
    granted = (
        _real(allowed.select("mode", "path"), "path", links, home, "__place")
        .select("mode", "__place")
        .distinct()
        .withColumn("__granted", F.lit(True))
    )
    checked = even_join(asked, granted, ["mode", "__place"]).withColumn(
        "__stop",
        F.when(~F.col("mode").isin("rm", "trash", "open"), "rejected")
        .when(F.col("__granted").isNull(), "not granted")
        .when(~in_roots, "outside roots"),
    )
    first = (
        checked.filter(F.col("__stop").isNotNull()).groupBy("request_id").agg(F.min("pos").alias("__first"))
    )
    outcome = (
        F.when(F.col("__stop") == "rejected", "rejected")
        .when(F.col("__first").isNull() | (F.col("pos") < F.col("__first")), "done")
        .when(F.col("pos") == F.col("__first"), F.col("__stop"))
        .otherwise("not reached")
    )
    return even_join(checked, first, ["request_id"]).select(
        "request_id", "mode", "pos", "path", outcome.alias("outcome")
    )


def batch_estimate(tier_items: DataFrame, done: DataFrame) -> DataFrame:
    """Items, paths and GB that clearing all green items not yet ``done(name)`` would cover."""
    return (
        tier_items.filter((F.col("tier") == "green") & (F.size("trash_paths") > 0))
        .join(done.select("name"), "name", "left_anti")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.coalesce(F.sum(F.size("trash_paths")), F.lit(0)).cast("long").alias("paths"),
            F.coalesce(F.sum(sizes.gigabytes(F.col("size_text"))), F.lit(0.0)).alias("gb"),
        )
    )


# The fields of the report's items.
REPORT_FIELDS = {
    "top5": ("rank", "tier", "size", "type", "name", "path", "note"),
    "green": ("name", "path", "size_estimate", "kill_processes", "trash_paths", "commands"),
    "yellow": ("name", "path", "size", "content_profile", "why_manual", "disposal", "risk", "trash_paths", "open_note"),
    "red": ("name", "path", "size", "why_keep", "indirect_release", "auto_reclaim", "app_paths"),
}


def report_sections(
    classified: DataFrame,
    entries: DataFrame,
    disks: DataFrame,
    *,
    notes: DataFrame | None = None,
    scans: DataFrame | None = None,
    summary: DataFrame | None = None,
) -> DataFrame:
    """The report as JSON rows ``section, body``: meta, system, top5, the tiers, denied, summary.

    One row per item, so a report of any size is written in parallel, a folder per section. The
    classified entries are read by five sections; pass them as a written table.

    An item has the fields of ``REPORT_FIELDS`` that ``classified`` or ``notes(path, ...)`` have, and its
    ``size_kb``; what a person or a model writes about an item comes with the notes, at most one row a path.
    ``scans`` are ``SCAN`` documents and give meta (time and length of the scan) and system; ``summary(overview,
    priority, long_term)`` is added to the numbers of each disk.
    """
    items = classified
    if notes is not None:
        told = [c for c in notes.columns if c == "path" or c not in classified.columns]
        items = even_join(classified, notes.select(told), ["path"])

    def body(section: str, present: Sequence[str]) -> Column:
        return F.to_json(F.struct(*[c for c in REPORT_FIELDS[section] if c in present], "size_kb"))

    ranked = top5(items)
    parts = [ranked.select(F.lit("top5").alias("section"), body("top5", ranked.columns).alias("body"))]
    bodies = F.when(F.lit(False), F.lit(""))
    for tier in TIERS:
        bodies = bodies.when(F.col("tier") == tier, body(tier, items.columns))
    parts.append(items.filter(F.col("tier").isin(*TIERS)).select(F.col("tier").alias("section"), bodies.alias("body")))
    parts.append(denied(entries).select(F.lit("denied").alias("section"), F.to_json(F.struct("path")).alias("body")))
    stats = tier_stats(classified, disks)
    parts.append(stats.select(F.lit("summary").alias("section"), F.to_json(F.struct(*stats.columns)).alias("body")))
    if summary is not None:
        text = F.to_json(F.struct("overview", "priority", "long_term"))
        parts.append(summary.select(F.lit("summary").alias("section"), text.alias("body")))
    if scans is not None:
        parts.append(scans.select(F.lit("meta").alias("section"), F.to_json(F.struct("generated_at", "scan_seconds")).alias("body")))
        parts.append(scans.select(F.lit("system").alias("section"), F.to_json("system").alias("body")))
    return reduce(DataFrame.unionByName, parts)


def write_report(sections: DataFrame, path: str) -> None:
    sections.write.mode("overwrite").partitionBy("section").text(path)
