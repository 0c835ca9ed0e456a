"""Registered storage queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions.real_paths import real_paths, resolved_links
from tidemark.operators import storage
from tidemark.plans.registry import query
from tidemark.session import written
from tidemark.sources import derived
from tidemark.sources.tables import table

FLOORED = 'SELECT * FROM child_sizes WHERE size_kb >= floor_kb'


def every_child(spark, folder):
    return storage.child_sizes(derived.fs_entry(spark, folder), derived.targets(spark, folder))


def children(spark, folder):
    return every_child(spark, folder).filter("NOT denied")


@query("storage_dir_sizes", "dirs", sql="""
    SELECT dir, CAST(sum(size_bytes) AS BIGINT) AS size_bytes FROM dirs GROUP BY dir""")
def _(spark, folder):
    return storage.dir_sizes(derived.fs_entry(spark, folder))


@query("storage_child_sizes", "child_sizes", sql=f"""
    SELECT "group", root || '/' || name AS path, size_kb, false AS denied FROM ({FLOORED})
    UNION ALL SELECT "group", root, 0, true FROM targets JOIN (SELECT DISTINCT path FROM fs_entry WHERE denied) ON path = root""")
def _(spark, folder):
    return every_child(spark, folder).select("group", "path", "size_kb", "denied")


@query("storage_target_floors", "child_sizes", sql=f"""
    SELECT "group", count(*) AS children, count(*) FILTER (size_kb < floor_kb) AS below_floor FROM child_sizes GROUP BY 1""")
def _(spark, folder):
    every = storage.child_sizes(
        derived.fs_entry(spark, folder),
        derived.targets(spark, folder).select("group", "root", F.lit(0).cast("long").alias("floor_kb")),
    ).filter("NOT denied")
    floors = every.withColumn("floor_kb", storage.floor_kb(F.col("group")))
    return floors.groupBy("group").agg(
        F.count(F.lit(1)).alias("children"), F.count_if(F.col("size_kb") < F.col("floor_kb")).alias("below_floor")
    )


@query("storage_top_children", "child_sizes", sql=f"""
    SELECT "group", name, size_kb, row_number() OVER (PARTITION BY "group" ORDER BY size_kb DESC, name) AS position
    FROM ({FLOORED}) QUALIFY position <= 40""")
def _(spark, folder):
    top = storage.top_children(children(spark, folder))
    return top.select("group", "name", "size_kb", F.col("position").cast("long").alias("position"))


@query("storage_dev_caches", "dirs", "customer_dirs", sql="""
    SELECT c_custkey AS list_pos, d.dir AS path, 'c' || c_custkey AS name, CAST(sum(size_bytes) AS BIGINT) // 1024 AS size_kb
    FROM dirs d JOIN customer_dirs c ON d.dir = c.path WHERE c_mktsegment = 'MACHINERY'
    GROUP BY ALL HAVING CAST(sum(size_bytes) AS BIGINT) // 1024 >= 51200""")
def _(spark, folder):
    listed = derived.customer_dirs(spark, folder).filter("c_mktsegment = 'MACHINERY'")
    return storage.dev_caches(
        derived.fs_entry(spark, folder), listed.select(F.col("c_custkey").alias("list_pos"), "path")
    )


@query("storage_denied", "fs_entry", sql="""
    SELECT path, '(permission denied)' AS name, CAST(0 AS BIGINT) AS size_kb FROM fs_entry WHERE denied""")
def _(spark, folder):
    return storage.denied(derived.fs_entry(spark, folder))


@query("storage_group_totals", "child_sizes", sql=f"""
    SELECT "group", CAST(sum(size_kb) AS BIGINT) AS size_kb, count(*) AS children,
           CASE WHEN sum(size_kb) < 1 THEN 'B' WHEN sum(size_kb) < 1024 THEN 'KB' WHEN sum(size_kb) < 1048576 THEN 'MB'
                WHEN sum(size_kb) < 1073741824 THEN 'GB' ELSE 'TB' END AS size_unit
    FROM ({FLOORED}) GROUP BY 1""")
def _(spark, folder):
    return storage.group_totals(children(spark, folder)).drop("size_label")


GB = r"""
    CASE WHEN size_text LIKE '%TB%' THEN n * 1024.0 WHEN size_text LIKE '%MB%' THEN n / 1024.0 {strict} ELSE n * 1.0 END"""
LABELS = r"(SELECT *, CAST(regexp_extract(size_text, '([0-9.]+)', 1) AS DOUBLE) AS n FROM tier_items)"


@query("storage_text_size_totals", "tier_items", sql=f"""
    SELECT tier, count(*) AS items, round(sum({GB.format(strict='')}), 3) AS gb FROM {LABELS} GROUP BY tier""")
def _(spark, folder):
    totals = storage.text_size_totals(derived.tier_items(spark, folder))
    return totals.withColumn("gb", F.round("gb", 3))


@query("storage_text_size_totals_strict", "tier_items", sql=f"""
    SELECT tier, count(*) AS items, round(sum({GB.format(strict="WHEN size_text LIKE '%KB%' THEN n / 1048576.0")}), 3) AS gb
    FROM {LABELS} GROUP BY tier""")
def _(spark, folder):
    totals = storage.text_size_totals(derived.tier_items(spark, folder), strict=True)
    return totals.withColumn("gb", F.round("gb", 3))


@query("storage_label_audit", "tier_items", sql="""
    SELECT tier, count(*) FILTER (size_text LIKE '%（估算）') AS redundant, count(*) AS labels,
           min(replace(size_text, '（估算）', '')) FILTER (size_text LIKE '%（估算）') AS first_cleaned
    FROM tier_items GROUP BY tier""")
def _(spark, folder):
    return storage.label_audit(derived.tier_items(spark, folder))


PATH_RULES = (
    storage.TierRule("^/AFRICA/", "green"),
    storage.TierRule("^/AMERICA/NATION_1/", "red"),
    storage.TierRule("^/AMERICA/", "yellow"),
    storage.TierRule("/c[0-9]*7$", None, 1),
    storage.TierRule("^/ASIA/.*/c1[0-9]*$", "red"),
)


@query("storage_classify", "child_sizes", sql=f"""
    SELECT path, size_kb, CASE WHEN regexp_matches(path, '/c[0-9]*7$') THEN 'none'
        WHEN regexp_matches(path, '^/ASIA/.*/c1[0-9]*$') THEN 'red' WHEN path LIKE '/AMERICA/NATION!_1/%' ESCAPE '!' THEN 'red'
        WHEN path LIKE '/AMERICA/%' THEN 'yellow' WHEN path LIKE '/AFRICA/%' THEN 'green' ELSE 'none' END AS tier
    FROM (SELECT root || '/' || name AS path, size_kb FROM ({FLOORED}))""")
def _(spark, folder):
    return storage.classify(children(spark, folder), PATH_RULES).select("path", "size_kb", "tier")


CLASSIFIED = f"""
    (SELECT root || '/' || name AS path, name, size_kb, split_part(root, '/', 2) AS disk,
            coalesce((SELECT arg_max(tier, length(prefix)) FROM tier_prefixes p
                      WHERE root || '/' || name = prefix OR starts_with(root || '/' || name, prefix || '/')), 'none') AS tier
     FROM ({FLOORED}))"""


def classified(spark, folder):
    tiered = storage.classify_by_prefix(children(spark, folder), derived.tier_prefixes(spark, folder))
    return tiered.withColumn("disk", F.split("path", "/")[1])


def disks(spark, folder):
    """A disk per region: its files are the used part, and half as much again is the total."""
    used = derived.fs_entry(spark, folder).groupBy(F.split("path", "/")[1].alias("disk")).agg(
        F.floor(F.sum("size_bytes") / 1024).cast("long").alias("used_kb")
    )
    return used.withColumn("total_kb", F.floor(F.col("used_kb") * 3 / 2).cast("long"))


DISKS = """
    (SELECT split_part(path, '/', 2) AS disk, CAST(sum(size_bytes) AS BIGINT) // 1024 AS used_kb,
            CAST(sum(size_bytes) AS BIGINT) // 1024 * 3 // 2 AS total_kb FROM fs_entry GROUP BY 1)"""


@query("storage_classify_by_prefix", "child_sizes", "tier_prefixes", sql=f"""
    SELECT path, size_kb, tier FROM {CLASSIFIED} UNION ALL SELECT path, size_kb, tier FROM {CLASSIFIED} WHERE size_kb % 2 = 0""")
def _(spark, folder):
    # Some children are listed twice, as two crawls would; both rows stay.
    listed = children(spark, folder)
    twice = listed.union(listed.filter("size_kb % 2 = 0"))
    return storage.classify_by_prefix(twice, derived.tier_prefixes(spark, folder)).select("path", "size_kb", "tier")


PLACES = "(SELECT '/' || source || '/d' || doc_id || '/' || n_chars AS rest, doc_id FROM documents)"


@query("storage_shipped_rules", sql=f"""
    SELECT path, CASE WHEN doc_id % 9 = 7 OR doc_id % 9 = 4 AND doc_id % 2 = 1 THEN 'none'
        ELSE CASE doc_id % 9 WHEN 0 THEN 'green' WHEN 1 THEN 'yellow' WHEN 2 THEN 'green' WHEN 3 THEN 'green' WHEN 4 THEN 'red'
             WHEN 5 THEN 'green' WHEN 6 THEN 'yellow' ELSE 'green' END END AS tier
    FROM (SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN '/Users/u/Library/Caches' || rest WHEN 1 THEN '/Users/u/Library/Containers' || rest
        WHEN 2 THEN '/Users/u/.npm' || rest WHEN 3 THEN '/Users/u/Library/Developer/Xcode/DerivedData' || rest
        WHEN 4 THEN '/Applications' || replace(rest, '/d', '.app/d') WHEN 5 THEN '/Users/u/.cargo' || rest
        WHEN 6 THEN '/Users/u/Library/Application Support' || rest WHEN 7 THEN '/System' || rest
        ELSE '/Users/u/Downloads/d' || doc_id || '.dmg' END AS path FROM {PLACES})""")
def _(spark, folder):
    """The rules as shipped: documents as places of a home folder, every other application is duplicated."""
    rest = F.concat(F.lit("/"), "source", F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/"), F.col("n_chars").cast("string"))
    places = [
        F.concat(F.lit("/Users/u/Library/Caches"), rest), F.concat(F.lit("/Users/u/Library/Containers"), rest),
        F.concat(F.lit("/Users/u/.npm"), rest), F.concat(F.lit("/Users/u/Library/Developer/Xcode/DerivedData"), rest),
        F.concat(F.lit("/Applications"), F.replace(rest, F.lit("/d"), F.lit(".app/d"))), F.concat(F.lit("/Users/u/.cargo"), rest),
        F.concat(F.lit("/Users/u/Library/Application Support"), rest), F.concat(F.lit("/System"), rest),
        F.concat(F.lit("/Users/u/Downloads/d"), F.col("doc_id").cast("string"), F.lit(".dmg")),
    ]
    docs = table(spark, folder, "documents").select("doc_id", F.get(F.array(*places), (F.col("doc_id") % 9).cast("int")).alias("path"))
    return storage.classify(docs, storage.MAC_RULES, flagged=F.col("doc_id") % 2 == 0).select("path", "tier")


@query("storage_top5", "child_sizes", "tier_prefixes", sql=f"""
    SELECT row_number() OVER (ORDER BY size_kb DESC, path) AS rank, tier, path, size_kb FROM {CLASSIFIED} QUALIFY rank <= 5""")
def _(spark, folder):
    five = storage.top5(classified(spark, folder))
    return five.select(F.col("rank").cast("long").alias("rank"), "tier", "path", "size_kb")


@query("storage_tier_stats", "child_sizes", "tier_prefixes", sql=f"""
    SELECT *, round(green_kb / total_kb * 100, 2) AS green_pct, round(yellow_kb / total_kb * 100, 2) AS yellow_pct,
           round(red_kb / total_kb * 100, 2) AS red_pct, round(other_kb / total_kb * 100, 2) AS other_pct
    FROM (SELECT disk, total_kb, used_kb, green_kb, yellow_kb, red_kb, greatest(0, used_kb - green_kb - yellow_kb - red_kb) AS other_kb
          FROM {DISKS} JOIN (SELECT disk, CAST(coalesce(sum(size_kb) FILTER (tier = 'green'), 0) AS BIGINT) AS green_kb,
                   CAST(coalesce(sum(size_kb) FILTER (tier = 'yellow'), 0) AS BIGINT) AS yellow_kb,
                   CAST(coalesce(sum(size_kb) FILTER (tier = 'red'), 0) AS BIGINT) AS red_kb
                FROM {CLASSIFIED} GROUP BY disk) USING (disk))""")
def _(spark, folder):
    return storage.tier_stats(classified(spark, folder), disks(spark, folder))


@query("storage_disk_usage", "fs_entry", sql=f"""
    SELECT disk, used_kb, total_kb, round(least(100.0, used_kb / total_kb * 100), 1) AS used_pct FROM {DISKS} WHERE disk <> 'ASIA'""")
def _(spark, folder):
    return storage.disk_usage(disks(spark, folder), main_disk="ASIA")


def containers(spark, folder):
    """Customers as sandbox containers named by a UUID; the segment gives the bundle id inside."""
    digest = F.upper(F.md5("c_name"))
    uuid = F.concat_ws("-", *[F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    inner = F.when(F.col("c_acctbal") < 0, F.lit("Documents")).otherwise(
        F.concat(F.lit("Library/com.example."), F.lower("c_mktsegment"))
    )
    return table(spark, folder, "customer").select(
        F.concat(F.lit("/Containers/"), uuid, F.lit("/Data/"), inner, F.lit("/blob")).alias("path"),
        (F.floor(F.abs("c_acctbal")) * 65536).alias("size_bytes"),
        F.lit(False).alias("is_symlink"),
        F.lit(False).alias("denied"),
    )


@query("storage_mystery_dirs", sql="""
    WITH c AS (SELECT upper(md5(c_name)) AS h, CAST(floor(abs(c_acctbal)) AS BIGINT) * 65536 // 1024 AS size_kb,
                      CASE WHEN c_acctbal >= 0 THEN 'com.example.' || lower(c_mktsegment) END AS bundle_id FROM customer)
    SELECT '/Containers/' || substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-'
               || substr(h, 21, 12) AS path, size_kb, bundle_id,
           CASE WHEN bundle_id <> 'com.example.machinery' THEN upper(substr(bundle_id, 13)) END AS owner
    FROM c WHERE size_kb >= 51200""")
def _(spark, folder):
    owners = (
        table(spark, folder, "customer").select("c_mktsegment").distinct().filter("c_mktsegment <> 'MACHINERY'")
        .select(F.concat(F.lit("com.example."), F.lower("c_mktsegment")).alias("bundle_id"), F.col("c_mktsegment").alias("owner"))
    )
    return storage.mystery_dirs(containers(spark, folder), owners)


def downloads(spark, folder):
    suffix = derived.mapped(F.col("p_type"), {"ECONOMY": ".dmg", "SMALL": ".pkg", "LARGE": ".EXE", "PROMO": ".msi"}, ".zip")
    place = F.when(F.col("p_size") > 10, "/Users/u/Downloads/").otherwise("/Users/u/Documents/")
    return table(spark, folder, "part").select(
        F.concat(place, F.replace("p_name", F.lit(" "), F.lit("-")), F.lit("-"), F.col("p_partkey").cast("string"), suffix).alias("path"),
        (F.col("p_size").cast("long") * 1048576).alias("size_bytes"),
        F.lit(False).alias("is_symlink"),
        F.lit(False).alias("denied"),
    )


@query("storage_installer_residue", sql="""
    SELECT suffix, count(*) AS files, CAST(sum(p_size) AS BIGINT) * 1048576 AS size_bytes
    FROM (SELECT p_size, CASE p_type WHEN 'ECONOMY' THEN 'dmg' WHEN 'SMALL' THEN 'pkg' WHEN 'LARGE' THEN 'exe' WHEN 'PROMO' THEN 'msi' END AS suffix
          FROM part WHERE p_size > 10) WHERE suffix IS NOT NULL GROUP BY suffix""")
def _(spark, folder):
    return storage.installer_residue(downloads(spark, folder))


@query("storage_duplicate_apps", sql="""
    WITH apps AS (SELECT DISTINCT p_name, '/Applications/' || upper(p_name) || ' ' || p_size || '.app' AS path, p_size * 1024 AS size_kb FROM part)
    SELECT p_name AS app, count(*) AS installs, CAST(sum(size_kb) AS BIGINT) AS size_kb, min(path) AS first_path FROM apps
    GROUP BY p_name HAVING count(*) > 1""")
def _(spark, folder):
    apps = table(spark, folder, "part").select(
        F.concat(F.lit("/Applications/"), F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit(".app")).alias("path"),
        (F.col("p_size").cast("long") * 1024).alias("size_kb"),
    )
    return storage.duplicate_apps(apps)


@query("storage_grants", "grants", sql="SELECT mode, path FROM grants")
def _(spark, folder):
    return storage.grants(derived.tier_items(spark, folder), derived.fs_entry(spark, folder))


@query("storage_audit_actions", "grants", "action_requests", sql="""
    WITH marked AS (
        SELECT r.*, CASE WHEN r.mode = 'shred' THEN 'rejected' WHEN g.path IS NULL THEN 'not granted'
                         WHEN r.place NOT LIKE '/A%' AND r.place NOT LIKE '/EUROPE/%' THEN 'outside roots' END AS stop
        FROM action_requests r LEFT JOIN grants g ON r.mode = g.mode AND r.place = g.path),
    firsts AS (SELECT *, min(pos) FILTER (stop IS NOT NULL) OVER (PARTITION BY request_id) AS first FROM marked)
    SELECT request_id, pos, path, CASE WHEN stop = 'rejected' THEN 'rejected' WHEN first IS NULL OR pos < first THEN 'done'
        WHEN pos = first THEN stop ELSE 'not reached' END AS outcome FROM firsts""")
def _(spark, folder):
    # The audit looks grants up twice and they are few against the listing they are derived from.
    allowed = written(storage.grants(derived.tier_items(spark, folder), derived.fs_entry(spark, folder)), "grants")
    roots = ("/AFRICA", "/AMERICA", "/ASIA", "/EUROPE")
    return storage.audit_actions(derived.action_requests(spark, folder), allowed, roots=roots).drop("mode")


@query("storage_real_paths", "real_places", sql="SELECT DISTINCT path, real, closed FROM real_places")
def _(spark, folder):
    return real_paths(derived.linked_paths(spark, folder), derived.links(spark, folder))


def linked_items(spark, folder):
    """Report items whose paths lead through links."""
    through = F.concat(F.lit("/links/c"), F.col("c_custkey"))
    tier = F.when(F.col("c_nationkey") < 10, "green").when(F.col("c_nationkey") < 18, "yellow").otherwise("red")
    order = F.concat(through, F.lit("/o"), F.col("c_custkey"))
    return derived.customer_dirs(spark, folder).select(
        tier.alias("tier"), through.alias("path"),
        F.when(tier != "red", F.array(order, F.concat(through, F.lit("/tmp")))).alias("trash_paths"),
        F.when(tier == "red", F.array(through, order)).alias("app_paths"),
    )


LINKED_GRANTS = """(
    SELECT DISTINCT unnest(CASE WHEN c_nationkey < 10 THEN ['rm', 'trash', 'open'] ELSE ['trash', 'open'] END) AS mode, path
    FROM (SELECT c_nationkey, unnest([dir || '/o' || n, dir || '/tmp']) AS path
          FROM link_ends JOIN customer ON c_custkey = n WHERE c_nationkey < 18)
    UNION
    SELECT 'open', path FROM (
        SELECT unnest(CASE WHEN c_nationkey < 18 THEN [dir] ELSE [dir, dir || '/o' || n] END) AS path
        FROM link_ends JOIN customer ON c_custkey = n WHERE c_nationkey >= 10) WHERE path IN (SELECT dir FROM all_dirs))"""


@query("storage_grants_linked", "link_ends", "all_dirs", sql=f"SELECT mode, path FROM {LINKED_GRANTS}")
def _(spark, folder):
    return storage.grants(
        linked_items(spark, folder), derived.fs_entry(spark, folder), links=derived.links(spark, folder)
    )


@query("storage_audit_linked", "link_ends", "all_dirs", sql=f"""
    WITH granted AS (SELECT * FROM {LINKED_GRANTS}),
    asked AS (
        SELECT l_orderkey AS request_id, ['rm', 'trash', 'open'][1 + l_orderkey % 3] AS mode,
               l_linenumber * 1000000000000 + l_partkey * 1000000 + l_suppkey AS pos,
               '/hop/n' || (l_partkey % 25) || '/c' || l_partkey || '/o' || l_partkey AS path, dir || '/o' || l_partkey AS place
        FROM lineitem JOIN link_ends ON n = l_partkey),
    marked AS (
        SELECT a.*, CASE WHEN g.path IS NULL THEN 'not granted' WHEN place LIKE '/EUROPE/%' THEN 'outside roots' END AS stop
        FROM asked a LEFT JOIN granted g ON g.mode = a.mode AND g.path = place),
    firsts AS (SELECT *, min(pos) FILTER (stop IS NOT NULL) OVER (PARTITION BY request_id) AS first FROM marked)
    SELECT request_id, pos, path, CASE WHEN first IS NULL OR pos < first THEN 'done'
        WHEN pos = first THEN stop ELSE 'not reached' END AS outcome FROM firsts""")
def _(spark, folder):
    part = F.col("l_partkey")
    links = written(resolved_links(derived.links(spark, folder)), "links")
    known = derived.customer_dirs(spark, folder).select(F.col("c_custkey").alias("l_partkey"))
    asked = table(spark, folder, "lineitem").join(known, "l_partkey").select(
        F.col("l_orderkey").alias("request_id"),
        F.element_at(F.array(F.lit("rm"), F.lit("trash"), F.lit("open")), (F.col("l_orderkey") % 3 + 1).cast("int")).alias("mode"),
        (F.col("l_linenumber") * 1000000000000 + part * 1000000 + F.col("l_suppkey")).alias("pos"),
        F.concat(F.lit("/hop/n"), part % 25, F.lit("/c"), part, F.lit("/o"), part).alias("path"),
    )
    allowed = written(storage.grants(linked_items(spark, folder), derived.fs_entry(spark, folder), links=links), "grants")
    roots = ("/AFRICA", "/AMERICA", "/ASIA", "/MIDDLE EAST")
    return storage.audit_actions(asked, allowed, roots=roots, links=links).drop("mode")


@query("storage_batch_estimate", "tier_items", sql=f"""
    SELECT count(*) AS items, count(*) * 2 AS paths, round(sum({GB.format(strict='')}), 3) AS gb FROM {LABELS}
    WHERE tier = 'green' AND name NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def _(spark, folder):
    done = table(spark, folder, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("name"))
    estimate = storage.batch_estimate(derived.tier_items(spark, folder), done)
    return estimate.withColumn("gb", F.round("gb", 3))


@query("storage_report", "child_sizes", "tier_prefixes", sql=f"""
    SELECT section, count(*) AS rows, CAST(coalesce(sum(size_kb), 0) AS BIGINT) AS size_kb FROM (
        SELECT tier AS section, size_kb FROM {CLASSIFIED} WHERE tier <> 'none'
        UNION ALL (SELECT 'top5', size_kb FROM {CLASSIFIED} ORDER BY size_kb DESC, path LIMIT 5)
        UNION ALL SELECT 'denied', NULL FROM fs_entry WHERE denied
        UNION ALL SELECT 'summary', NULL FROM {DISKS}) GROUP BY section""")
def _(spark, folder):
    tiered = written(classified(spark, folder), "classified")
    sections = storage.report_sections(tiered, derived.fs_entry(spark, folder), disks(spark, folder))
    body = F.from_json("body", "size_kb BIGINT")
    return sections.groupBy("section").agg(
        F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(body.size_kb), F.lit(0)).alias("size_kb")
    )


@query("storage_report_fields", "child_sizes", "tier_prefixes", sql=f"""
    WITH c AS (SELECT DISTINCT tier, path, name, size_kb FROM {CLASSIFIED} WHERE tier <> 'none')
    SELECT tier AS section, path, name, size_kb,
           CASE WHEN tier = 'yellow' THEN 'risk of ' || name END AS risk, CASE WHEN tier = 'red' THEN 'keep ' || name END AS why_keep,
           CASE WHEN tier IN ('green', 'yellow') THEN path || '/tmp' END AS trash_path,
           CASE WHEN tier = 'red' THEN path || '/app' END AS app_path FROM c
    UNION ALL SELECT 'meta', NULL, '2024-01-01 00:00:00', 42, NULL, NULL, NULL, NULL
    UNION ALL SELECT 'system', NULL, 'os of ' || (SELECT count(*) FROM nation), NULL, NULL, NULL, NULL, NULL""")
def _(spark, folder):
    tiered = written(classified(spark, folder).dropDuplicates(["tier", "path", "size_kb"]), "classified")
    name = F.col("name")
    notes = tiered.select(
        "path", F.concat(F.lit("risk of "), name).alias("risk"), F.concat(F.lit("keep "), name).alias("why_keep"),
        F.array(F.concat("path", F.lit("/tmp"))).alias("trash_paths"), F.array(F.concat("path", F.lit("/app"))).alias("app_paths"),
    ).dropDuplicates(["path"])
    scans = table(spark, folder, "nation").agg(F.count(F.lit(1)).cast("string").alias("n")).select(
        F.lit("2024-01-01 00:00:00").alias("generated_at"), F.lit(42.0).alias("scan_seconds"),
        F.struct(F.concat(F.lit("os of "), "n").alias("os")).alias("system"),
    )
    sections = storage.report_sections(tiered, derived.fs_entry(spark, folder), disks(spark, folder), notes=notes, scans=scans)
    read = F.from_json(
        "body", "path STRING, name STRING, size_kb BIGINT, risk STRING, why_keep STRING, trash_paths ARRAY<STRING>,"
        " app_paths ARRAY<STRING>, generated_at STRING, scan_seconds DOUBLE, os STRING",
    )
    rows = sections.filter("section NOT IN ('top5', 'denied', 'summary')").select("section", read.alias("b"))
    return rows.select(
        "section", "b.path", F.coalesce("b.name", "b.generated_at", "b.os").alias("name"),
        F.coalesce("b.size_kb", F.col("b.scan_seconds").cast("long")).alias("size_kb"), "b.risk", "b.why_keep",
        F.get("b.trash_paths", F.lit(0)).alias("trash_path"), F.get("b.app_paths", F.lit(0)).alias("app_path"),
    )
