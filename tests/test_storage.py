from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import paths, sizes
from tidemark.operators import storage

KB, MB = 1024, 1048576
ENTRY = "path STRING, size_bytes BIGINT, is_symlink BOOLEAN, denied BOOLEAN"


def entries(spark, *rows):
    """Rows of ``(path, bytes)`` with an optional ``link`` or ``denied``."""
    flagged = [(r[0], r[1], r[2:] == ("link",), r[2:] == ("denied",)) for r in rows]
    return spark.createDataFrame(flagged, ENTRY)


@pytest.fixture
def listing(spark):
    rows = [
        ("/a/b/one", 51200 * KB), ("/a/c/two", 51200 * KB - 1), ("/a/bc/x/y", 200 * MB), ("/a/file", 60 * MB),
        ("/a/lnk", 900 * MB, "link"), ("/a/b/secret", 900 * MB, "denied"), ("/z", 0, "denied"),
    ] + [(f"/many/d{n:02d}/f", (100 + n // 2) * MB) for n in range(43)]
    return entries(spark, *rows)


@pytest.fixture
def targets(spark):
    rows = [("g", "/a", 51200), ("nested", "/a/b", 0), ("m", "/many", 102400), ("locked", "/z", 51200), ("gone", "/none", 0)]
    return spark.createDataFrame(rows, "group STRING, root STRING, floor_kb BIGINT")


def test_sizes_roll_up_to_every_ancestor(listing):
    got = {r.dir: r.size_bytes for r in storage.dir_sizes(listing).collect()}
    assert got["/a"] == 51200 * KB + 51200 * KB - 1 + 260 * MB
    assert got["/a/b"] == 51200 * KB and got["/a/bc"] == 200 * MB
    assert got["/a"] + got["/many"] == sum(v for k, v in got.items() if k.count("/") == 1)


def test_children_floor_ties_and_limit(listing, targets):
    children = storage.child_sizes(listing, targets)
    got = {(r.group, r.name): (r.size_kb, r.denied) for r in children.collect()}
    assert got["g", "b"] == (51200, False) and ("g", "c") not in got
    assert got["g", "bc"][0] == 200 * KB and got["g", "file"][0] == 60 * KB
    assert ("g", "lnk") not in got and got["nested", "one"] == (51200, False)
    assert got["locked", "(permission denied)"] == (0, True)
    top = [r.name for r in storage.top_children(children.filter("group = 'm'")).orderBy("position").collect()]
    assert len(top) == 40 and top[:3] == ["d42", "d40", "d41"]


def test_dev_caches_keep_list_order_on_ties(spark):
    rows = [(f"/h/{name}/f", 60 * MB) for name in ("z", "b")] + [("/h/small/f", 1), ("/h/big/f", 90 * MB)]
    listed = spark.createDataFrame([(1, "/h/z"), (2, "/h/b"), (3, "/h/small"), (4, "/h/big")], "list_pos INT, path STRING")
    assert [r.name for r in storage.dev_caches(entries(spark, *rows), listed).collect()] == ["big", "z", "b"]


def test_labels(spark):
    kbs = [0.5, 1, 1023, 1024, 1536, 1024**2, 1024**3, 1024**4]
    df = spark.createDataFrame([(float(k),) for k in kbs], "kb DOUBLE").select(sizes.label(F.col("kb")).alias("l"))
    assert [r.l for r in df.collect()] == ["512 B", "1 KB", "1023 KB", "1.0 MB", "1.5 MB", "1.0 GB", "1.0 TB", "1024.0 TB"]


def test_numbers_from_labels(spark):
    texts = ["约 27.8 GB（估算）", "1.5 TB", "900 MB", "512 KB", "", None, "7", "合计约 8.6 gb"]
    df = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n INT, t STRING")
    read = df.select("n", sizes.gigabytes(F.col("t")).alias("v"), sizes.gigabytes(F.col("t"), True).alias("s"))
    rows = [(r.v, r.s) for r in read.orderBy("n").collect()]
    assert [v for v, _ in rows] == [27.8, 1536.0, 900 / 1024, 512.0, 0.0, 0.0, 7.0, 8.6]
    assert rows[3][1] == 512 / 1024**2
    clean = df.select(sizes.without_estimate_note(F.col("t")).alias("c")).first().c
    assert clean == "约 27.8 GB"


def test_rules(spark):
    places = {
        "/u/Library/Caches/x": "green", "/u/Library/Containers/y": "yellow", "/u/Downloads/a.dmg": "green",
        "/u/Downloads/a.zip": "none", "/System/x": "none", "/u/.npm": "green", "/u/.npmrc": "none",
    }
    df = spark.createDataFrame([(p,) for p in places], "path STRING")
    assert {r.path: r.tier for r in storage.classify(df, storage.MAC_RULES).collect()} == places
    windows = spark.createDataFrame([("C:/Users/u/AppData/Local/Temp",), ("C:/Users/u/AppData/Local/App",), ("C:/Windows/AppData/Local/x",)], "path STRING")
    assert [r.tier for r in storage.classify(windows, storage.WINDOWS_RULES).collect()] == ["green", "yellow", "none"]
    prefixes = spark.createDataFrame([("/u", "yellow", 0), ("/u/Library", "red", 0), ("/u", "green", -1)], "prefix STRING, tier STRING, priority INT")
    got = {r.path: r.tier for r in storage.classify_by_prefix(df, prefixes).collect()}
    assert got["/u/Library/Caches/x"] == "red" and got["/u/.npm"] == "yellow" and got["/System/x"] == "none"


def test_tier_stats_clamp(spark):
    classified = spark.createDataFrame([("d", "green", 70), ("d", "red", 50), ("d", "none", 9)], "disk STRING, tier STRING, size_kb BIGINT")
    disks = spark.createDataFrame([("d", 200, 100), ("e", 0, 0)], "disk STRING, total_kb BIGINT, used_kb BIGINT")
    got = {r.disk: r for r in storage.tier_stats(classified, disks).collect()}
    assert (got["d"].other_kb, got["d"].green_pct, got["d"].yellow_kb) == (0, 35.0, 0)
    assert got["e"].other_pct == 0.0
    used = storage.disk_usage(disks.withColumn("used_kb", F.lit(500)), main_disk="e").collect()
    assert [(r.disk, r.used_pct) for r in used] == [("d", 100.0)]


def test_mystery_and_residue_and_duplicates(spark):
    box = "/Containers/0A1B2C3D-0000-1111-2222-333344445555"
    listing = entries(spark, (f"{box}/Data/com.vendor.app/x", 60 * MB), (f"{box}/Data/other", 1), ("/Downloads/x.dmg", 5), ("/Downloads/y.PKG", 6), ("/Docs/z.dmg", 7))
    owners = spark.createDataFrame([("com.vendor.app", "App")], "bundle_id STRING, owner STRING")
    (row,) = storage.mystery_dirs(listing, owners).collect()
    assert (row.path, row.owner, row.size_kb) == (box, "App", 60 * KB)
    assert {r.suffix: r.size_bytes for r in storage.installer_residue(listing).collect()} == {"dmg": 5, "pkg": 6}
    apps = spark.createDataFrame([("/Applications/Foo 2.app", 1), ("/u/foo.app", 2), ("/Applications/Bar.app", 3)], "path STRING, size_kb BIGINT")
    assert [(r.app, r.installs, r.size_kb) for r in storage.duplicate_apps(apps).collect()] == [("foo", 2, 3)]


def test_grants_and_audit(spark):
    items = spark.createDataFrame(
        [("green", "/u/g", ["/u/g/c"], None), ("yellow", "/u/y", ["/u/y/t"], None), ("yellow", "/u/absent", None, None),
         ("red", "/u/r", None, ["/Applications/R.app", "/Applications/No.app"])],
        "tier STRING, path STRING, trash_paths ARRAY<STRING>, app_paths ARRAY<STRING>",
    )
    listing = entries(spark, ("/u/y/f", 1), ("/Applications/R.app/bin", 1))
    granted = storage.grants(items, listing)
    got = {(r.mode, r.path) for r in granted.collect()}
    assert got == {
        ("rm", "/u/g/c"), ("trash", "/u/g/c"), ("open", "/u/g/c"), ("trash", "/u/y/t"), ("open", "/u/y/t"), ("open", "/u/y"),
        ("open", "/Applications/R.app"),
    }
    good, bad = "/u/g/c", "/u/x"
    requests = spark.createDataFrame(
        [(1, "rm", [good, good]), (2, "rm", [bad, good]), (3, "rm", [good, bad, good]), (4, "rm", [good, bad]),
         (5, "burn", [good]), (6, "open", ["/Applications/R.app"]), (7, "rm", ["/u/y/t"])],
        "request_id INT, mode STRING, paths ARRAY<STRING>",
    )
    audit = storage.audit_actions(storage.request_paths(requests), granted, roots=("/u",))
    outcome: dict[int, list[str]] = {}
    for r in audit.orderBy("request_id", "pos").collect():
        outcome.setdefault(r.request_id, []).append(r.outcome)
    assert outcome == {
        1: ["done", "done"], 2: ["not granted", "not reached"], 3: ["done", "not granted", "not reached"], 4: ["done", "not granted"],
        5: ["rejected"], 6: ["outside roots"], 7: ["not granted"],
    }


def test_normalised_paths(spark):
    given = ["/a/./b/../c", "/../x", "/a//b/", "/"]
    df = spark.createDataFrame([(p,) for p in given], "p STRING").select(paths.normalised(F.col("p")).alias("n"))
    assert [r.n for r in df.collect()] == ["/a/c", "/x", "/a/b", "/"]


def test_equal_rows_stay_and_the_stricter_tier_wins(spark):
    children = spark.createDataFrame([("/a/b", 1), ("/a/b", 1), ("/z", 2), (None, 3)], "path STRING, size_kb INT")
    prefixes = spark.createDataFrame([("/a", "green", 1), ("/a", "red", 1), ("/a", "yellow", 1)], "prefix STRING, tier STRING, priority INT")
    got = sorted((r.path or "", r.size_kb, r.tier) for r in storage.classify_by_prefix(children, prefixes).collect())
    assert got == [("", 3, "none"), ("/a/b", 1, "red"), ("/a/b", 1, "red"), ("/z", 2, "none")]


def test_shipped_rules(spark):
    places = {
        "/Applications/X.app": "red", "/Users/u/Library/Caches/x": "green", "/System/x": "none", "/Users/u/Downloads/a.pkg": "green",
        "D:/games/x": "yellow", "C:/Program Files (x86)/App": "red", "C:/hiberfil.sys": "none", "C:/Windows/WinSxS": "none",
        "C:/Users/u/AppData/Local/Temp/x": "green", "D:/pagefile.sys": "none",
    }
    rows = spark.createDataFrame([(p, True) for p in places] + [("/Applications/Y.app", False)], "path STRING, again BOOLEAN")
    rules = storage.MAC_RULES + storage.WINDOWS_RULES
    got = {r.path: r.tier for r in storage.classify(rows, rules, flagged=F.col("again")).collect()}
    assert got == {**places, "/Applications/Y.app": "none"}
    assert {r.tier for r in storage.classify(rows.filter("path LIKE '/App%'"), rules).collect()} == {"none"}


def test_actions_compare_resolved_paths(spark):
    granted = spark.createDataFrame([("rm", "~/cache/./x"), ("open", "/Applications/x")], "mode STRING, path STRING")
    asked = spark.createDataFrame(
        [(1, "open", 0, "/Applications/./x"), (1, "open", 1, "/Applications/../Applications/x"), (2, "rm", 0, "/home/u/cache/x"),
         (3, "rm", 0, "/Applications/x/../../home/u/cache/x"), (4, "open", 0, "/Applications/x/../../etc"), (5, "open", 0, "/Applications/link")],
        "request_id INT, mode STRING, pos INT, path STRING",
    )
    links = spark.createDataFrame([("/Applications/link", "x")], "path STRING, target STRING")
    got = {(r.request_id, r.pos): r.outcome for r in storage.audit_actions(asked, granted, home="/home/u", links=links).collect()}
    assert got == {(1, 0): "done", (1, 1): "done", (2, 0): "done", (3, 0): "done", (4, 0): "not granted", (5, 0): "done"}


def test_listing_is_read_once(spark, tmp_path):
    rows = [("/r/a/x", 200 << 20, False, False), ("/r/f", 300 << 20, False, False), ("/q", 0, False, True), ("/r/a/y", 1 << 40, True, False)]
    spark.createDataFrame(rows, "path STRING, size_bytes LONG, is_symlink BOOLEAN, denied BOOLEAN").write.parquet(f"{tmp_path}/l")
    listing = spark.read.parquet(f"{tmp_path}/l")
    targets = spark.createDataFrame([("home", "/r", 51200), ("home", "/q", 51200), ("all", "/r/a", 51200)], "group STRING, root STRING, floor_kb LONG")
    sized = storage.child_sizes(listing, targets)
    got = sorted((r.group, r.path, r.size_kb, r.denied) for r in sized.collect())
    assert got == [("all", "/r/a/x", 204800, False), ("home", "/q", 0, True), ("home", "/r/a", 204800, False), ("home", "/r/f", 307200, False)]
    plan = storage.child_sizes(listing, targets)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan parquet") == 1
