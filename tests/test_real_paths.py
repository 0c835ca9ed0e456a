from __future__ import annotations

import os

from pyspark.sql import functions as F

from tidemark.functions import links as chains
from tidemark.functions import real_paths as real
from tidemark.functions.real_paths import real_paths, resolved_links
from tidemark.operators import governance, storage
from tidemark.session import checkpoint

LINKS = "path STRING, target STRING"


def table(spark, rows):
    return spark.createDataFrame(rows, LINKS)


def found(spark, wanted, links, **more):
    rows = real_paths(spark.createDataFrame([(p,) for p in wanted], "path STRING"), table(spark, links), **more)
    return {r.path: (r.real, r.closed) for r in rows.collect()}


def test_a_file_system_says_the_same(spark, tmp_path):
    """Links to folders, chains, targets with dots, links behind links and circles, against the file system."""
    top = str(tmp_path)
    for folder in ("data/x", "data/deep/er", "apps", "b"):
        (tmp_path / folder).mkdir(parents=True)
    links = [
        ("apps/link", f"{top}/data"), ("apps/up", "../data/deep"), ("data/deep/back", "../../apps"), ("b/one", "two"), ("b/two", "three"),
        ("b/three", "./../data/deep/er/../x"), ("data/x/self", "self"), ("b/ring", "gone/../ring2/y"), ("b/ring2", "ring"),
        ("b/dangling", "nowhere/at/all"), ("data/deep/er/b", "../../../b"), ("b/into", "ring"),
    ]
    for path, target in links:
        os.symlink(target, f"{top}/{path}")
    wanted = [
        "apps/link/x", "apps/up/../x", "apps/up/back/link/deep/er", "b/one", "b/one/.", "b/one/../deep/back/up", "b/two//z/..",
        "apps/up/er/b/one/new", "b/dangling/x", "data/deep/er", "apps/up/er/b/dangling", "not/there/../b/two",
    ]
    got = found(spark, [f"{top}/{p}" for p in wanted], [(f"{top}/{p}", t) for p, t in links])
    assert got == {f"{top}/{p}": (os.path.realpath(f"{top}/{p}"), True) for p in wanted}
    circles = [f"{top}/{p}" for p in ("data/x/self/a", "b/ring", "b/ring2/q", "b/into/q", "apps/up/er/b/ring/z")]
    got = found(spark, circles, [(f"{top}/{p}", t) for p, t in links])
    assert [got[p][1] for p in circles] == [False] * 5
    assert got[circles[4]][0] == f"{top}/b/ring/z"


def test_long_chains_and_long_ways(spark):
    chain = [(f"/c/l{i}", f"l{i + 1}/d{i}") for i in range(300)]
    way = [(f"/w/{i}", f"/w/{i + 1}") for i in range(3)] + [("/w/3/in", "/w/0"), ("/t", None), (None, "/t")]
    got = found(spark, ["/c/l0/x", "/c/l299", "/w/0/in/in/in", "/t", None, "/"], chain + way)
    down = "/".join(f"d{i}" for i in reversed(range(300)))
    assert got == {
        "/c/l0/x": (f"/c/l300/{down}/x", True), "/c/l299": ("/c/l300/d299", True), "/w/0/in/in/in": ("/w/3", True),
        "/t": ("/t", True), "/": ("/", True),
    }


def test_home_and_repeated_links(spark):
    links = [("~/cache", "/big/cache"), ("/home/u/cache", "/big/cache2"), ("/home", "/Users")]
    got = found(spark, ["~/cache/x", "~", "~other/x", "/home/u/y"], [links[0], links[1]], home="/home/u")
    assert got == {
        "~/cache/x": ("/big/cache/x", True), "~": ("/home/u", True), "~other/x": ("/~other/x", True), "/home/u/y": ("/home/u/y", True),
    }
    assert found(spark, ["/home/u"], [links[2]]) == {"/home/u": ("/Users/u", True)}
    assert resolved_links(table(spark, [])).collect() == [] and found(spark, [], links) == {}
    assert found(spark, ["/a/./b"], []) == {"/a/./b": ("/a/b", True)}


def audited(spark, requests, granted, links, **more):
    asked = spark.createDataFrame(requests, "request_id INT, mode STRING, pos INT, path STRING")
    allowed = spark.createDataFrame([("rm", p) for p in granted], "mode STRING, path STRING")
    rows = storage.audit_actions(asked, allowed, links=table(spark, links), **more).collect()
    return {(r.request_id, r.pos): r.outcome for r in rows}


def test_requests_and_grants_meet_at_their_real_places(spark):
    """A folder that is a link, a chain of links, and a grant that leads out of the roots."""
    assert audited(spark, [(1, "rm", 0, "/Applications/link/x")], ["/Data/x"], [("/Applications/link", "/Data")], roots=("/Data",)) == {(1, 0): "done"}
    chain = [("/A/a", "/A/b"), ("/A/b", "/Data/x")]
    assert audited(spark, [(1, "rm", 0, "/A/a")], ["/Data/x"], chain, roots=("/Data",)) == {(1, 0): "done"}
    out = [("/A/a", "/etc/p")]
    assert audited(spark, [(1, "rm", 0, "/A/a"), (1, "rm", 1, "/A/a")], ["/A/a"], out, roots=("/A",)) == {(1, 0): "outside roots", (1, 1): "not reached"}


def test_home_is_a_root_at_its_real_place(spark):
    links = [("/home", "/Users"), ("/Users/u/c", "/elsewhere")]
    asked = [(1, "rm", 0, "~/x"), (2, "rm", 0, "/Users/u/x"), (3, "rm", 0, "~/c/y"), (4, "rm", 0, "/home/u/x/../x")]
    got = audited(spark, asked, ["~/x", "~/c/y"], links, home="/home/u")
    assert got == {(1, 0): "done", (2, 0): "done", (3, 0): "outside roots", (4, 0): "done"}


def test_grants_hold_for_real_paths_that_exist(spark):
    items = spark.createDataFrame(
        [("green", "/l/g", ["/l/g/c"], None), ("yellow", "/l/y", ["/l/y/t"], None), ("yellow", "/l/none", None, None), ("red", "/l/r", None, ["/l/r", "/ring"])],
        "tier STRING, path STRING, trash_paths ARRAY<STRING>, app_paths ARRAY<STRING>",
    )
    listing = spark.createDataFrame([("/data/y/f",), ("/data/r",)], "path STRING")
    got = storage.grants(items, listing, links=table(spark, [("/l", "data"), ("/ring", "ring")]))
    assert {(r.mode, r.path) for r in got.collect()} == {
        ("rm", "/data/g/c"), ("trash", "/data/g/c"), ("open", "/data/g/c"), ("trash", "/data/y/t"), ("open", "/data/y/t"),
        ("open", "/data/y"), ("open", "/data/r"),
    }


def test_link_states_behind_links(spark):
    rows = [
        ("/p/real/a.md", False, None), ("/p/dir", True, "real"), ("/p/b", True, "dir/a.md"), ("/p/c", True, "dir/no.md"), ("/p/d", True, "dir"),
        ("/p/e", True, "/p/e/x"), ("/p/f", True, "b"),
    ]
    files = spark.createDataFrame(rows, "path STRING, is_symlink BOOLEAN, target STRING")
    got = {r.path: (r.target, r.state) for r in governance.symlink_state(files).collect()}
    assert got == {
        "/p/dir": ("/p/real", "valid"), "/p/b": ("/p/dir/a.md", "valid"), "/p/c": ("/p/dir/no.md", "broken"), "/p/d": ("/p/dir", "valid"),
        "/p/e": ("/p/e/x", "broken"), "/p/f": ("/p/b", "valid"),
    }


def test_circles_do_not_prolong_chains(spark, monkeypatch):
    """One long circle and many short chains: as many rounds as the chains need, and two more."""
    kept = []
    monkeypatch.setattr(chains, "checkpoint", lambda df: kept.append(df) or checkpoint(df))
    ring = [(f"r{i}", f"r{(i + 1) % 500}") for i in range(500)]
    edges = spark.createDataFrame([*ring, ("a", "b"), ("b", "c"), ("c", "d"), ("into", "r3")], "key STRING, at STRING")
    found = {r.source: (r.root, r.closed) for r in chains.follow(edges, "key", "at").collect()}
    assert all(found[c] == ("d", True) for c in "abc") and not found["into"][1] and not found["r7"][1]
    assert len(found) == 504 and len(kept) <= 5


def test_a_checkpoint_keeps_no_constraints(spark):
    """They grow in every round of a loop, and planning with them."""
    cut = checkpoint(spark.range(9).filter("id > 3").withColumn("twice", F.col("id") * 2))
    assert cut.count() == 5
    plan = cut._jdf.queryExecution().optimizedPlan()
    assert plan.constraints().isEmpty()


def test_an_audit_follows_the_links_once(spark, monkeypatch):
    """Requests, grants and the home folder share one table of followed links, also one that is handed over."""
    calls = []
    for module in (storage, real):
        monkeypatch.setattr(module, "resolved_links", lambda rows, **more: calls.append(1) or resolved_links(rows, **more), raising=False)
    asked = spark.createDataFrame([(1, "open", 1, "/l/x"), (1, "open", 2, "/l/y")], "request_id INT, mode STRING, pos INT, path STRING")
    allowed = spark.createDataFrame([("open", "/l/x")], "mode STRING, path STRING")
    ways = table(spark, [("/l", "/d")])
    want = {1: "done", 2: "not granted"}
    got = storage.audit_actions(asked, allowed, roots=["/d"], home="/h", links=ways)
    assert {r.pos: r.outcome for r in got.collect()} == want and len(calls) == 1
    got = storage.audit_actions(asked, allowed, roots=["/d"], home="/h", links=checkpoint(resolved_links(ways)))
    assert {r.pos: r.outcome for r in got.collect()} == want and len(calls) == 1
