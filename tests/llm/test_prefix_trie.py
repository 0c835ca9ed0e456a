from __future__ import annotations

import hashlib
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from tidemark.llm import prefix_trie

SCHEMA = "conv_id LONG, turn LONG, role STRING, text STRING, len STRING, pa STRING, path STRING, pos STRING"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def rebuilt(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(ts)] for c, ts in own.items()}

    def first(c):
        return c - c % 20 if c >= 0 else c + -c % 20

    result = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        result[c] = tuple(own.get(first(c), [])[:h] + ts[h:])
    return result


def brute_nodes(rows):
    convs = rebuilt(rows)
    members = {}
    for c, ts in convs.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    children, leaves, saved = ({p: 0 for p in members} for _ in range(3))
    for p, ids in members.items():
        if p:
            children[p[:-1]] += 1
    for p, ids in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(ids) - 1) * len(brute.words(p[-1][1])) if p else 0
    result = []
    for prefix, ids in members.items():
        ends = ",".join(str(c) for c in sorted(ids) if convs[c] == prefix)
        result.append((
            min(ids), len(prefix), min(members[prefix[:-1]]) if prefix else None, len(ids), children[prefix], leaves[prefix], saved[prefix],
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(result, key=str)


def found(spark, rows, batches=2):
    table = spark.createDataFrame([(*r, "x", "y", "z", "p") for r in rows], SCHEMA).repartition(4)
    got = prefix_trie.conversation_trie(table, batches)
    assert got.columns == COLUMNS
    return sorted((tuple(r) for r in got.collect()), key=str)


def forest(prose, count, words="abc"):
    """Conversations over few different turns, so that they share prefixes, end inside others and repeat."""
    rows = []
    for c in range(count):
        long = 70 if c % 40 == 0 else prose.random.randrange(1, 9)
        rows += [(c, t, prose.random.choice(["user", "assistant"]), prose.random.choice(words) * 2 + " x" * (t % 3)) for t in range(long)]
    return rows


@pytest.mark.parametrize("batches", [1, 3])
def test_nodes_equal_brute_force(spark, prose, batches):
    rows = forest(prose, 160)
    long = [r for r in rows if r[0] == 40]
    rows += [(900 + i, t, role, text) for i in range(8) for _, t, role, text in long[: 9 * i + 3]]  # prefixes of one another
    rows += [(1000 + i, t, "user", f"same {t}") for i in range(30) for t in range(4)]
    rows += [(2000 + i, t, "user", f"same {t}" if t < i else f"other {i}") for i in range(20) for t in range(22)]
    assert found(spark, rows, batches) == brute_nodes(rows)


def test_odd_rows(spark, prose):
    """Nulls in every column, ties, repeated rows, empty and long texts, negative ids, families without a first."""
    rows = [(None, 1, "user", "nobody"), (None, None, None, None), (1, None, None, None), (2, None, "user", "first"), (2, 1, None, "b")]
    rows += [(3, 5, "user", "tie b"), (3, 5, "user", "tie a"), (3, 5, "bot", "tie c"), (3, 5, "user", "tie a"), (0, 1, "user", "only one")]
    rows += [(-7, 1, "user", "x y"), (-27, 1, "user", "x y"), (-20, 3, "user", prose(20_000)), (5000, 7, "", ""), (5001, 7, "", "")]
    rows += [(45, t, "u", None) for t in (3, 2, 1)] + [(i, 1, "u", "short") for i in range(60, 80)]
    got = found(spark, rows)
    assert got == brute_nodes(rows)
    assert any(r[1] == 0 and r[2] is None for r in got)


def test_no_conversations(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []


def test_exit_of_paths_that_are_not_in_the_trie(spark, prose):
    """The fat binary search, for paths that part on an edge, at a node, or lie inside the trie."""
    rows = forest(prose, 80, "ab")
    table = spark.createDataFrame([(*r, "x", "y", "z", "p") for r in rows], SCHEMA)
    paths = prefix_trie.sequences(prefix_trie.turns(table).withColumn("part", F.lit(1)).unionByName(
        table.select("conv_id").distinct().selectExpr("conv_id", "0 part", "0L pos", "'' role", "'' text")
    )).dropDuplicates(["pa", "pb"])
    paths = prefix_trie.written(paths, "test")
    inside, outside = paths.filter("conv_id % 2 = 0"), paths.filter("conv_id % 2 = 1")
    trie = prefix_trie.build(inside, 1)
    nodes = {(r.len, r.pa, r.pb) for r in trie.collect()}
    held = {(d, p.pa, p.pb) for r in inside.collect() for d, p in enumerate(r.path)}
    for r in prefix_trie.located(trie, outside, 70).collect():
        names = [(d, p.pa, p.pb) for d, p in enumerate(r.path)]
        assert r.lcp == max(d for d, *_ in names if names[d] in held)
        assert r.a == max(d for d, *_ in names if names[d] in nodes)
        assert (r.v_len is None) == (r.lcp == r.a)
    assert trie.filter("len > 0").select("fat", "fa", "fb").distinct().count() == len(nodes) - 1
