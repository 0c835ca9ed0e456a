from __future__ import annotations

import zlib

from tidemark.llm import sharding

SCHEMA = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, shard STRING"


def shards_of(rows, count):
    found = {}
    for r in rows:
        found.setdefault(r.shard, []).append(r)
    assert set(found) <= set(range(count))
    for own in found.values():
        assert sorted(r.slot for r in own) == list(range(len(own)))
    return found


def test_even_bytes_and_gapless_slots(spark, prose):
    docs = [(i, prose(prose.random.randrange(1, 40)), "en de fr".split()[i % 3], f"s{i % 7}", None, "x") for i in range(3000)]
    rows = sharding.shard(spark.createDataFrame(docs, SCHEMA).repartition(5), 8).collect()
    texts = {d[0]: d[1].encode() for d in docs}
    assert len(rows) == len(docs)
    for r in rows:
        assert r.size == len(texts[r.doc_id]) + 16 and r.text_crc32 == zlib.crc32(texts[r.doc_id])
    sizes = [sum(r.size for r in own) for own in shards_of(rows, 8).values()]
    assert len(sizes) == 8 and max(sizes) <= 1.02 * sum(sizes) / 8


def test_equal_texts_stay_together_unless_they_are_too_many(spark, prose):
    hot, pair = prose(30), prose(25)
    docs = [(i, hot if i % 3 == 0 else prose(30), "en", "s", 1, "x") for i in range(3000)] + [(5000 + i, pair, "en" if i else "de", f"s{i}", i, None) for i in range(5)]
    rows = sharding.shard(spark.createDataFrame(docs, SCHEMA), 10).collect()
    found = shards_of(rows, 10)
    sizes = [sum(r.size for r in own) for own in found.values()]
    assert max(sizes) <= 1.05 * sum(sizes) / 10
    assert len({r.shard for r in rows if r.doc_id >= 5000}) == 1


def test_odd_rows(spark):
    docs = [(1, None, None, None, None, None), (1, None, None, None, None, None), (2, "", "en", "a", 0, "x"), (None, "t", "en", "b", 1, "x"), (9, "é" * 50_000, "fr", None, 3, "x")]
    rows = sharding.shard(spark.createDataFrame(docs, SCHEMA), 40).collect()
    assert len(rows) == 5 and sorted(r.size for r in rows) == [16, 16, 16, 17, 100_016]
    shards_of(rows, 40)
    assert sharding.shard(spark.createDataFrame([], SCHEMA), 4).collect() == []
    bare = spark.createDataFrame([(i, "a b c") for i in range(50)], "doc_id LONG, text STRING")
    assert len(shards_of(sharding.shard(bare, 5).collect(), 5)) == 5


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = sharding.shard(docs, 40).collect()
    sizes = [sum(r.size for r in own) for own in shards_of(rows, 40).values()]
    assert len(sizes) == 40 and max(sizes) <= 1.06 * sum(sizes) / 40


def test_the_tree_is_the_plain_one(spark, prose):
    """Every node is cut along its widest dimension at the weighted median of its rows, found here by sorting them."""
    docs = [(3 * i, prose(prose.random.randrange(1, 60)), "en de fr es".split()[i % 4], f"s{i % 9}", None, "x") for i in range(900)]
    docs += [(9000 + i, "same", "en", "s1", None, "x") for i in range(40)]
    points, dimensions, target = sharding._points(spark.createDataFrame(docs, SCHEMA).repartition(3), 13)
    tree = sharding.build_tree(points, dimensions, 13, target)
    nodes = [(tree, [r.asDict() for r in points.collect()])]
    leaves = 0
    while nodes:
        node, rows = nodes.pop()
        if node.left is None:
            assert node.shards == 1
            leaves += 1
            continue
        span = {d: max(r[d] >> 39 for r in rows) - min(r[d] >> 39 for r in rows) for d in dimensions}
        assert span[node.dimension] == max(span.values())
        left = [r for r in rows if r[node.dimension] <= node.cut]
        wanted = sum(r["size"] for r in rows) * node.left.shards / node.shards
        keys, weight = {}, 0
        for r in rows:
            keys[r[node.dimension]] = keys.get(r[node.dimension], 0) + r["size"]
        reached = [0] + [weight := weight + keys[k] for k in sorted(keys)]
        nearest = min(abs(w - wanted) for w in reached)
        assert abs(sum(r["size"] for r in left) - wanted) <= nearest + target * sharding.EXACT
        nodes += [(node.left, left), (node.right, [r for r in rows if r[node.dimension] > node.cut])]
    assert leaves == 13
